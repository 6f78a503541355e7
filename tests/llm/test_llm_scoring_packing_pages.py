import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_rows import SCHEMA, document, odd_rows, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from volpanel.llm import factor_classifier as C
from volpanel.llm import lm_score as L
from volpanel.llm import packing as P
from volpanel.llm import wrapper_extract as X
from volpanel.llm.common import vocabulary

# --- language model ---------------------------------------------------------------------------------------------------


def test_a_level_is_coded_in_slices():
    rng = np.random.default_rng(5)
    values = np.sort(rng.integers(0, 1 << 48, 3 * L.SLICE + 5).astype(np.uint64))
    tracemalloc.start()
    coded = L.EliasFano.build(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # A number for each bit would take 8 * 30 bytes.
    assert peak < 150 * len(values)
    places = np.r_[0 : len(values) : 97, L.SLICE - 1, L.SLICE, len(values) - 1]
    assert (coded.values(places) == values[places]).all() and (coded.find(values[places]) >= 0).all()
    assert (L.EliasFano.build(np.arange(20, dtype=np.uint64)).values(np.arange(20)) == np.arange(20)).all() and L.EliasFano.build(values[:0]).n == 0


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def remainder(doc_id, folds):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def base_rows(rows):
    count = Counter()
    for r in rows:
        if remainder(r[0], 7) != 2:
            count.update([*words(r[1]), None])
    total = sum(count.values())
    out = []
    for r in rows:
        tokens = [*words(r[1]), None]
        base = sum(math.log10((count[t] + 1) / (total + len(count) + 1)) for t in tokens)
        out.append((r[0], remainder(r[0], 7) == 2, len(tokens), sum(count[t] > 0 for t in tokens), total, round(base, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_counts_and_base_score(odd, crowded, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    for df in (odd, crowded):
        rows = L.score(df).collect()
        assert sorted(((*r[:5], round(r.base_score, 6)) for r in rows), key=str) == base_rows(odd_rows())
        assert all(r.score < 0 and math.isfinite(r.score) for r in rows)


def test_pieces_of_a_long_text_score_like_the_whole(odd, monkeypatch):
    whole = sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in L.score(odd).collect())
    monkeypatch.setattr(L, "PIECE", 3000)
    assert sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in L.score(odd).collect()) == whole


def test_model_beats_the_base_on_held_out_text(spark, none):
    phrase = ["the river runs to the sea", "a stone in the river", "the sea is deep and cold", "cold stone under the deep sea"]
    rows = [document(i, ". ".join(phrase[(i * k + k) % 4] for k in range(1, 12))) for i in range(120)]
    got = L.score(spark.createDataFrame(rows, SCHEMA)).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > 0.7 * got.b
    assert L.score(none).count() == 0


def test_a_passage_seen_once_is_known(spark):
    ids = [i for i in range(200) if remainder(i, 7) != 2][:40]
    quoting, mixed = [i for i in range(200) if remainder(i, 7) == 2][:2]
    seen = [prose(700 + i, 200).split() for i in ids]
    passage = seen[5][40:100]
    rows = [document(i, " ".join(w)) for i, w in zip(ids, seen)]
    rows += [document(quoting, " ".join(passage)), document(mixed, " ".join(np.random.default_rng(1).permutation(passage)))]
    got = {r.doc_id: r for r in L.score(spark.createDataFrame(rows, SCHEMA)).where("held_out").collect()}
    assert abs(got[quoting].base_score - got[mixed].base_score) < 1e-6
    assert got[quoting].score > got[mixed].score + 0.5 * len(passage)


def plain_scores(rows):
    """The smoothed model from dictionaries of words, without codes."""
    train = [[*words(r[1]), None] for r in rows if remainder(r[0], 7) != 2]
    one, two, three = Counter(), Counter(), Counter()
    for tokens in train:
        told = ["start", *tokens]
        one.update(tokens)
        two.update(zip(told, told[1:]))
        three.update(zip(told, told[1:], told[2:]))
    total = sum(one.values())

    def sums(grams):
        tokens, kinds = Counter(), Counter()
        for gram, n in grams.items():
            tokens[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        return tokens, kinds

    of = {2: sums(two), 3: sums(three)}

    def p(context, word):
        if not context:
            return (one[word] + 1) / (total + len(one) + 1)
        grams, (tokens, kinds) = (two, three)[len(context) - 1], of[len(context) + 1]
        lower = p(context[1:], word)
        n = tokens[context]
        return max(grams[(*context, word)] - L.DISCOUNT, 0) / n + L.DISCOUNT * kinds[context] / n * lower if n else lower

    out = {}
    for r in rows:
        told = ["start", *words(r[1]), None]
        out[r[0]] = sum(math.log10(p(tuple(told[max(0, i - 2) : i]), told[i])) for i in range(1, len(told))), len(told) - 1
    contexts = {c[:-1] for c in three}
    for c in list(contexts)[:50]:
        assert abs(sum(p(c, w) for w in one) + L.DISCOUNT * of[3][1][c] / of[3][0][c] * (1 - sum(p(c[1:], w) for w in one)) - 1) < 1e-9
    return out, total


@pytest.mark.parametrize("share", [1 / 4096, 1.0])
def test_scores_against_dictionaries(spark, monkeypatch, share):
    """With and without split contexts, in blocks that share words; every token's figures are within the code's steps."""
    monkeypatch.setattr(L, "HOT_SHARE", share)
    monkeypatch.setattr(L, "BLOCK", 900)
    rows = [document(i, prose(i % 40, 30 + i % 50) + " the same end of it") for i in range(120)] + [document(500, ""), document(501, "of it"), document(502, "Zzz unseen words")]
    want, tokens = plain_scores(rows)
    step = L.step_of(tokens)
    for r in L.score(spark.createDataFrame(rows, SCHEMA)).collect():
        score, n = want[r.doc_id]
        assert r.n_tokens == n and abs(r.score - score) <= n * 1.5 / step + 1e-6


@pytest.mark.parametrize("tokens", [1, 1000, 10**9, 10**14])
def test_codes_cover_the_least_probability(tokens):
    step = L.step_of(tokens)
    p = np.r_[(1 - L.DISCOUNT) / tokens, L.DISCOUNT / tokens, np.logspace(np.log10((1 - L.DISCOUNT) / tokens), 0, 50)]
    assert (np.abs(np.log10(L.decode(L.code(p, step), 0.0, step) / p)) <= 0.5 / step + 1e-9).all()


def test_word_totals_have_64_bits():
    totals = np.array([5_000_000_000, 1, 0, (1 << 62) + 3], "<i8")
    assert np.array_equal(L._spread(L._squeeze(totals), "<i8"), totals)


def test_figures_take_less_than_deflated_and_come_back():
    ranks = np.random.default_rng(5).geometric(0.02, 100_000).astype("<u4")
    data = L._squeeze(ranks)
    planes = np.ascontiguousarray(ranks.view(np.uint8).reshape(-1, 4).T)
    assert len(data) < len(zlib.compress(planes.tobytes(), 1))
    for kind in (np.uint8, "<u4", "<u8", "<i8"):
        for values in (ranks.astype(kind), np.empty(0, kind)):
            assert np.array_equal(L._spread(L._squeeze(values), kind), values)


@pytest.mark.parametrize("tops", [(50, 9), (1 << 48, 1 << 48), (1 << 64, 1 << 64), (1 << 64, 2), (3, 1 << 64), (1, 1)])
def test_pairs_are_put_in_order(tops):
    r = np.random.default_rng(8)
    a, b = (r.choice(r.integers(0, top, 300, np.uint64, endpoint=False) if top < 1 << 64 else r.integers(0, top - 1, 300, np.uint64, endpoint=True), 4000) for top in tops)
    b[:2000] ^= r.integers(0, 2, 2000).astype(np.uint64)
    found, want = L.pair_order(a, b), np.lexsort((b, a))
    assert sorted(found.tolist()) == list(range(4000))
    assert np.array_equal(a[found], a[want]) and np.array_equal(b[found], b[want])
    assert not len(L.pair_order(a[:0], b[:0]))


def test_probabilities_sum_to_one():
    """Discounted probabilities and the weight of the lower order, as the level stores them."""
    contexts, sizes = np.array([3, 9], np.uint64), np.array([2, 1])
    level = L.Level.build(contexts, sizes, np.array([5, 7, 5], np.uint64), np.array([0.25, 0.4, 0.9]), np.array([0.35, 0.1]))
    codes, weights, ranks = level.find(np.array([3, 3, 9, 9, 4], np.uint64), np.array([5, 7, 5, 7, 5], np.uint64))
    assert (codes > 0).tolist() == [True, True, True, False, False] and (weights > 0).tolist() == [True, True, True, True, False]
    assert ranks[:3].tolist() == [0, 1, 0]
    assert np.allclose(L.decode(codes, 0.0)[:3], [0.25, 0.4, 0.9], rtol=0.04)


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1, 1 << 47), (500, 700), (3000, 1 << 48), (2000, 2000)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    code = L.EliasFano.build(values)
    assert np.array_equal(code.values(np.arange(n)), values)
    wanted = np.r_[values, rng.integers(0, top + 5, 300, dtype=np.uint64), np.uint64(0), np.uint64(top + 1000)].astype(np.uint64)
    assert np.array_equal(code.successor(wanted), np.searchsorted(values, wanted))


def test_level_maps_back_from_a_file(tmp_path):
    rng = np.random.default_rng(1)
    contexts = np.unique(rng.integers(0, 1 << 48, 300, dtype=np.uint64))
    sizes = rng.integers(0, 6, len(contexts))
    symbols = np.concatenate([np.sort(rng.choice(1000, s, replace=False)) for s in sizes]).astype(np.uint64)
    level = L.Level.build(contexts, sizes, symbols, rng.random(len(symbols)), rng.random(len(contexts)))
    (tmp_path / "level").write_bytes(level.to_bytes())
    again = L.Level.open(str(tmp_path / "level"))
    asked = np.repeat(contexts, sizes), symbols
    assert all(np.array_equal(a, b) for a, b in zip(level.find(*asked), again.find(*asked)))
    assert (level.find(*asked)[0] > 0).all()


# --- packing ----------------------------------------------------------------------------------------------------------


def test_pieces_cover_every_document_and_sequences_are_gapless(odd, crowded, none):
    tokenizer = Tokenizer.from_file(vocabulary())
    ids = {}
    for r in odd_rows():
        if r[0] is not None and r[0] not in (15, 16):
            ids[r[0]] = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
    for df in (odd, crowded):
        out = P.pack(df, vocabulary()).toPandas()
        assert out.groupby("sequence_id").length.sum().max() <= 2048
        for _, s in out.sort_values("offset").groupby("sequence_id"):
            assert s.offset.tolist() == np.r_[0, s.length.cumsum()[:-1]].tolist()
        for doc_id, want in ids.items():
            own = out[out.doc_id == doc_id].sort_values("start")
            assert own.start.tolist() == np.r_[0, own.length.cumsum()[:-1]].tolist() and own.length.sum() == len(want)
            assert (own.doc_tokens == len(want)).all()
            for s, n, crc in zip(own.start, own.length, own.ids_crc32):
                assert zlib.crc32(np.array(want[s : s + n], "<u4").tobytes()) == crc
        assert out.doc_id.isna().sum() == 2
    assert P.pack(none, vocabulary()).count() == 0


def test_kept_words_give_the_tokenizers_ids():
    tokenizer, own = Tokenizer.from_file(vocabulary()), P.encoder(vocabulary())
    texts = [prose(i, 200) for i in range(5)] + [
        "It's they'll 12 3.5 <|endoftext|> x", "Ünïcode ÀÉŸ İI ŉ µª² \u00a0 nbsp", "e\u0301 combining", "\x0b \x0c \x1c", "don''t #*$%&| ...", "日本語 テスト", "ſ long s", "a<|b",
        "tab\there\r\nnew", "",
    ]
    for t in texts:
        assert own(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_patterns_give_each_length_its_slots():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 3000):
        histogram = dict(Counter(rng.integers(1, 257, n).tolist()))
        plan = P.plan_patterns(histogram, 256)
        given = Counter()
        for pattern, count in plan:
            assert sum(s * k for s, k in pattern.items()) <= 256
            for s, k in pattern.items():
                given[s] += k * count
        assert given == Counter(histogram)
        if n > 1000:
            least = sum(s * k for s, k in histogram.items()) / 256
            assert sum(c for _, c in plan) < 1.02 * least + 2


# --- classifier -------------------------------------------------------------------------------------------------------


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    machine = C.Machine.empty(3)
    at, value = np.array([2, 9, 40, 77]), rng.normal(size=4)
    machine.linear[at], machine.factors[at] = rng.normal(size=4), rng.normal(size=(4, 3))
    pairs = sum(machine.factors[at[i]].dot(machine.factors[at[j]]) * value[i] * value[j] for i in range(4) for j in range(i))
    assert abs(machine.margin(at, value) - (machine.linear[at].dot(value) + pairs)) < 1e-5


def test_scores_tell_junk_from_prose(spark):
    rows, labels = [], []
    for i in range(300):
        junk = i % 3 == 0
        rows.append(document(i, " ".join(f"{w}###" for w in prose(i, 60).split()) if junk else prose(i, 60)))
        labels.append((i, 0 if junk else 1))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    out = C.score(docs, marks).join(marks, "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.held_out == [remainder(i, 5) == 0 for i in held.doc_id]).all()
    assert (held.predicted == held.quality).mean() > 0.95 and out.score.between(0, 1).all()


def test_classifier_on_odd_rows(spark, odd, crowded, none):
    marks = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (5, None), (14, 0), (14, 0), (99, 1)], "doc_id long, quality int")
    for df in (odd, crowded):
        rows = C.score(df, marks).collect()
        assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert C.score(none, marks).count() == 0
    assert {r.score for r in C.score(odd, marks.limit(0)).collect()} == {0.5}


# --- pages ------------------------------------------------------------------------------------------------------------

ARTICLE = (
    "<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style></head><body><header><h2>Site</h2></header><nav><ul><li><a href=x>One</a></li><li><a>Two</a></li></ul></nav>"
    "<div class='cookie-notice'>We use cookies</div><article><h1>Head &amp; line {i}</h1><p>First <b>bold</b> {i}<br>next<p>Second&nbsp;para &#x41;</p>{more}"
    "<div class=\"ad\">Buy</div><section id='comments'><p>Nice!</p></section></article><aside>Side</aside><form><p>Mail</p><input></form><script>var t = '</p>';</script><footer>&copy; me</footer></body></html>"
)


def test_article_text(spark):
    more = ["", "<ul><li>item a<li>item b</ul>", "<p>Third</p><blockquote>Quote</blockquote>"]
    pages = [(i, f"http://h{i % 2}.org/{i}", ARTICLE.format(i=i, more=more[i % 3])) for i in range(9)]
    want = {i: f"Head & line {i}\nFirst bold {i} next\nSecond para A" + ["", "\nitem a\nitem b", "\nThird\nQuote"][i % 3] for i in range(9)}
    odd_pages = [
        (100, None, None), (101, "http://h0.org/", ""), (102, "http://h0.org/x", "plain & simple"), (103, "http://z.org/1", "<div>" * 400 + "deep" + "</div>" * 400),
        (104, "http://h1.org/cut", ARTICLE.format(i=7, more="")[:560]), (105, "http://z.org/2", "<p>a<!-- <p>no</p> --> b <script>never ends"),
    ]
    df = spark.createDataFrame(pages + odd_pages + pages[:1], "page_id long, url string, html string").withColumn("host", F.lit("clash")).repartition(3)
    rows = X.main_text(df).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == len(pages) + len(odd_pages) + 1
    assert {i: got[i] for i in want} == want
    assert got[100] == "" and got[101] == "" and got[102] == "plain & simple" and got[103] == "deep" and got[105] == "a b"
    assert got[104].startswith("Head & line 7\nFirst bold 7")
    assert all(r.n_chars == len(r.text) for r in rows)
    assert X.main_text(df.limit(0)).count() == 0


def test_without_an_article_slots_that_differ_are_text():
    pages = [f"<body><div class=top>Same words</div><div><p>Story {i} here</p><p>More {i}</p></div><a href=x>Link {i}</a></body>" for i in range(5)]
    wrapper = X.skeleton(X.parse(pages[0]))
    for p in pages[1:]:
        wrapper = X.align(wrapper, X.skeleton(X.parse(p)))
    assert [X.extract(p, wrapper) for p in pages] == [f"Story {i} here\nMore {i}" for i in range(5)]


def test_alignment_finds_optional_and_repeated_parts():
    a = X.skeleton(X.parse("<div><h1>x</h1><p>a</p></div>"))
    b = X.skeleton(X.parse("<div><h1>y</h1><p>a</p><p>b</p><hr><ul><li>1</li><li>2</li></ul></div>"))
    parts = {p.key: p for p in X.align(a, b).parts[0].parts}
    assert parts["p"].repeated and not parts["p"].optional and parts["ul"].optional and parts["ul"].parts[0].repeated
    dl = X.skeleton(X.parse("<dl><dt>a</dt><dd>1</dd><dt>b</dt><dd>2</dd><dt>c</dt><dd>3</dd></dl>")).parts[0]
    assert [(p.key, p.repeated) for p in dl.parts] == [("dt", True), ("dd", True)]


def wrapped(pages):
    """The wrapper of pages of one host."""
    wrapper = X.skeleton(X.parse(pages[0]))
    for p in pages[1:]:
        wrapper = X.align(wrapper, X.skeleton(X.parse(p)))
    return wrapper


def test_no_block_of_a_mixed_article_is_lost():
    kinds = {"p": "<p>{}</p>", "ul": "<ul><li>{}</li></ul>", "blockquote": "<blockquote>{}</blockquote>", "h2": "<h2>{}</h2>"}
    rng = np.random.default_rng(3)
    orders = [["p", "ul", "p"], ["ul", "p", "ul"], *([str(k) for k in rng.choice(list(kinds), rng.integers(1, 12))] for _ in range(25))]
    want = [[f"{kind} {i} {k}" for k, kind in enumerate(order)] for i, order in enumerate(orders)]
    inner = ["".join(kinds[kind].format(t) for kind, t in zip(order, told)) for order, told in zip(orders, want)]
    for page in ("<body><nav>Menu</nav><article>{}</article></body>", "<body><nav>Menu</nav><div>{}</div></body>"):
        pages = [page.format(x) for x in inner]
        for some in (pages[:2], pages):
            wrapper = wrapped(some)
            assert [X.extract(p, wrapper).split("\n") for p in some] == want[: len(some)]


def test_copies_of_a_page_agree_as_one_page():
    page = "<body><h1>Title</h1><div>Only story</div></body>"
    assert X.extract(page, wrapped([page] * 5)) == "Title\nOnly story"


def test_without_an_article_links_in_sentences_stay():
    pages = [
        f"<body><ul><li><a>Menu {i}</a><li><a>One</a> | <a>Two</a></ul><p>Story {i} by <a href=x>Editor</a>, <b>again</b> <a>{i}</a>.</p><div>Same <b>words</b></div></body>"
        for i in range(5)
    ]
    wrapper = wrapped(pages)
    assert [X.extract(p, wrapper) for p in pages] == [f"Story {i} by Editor, again {i}." for i in range(5)]


def test_deep_elements_keep_blocks_and_marks():
    deep = "<div>" * 5000 + "<nav>Menu</nav><p>One {0}</p><p>Two {0}</p><div class=ad>Buy</div>" + "</div>" * 5000 + "<p>Last {0}</p>"
    for page in ("<body><article>" + deep + "</article></body>", "<body>" + deep + "</body>"):
        pages = [page.format(i) for i in range(4)]
        wrapper = X._loads(X._merge([X._dumps(wrapped(pages[:2])), X._dumps(wrapped(pages[2:]))]))
        assert [X.extract(p, wrapper) for p in pages] == [f"One {i}\nTwo {i}\nLast {i}" for i in range(4)]
