import re
from collections import Counter

import pytest
from llm_rows import SCHEMA, document, odd_rows, prose
from pyspark.sql import functions as F

from volpanel.llm import mixing as M
from volpanel.llm import quality_rules as Q
from volpanel.llm import url_filter as U
from volpanel.llm.queries import LISTED_WORDS

RULES = (U.Rule("allow", "com"), U.Rule("block", "example.com", "/en/"), U.Rule("allow", "www.example.com", "/en/"), U.Rule("block", "net", "/es/"))


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        len(re.findall("[A-Z]", text)), len(lines),
    )


@pytest.mark.parametrize("row", odd_rows(), ids=lambda r: str(r[0]))
def test_measures(row):
    assert Q.measure_text(row[1]) == brute_measures(row[1])


def test_measures_of_repeats():
    for text in ("a b c d e f a b c d e g", "x " * 9, "a b c d e a b c d e", "p q r s t p q r s", "1 2 3 4 5 1 2 3 4 5 1 2 3 4"):
        assert Q.measure_text(text) == brute_measures(text)


def test_every_row_is_judged(odd, crowded, none):
    for df in (odd, crowded):
        rows = Q.judge(df).collect()
        assert len(rows) == len(odd_rows())
        for r in rows:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert not (r.base_failed and r.kept)
        kept = Q.keep_documents(df)
        assert kept.columns == df.columns and kept.count() == sum(r.kept for r in rows)
    assert Q.judge(none).count() == 0 and Q.keep_documents(none).count() == 0


def test_junk_goes_and_clean_stays(spark):
    clean = [document(i, prose(i, 120), "en", f"s{i % 2}") for i in range(40)]
    junk = [document(100 + i, " ".join(w + "###" for w in prose(i, 80).split()), "en", f"s{i % 2}") for i in range(8)]
    kept = {r.doc_id for r in Q.keep_documents(spark.createDataFrame(clean + junk, SCHEMA)).collect()}
    assert kept == set(range(40))


def test_texts_are_measured_once_a_pass(odd, monkeypatch):
    """Filters that move down to the scan must not bring a second measuring, which takes a second Python worker for each task."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    staged, real = {}, Q.stage

    def told(df, label):
        staged[label] = plan(df).count("ArrowEvalPython"), df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        return real(df, label)

    monkeypatch.setattr(Q, "stage", told)
    assert plan(Q.keep_documents(odd)).count("ArrowEvalPython") == 1
    assert staged["quality-sketch"] == (1, "1000")


def test_junk_heavy_and_single_document_groups_are_bounded_by_coarser_ones(spark):
    junk = lambda i: " ".join(w + "###" for w in prose(i, 80).split())
    rows = [document(i, prose(i, 120), "en", "good") for i in range(40)]
    rows += [document(100 + i, junk(i), "en", "mostly junk") for i in range(3)] + [document(110 + i, prose(50 + i, 120), "en", "mostly junk") for i in range(2)]
    rows += [document(120, junk(9), "en", "alone"), document(121, junk(10), "de", "alone"), document(122, junk(11), None, None), document(123, prose(60, 120), "de", "fine")]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {*range(40), 110, 111, 123}
    assert {r.doc_id for r in Q.keep_documents(docs).collect()} == want
    assert {r.doc_id for r in Q.judge(docs).where("kept").collect()} == want


def test_sketches_merge_and_bound_quantiles(spark, odd):
    measured = odd.select("lang", "source", Q.measures("text").alias("m"))
    m = F.col("m")
    whole = Q.sketches(measured, m)
    halves = [Q.sketches(measured.where(c), m) for c in (F.col("m.n_words") % 2 == 0, F.col("m.n_words") % 2 == 1)]
    assert sorted(map(str, Q.merge_sketches(*halves).collect())) == sorted(map(str, whole.collect()))
    values = sorted(0.5 + i for i in range(1, 200))
    rows = spark.createDataFrame([("en", "a", (int(v * 10), 10, 0, 0, 0, 0, 1)) for v in values], "lang string, source string, m struct<n_symbols: long, n_words: long, word_chars: long, n_dup_lines: long, n_repeat_words: long, n_capitals: long, n_lines: long>")
    ratio = (Q.Ratio("symbols", "n_symbols", "n_words", reach=1.0),)
    cut = Q.thresholds(Q.sketches(rows, F.col("m"), ratio), ratio).first()["cut_symbols"]
    q50, q75 = values[int(0.5 * 199)], values[int(0.75 * 199)]
    assert abs(cut - (2 * q75 - q50)) < 0.05 * cut


def test_sources_have_cut_offs_of_their_own(spark):
    """Texts half symbols are clean in one source, texts a quarter symbols are junk in another: no fixed cut-off is right for both."""
    marked = lambda i, n, k: " ".join(w + "#" * (j % k == 0) for j, w in enumerate(prose(i, n).split()))
    rows = [document(i, prose(i, 100 + i % 40), "en", ("news", "blog")[i % 2]) for i in range(400)]
    rows += [document(1000 + i, marked(i, 80 + i % 40, 2), "en", "code") for i in range(200)]
    junk = [document(2000 + i, marked(i, 100, 4), "en", "news") for i in range(8)]
    docs = spark.createDataFrame(rows + junk, SCHEMA)
    assert {r.doc_id for r in Q.keep_documents(docs).collect()} == {r[0] for r in rows}
    told = Q.judge(docs)
    assert {r.doc_id for r in told.where("kept").collect()} == {r[0] for r in rows}
    assert told.where("doc_id >= 2000").agg(F.max(F.col("n_symbols") / F.col("n_words"))).first()[0] < 0.3
    measured = docs.select("lang", "source", Q.measures("text").alias("m"))
    cuts = {r.source: r.cut_symbols for r in Q.thresholds(Q.sketches(measured, F.col("m"))).collect()}
    assert cuts["news"] == 0 and cuts["code"] > 0.4


def brute_cuts(rows, ratio):
    """Cut-offs from sorted lists in fractions, without buckets."""
    from fractions import Fraction as Fr

    own, tongue = {}, {}
    for lang, source, x in rows:
        own.setdefault((lang, source), []).append(x)
        tongue.setdefault(lang, []).append(x)
    weight = lambda n: min(Fr(1, 2), Fr(n, n + Q.PRIOR))
    every, out = [x for *_, x in rows], {}
    for (lang, source), mine in own.items():
        a, b = weight(len(mine)), weight(len(tongue[lang]))
        parts = ((a, mine), ((1 - a) * b, tongue[lang]), ((1 - a) * (1 - b), every))
        mix = sorted((x, w / len(xs)) for w, xs in parts for x in xs)

        def quantile(q):
            upto = Fr(0)
            for x, w in mix:
                upto += w
                if upto >= q:
                    return x

        out[lang, source] = quantile(Fr(3, 4)) + ratio.reach * (quantile(Fr(3, 4)) - quantile(Fr(1, 2)))
    return out


def test_cut_offs_against_sorted_lists(spark):
    import random

    dice = random.Random(5)
    places = [("en", "a", 307, 1.0), ("en", "b", 41, 2.0), ("de", "a", 7, 0.5), (None, None, 90, 3.0), (None, "a", 151, 0.7), ("de", None, 1, 9.0)]
    rows = [(lang, source, round(dice.lognormvariate(0, 0.4) * at, 3)) for lang, source, n, at in places for _ in range(n)]
    kinds = "lang string, source string, m struct<n_symbols: long, n_words: long, word_chars: long, n_dup_lines: long, n_repeat_words: long, n_capitals: long, n_lines: long>"
    frame = spark.createDataFrame([(lang, source, (round(x * 1000), 1000, 0, 0, 0, 0, 0)) for lang, source, x in rows], kinds)
    ratio = Q.Ratio("symbols", "n_symbols", "n_words", reach=2.0)
    want = brute_cuts(rows, ratio)
    got = {(r.lang, r.source): r.cut_symbols for r in Q.thresholds(Q.sketches(frame, F.col("m"), (ratio,)), (ratio,)).collect()}
    assert got.keys() == want.keys()
    for k, cut in want.items():
        assert abs(got[k] - cut) < 0.06 * cut


def brute_url(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    plain = re.sub(r"^(www|m)\.", "", host) + re.sub(r"(/|\.html)$", "", path) if host else ""
    on = plain != "" and plain in listed
    return host, path, best.key if best else None, best.action if best else "block" if on else "allow", on


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "http://Example.COM/en/x?q=1", "https://www.example.com/en/", "http://a.www.example.com/en/y#t", "http://example.com/EN/x",
        "http://example.com", "http://x.net/es/1.html", "http://net/es/", "http://es.net/e", "http://bad.org/p/", "http://www.bad.org/p.html?x", "http://notexample.com/en/a",
        "ftp://m.bad.org/p", "http://bad.org/p/q", "http://a://b.com/c", "http://" + "a." * 200 + "com/" + "b/" * 300, "http://x.net/es/1.html", "HTTP://X.NET/fr/",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("key", F.lit(1))
    listed = spark.createDataFrame([("bad.org/p",), ("elsewhere.org/z",), (None,), ("",)], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.listed) for r in U.judge(pages, RULES, listed).collect()}
    assert got == {i: brute_url(u, {"bad.org/p", "elsewhere.org/z"}) for i, u in enumerate(urls)}
    assert U.judge(pages.limit(0), RULES, listed).count() == 0
    assert {r.verdict for r in U.judge(pages, (), listed.limit(0)).collect()} == {"allow"}


def test_listed_hosts_have_whole_words_of_every_category(spark):
    bad = ["www.cheap-pills.example.com", "casino-win.com", "m.free-bets.org", "ads-track.net", "spam-farm.example.org", "M.Adult-X.example.net", "ads.example.org:80"]
    good = ["alphabets.org", "roads-x.net", "m.downloads-here.org", "adulthood.net", "spamalot.org", "casinos.net"]
    pages = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(bad + good)], "page_id long, url string")
    listed = U.listed_by_host(pages, LISTED_WORDS)
    got = {r.page_id: (r.listed, r.verdict) for r in U.judge(pages, (), listed).collect()}
    assert got == {i: (True, "block") if i < len(bad) else (False, "allow") for i in range(len(bad + good))}


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    probe = U.may_hold(spark, U.build_filter(keys))
    assert keys.where(~probe(F.xxhash64("key"))).count() == 0
    others = spark.range(20000).select(F.concat(F.lit("other"), "id").alias("key"))
    assert others.where(probe(F.xxhash64("key"))).count() < 200


def test_rules_are_checked(spark):
    with pytest.raises(ValueError):
        U.rule_table(spark, [U.Rule("allow", "com"), U.Rule("block", "com")])
    with pytest.raises(ValueError):
        U.rule_table(spark, [U.Rule("allow", "com", "/x")])


def test_mix_meets_its_margins(spark):
    rows = [document(i, prose(i, 30 + i % 50), ["en", "de", "fr"][(i * 7 % 10) // 4], f"s{min(3, i % 9)}") for i in range(900)]
    mix = M.Mix(keep=0.4, exponents=(0.8, 0.9, 1.0), sweeps=12)
    weighed = M.weigh(spark.createDataFrame(rows, SCHEMA), mix)
    w = weighed.toPandas()
    assert w.probability.between(0, 1).all() and len(w) == 900
    for column, exponent in (("source", 0.8), ("lang", 0.9)):
        has = w.groupby(column).n_tokens.sum()
        want = 0.4 * has.sum() * has**exponent / (has**exponent).sum()
        expected = (w.n_tokens * w.probability).groupby(w[column]).sum()
        assert (abs(expected / want - 1) < 0.02).all()
    assert abs(w.kept.mean() - 0.4) < 0.08


def test_a_margin_reads_its_cells_twice(spark, monkeypatch):
    plans, keep = [], M.stage
    monkeypatch.setattr(M, "stage", lambda df, label="stage": plans.append(df._jdf.queryExecution().analyzed().collectLeaves().size()) or keep(df, label))
    rows = [document(i, prose(i, 20), ["en", "de"][i % 2], f"s{i % 3}") for i in range(60)]
    assert M.sample(spark.createDataFrame(rows, SCHEMA)).count() > 0
    assert max(plans) <= 3


def test_sample_keeps_what_weigh_says(odd, crowded, none):
    for df in (odd, crowded):
        kept = M.sample(df)
        assert kept.columns == df.columns
        assert kept.count() == M.weigh(df).where("kept").count()
    assert M.weigh(odd).count() == len(odd_rows())
    assert M.weigh(none).count() == 0 and M.sample(none).count() == 0
