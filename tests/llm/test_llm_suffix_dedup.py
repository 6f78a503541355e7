import hashlib
import random
from collections import defaultdict
from pathlib import Path

import numpy as np
from llm_rows import SCHEMA, document, odd_rows, prose

from volpanel.llm import suffix_dedup as S
from volpanel.llm.ngram_join import keep_one
from volpanel.session import staging


def brute(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept hash) by a set of all strings so far, documents in order."""
    texts = {(r[0], r[1] or "") for r in rows}
    order = sorted(texts, key=lambda t: (t[0] is not None, t[0] or 0, hashlib.sha256(t[1].encode()).digest()))
    seen, done = set(), {}
    for t in order:
        raw = t[1].encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(int)) == 1))
        done[t] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted(((r[0], *done[(r[0], r[1] or "")]) for r in rows), key=str)


def got(df, length=S.LENGTH):
    return sorted((tuple(r) for r in S.removals(df, length).collect()), key=str)


def test_odd_rows_against_all_strings(odd, crowded):
    want = brute(odd_rows(), S.LENGTH)
    assert sum(r[2] for r in want) > 0
    assert got(odd) == want
    assert got(crowded) == want


def test_empty_table(none):
    assert S.removals(none).count() == 0 and S.cleaned(none).count() == 0


def test_periodic_overlapping_and_shifted_passages(spark):
    rng = random.Random(3)
    pool = [prose(i, 40) for i in range(5)]
    rows = [document(i, "".join(rng.choice([p, p[rng.randrange(60) :], "ab" * rng.randrange(90), "z" * rng.randrange(260)]) for p in rng.choices(pool, k=4))) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(df) == brute(rows, S.LENGTH)


def test_repeated_rows_keep_the_first_occurrence(spark):
    passage = prose(21, 60)
    rows = [document(i, prose(300 + i, 20) + passage[i % 3 : 250 - 20 * i] + prose(400 + i, 20)) for i in range(5)]
    for first in (document(0, rows[0][1]), document(None, rows[0][1])):
        some = [first, first, *rows[1:], rows[3]]
        assert got(spark.createDataFrame(some, SCHEMA).repartition(3)) == brute(some, S.LENGTH)


def test_hot_anchors_by_hash_equal_the_merge(spark, monkeypatch):
    passage = prose(11, 60)
    rows = [document(i, prose(100 + i, 12) + passage[i % 7 :] + prose(200 + i, 12)) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows, S.LENGTH)
    assert got(df) == want
    monkeypatch.setattr(S, "HOT", 2)
    assert got(df) == want


def test_chunks_split_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 700)
    texts = [prose(1, 900).encode(), b"", prose(2, 10).encode(), prose(1, 900).encode()[37:]]
    owner, begin, last, anchor = S.runs(texts)
    strings = defaultdict(set)
    for o, b, e, a in zip(owner, begin, last, anchor):
        for i in range(b, e + 1):
            strings[texts[o][i : i + S.LENGTH]].add(int(a))
    assert all(len(a) == 1 for a in strings.values())
    assert sum(last - begin + 1) == sum(max(0, len(t) - S.LENGTH + 1) for t in texts)


def test_merged_transforms_give_order_and_common_prefixes():
    rng = random.Random(5)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))).encode() for _ in range(24)]
    depth = 6
    shards = [strings[:7], strings[7:9], strings[9:]]
    made = [S.index(s) for s in shards]
    here, interval, common = S.merge_transforms([t for _, t, _ in made], [x for *_, x in made], depth)
    suffixes = []
    for shard, (order, _, _) in zip(shards, made):
        flat = [s[i:] for s in shard for i in range(len(s) + 1)]
        assert [flat[i] for i in order] == sorted(flat)
        suffixes += [flat[i] for i in order]

    def same(a, b):
        return next((j for j in range(min(len(a), len(b), depth)) if a[j] != b[j]), min(len(a), len(b), depth))

    assert common.tolist() == [max(same(a, b) for j, b in enumerate(suffixes) if j != i) for i, a in enumerate(suffixes)]
    merged = [suffixes[i][:depth] for i in here]
    assert merged == sorted(s[:depth] for i, s in enumerate(suffixes) if common[i] == depth)
    assert [interval[i] == interval[i + 1] for i in range(len(merged) - 1)] == [merged[i] == merged[i + 1] for i in range(len(merged) - 1)]


def test_two_symbols_a_round_find_the_same_intervals():
    rng = random.Random(8)
    strings = ["".join(rng.choice("ab\x00") for _ in range(rng.randrange(1, 40))).encode() for _ in range(30)]
    shards = [strings[:11], strings[11:]]
    made = [S.index(s) for s in shards]
    one, two = (S.merge_transforms([t for _, t, _ in made], [x for *_, x in made], 8, step) for step in (1, 2))
    assert one[0].tolist() == two[0].tolist()
    assert (np.diff(one[1]) > 0).tolist() == (np.diff(two[1]) > 0).tolist()
    assert ((one[2] // 2 * 2) == two[2]).all()


def test_four_symbols_a_round_find_the_same_intervals():
    rng = random.Random(8)
    strings = ["".join(rng.choice("ab\x00") for _ in range(rng.randrange(1, 40))).encode() for _ in range(30)]
    made = [S.index(s) for s in (strings[:11], strings[11:])]
    one, four = (S.merge_transforms([t for _, t, _ in made], [x for *_, x in made], 8, step) for step in (1, 4))
    assert one[0].tolist() == four[0].tolist()
    assert (np.diff(one[1]) > 0).tolist() == (np.diff(four[1]) > 0).tolist()
    assert ((one[2] // 4 * 4) == four[2]).all()


def test_suffix_array_is_that_of_sorted_suffixes():
    rng = random.Random(4)
    strings = ["".join(rng.choice("aaab\x00") for _ in range(n)).encode() for n in (0, 1, 7, 8, 9, 16, 17, 150, 151, 151)]
    strings.append(strings[-1])
    order, transform, longer = S.index(strings)
    text = b"".join(s + b"\xff" for s in strings)
    suffixes = [text[i : text.index(b"\xff", i)] for i in range(len(text))]
    assert order.tolist() == sorted(range(len(text)), key=lambda i: (suffixes[i], i))
    assert transform.tolist() == [(text[i - 1] + 1) % 256 for i in order]
    assert order[longer].tolist() == [(i - 1) % len(text) for i in order.tolist()]


def test_pieces_of_long_texts(monkeypatch):
    texts = [prose(i, 200).encode() for i in range(4)]
    whole = S.runs(texts)
    monkeypatch.setattr(S, "CHUNK", 1 << 8)

    def strings(found):
        return {(i, at, h) for i, first, last, h in zip(*(c.tolist() for c in found)) for at in range(first, last + 1)}

    assert strings(S.runs(texts)) == strings(whole)


def test_staged_tables_go_with_the_result(spark, odd):
    """Only the lost bytes and the ids that stay are left in the folder, no texts, contexts, sets or links."""
    with staging(spark) as folder:
        for make in (S.cleaned, S.removals, keep_one):
            make(odd).collect()
        assert {p.name.rsplit("-", 1)[0] for p in Path(folder.removeprefix("file:")).iterdir()} == {"lost", "kept"}


def test_repeated_lists_all_places():
    strings = [b"xxabcdefyy", b"abcdefabcdef", b"zzz"]
    found = {tuple(sorted(map(tuple, g.tolist()))) for g in S.repeated(strings, 6, shard_bytes=8)}
    assert ((0, 2), (1, 0), (1, 6)) in found


def test_cleaned_texts(odd, crowded):
    for df in (odd, crowded):
        out = S.cleaned(df)
        assert out.columns == df.columns and out.count() == df.count()
    sizes = {r[0]: r[1] - r[2] for r in brute(odd_rows(), S.LENGTH) if r[0] not in (None, 15, 16)}
    for r in S.cleaned(odd).collect():
        if r.text is not None and r.doc_id in sizes:
            assert len(r.text.encode()) <= sizes[r.doc_id] and r.n_chars == len(r.text)


def test_halves_of_removed_characters_do_not_meet(spark):
    """The shared string begins in the middle of one character and ends in the middle of another; their kept bytes C5 and A1 would be an s with a caron."""
    shared = "".join(random.Random(9).choices("abcdefghij", k=150))
    rows = [document(1, "first é" + shared + "à last"), document(2, "begin ũ" + shared + "á end")]
    out = {r.doc_id: (r.text, r.n_chars) for r in S.cleaned(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: (rows[0][1], len(rows[0][1])), 2: ("begin  end", 10)}
    raw, gone = "aéb".encode(), np.array([False, False, True, False])
    assert S.whole_characters(raw, gone).tolist() == [False, True, True, False]
    assert not S.whole_characters(raw, np.zeros(4, bool)).any()
