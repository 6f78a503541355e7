import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from volpanel.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, every=100):
    known = []
    for vec_id, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in e]
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        if sum(x * x for x in v) <= H.LONGEST**2:
            known.append((vec_id, v, label))
    out = []
    last = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for i, (anchor, v, label) in enumerate(known):
        if anchor is None or anchor % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), other, of) for j, (other, w, of) in enumerate(known) if j != i]
        for score, positive, _ in sorted((s for s in scored if s[2] == label), key=last)[:5]:
            hard = sorted((s for s in scored if s[2] != label and 80 * score <= 100 * s[0] <= 100 * score), key=last)[:5]
            out += [(anchor, positive, rank + 1, n[1], score, n[0]) for rank, n in enumerate(hard)]
    return sorted(out, key=repr)


def mined(frame, every=100):
    out = H.mine(frame, H.moved_label(), F.col("id") % every == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def vectors(n, width, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    v = centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, width))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("width", [3, 64, 100])
def test_equals_a_comparison_with_every_row(spark, width, monkeypatch):
    monkeypatch.setattr(H, "CHUNK", 100)
    rng = np.random.default_rng(width)
    rows = [(i, [float(x) for x in v], int(rng.integers(0, 10))) for i, v in enumerate(vectors(500, width, 1))]
    found = mined(spark.createDataFrame(rows, SCHEMA).repartition(3), 20)
    assert found and found == brute_force(rows, 20)


def test_odd_rows(spark):
    v = [[float(x) for x in row] for row in vectors(60, 8, 2)]
    rows = [(i, x, i % 3) for i, x in enumerate(v)]
    rows += [(200 + i, v[0], 1) for i in range(12)] + [(300, v[0], 2)] * 4 + [(None, v[0], 2), (None, v[1], 1), (400, v[5][:3], 1), (401, [], 1), (500, [0.0] * 8, 0)]
    rows += [(600, None, 1), (700, v[1], None), (800, [*v[1][:7], None], 1), (900, [*v[1][:7], float("nan")], 1), (1000, [float("inf"), 1.0], 2), (1100, [3e38, 1.0], 1)]
    rows += [(1200, [1e5, 2e5], 1), (1201, [1.5e5, 1e5], 1), (1202, [1.2e5, 1.1e5], 0), (1203, [-1e5, 0.0], 0)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute_force(rows)
    assert mined(frame) == want
    crowded = frame.select("*", *(F.lit(1).alias(c) for c in ("id", "row", "v", "e", "score", "least", "rank", "slot", "codes")))
    assert mined(crowded) == want


def test_empty_tables_and_few_rows(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(0, [1.0, 2.0], 1)], SCHEMA)) == []
    rows = [(100, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.9, 0.0], 2)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute_force(rows) != []


def chunk(whole):
    words, alignments, rests = H.encode(whole.astype(float))
    n = len(whole)
    return H.Rows(pd.DataFrame({
        "row": np.arange(n), "id": np.arange(n), "label": np.zeros(n, int), "parts": [x.astype("<i4").tobytes() for x in whole],
        "codes": [x.tobytes() for x in words], "alignments": list(alignments), "rests": list(rests), "length": np.sqrt((whole.astype(float) ** 2).sum(axis=1)),
    }))


@pytest.mark.parametrize("scale", [1, 300, 1 << 20])
def test_intervals_hold_and_narrow(scale):
    rng = np.random.default_rng(scale)
    whole = np.floor(scale * rng.normal(size=(3000, 64))).astype(np.int64)
    rows = chunk(whole)
    assert np.allclose(np.linalg.norm(H.rotated(whole), axis=1), rows.length)
    assert (np.diff(rows.rests, axis=0) < 0).all()
    for i, q in enumerate((*whole[:5], np.zeros(64, np.int64), np.full(64, 3 * scale))):
        anchor = H.Anchor(q, H.turns(q[None])[0])
        exact = whole @ q
        for wanted in np.quantile(exact, [0.5, 0.99, 0.999]):
            kept = anchor.survivors(rows, np.arange(3000), wanted)
            assert set(np.flatnonzero(exact >= wanted)) <= set(rows.row[kept])
        kept = anchor.survivors(rows, np.arange(3000), -np.inf, best=5)
        fifth = np.sort(exact)[-5]
        assert set(np.flatnonzero(exact >= fifth)) <= set(rows.row[kept])
        if i < 5 and scale > 1:
            assert len(kept) < 300  # of 3,000
        assert (anchor.scores(rows, kept) == exact[rows.row[kept]]).all()


def test_popcount_estimate_is_the_inner_product_with_the_rounded_anchor():
    rng = np.random.default_rng(7)
    whole = np.floor(256 * rng.normal(size=(50, 128))).astype(np.int64)
    rows, turned = chunk(whole), H.turns(whole[:1])[0]
    for q, own in zip(turned, H.Anchor(whole[0], turned).turned):
        rounded = q.min() + np.rint((q - q.min()) / own.step) * own.step
        signs = np.unpackbits(rows.codes[0].T.copy().view("u1"), axis=1, bitorder="little") * 2.0 - 1
        assert np.allclose(own.against_code(rows.codes[0]), signs @ rounded / np.sqrt(128))
        assert abs(np.linalg.norm(q - rounded) - own.error) < 1e-9
