import random
import re

import pandas as pd
import pytest
from llm_rows import SCHEMA, document, odd_rows, prose

from volpanel.llm import ngram_join as N


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs of rows."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same_id = rows[i][0] == rows[j][0] and rows[i][0] is not None
            linked = a and b and None not in (rows[i][0], rows[j][0]) and 100 * len(a & b) >= 80 * len(a | b)
            if linked or (same_id and a and b):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        if r[0] is None or not sets[i]:
            out.append((r[0], len(sets[i]), r[0]))
        else:
            out.append((r[0], len(sets[i]), min(rows[j][0] for j in range(len(rows)) if find(j) == find(i) and sets[j])))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in N.classes(df).collect()), key=str)


def test_odd_rows_against_all_pairs(odd, crowded):
    want = brute(odd_rows())
    assert got(odd) == want
    assert got(crowded) == want


def test_empty_table(none):
    assert N.classes(none).count() == 0 and N.keep_one(none).count() == 0


@pytest.mark.parametrize("seed", [1])
def test_chains_and_dense_groups(spark, seed):
    """Copies with several edits each: many pairs lie just under and just over the threshold."""
    rng = random.Random(seed)
    rows, at = [], 0
    for group in range(4):
        base = prose(100 * seed + group, rng.choice([8, 40, 120])).split()
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(30)}"
            rows.append(document(at, " ".join(own)))
            at += rng.choice([1, 3])
    chain = prose(7 * seed, 60).split()
    for i in range(20):
        rows.append(document(at + i, " ".join(chain[i:] + [f"tail{j}" for j in range(i)])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == brute(rows)


def test_one_of_each_class_stays(odd, crowded):
    rows = odd_rows()
    stay = {c for i, _, c in brute(rows) if i is not None}
    for df in (odd, crowded):
        left = N.keep_one(df)
        assert left.columns == df.columns
        ids = [r.doc_id for r in left.collect()]
        assert sorted(i for i in ids if i is not None) == sorted(stay)
        assert ids.count(None) == 2


def test_contraction_of_a_long_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    found = {r.node: r.component for r in N.components(links).collect()}
    assert all(found[i] == 0 for i in range(n + 1)) and found[1001] == 1000


def test_stars_around_leaders_take_one_round(spark, monkeypatch):
    labels, keep = [], N.stage
    monkeypatch.setattr(N, "stage", lambda df, label="stage": labels.append(label) or keep(df, label))
    links = spark.createDataFrame([(5000 * k + 77, 5000 * k + i) for k in range(2) for i in range(1500)], "a long, b long")
    found = {r.node: r.component for r in N.components(links).collect()}
    assert found == {5000 * k + i: 5000 * k for k in range(2) for i in range(1500)}
    assert labels.count("parents") == 1


def test_no_plan_of_the_join_is_long(spark, monkeypatch):
    plans, keep = [], N.stage
    monkeypatch.setattr(N, "stage", lambda df, label="stage": plans.append(df._jdf.queryExecution().analyzed().collectLeaves().size()) or keep(df, label))
    rows = [document(i, prose(900 + i % 3, 200, 5000) + f" w{i}") for i in range(12)]
    assert len({r.component_id for r in N.classes(spark.createDataFrame(rows, SCHEMA)).collect()}) == 3
    assert max(plans) <= 9


def test_several_texts_of_an_id_have_their_own_shingles(spark):
    two, three = prose(801, 300, 5000), prose(802, 300, 5000)
    rows = [document(1, two + " " + prose(803, 55, 5000)), document(1, three + " " + prose(804, 55, 5000)), document(2, two), document(3, three)]
    got = {(r.doc_id, r.component_id) for r in N.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_a_first_look_holds_no_whole_sets():
    texts = pd.Series([" ".join(f"w{i}" for i in range(2000)), None, "a b"])
    found = N.first_look.func(texts)
    assert found["n"].tolist() == [1996, 0, 1] and all(x.base is None for x in found["low"])
    assert len(found["low"][0]) == (N.shingles(texts[0]) < int(-(1 << 63) + N.FIRST_LOOK * (1 << 64))).sum()
