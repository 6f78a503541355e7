import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from volpanel.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")


def damage(rows):
    told = lambda x: " " if x is None else str(x)
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        role, text = told(role), told(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        visible = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """Every sequence of edits with at most three insertions in a row: (cost, letters, repaired rows)."""
    best = None
    for inserted in itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
        if 2 * sum(map(len, inserted)) > (best[0] if best else 3 * len(rows)):
            continue
        for edits in itertools.product("DKua", repeat=len(rows)):
            cost = 2 * sum(map(len, inserted))
            initials, letters, made = "", "", []
            for add, edit, row, kind in zip(inserted, edits, rows, kinds):
                letters += "I" * len(add)
                initials += add
                made += [({"u": "user", "a": "assistant"}[x], "") for x in add]
                if edit == "D":
                    cost, letters = cost + 3, letters + "D"
                    continue
                if kind in ("blank", "duplicate"):
                    break
                cost += kind == "truncated"
                if edit == "K":
                    letters += "K"
                    initials += row[2][:1] or "?"
                    made.append((row[2], row[3]))
                else:
                    cost, letters, initials = cost + 2, letters + "R", initials + edit
                    made.append(({"u": "user", "a": "assistant"}[edit], row[3]))
            else:
                letters += "I" * len(inserted[-1])
                initials += inserted[-1]
                made += [({"u": "user", "a": "assistant"}[x], "") for x in inserted[-1]]
                if PATTERN.fullmatch(initials) and (best is None or (cost, letters) < best[:2]):
                    best = (cost, letters, made)
    return best


def expected(conv, rows, search):
    rows = in_order(rows)
    kinds = faults(rows)
    turns = [r[1] for r in rows if r[1] is not None]
    cost, audit, made = search(rows, kinds) if rows else (0, "", [])
    return {
        "conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{k: kinds.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
    }


def told(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0))


def some_rows(n, seed, most=5):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, most)):
            text = rng.choice(["Yes.", "No", "", " \t", "Why?\n ", "Good!", "ends é", None])
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), rng.choice(["user", "assistant", "system", "tool", "", None]), text))
    return rows


def test_codes_and_costs_equal_all_edit_sequences(spark):
    rows = some_rows(50, 5, 4)
    rows += [(None, 0, "user", "A."), (None, None, "assistant", "B"), (700, 1, "user", "x."), (700, 1, "user", "x."), (700, 1, "assistant", "y.")]
    ids = {r[0] for r in rows}
    after = damage(rows)
    want = [expected(i, [r for r in after if r[0] == i], cheapest) for i in sorted(ids, key=lambda x: (x is None, x or 0))]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for block in (256, 2):
        assert told(R.report(R.damaged(frame), frame, block)) == want


def test_all_rows_dropped_and_empty_table(spark):
    gone = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(*gone, "user", "a.")], SCHEMA)
    out = told(R.report(R.damaged(frame), frame))
    assert out == [expected(gone[0], [], cheapest)]
    none = spark.createDataFrame([], SCHEMA)
    assert R.report(R.damaged(none), none).count() == 0


def plain_search(rows, kinds):
    """Cheapest edits by dynamic programming over (cost, letters) pairs, without weights and blocks."""
    nodes = {R.START: (0, "")}
    for row, kind in zip([*rows, None], [*kinds, None]):
        for _ in range(3):
            for state, (cost, letters) in list(nodes.items()):
                for x in "ua":
                    to = R.NEXT.get((state, x))
                    if to is not None and (cost + 2, letters + "I") < nodes.get(to, (1 << 60, "")):
                        nodes[to] = (cost + 2, letters + "I")
        if row is None:
            return min(nodes[s] for s in R.ENDS if s in nodes)
        after = {}
        for state, (cost, letters) in nodes.items():
            moves = [(cost + 3, letters + "D", state)]
            if kind not in ("blank", "duplicate"):
                late = kind == "truncated"
                moves += [(cost + late, letters + "K", R.NEXT.get((state, row[2][:1])))]
                moves += [(cost + late + 2, letters + "R", R.NEXT.get((state, x))) for x in "ua"]
            for c, l, to in moves:
                if to is not None and (c, l) < after.get(to, (1 << 60, "")):
                    after[to] = (c, l)
        nodes = after


def test_long_conversation_in_blocks(spark):
    rng = random.Random(1)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["A.", "B", "C!", "", "long " * 9]) + str(rng.randrange(400)) + rng.choice(".!x")) for t in range(1500)]
    rows += [(2, t, ("user", "assistant")[t % 2], f"t{t}.") for t in range(700)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = {r["conv_id"]: r for r in told(R.report(frame, frame))}
    for conv in (1, 2):
        own = in_order([r for r in rows if r[0] == conv])
        kinds = faults(own)
        assert (out[conv]["cost"], out[conv]["audit"]) == plain_search(own, kinds)
        assert [out[conv][k] for k in ("blank", "duplicate", "truncated")] == [kinds.count(k) for k in ("blank", "duplicate", "truncated")]


def test_repaired_rows_follow_the_pattern_and_the_digest(spark):
    frame = spark.createDataFrame(some_rows(80, 9, 9), SCHEMA)
    rows = R.ordered(R.damaged(frame))
    decided = R.plans(rows, 3)
    made = {}
    for r in R.repaired_rows(rows, decided, 3).orderBy("conv_id", "position").collect():
        made.setdefault(r.conv_id, []).append(r)
    digest = {r.conv_id: r.repaired_sha256 for r in R.repaired_digests(rows, decided, 3).collect()}
    assert digest
    for conv, text in digest.items():
        own = made.get(conv, [])
        assert [r.position for r in own] == list(range(len(own)))
        assert PATTERN.fullmatch("".join(r.role[:1] for r in own))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == text


def test_other_columns_and_types(spark):
    rows = [(f"c{c}", t, r, x) for c, t, r, x in some_rows(20, 3)]
    frame = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    for name in ("ord", "block", "id", "kind", "code", "fault", "digest", "copy", "cost"):
        frame = frame.withColumn(name, F.lit(1))
    out = R.report(R.damaged(frame), frame)
    assert out.count() == 20 and dict(out.dtypes)["conv_id"] == "string"


@pytest.mark.parametrize("codes", ["su", "ususau", "xaAx-", "_sSuUaA", "aaaauuuu"])
def test_blocks_put_together_equal_one_block(codes):
    whole = R.decide([R.solve(codes, True, True)])
    for cut in range(1, len(codes)):
        assert R.decide([R.solve(codes[:cut], True, False), R.solve(codes[cut:], False, True)]) == whole
    assert R.decide([R.solve(c, i == 0, i == len(codes) - 1) for i, c in enumerate(codes)]) == whole
