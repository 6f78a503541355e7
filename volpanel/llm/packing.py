"""Documents packed into sequences of one length by cutting-stock column generation.

Every document is encoded once and cut into full pieces, each a sequence of its own, and one rest. The rests' lengths, rounded up to
cells of ``CELL`` tokens, form a histogram of at most ``capacity / CELL`` bins, which is all that the driver sees. There a linear program over
patterns (how many rests of each bin one sequence takes) is solved by the revised simplex method; each new pattern comes from
a knapsack by dynamic programming over the current prices of the bins. Pattern counts are rounded down and the few remaining rests are
packed largest first, which gives every bin an exact number of slots. Spark then ranks the rests of each bin and
the rank names the slot, so all pieces are placed without any of them passing through the driver.

Ranks come in two steps, within (bin, share of the ids) and over the shares' counts, so a length that a third of all documents have
is ranked by many tasks.

Defined cases: a NULL or empty text is the end id alone; a document longer than ``capacity`` has several pieces; repeated rows are packed as
often as they occur; rows with a NULL id are packed with that id; an empty table gives an empty table.
"""

from __future__ import annotations

import warnings
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from volpanel.llm.common import partitions
from volpanel.llm.encoding import encoder
from volpanel.session import stage

CAPACITY, CELL, END_ID = 2048, 8, 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
ROWS_AT_ONCE = 50_000


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows ``PIECE``: full pieces and rests of every document."""
    end = np.array([END_ID], "<u4").tobytes()
    step = 4 * capacity

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = encoder(vocabulary)
        rows: list[tuple] = []
        for part in parts:
            for doc_id, ids in zip(part["doc_id"], ids_of.each(text or "" for text in part["text"])):
                ids += end
                n = len(ids) // 4
                for at in range(0, len(ids), step):
                    own = ids[at : at + step]
                    rows.append((doc_id, at // 4, len(own) // 4, zlib.crc32(own), n))
                if len(rows) >= ROWS_AT_ONCE:
                    yield frame(rows)
                    rows = []
        yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return out.astype({"doc_id": "Int64", "start": "int64", "length": "int64", "ids_crc32": "int64", "doc_tokens": "int64"})

    # A NULL among the ids would turn the batch's ids into floating point; as text they stay exact.
    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return source.mapInPandas(lambda parts: cut(p.assign(doc_id=[None if x is None else int(x) for x in p["doc_id"]]) for p in parts), PIECE)


def best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Knapsack with repetition: the dearest pattern that fits into ``room`` cells, and its worth."""
    price = np.full(room, -np.inf)  # by size, so that each step reads two slices
    price[sizes - 1] = prices
    worth, taken = np.zeros(room + 1), np.full(room + 1, -1)
    for space in range(1, room + 1):
        gain = worth[space - 1 :: -1][:space] + price[:space] if space < room else worth[room - 1 :: -1] + price
        best = int(gain.argmax())
        worth[space], taken[space] = (gain[best], best + 1) if gain[best] > worth[space - 1] else (worth[space - 1], -1)
    number = {int(size): i for i, size in enumerate(sizes)}
    pattern, space = np.zeros(len(sizes)), room
    while space > 0:
        if taken[space] < 0:
            space -= 1
        else:
            pattern[number[int(taken[space])]] += 1
            space -= int(taken[space])
    return worth[room], pattern


def generate_columns(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and their amounts in an optimal solution of the linear program.

    The first basis has one pattern for each bin. Amounts and prices follow from the basis inverse, which each pivot updates. Every pivot is a feasible
    basis, so stopping at the round limit, far above what the sizes here need, would cost padding and never a document; it is told as a warning.
    """
    m = len(sizes)
    columns = np.diag((room // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(columns))
    amounts = inverse @ demand
    for _ in range(40 * m):
        prices = inverse.sum(axis=0)
        worth, pattern = best_pattern(prices, sizes, room)
        if worth <= 1 + 1e-7:
            break
        direction = inverse @ pattern
        allowed = direction > 1e-9
        ratio = np.where(allowed, amounts / np.where(allowed, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        columns[:, out] = pattern
        step = ratio[out]
        amounts = np.maximum(amounts - step * direction, 0)
        amounts[out] = step
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
    else:
        warnings.warn(f"the linear program of {m} bins was stopped after {40 * m} pivots", stacklevel=2)
    return [(columns[:, j], amounts[j]) for j in range(m) if amounts[j] > 1e-9]


def plan_patterns(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """(pattern as bin -> times, how many sequences) that together give every bin exactly its number of slots."""
    sizes = np.array(sorted(histogram), int)
    left = np.array([histogram[int(s)] for s in sizes], int)
    plan: list[tuple[np.ndarray, int]] = []
    for pattern, amount in generate_columns(sizes, left.astype(float), room) if len(sizes) else ():
        # Rounding down keeps within the demand but for the last digits of a floating point number.
        used = pattern > 0
        count = min(int(amount + 1e-6), int((left[used] // pattern[used].astype(int)).min()))
        if count > 0:
            plan.append((pattern.astype(int), count))
            left = left - count * pattern.astype(int)
    while left.any():
        pattern, space = np.zeros(len(sizes), int), room
        for i in range(len(sizes) - 1, -1, -1):
            pattern[i] = min(left[i], space // sizes[i])
            space -= pattern[i] * sizes[i]
        count = int((left[pattern > 0] // pattern[pattern > 0]).min())
        plan.append((pattern, count))
        left = left - count * pattern
    return [({int(s): int(k) for s, k in zip(sizes, pattern) if k}, count) for pattern, count in plan]


def slot_table(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each bin the rows (first rank, times per sequence, first sequence), by rank."""
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, count in plan:
        for size, times in pattern.items():
            slots[size].append((used[size], times, sequence))
            used[size] += times * count
        sequence += count
    return {size: np.array(rows, np.int64) for size, rows in slots.items()}


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, cell: int = CELL) -> DataFrame:
    """Rows of ``PIECE`` with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    cut = stage(pieces(docs, vocabulary, capacity), "pieces")
    room = capacity // cell
    # A full piece needs no company: its own bin lies above the room of a pattern.
    size = F.when(F.col("length") == capacity, room + 1).otherwise(F.ceil(F.col("length") / cell)).cast("int")
    shares = partitions(spark)
    binned = cut.withColumn("size", size).withColumn("share", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shares)).cast("int"))
    counts = stage(binned.groupBy("size", "share").count(), "piece-counts")
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("count").alias("n")).collect()}
    full = histogram.pop(room + 1, 0)
    slots = slot_table([*plan_patterns(histogram, room), ({room + 1: 1}, full)])

    @F.pandas_udf("long")
    def sequence_of(sizes: pd.Series, ranks: pd.Series) -> pd.Series:
        out, s, r = np.empty(len(sizes), np.int64), sizes.to_numpy(), ranks.to_numpy()
        for own in np.unique(s):
            at = np.flatnonzero(s == own)
            row = slots[int(own)][np.searchsorted(slots[int(own)][:, 0], r[at], side="right") - 1]
            out[at] = row[:, 2] + (r[at] - row[:, 0]) // row[:, 1]
        return pd.Series(out)

    before = Window.partitionBy("size").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "share", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("size", "share").orderBy("doc_id", "start", "ids_crc32")
    ranked = binned.withColumn("within", F.row_number().over(within) - 1).join(offsets, ["size", "share"])
    placed = ranked.withColumn("sequence_id", sequence_of("size", F.col("before") + F.col("within")))
    ahead = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"),
    )
