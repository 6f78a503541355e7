"""Hard negatives by rotated one-bit codes, intervals that hold for certain, and whole-number scores of what the intervals leave.

Vectors are whole numbers, floor(``SCALE`` × component). A vector is turned by a fixed rotation (signs and a Hadamard transform, twice), which keeps inner products and spreads a
vector over its coordinates. The signs of the turned vector are its first one-bit code, a unit vector of ± 1/√D; stored beside it is the alignment,
the inner product of code and vector. What the aligned code leaves is turned again and coded the same way, ``CODES`` times, so the vector is
Σ alignment·code + rest, with the rest's length stored after each code.

An anchor's vector, turned as often, is rounded to ``PLANES`` bits a coordinate and kept as bit planes, with the length of its rounding error. Inner products of
codes and planes are population counts, and give an estimate of the score. By Cauchy and Schwarz the estimate is off by no more than
|rest|·|anchor| + Σ alignment·|rounding error|, whatever the data. A row whose interval can't reach what an anchor needs is out after one code,
or two, and so on; the rows left after the last code are scored in whole numbers. Results are therefore those of a comparison with every row.

Anchors are a stated set of queries and meet all rows in blocks: tasks hold ``CHUNK`` rows at a time and stream all anchors past them from their staged files, through ``pyarrow.fs``
at the address of the shared folder. Neither side is broadcast or sent to the driver, and a task gives at most the few best rows per anchor and
chunk. So that this doesn't add up to much either, every search runs over a part of the rows (1 in ``PART``, by hash) first, whose fifth best
scores are what a row has to reach in the search over all rows. Rows are dealt by a number of their own, so equal vectors, labels or ids are spread evenly.

Defined cases: rows without a label or vector, or with a NULL, NaN or infinite component take no part; nor do rows whose whole-number vector is longer than
``LONGEST``, beyond which scores would leave 64 bits; a shorter vector counts as if it ended in zeros, an empty one is zero everywhere; a row without an id takes part as
the last of equal scores and is no anchor; repeated rows count one by one, so a copy of an anchor is another row with the anchor's own id; an
empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window, functions as F

from volpanel.llm.common import partitions, spread_numbers
from volpanel.llm.token_store import place
from volpanel.session import stage

SCALE = 256
CODES, PLANES = 6, 8
POSITIVES, NEGATIVES = 5, 5
#: A negative's score times 100 lies between 80 times the positive's and 100 times it.
LEAST_PERCENT = 80
CHUNK, ANCHORS_AT_ONCE, PART = 1 << 15, 1024, 16
LONGEST = 1 << 28
NO_ID = (1 << 63) - 1  # stands for a NULL id, which comes last
#: Floating point may be off by this share of the lengths' product.
SLACK = 1e-9

INDEX = (
    "row long, id long, label long, parts binary, codes binary, alignments array<double>, rests array<double>, length double"
)


def whole_rows(embeddings: DataFrame, label: Column) -> DataFrame:
    """(id, label, v): rows that take part, vectors as arrays of whole numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    # Told apart before the whole table is read, so that extra columns can't clash.
    told = embeddings.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    known = told.filter(F.col("label").isNotNull() & F.col("e").isNotNull()).filter(F.forall("e", finite))
    scaled = F.transform("e", lambda x: F.floor(x * SCALE).cast("double"))
    far = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) > float(LONGEST) ** 2
    return known.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "label", scaled.alias("v")).filter(~far)


def padded_width(dimension: int) -> int:
    return max(64, 1 << max(dimension - 1, 0).bit_length())


@lru_cache(maxsize=4)
def _signs(width: int) -> np.ndarray:
    return np.where(spread_numbers(2 * width).reshape(2, width) >> np.uint64(63), -1.0, 1.0)


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Rows turned by signs and a Hadamard transform, twice."""
    out, width = vectors.astype(float), vectors.shape[1]
    for signs in _signs(width):
        out = out * signs
        step = 1
        while step < width:
            pairs = out.reshape(len(out), width // (2 * step), 2, step)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), width)
            step *= 2
        out /= np.sqrt(width)
    return out


def turns(vectors: np.ndarray, times: int = CODES) -> np.ndarray:
    """Rows after 1, 2, … rotations (row, turn, coordinate)."""
    out = []
    for _ in range(times):
        vectors = rotated(vectors)
        out.append(vectors)
    return np.stack(out, axis=1)


def packed_signs(positive: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    return np.packbits(positive, axis=1, bitorder="little").view("<u8")


def encode(vectors: np.ndarray, codes: int = CODES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-bit codes (row, code, word), alignments and lengths of the rests (row, code)."""
    rest, root = vectors, np.sqrt(vectors.shape[1])
    words, alignments, rests = [], [], []
    for _ in range(codes):
        rest = rotated(rest)
        positive = rest >= 0
        alignment = np.abs(rest).sum(axis=1) / root
        words.append(packed_signs(positive))
        rest = rest - np.where(positive, 1.0, -1.0) * (alignment / root)[:, None]
        alignments.append(alignment)
        rests.append(np.sqrt((rest * rest).sum(axis=1)))
    return np.stack(words, axis=1), np.stack(alignments, axis=1), np.stack(rests, axis=1)


def index(rows: DataFrame) -> DataFrame:
    """Every row with its codes, staged; ``row`` is a number of its own."""
    spark = rows.sparkSession
    numbered = stage(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    width = padded_width(numbered.agg(F.max(F.size("v"))).first()[0] or 0)

    def code(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for first in range(0, len(part), 4096):
                own = part.iloc[first : first + 4096]
                v = np.zeros((len(own), width))
                for i, x in enumerate(own["v"]):
                    v[i, : len(x)] = x
                words, alignments, rests = encode(v)
                whole = v.astype("<i4")
                yield pd.DataFrame({
                    "row": own["row"], "id": own["id"], "label": own["label"], "parts": [x.tobytes() for x in whole], "codes": [x.tobytes() for x in words],
                    "alignments": list(alignments), "rests": list(rests), "length": np.sqrt((v * v).sum(axis=1)),
                })

    spread = numbered.repartition(partitions(spark), "row")
    return stage(spread.mapInPandas(code, INDEX), "codes")


class Rows:
    """A chunk of indexed rows in order of their labels, as arrays."""

    def __init__(self, part: pd.DataFrame):
        part = part.sort_values("label", kind="stable")
        self.n = len(part)
        self.row, self.id, self.label = (part[c].to_numpy() for c in ("row", "id", "label"))
        self.parts = np.frombuffer(b"".join(part["parts"]), "<i4").reshape(self.n, -1)
        width = self.parts.shape[1]
        self.codes = np.ascontiguousarray(np.frombuffer(b"".join(part["codes"]), "<u8").reshape(self.n, -1, width // 64).transpose(1, 2, 0))
        self.alignments, self.rests = (np.ascontiguousarray(np.stack(part[c].to_numpy()).T) for c in ("alignments", "rests"))
        self.length = part["length"].to_numpy()

    def of_label(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.label, label, "left")), int(np.searchsorted(self.label, label, "right"))


class Turned:
    """A query after one turn: rounded, as bit planes."""

    def __init__(self, turned: np.ndarray, planes: int):
        low, high = float(turned.min()), float(turned.max())
        self.low, self.step, self.root = low, (high - low) / ((1 << planes) - 1) or 1.0, np.sqrt(len(turned))
        steps = np.rint((turned - low) / self.step).astype(np.int64)
        rounded = low + steps * self.step
        self.sum, self.error = float(rounded.sum()), float(np.sqrt(((turned - rounded) ** 2).sum()))
        self.planes = packed_signs((steps >> np.arange(planes)[:, None] & 1).astype(bool))

    def against_code(self, words: np.ndarray) -> np.ndarray:
        """Inner products of the rounded query with one-bit codes, given as (word, row)."""
        ones = np.zeros(words.shape[1])  # sum of the rounded coordinates where the code is positive
        for w, word in enumerate(words):
            ones += self.low * np.bitwise_count(word)
            for p, plane in enumerate(self.planes):
                ones += (self.step * (1 << p)) * np.bitwise_count(word & plane[w])
        return (2 * ones - self.sum) / self.root


class Anchor:
    """A query: its whole-number parts and what it is after each turn."""

    def __init__(self, parts: np.ndarray, turned: np.ndarray, planes: int = PLANES):
        self.parts = parts.astype(np.int64)
        self.length = float(np.sqrt((parts.astype(float) ** 2).sum()))
        self.turned = [Turned(t, planes) for t in turned]

    def survivors(self, rows: Rows, at: np.ndarray, least: float, most: float = np.inf, best: int | None = None) -> np.ndarray:
        """Places in ``rows`` among ``at`` whose score may lie from ``least`` to ``most`` (and, if ``best``, be among so many greatest)."""
        estimate, rounding = np.zeros(len(at)), np.zeros(len(at))
        for code in range(len(rows.codes)):
            if not len(at):
                break
            alignment = rows.alignments[code][at]
            estimate = estimate + alignment * self.turned[code].against_code(rows.codes[code][:, at])
            rounding = rounding + alignment * self.turned[code].error
            off = rows.rests[code][at] * self.length + rounding + SLACK * (1 + rows.length[at] * self.length)
            if best is not None and len(at) > best:
                least = max(least, float(np.partition(estimate - off, len(at) - best)[len(at) - best]))
            left = (estimate + off >= least) & (estimate - off <= most)
            at, estimate, rounding = at[left], estimate[left], rounding[left]
        return at

    def scores(self, rows: Rows, at: np.ndarray) -> np.ndarray:
        return rows.parts[at].astype(np.int64) @ self.parts


def first_best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` greatest scores, of equal ones those of the smallest ids."""
    if len(scores) > n:
        kept = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
        return kept[np.lexsort((ids[kept], -scores[kept]))[:n]]
    return np.lexsort((ids, -scores))


def _anchors(addresses: list[str]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Blocks of staged anchors: their columns, whole-number parts and vectors after each turn (anchor, turn, coordinate)."""
    for address in addresses:
        system, path = place(address)
        with system.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=ANCHORS_AT_ONCE):
                table = pa.Table.from_batches([batch]).drop_columns(["parts"])
                parts = np.frombuffer(b"".join(batch.column("parts").to_pylist()), "<i4").reshape(batch.num_rows, -1)
                yield table.to_pydict(), parts, turns(parts)


Search = Callable[[Rows, Anchor, dict, int], list[tuple]]


def searched(rows: DataFrame, anchors: DataFrame, search: Search, schema: str) -> DataFrame:
    """``search`` for every anchor (a staged table) in every chunk of ``rows``."""
    addresses = sorted(anchors.inputFiles())
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def chunks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for part in parts:
            held.append(part)
            n += len(part)
            if n >= CHUNK:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
        if n:
            yield pd.concat(held, ignore_index=True)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(parts):
            own = Rows(part)
            for columns, vectors, turned in _anchors(addresses):
                found = []
                for i in range(len(vectors)):
                    found += search(own, Anchor(vectors[i], turned[i]), {k: v[i] for k, v in columns.items()}, i)
                yield pd.DataFrame(found, columns=names)

    return rows.mapInPandas(run, schema)


def _positive_rows(rows: Rows, anchor: Anchor, told: dict, _: int) -> list[tuple]:
    begin, end = rows.of_label(told["label"])
    at = np.arange(begin, end)
    at = at[rows.row[at] != told["row"]]
    least = -np.inf if told["least"] is None else told["least"]
    at = anchor.survivors(rows, at, least, best=POSITIVES)
    scores = anchor.scores(rows, at)
    best = first_best(scores, rows.id[at], POSITIVES)
    return [(told["row"], int(scores[i]), int(rows.id[at[i]])) for i in best if scores[i] >= least]


def _negative_rows(rows: Rows, anchor: Anchor, told: dict, _: int) -> list[tuple]:
    begin, end = rows.of_label(told["label"])
    at = np.concatenate([np.arange(begin), np.arange(end, rows.n)])
    at = anchor.survivors(rows, at, min(told["least"]), max(told["most"]))
    scores, out = anchor.scores(rows, at), []
    for place_, (least, most) in enumerate(zip(told["least"], told["most"])):
        within = np.flatnonzero((scores >= least) & (scores <= most))
        out += [(told["row"], place_, int(scores[i]), int(rows.id[at[i]])) for i in within[first_best(scores[within], rows.id[at[within]], NEGATIVES)]]
    return out


def _best_of(found: DataFrame, by: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def positives(indexed: DataFrame, anchors: DataFrame) -> DataFrame:
    """(row, score, id, rank): each anchor's best other rows of its label."""
    schema = "row long, score long, id long"
    some = indexed.filter(F.pmod(F.xxhash64("row"), F.lit(PART)) == 0)
    first = searched(some, stage(anchors.withColumn("least", F.lit(None).cast("long")), "anchors"), _positive_rows, schema)
    # The fifth best of a part of the rows is a score that the fifth best of all rows reaches.
    reached = _best_of(first, ["row"], POSITIVES).groupBy("row").agg(F.when(F.count("score") == POSITIVES, F.min("score")).alias("least"))
    bounded = stage(anchors.join(reached, "row", "left"), "anchors")
    return _best_of(searched(indexed, bounded, _positive_rows, schema), ["row"], POSITIVES)


def negatives(indexed: DataFrame, anchors: DataFrame, found: DataFrame) -> DataFrame:
    """(row, slot, score, id, rank): for each anchor and each of its positives (slot, from 0) the best rows of other labels within the window."""
    schema = "row long, slot int, score long, id long"
    # No score lies from 80 % of a negative number up to that number itself.
    windows = found.filter("score >= 0").withColumn("low", F.expr(f"({LEAST_PERCENT} * score + 99) div 100"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col("low"), F.col("score"))))
    asked = windows.groupBy("row").agg(ordered.alias("w")).select("row", F.col("w.low").alias("least"), F.col("w.score").alias("most"))
    first_anchors = stage(anchors.join(asked, "row"), "anchors")
    some = indexed.filter(F.pmod(F.xxhash64("row"), F.lit(PART)) == 0)
    first = _best_of(searched(some, first_anchors, _negative_rows, schema), ["row", "slot"], NEGATIVES)
    reached = first.groupBy("row", "slot").agg(F.count("score").alias("n"), F.min("score").alias("fifth")).filter(F.col("n") == NEGATIVES)
    by_slot = reached.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "fifth"))).alias("fifth"))
    raised = F.transform("least", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("fifth", i.cast("int")), x)))
    bounded = stage(first_anchors.join(by_slot, "row", "left").withColumn("least", raised).drop("fifth"), "anchors")
    return _best_of(searched(indexed, bounded, _negative_rows, schema), ["row", "slot"], NEGATIVES)


def mine(embeddings: DataFrame, label: Column, is_anchor: Column) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor`` is a condition on ``id``."""
    indexed = index(whole_rows(embeddings, label))
    anchors = indexed.filter(is_anchor & (F.col("id") != NO_ID)).select("row", "id", "label", "parts")
    near = stage(positives(indexed, anchors), "positives")
    hard = negatives(indexed, anchors, near)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    own = anchors.select("row", F.col("id").alias("anchor"))
    pairs = near.select("row", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    return hard.join(pairs, ["row", "slot"]).join(own, "row").select(
        F.col("anchor").alias("anchor_id"), known("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )


def moved_label(every: int = 7, labels: int = 10) -> Column:
    """The label, one further where the id is divisible by ``every``."""
    label = F.col("label").cast("long")
    return F.when(F.col("vec_id") % every == 0, (label + 1) % labels).otherwise(label)
