"""Document fingerprints that add up: a homomorphic multiset hash of paragraphs.

A text is the multiset of its paragraphs, the parts between line feeds. A paragraph becomes a wide vector of two blocks:

* ``EXACT`` lanes modulo 2**64, its BLAKE2b digest. Sums of these decide equality.
* ``LANES`` lanes modulo 2**16, a signed count of its ``SPAN``-byte windows: each window adds +1 or -1 to one lane. (A paragraph
  shorter than a window counts as one.) The cosine of two such sums estimates the likeness of the texts.

The fingerprint of a text is the sum of its paragraphs' vectors, so it doesn't depend on their order, and adding or taking away a paragraph is
one vector addition or subtraction; the edited text's fingerprint comes from the original's that way.

To meet the next document by id, rows are dealt to ranges of ids whose bounds are ids of the table; the rows at a bound go to the
range before it too. Texts are shuffled once, and a range is streamed in order, one document held back at a time.

Defined cases: NULL is the empty text, which is one empty paragraph; a NULL id sorts before all others; rows with one id follow each other
by text; the only row of a table is its own next document; an empty table gives an empty table. A lane that passes 32,767
wraps around, which blurs likeness and never equality.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from volpanel.llm.common import partitions, spread_numbers

EXACT, LANES, SPAN = 8, 256, 24
FIRST = -(1 << 63)
RANGES_PER_PARTITION = 4
FINGERPRINTED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


BYTE = spread_numbers(256)
FACTOR = np.uint64(0xD6E8FEB86659FD93)
F2 = np.uint64(pow(int(FACTOR), 2, 1 << 64))
F4 = np.uint64(pow(int(FACTOR), 4, 1 << 64))
F8 = np.uint64(pow(int(FACTOR), 8, 1 << 64))


def window_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hash of every window of SPAN = 24 bytes, from those of 1, 2, 4, 8 and 16."""
    one = BYTE[data]
    two = one[:-1] * FACTOR + one[1:]
    four = two[:-2] * F2 + two[2:]
    eight = four[:-4] * F4 + four[4:]
    sixteen = eight[:-8] * F8 + eight[8:]
    return sixteen[:-8] * F8 + eight[16:]


def _slots(hashes: np.ndarray) -> np.ndarray:
    """Lane and sign as one number under 2 * LANES."""
    mixed = (hashes ^ (hashes >> np.uint64(32))) * FACTOR
    return (mixed >> np.uint64(55)).astype(np.int64)


@dataclass
class Fingerprint:
    exact: np.ndarray
    lanes: np.ndarray

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact + other.exact, self.lanes + other.lanes)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact - other.exact, self.lanes - other.lanes)

    def text(self) -> str:
        return base64.b64encode(self.exact.astype("<u8").tobytes() + self.lanes.astype("<u2").tobytes()).decode()

    def likeness(self, other: Fingerprint) -> float:
        if np.array_equal(self.exact, other.exact):
            return 1.0
        a, b = (x.lanes.astype(np.uint16).view(np.int16).astype(float) for x in (self, other))
        size = float(np.sqrt(a.dot(a) * b.dot(b)))
        return min(1.0, max(0.0, float(a.dot(b)) / size)) if size else 0.0


def of_text(text: str) -> Fingerprint:
    """Sum of the vectors of all paragraphs; windows are hashed for all of them at once."""
    raw = text.encode("utf-8", "surrogatepass")
    paragraphs = raw.split(b"\n")
    digests = b"".join(hashlib.blake2b(p, digest_size=8 * EXACT).digest() for p in paragraphs)
    exact = np.frombuffer(digests, "<u8").reshape(-1, EXACT).sum(axis=0, dtype=np.uint64)
    slots = [_slots(np.frombuffer(digests, "<u8")[i * EXACT : i * EXACT + 1]) for i, p in enumerate(paragraphs) if 0 < len(p) < SPAN]
    if len(raw) >= SPAN:
        data = np.frombuffer(raw, np.uint8)
        found = _slots(window_hashes(data))
        ends = np.flatnonzero(data == 10)
        if len(ends):
            inside = np.zeros(len(data) + 1, np.int32)
            np.add.at(inside, np.maximum(ends - SPAN + 1, 0), 1)
            np.subtract.at(inside, ends + 1, 1)
            found = found[np.cumsum(inside)[: len(found)] == 0]
        slots.append(found)
    counts = np.bincount(np.concatenate(slots), minlength=2 * LANES) if slots else np.zeros(2 * LANES, np.int64)
    return Fingerprint(exact, (counts[0::2] - counts[1::2]) & 0xFFFF)


def edited(text: str, following: str) -> str:
    """The text whose last quarter is replaced by as much of the beginning of the following one."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def of_edited(text: str, own: Fingerprint, new: str) -> Fingerprint:
    """The edited text's fingerprint: the paragraphs behind the last common line feed go, the new ones come."""
    kept = len(text) - len(text) // 4
    cut = text.rfind("\n", 0, kept) + 1
    return own - of_text(text[cut:]) + of_text(new[cut:]) if cut else of_text(new)


def _stream(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: tuple | None = None
    for part in parts:
        rows = []
        for doc_id, text, at, guest in zip(part["doc_id"], part["text"], part["range"], part["guest"]):
            text = text or ""
            own = of_text(text)
            if held is not None and held[0] == at:
                _, before_id, before, print_ = held
                new = edited(before, text)
                print_new = of_edited(before, print_, new)
                rows.append((
                    None if before_id is None else int(before_id), len(before), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
                    print_.text(), print_new.text(), print_.likeness(print_new), print_.likeness(own),
                ))
            held = None if guest else (at, doc_id, text, own)
            if guest:
                held = (-1, None, "", own)  # the guests behind the first one of a range have nothing before them
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in FINGERPRINTED.split(", ")])
        yield out.astype({"doc_id": "Int64"})


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows ``FINGERPRINTED`` for every row of ``docs``."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST))
    ranges = partitions(spark) * RANGES_PER_PARTITION
    shares = [i / ranges for i in range(1, ranges)]
    row = docs.agg(F.min(key).alias("least"), F.percentile_approx(key, shares, 20 * ranges).alias("bounds")).first()
    if row["least"] is None:
        return spark.createDataFrame([], FINGERPRINTED)
    bounds = np.unique(np.array([row["least"], *row["bounds"]], np.int64))

    @F.pandas_udf("array<struct<range: int, guest: boolean>>")
    def places(keys: pd.Series) -> pd.Series:
        values = keys.to_numpy()
        home = np.searchsorted(bounds, values, side="right") - 1
        at_bound = bounds[home] == values
        # The row at a bound also ends the range before; the first of all ends the last range.
        return pd.Series([
            [{"range": h, "guest": False}, {"range": (h - 1) % len(bounds), "guest": True}] if b else [{"range": h, "guest": False}]
            for h, b in zip(home.tolist(), at_bound.tolist())
        ])

    dealt = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", key.alias("key"), F.explode(places(key)).alias("p"))
    return (
        dealt.select("doc_id", "text", "key", "p.*")
        .repartition(partitions(spark), "range")
        .sortWithinPartitions("range", "guest", "key", "text")
        .mapInPandas(_stream, FINGERPRINTED)
    )
