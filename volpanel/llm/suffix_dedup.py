"""Repeated byte strings removed by merging Burrows-Wheeler transforms.

Each byte covered by a ``LENGTH``-byte string that also starts earlier, in a document with a smaller id or before in the same one, goes;
strings are judged on the input. Most text has no such string, so the transforms are only made where one can be:

1. Every string of ``LENGTH`` bytes has one anchor, its 48-byte window with the smallest hash. Equal strings have equal anchors at equal places,
   so a string whose anchor's hash occurs once in the corpus is alone. Neighbouring strings share an anchor; such a run is one row (hash,
   document, start), and a partial aggregation finds the hashes that occur once.
2. A run with its bytes is a context. Of equal contexts all but the first are covered throughout; a partial aggregation finds the first ones.
3. Anchors left with several different contexts: these are gathered in buckets of bounded size. Hashes of a bucket's strings show which stretch of a context
   can hold a repeated one; contexts are trimmed to it, and many vanish. They are dealt to
   shards, each shard gets its suffix array and transform, and the transforms are merged by refining their interleave symbol by symbol: after h
   rounds the merged suffixes are in order of their first h bytes, and the round in which a suffix is left alone tells its common
   prefix length. After ``LENGTH`` rounds each interval left holds the places of one string; all but the first are covered. Suffixes are sorted in
   shards alone.
4. An anchor with more than ``HOT`` different contexts, such as the edge of a passage that a large part of the corpus quotes, would not fit a bucket. Its
   strings are compared as rows by a 128-bit hash of their bytes, with partial aggregation.

Anchors, contexts and strings are told apart by 64, 128 (anchor and context) and 128 bits.

Defined cases: NULL and empty texts and texts under ``LENGTH`` bytes lose nothing; a NULL id sorts first; different texts with one id count as one
document after the other, in order of their digests, equal rows as one row; an empty table gives an empty table; other columns than
doc_id and text don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from volpanel.llm.common import fresh_name, release_shuffles, spread_numbers, text_digest
from volpanel.llm.fingerprint import FACTOR, FIRST, SPAN, window_hashes
from volpanel.session import stage, stage_alone

LENGTH = 100
CHUNK = 1 << 17  # the hashes of a piece stay in the processor's cache
BUCKET_BYTES = 1 << 18
SHARD_BYTES = 1 << 15
HOT = 20_000
#: A place packs the ordinal of a text among those of its id above the byte offset.
ORDINAL = 1 << 40
#: An anchor is two windows of the fingerprint's span, one behind the other.
ANCHOR = 2 * SPAN
ANCHOR_FACTOR = np.uint64(pow(int(FACTOR), SPAN, 1 << 64))


def _chunks(texts: Sequence[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in pieces of bounded size: bytes, and for each piece its text, its offset in the text and its end in the bytes.

    Pieces of one text overlap so that each string lies in exactly one of them.
    """
    parts: list[bytes] = []
    owners: list[int] = []
    bases: list[int] = []
    size = 0

    def done() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(parts), np.uint8), np.array(owners), np.array(bases), np.cumsum([len(p) for p in parts])

    for number, text in enumerate(texts):
        for base in range(0, len(text) - length + 1, CHUNK):
            part = text[base : base + CHUNK + length - 1]
            parts.append(part)
            owners.append(number)
            bases.append(base)
            size += len(part)
            if size >= CHUNK:
                yield done()
                parts, owners, bases, size = [], [], [], 0
    if parts:
        yield done()


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def runs(texts: Sequence[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Text number, first and last string start, and anchor hash of every run of strings with one anchor, in text order."""
    out: list[tuple[np.ndarray, ...]] = []
    for data, owners, bases, ends in _chunks(texts, length):
        half = window_hashes(data)
        hashes = half[:-SPAN] * ANCHOR_FACTOR + half[SPAN:]
        hashes = (hashes ^ (hashes >> np.uint64(31))) * FACTOR
        hashes ^= hashes >> np.uint64(29)
        keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (_sliding_min(keys, length - ANCHOR + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        piece = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(anchor)]
        begins = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])])
        of = piece[begins]
        last = np.minimum(np.r_[begins[1:], len(anchor)] - 1, ends[of] - length)
        real = last >= begins
        begins, last, of = begins[real], last[real], of[real]
        shift = bases[of] - np.r_[0, ends[:-1]][of]
        out.append((owners[of], begins + shift, last + shift, hashes[anchor[begins]].view(np.int64)))
    if not out:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(column) for column in zip(*out))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def numbered(docs: DataFrame) -> DataFrame:
    """doc (the id, NULL as the least number), place (0, or ordinal times ORDINAL for further texts of an id) and text of every row."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc"), "text")
    told = stage(rows.select("doc", text_digest(F.col("text")).alias("digest")).groupBy("doc").agg(F.count_distinct("digest").alias("texts")).where("texts > 1"), "shared-ids")
    if told.isEmpty():
        return rows.withColumn("place", F.lit(0).cast("long"))
    shared = rows.join(told, "doc", "left_semi").select("doc", text_digest(F.col("text")).alias("digest")).distinct()
    order = Window.partitionBy("doc").orderBy("digest")
    ordinals = shared.withColumn("place", (F.row_number().over(order) - 1) * F.lit(ORDINAL)).withColumnRenamed("doc", "of")
    own = (F.col("doc") == F.col("of")) & (text_digest(F.col("text")) == F.col("digest"))
    return rows.join(stage(ordinals, "ordinals"), own, "left").select("doc", "text", F.coalesce("place", F.lit(0)).cast("long").alias("place"))


def _anchors(rows: DataFrame, length: int) -> DataFrame:
    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            owner, begin, _, h = runs([_bytes(t) for t in part["text"]], length)
            yield pd.DataFrame({"h": h, "doc": part["doc"].to_numpy(np.int64)[owner], "at": part["place"].to_numpy(np.int64)[owner] + begin})

    return rows.where(F.octet_length("text") >= length).mapInPandas(emit, "h long, doc long, at long")


def _repeated_runs(rows: DataFrame, length: int) -> DataFrame:
    """doc, place, text and, run by run, anchor hash, context hash, start and number of further strings, of texts with runs whose anchor occurs more than once."""
    once = (
        _anchors(rows, length).groupBy("h").agg(F.count("*").alias("times"), F.min("doc").alias("of"), F.min("at").alias("at")).where("times = 1")
        .groupBy("of", F.floor(F.col("at") / ORDINAL).alias("ordinal")).agg(F.collect_list(F.col("at") % ORDINAL).alias("once"))
    )
    # Written before the texts move, so that the shuffles behind it can go first.
    once = stage(once, "lone-runs")
    release_shuffles(rows.sparkSession)

    def keep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [_bytes(t) for t in part["text"]]
            owner, begin, last, h = runs(texts, length)
            borders = np.searchsorted(owner, np.arange(len(texts) + 1))
            out = []
            for i, (text, alone) in enumerate(zip(texts, part["once"])):
                own = slice(borders[i], borders[i + 1])
                b, e, a = begin[own], last[own], h[own]
                if alone is not None:
                    more = np.ones(len(b), bool)
                    more[np.searchsorted(b, alone)] = False  # b ascends and has every lone one
                    b, e, a = b[more], e[more], a[more]
                if len(b):
                    c = [xxhash.xxh3_64_intdigest(text[y : z + length]) for y, z in zip(b.tolist(), e.tolist())]
                    out.append((part["doc"].iat[i], part["place"].iat[i], part["text"].iat[i], a, np.array(c, np.uint64).view(np.int64), b, e - b))
            yield pd.DataFrame(out, columns=["doc", "place", "text", "h", "c", "at", "more"])

    same = (F.col("doc") == F.col("of")) & (F.col("place") == F.col("ordinal") * ORDINAL)
    long_enough = rows.where(F.octet_length("text") >= length)
    told = long_enough.join(once, same, "left").select("doc", "place", "text", "once")
    return told.mapInPandas(keep, "doc long, place long, text string, h array<long>, c array<long>, at array<long>, more array<long>")


def index(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of UTF-8 strings, each closed by a 0, with its transform and where each suffix's longer one stands; a byte b is the symbol b + 1.

    Suffixes are ranked by their first 8 symbols, then by twice as many a round; equal ones stay in the order of the strings.
    """
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8) + np.uint8(1)
    n = len(text)
    ends = np.flatnonzero(text == 0)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)
    known, longest = 8, int(left.max()) + 1
    padded = np.r_[text, np.zeros(known, np.uint8)]
    key = np.zeros(n, np.uint64)
    for i in range(known):  # zeros from the string's end on
        key = (key << np.uint64(8)) | np.where(left >= i, padded[i : i + n], np.uint8(0))
    while True:
        by_key = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[by_key] = np.cumsum(np.r_[False, np.diff(key[by_key]) != 0])
        if known >= longest:
            break
        behind = np.zeros(n, np.int64)
        further = np.flatnonzero(left >= known)
        behind[further] = rank[further + known] + 1
        key = rank * (n + 1) + behind
        known *= 2
    # Small numbers are sorted by their digits.
    order = np.argsort(rank.astype(np.uint16) if n <= 1 << 16 else rank, kind="stable").astype(np.int32)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    return order, text[order - 1], place[order - 1]


def merge_transforms(
    transforms: Sequence[np.ndarray], longer: Sequence[np.ndarray], depth: int, step: int = 1
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes that share their first ``depth`` symbols with another one.

    Gives the suffixes (numbered through all shards) in order of these symbols, the interval each is in, and for every suffix of the shards the
    length of the longest prefix, up to ``depth``, that it has in common with any other. A round reads the transforms along the interleave and deals the suffixes
    that are ``step`` symbols longer, one, two or four, to the symbols' places; lengths are told in steps of as many. A suffix alone in its
    interval stays so when it grows, so it leaves the interleave and only its length is kept. No suffix is compared with another one.
    """
    starts = np.cumsum([0] + [len(t) for t in transforms])
    symbols = np.concatenate(transforms)
    onward = np.concatenate([x + s for x, s in zip(longer, starts)]).astype(np.int32)
    reach = 1
    while reach < step:
        # Twice as many symbols back; a 0 for either half says that the string begins before.
        before = symbols[onward]
        both = np.where((symbols > 0) & (before > 0), (before.astype(np.uint64) << np.uint64(8 * symbols.itemsize)) | symbols, np.uint64(0))
        told, both = np.unique(both, return_inverse=True)
        both += told[0] != 0
        symbols = both.astype(np.uint16 if len(told) < 1 << 16 else np.uint32)
        onward = onward[onward]
        reach *= 2
    common = np.zeros(len(symbols), np.int32)
    here, interval = np.arange(len(symbols), dtype=np.int32), np.zeros(len(symbols), np.int32)
    for done in range(0, depth, step):
        read = symbols[here]
        inside = np.flatnonzero(read)
        read, here, interval = read[inside], here[inside], interval[inside]
        order = np.argsort(read, kind="stable")
        read, before = read[order], interval[order]
        border = np.ones(len(read) + 1, bool)
        border[1:-1] = (read[1:] != read[:-1]) | (before[1:] != before[:-1])
        several = np.flatnonzero(~(border[:-1] & border[1:]))
        here = onward[here[order[several]]]
        interval = np.cumsum(border[:-1], dtype=np.int32)[several]
        common[here] = done + step
        if not len(here):
            break
    return here, interval, common


def repeated_places(strings: list[bytes], length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Places, rows (string, offset), of the substrings of ``length`` bytes that the strings hold more than once, and a number for each that equal ones share."""
    shards: list[list[int]] = [[]]
    size = 0
    for number, s in enumerate(strings):
        if size >= shard_bytes:
            shards.append([])
            size = 0
        shards[-1].append(number)
        size += len(s) + 1
    made = [index([strings[i] for i in shard]) for shard in shards]
    place = []
    for shard, (order, _, _) in zip(shards, made):
        starts = np.cumsum([0] + [len(strings[i]) + 1 for i in shard])
        of = np.searchsorted(starts, order, side="right") - 1
        place.append(np.stack([np.array(shard)[of], order - starts[of]], axis=1))
    step = next(n for n in (4, 2, 1) if length % n == 0)
    here, interval, _ = merge_transforms([t for _, t, _ in made], [x for *_, x in made], length, step)
    return np.concatenate(place)[here], interval


def repeated(strings: list[bytes], length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """The places of ``repeated_places``, one array for each substring."""
    places, interval = repeated_places(strings, length, shard_bytes)
    return np.split(places, np.flatnonzero(interval[1:] != interval[:-1]) + 1) if len(places) else []


def _string_hashes(data: np.ndarray, length: int, seeds: int) -> list[np.ndarray]:
    """64-bit hashes of every string of ``length`` bytes, from the hashes of its 24-byte windows."""
    windows = window_hashes(data)
    n = len(data) - length + 1
    out = []
    for seed in spread_numbers(seeds):
        total = np.full(n, seed, np.uint64)
        for at in [*range(0, length - SPAN, SPAN), length - SPAN]:
            total = (total ^ windows[at : at + n]) * (FACTOR ^ seed | np.uint64(1))
            total ^= total >> np.uint64(32)
        out.append(total.view(np.int64))
    return out


def trimmed(strings: list[bytes], length: int) -> list[tuple[int, int, bytes]]:
    """(number, offset, bytes) of the stretches of strings outside of which no substring of ``length`` bytes has the hash of another one."""
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(strings), np.uint8)
    if len(data) < length:
        return []
    hashes = _string_hashes(data, length, 1)[0]
    owner = np.repeat(np.arange(len(strings)), sizes)[: len(hashes)]
    inside = np.flatnonzero(np.arange(len(hashes)) + length <= ends[owner])
    _, place, times = np.unique(hashes[inside], return_inverse=True, return_counts=True)
    twice = inside[times[place] > 1]
    of = owner[twice]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, np.int64)
    out = []
    for b, e in zip(first, np.r_[first[1:], len(of)]):
        number = int(of[b])
        start = int(ends[number] - sizes[number])
        out.append((number, int(twice[b]) - start, strings[number][twice[b] - start : twice[e - 1] - start + length]))
    return out


def _covered_by_merge(contexts: DataFrame, length: int) -> DataFrame:
    """Places (doc, at) of strings that an earlier context of their bucket holds too."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["doc", "at"], ignore_index=True)  # equal rows have one context
        parts = trimmed([bytes(c) for c in rows["context"]], length)
        number = np.array([p[0] for p in parts], np.int64)
        doc = rows["doc"].to_numpy(np.int64)[number]
        at = rows["at"].to_numpy(np.int64)[number] + np.array([p[1] for p in parts], np.int64)
        if not parts:
            return pd.DataFrame({"doc": np.empty(0, np.int64), "at": np.empty(0, np.int64)})
        places, group = repeated_places([p[2] for p in parts], length)
        doc, at = doc[places[:, 0]], at[places[:, 0]] + places[:, 1]
        order = np.lexsort((at, doc, group))
        late = order[1:][group[order[1:]] == group[order[:-1]]]  # all but the first of each string
        return pd.DataFrame({"doc": doc[late], "at": at[late]})

    return contexts.groupBy("bucket").applyInPandas(merge, "doc long, at long")


def _covered_by_hash(contexts: DataFrame, length: int) -> DataFrame:
    """The same, for anchors with very many contexts: strings as rows."""

    def explode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sizes = part["context"].map(len).to_numpy(np.int64)
            if not sizes.sum():
                continue
            ends = np.cumsum(sizes)
            s1, s2 = _string_hashes(np.frombuffer(b"".join(part["context"]), np.uint8), length, 2)
            owner = np.repeat(np.arange(len(sizes)), sizes)[: len(s1)]
            inside = np.flatnonzero(np.arange(len(s1)) + length <= ends[owner])
            of = owner[inside]
            at = part["at"].to_numpy(np.int64)[of] + inside - (ends - sizes)[of]
            yield pd.DataFrame({"s1": s1[inside], "s2": s2[inside], "doc": part["doc"].to_numpy(np.int64)[of], "at": at})

    strings = stage(contexts.mapInPandas(explode, "s1 long, s2 long, doc long, at long"), "strings")
    first = strings.groupBy("s1", "s2").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return strings.join(first, ["s1", "s2"]).where(F.struct("doc", "at") != F.col("first")).select("doc", "at")


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, place and text of the texts that may lose bytes, with their repeated runs (at, more), those of them that are the first of their
    context (firsts) and the starts of covered strings in these (strings); ``lost_bytes`` reads them."""
    spark = docs.sparkSession
    rows = numbered(docs)
    held = stage_alone(spark, lambda: _repeated_runs(rows, length), "runs")
    release_shuffles(spark)
    run = held.select("doc", "place", F.explode(F.arrays_zip("h", "c", "at", "more")).alias("r")).select(
        "r.h", "r.c", "doc", (F.col("place") + F.col("r.at")).alias("at"), "r.more"
    )
    first = stage(run.groupBy("h", "c").agg(F.min(F.struct("doc", "at")).alias("first"), F.max("more").alias("more")), "contexts")
    release_shuffles(spark)

    several = first.groupBy("h").agg(F.count("*").alias("contexts")).where("contexts > 1")
    place_of = lambda at: (F.floor(at / ORDINAL) * ORDINAL).alias("in")
    wanted = first.join(several, "h").select(
        F.col("first.doc").alias("of"), place_of(F.col("first.at")), F.struct((F.col("first.at") % ORDINAL).alias("at"), "more", "h", "contexts").alias("w"),
    ).groupBy("of", "in").agg(F.collect_list("w").alias("wanted"))

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for doc, place, text, asked in zip(part["doc"], part["place"], part["text"], part["wanted"]):
                raw = _bytes(text)
                out += [(w["h"], w["contexts"], doc, place + w["at"], raw[w["at"] : w["at"] + w["more"] + length]) for w in asked]
            yield pd.DataFrame(out, columns=["h", "contexts", "doc", "at", "context"])

    same = (F.col("doc") == F.col("of")) & (F.col("place") == F.col("in"))
    cut_out = held.select("doc", "place", "text").join(wanted, same)
    contexts = stage(cut_out.mapInPandas(cut, "h long, contexts long, doc long, at long, context binary"), "context-bytes")
    release_shuffles(spark)
    size = contexts.agg(F.coalesce(F.sum(F.octet_length("context")), F.lit(0)).alias("n")).first()["n"]
    buckets = 1 + size // BUCKET_BYTES
    # Whole anchors to a bucket; none has more than HOT contexts of at most 2 * LENGTH bytes.
    cold = contexts.where(F.col("contexts") <= HOT).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    single = _covered_by_merge(cold, length).unionByName(_covered_by_hash(contexts.where(F.col("contexts") > HOT), length))

    # A document's runs are covered as a whole but where they are the first of their context; there string by string.
    marks = first.select(F.col("first.doc").alias("of"), F.col("first.at").alias("at"), F.lit(True).alias("first")).unionByName(
        single.select(F.col("doc").alias("of"), "at", F.lit(False).alias("first"))
    )
    at = F.col("at") % ORDINAL
    by_text = marks.groupBy("of", place_of(F.col("at"))).agg(
        F.collect_list(F.when(F.col("first"), at)).alias("firsts"), F.collect_list(F.when(~F.col("first"), at)).alias("strings")
    )
    return held.select("doc", "place", "text", "at", "more").join(by_text, same, "left").select("doc", "place", "text", "at", "more", "firsts", "strings")


def lost_bytes(size: int, at: np.ndarray, more: np.ndarray, firsts: np.ndarray | None, strings: np.ndarray | None, length: int) -> np.ndarray:
    """Which bytes of a text are covered."""
    whole = np.ones(len(at), bool) if firsts is None else ~np.isin(at, firsts)
    starts = at[whole] if strings is None else np.r_[at[whole], strings]
    ends = at[whole] + more[whole] + length if strings is None else np.r_[at[whole] + more[whole], strings] + length
    edge = np.bincount(starts.astype(np.int64), minlength=size + 1) - np.bincount(ends.astype(np.int64), minlength=size + 1)
    return np.cumsum(edge[:-1]) > 0


def _losses(part: pd.DataFrame, length: int) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Id, bytes and covered bytes of each text that loses some."""
    for doc, text, at, more, firsts, strings in zip(*(part[c] for c in ("doc", "text", "at", "more", "firsts", "strings"))):
        raw = _bytes(text)
        gone = lost_bytes(len(raw), np.asarray(at), np.asarray(more), firsts, strings, length)
        if gone.any():
            yield doc, raw, gone


def removals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for doc, raw, gone in _losses(part, length):
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                times = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                out.append((doc, hashlib.sha256(raw).digest(), int(gone.sum()), times, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["of", "own_digest", "n_removed", "n_spans", "kept"])

    schema = "of long, own_digest binary, n_removed long, n_spans long, kept string"
    lost = stage_alone(docs.sparkSession, lambda: spans(docs, length).mapInPandas(judge, schema).distinct(), "lost")
    release_shuffles(docs.sparkSession)
    rows = docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), text_digest(F.col("text")).alias("digest"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc"),
    )
    return rows.join(lost, (F.col("doc") == F.col("of")) & (F.col("digest") == F.col("own_digest")), "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept", F.lower(F.hex("digest"))).alias("kept_sha256"),
    )


def whole_characters(raw: bytes, gone: np.ndarray) -> np.ndarray:
    """``gone`` widened to every byte of the characters that lost one, so that no two halves meet and make a character the text never had."""
    starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return np.repeat(np.logical_or.reduceat(gone, starts), np.diff(np.r_[starts, len(raw)]))


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the covered bytes taken out of ``text`` and ``n_chars`` set to the code points left.

    A character that lost some of its bytes goes as a whole. All rows stay; a NULL text stays NULL.
    """

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [
                (doc, hashlib.sha256(raw).digest(), np.frombuffer(raw, np.uint8)[~whole_characters(raw, gone)].tobytes().decode("utf-8", "ignore"))
                for doc, raw, gone in _losses(part, length)
            ]
            yield pd.DataFrame(out, columns=["of", "own_digest", "left"])

    schema = "of long, own_digest binary, left string"
    lost = stage_alone(docs.sparkSession, lambda: spans(docs, length).mapInPandas(cut, schema).dropDuplicates(["of", "own_digest"]), "lost")
    release_shuffles(docs.sparkSession)
    lost = lost.toDF(*(fresh_name(docs, c) for c in lost.columns))
    of, own_digest, left = (lost[c] for c in lost.columns)
    own = (F.coalesce(docs["doc_id"].cast("long"), F.lit(FIRST)) == of) & (text_digest(docs["text"]) == own_digest)
    text = F.coalesce(left, docs["text"])
    new = {"text": text, "n_chars": F.when(left.isNotNull(), F.length(left)).otherwise(docs["n_chars"]).cast("long") if "n_chars" in docs.columns else None}
    return docs.join(lost, own, "left").select(*(new[c].alias(c) if new.get(c) is not None else docs[c] for c in docs.columns))
