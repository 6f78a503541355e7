"""Language-model scores from an Elias-Fano n-gram trie, counted over all training documents.

Texts are read once into blocks of about ``BLOCK`` tokens, written to the shared folder as word numbers: 64-bit hashes of the block's words and
positions in that list. From then on a block sends its distinct words or n-grams, with counts, to shards and gets one byte
or a few for each of them back, so what is shuffled is packed arrays and never a row per token.

Level 1 counts words. A higher level's shard gathers the n-grams of its contexts from all blocks and builds a ``Level``: sorted contexts, pointers
to their successors and the successors themselves, three monotone sequences in Elias-Fano code, and one byte for the logarithm of
each discounted probability and of each context's weight for the lower order. The successors of all contexts become one monotone sequence by adding to each
what the contexts before it use up, and a lookup is a successor search between the two pointers of its context. Words in level 2
are positions in the shard's sorted words; in level 3 a word is its position among the successors that its middle
word has in level 2, which is much smaller, and the context is the place of its pair in level 2, so that questions go as small distances. A level is one flat
buffer in the task of its shard, asked there and not written anywhere; the same bytes in a file are mapped by ``Level.open``.

Smoothing is absolute discounting: p(w | u) = max(c(uw) - D, 0) / c(u) + weight(u) * p(w), over every n-gram of the training rows, those seen
once too; the lowest order is (c + 1) / (N + V + 1), as in the base score. Level 3 holds words behind the pairs of level 2. The 255 codes of a figure
are spread evenly over its logarithm down to the least that N tokens can give, (1 - D) / N, so none is cut off; totals have 64 bits.

Contexts that fill more than a share of the corpus (the commonest words, the beginning of a text) are split over shards by the following word; their
tokens and successors are summed over the parts, and the weight gets the same one-byte code as any other. A text of over ``PIECE`` characters goes on in a new piece, whose first word has the last two of the piece before as context. At most ``1 / HOT_SHARE`` contexts can be that common, which bounds the tables of them.

Defined cases: NULL and empty texts are the end token alone; a NULL id counts as a training row; repeated rows count and are scored as often as they
occur; without training rows N = V = 0 and every token has probability 1; an empty table gives an empty table. Hashes of 64 bits tell words apart, of 48
bits words in pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from volpanel.llm.common import partitions, remainder, shuffles_dropped, small_batches
from volpanel.llm.ngram_join import word_hashes
from volpanel.session import stage

BLOCK = 3 << 18
PIECE = 1 << 20
DISCOUNT = 0.75
HOT_SHARE = 1 / 4096
HOT_PARTS = 64
END, BEGIN = np.uint64(0x9D5C6B2A1F3E4D01), np.uint64(0x3C1A5E7F9B2D4C03)
LOW48 = np.uint64((1 << 48) - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Numbers that are coded or asked for at once, a multiple of eight.
SLICE = 1 << 16
STEP = 31.75  # codes for a factor of ten, where a level is built without a step of its own
BLOCKS = "block string, run long, rows binary, ids binary, no_id binary, held binary, counts binary, leads binary, words binary, tokens binary"
REQUEST = "shard int, block string, contexts binary, sizes binary, symbols binary, times binary"
ANSWER = "block string, shard int, codes binary, weights binary, ranks binary, starts binary, hot binary"


# --- Elias-Fano -------------------------------------------------------------------------------------------------------


@dataclass
class EliasFano:
    """A sorted sequence of numbers under ``top``: low bits plain, high bits as a bit vector with a one for each number and a zero for each step up."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = min(56, max(0, (top // max(1, n)).bit_length() - 1))
        steps = (values >> np.uint64(bits)).astype(np.int64)
        flags = np.zeros((int(steps[-1]) if n else 0) + n + 1, np.uint8)
        flags[steps + np.arange(n)] = 1
        # A slice's bits fill whole bytes, and only they are ever spread out to a number each.
        places = np.arange(bits, dtype=np.uint64)[::-1]
        low = [np.packbits(((values[i : i + SLICE, None] >> places) & np.uint64(1)).astype(np.uint8).ravel()) for i in range(0, n, SLICE)]
        return cls(n, bits, np.concatenate([*low, np.zeros(8, np.uint8)]), np.packbits(flags))

    def __post_init__(self) -> None:
        self._starts: np.ndarray | None = None
        self._words: np.ndarray | None = None

    def starts(self) -> np.ndarray:
        """How many numbers lie below each high part, found in the bit vector once."""
        if self._starts is None:
            zeros = np.flatnonzero(np.unpackbits(np.asarray(self.high)) == 0)
            self._starts = np.r_[0, zeros - np.arange(len(zeros))]
        return self._starts

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        if self._words is None:
            data = np.asarray(self.low)
            # The eight bytes from each byte on, as one number, without a copy of them.
            self._words = np.ndarray((len(data) - 7,), ">u8", buffer=data, strides=(1,))
        bit = at.astype(np.int64) * self.low_bits
        shift = (64 - self.low_bits - (bit & 7)).astype(np.uint64)
        return (self._words[bit >> 3].astype(np.uint64) >> shift) & np.uint64((1 << self.low_bits) - 1)

    def values(self, at: np.ndarray) -> np.ndarray:
        at = at.astype(np.int64)
        high = np.searchsorted(self.starts()[1:], at, side="right").astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._lows(at)

    def _search(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first number not below each wanted one, and the end of the wanted one's high part."""
        wanted = wanted.astype(np.uint64)
        starts = self.starts()
        high = wanted >> np.uint64(self.low_bits)
        beyond = high >= np.uint64(len(starts))
        steps = np.where(beyond, 0, high).astype(np.int64)
        left = np.where(beyond, self.n, np.minimum(starts[steps], self.n))
        end = np.where(beyond, self.n, np.minimum(starts[np.minimum(steps + 1, len(starts) - 1)], self.n))
        rest = wanted & np.uint64((1 << self.low_bits) - 1)
        open_ = np.flatnonzero(left < end)
        low, high_end, goal = left[open_], end[open_].copy(), rest[open_]
        while len(open_):
            middle = (low + high_end) // 2
            below = self._lows(middle) < goal
            low, high_end = np.where(below, middle + 1, low), np.where(below, high_end, middle)
            done = low >= high_end
            left[open_[done]] = low[done]
            open_, low, high_end, goal = open_[~done], low[~done], high_end[~done], goal[~done]
        return left, end

    def successor(self, wanted: np.ndarray) -> np.ndarray:
        """Position of the first number not below each wanted one."""
        return self._search(wanted)[0]

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Position of each wanted number, -1 where it is missing: its successor, if that is in the same high part and has the same low bits."""
        at, end = self._search(wanted)
        out = np.full(len(at), -1, np.int64)
        inside = np.flatnonzero(at < end)
        same = self._lows(at[inside]) == (wanted[inside].astype(np.uint64) & np.uint64((1 << self.low_bits) - 1))
        out[inside[same]] = at[inside[same]]
        return out

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits, len(self.low), len(self.high)], np.int64).view(np.uint8), self.low, self.high]

    @classmethod
    def read(cls, data: np.ndarray, at: int) -> tuple[EliasFano, int]:
        n, bits, low, high = (int(x) for x in np.frombuffer(data[at : at + 32].tobytes(), np.int64))
        at += 32
        return cls(n, bits, data[at : at + low], data[at + low : at + low + high]), at + low + high


def step_of(tokens: int) -> float:
    """Codes for a factor of ten, so that the least figure of a model of so many tokens, (1 - DISCOUNT) / tokens, has one of the 255."""
    return 254 / np.log10((tokens + 10) / (1 - DISCOUNT))


def code(p: np.ndarray, step: float = STEP) -> np.ndarray:
    """One byte for a probability; 0 stands for none."""
    return np.clip(1 + np.rint(-np.log10(np.maximum(p, 1e-300)) * step), 1, 255).astype(np.uint8)


def decode(codes: np.ndarray, none: float, step: float = STEP) -> np.ndarray:
    return np.where(codes == 0, none, 10 ** (-(codes.astype(float) - 1) / step))


@dataclass
class Level:
    """Contexts of one order with their successors."""

    contexts: EliasFano
    pointers: EliasFano
    words: EliasFano
    successors: EliasFano
    codes: np.ndarray
    weights: np.ndarray

    @classmethod
    def build(cls, contexts: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, probabilities: np.ndarray, weights: np.ndarray, step: float = STEP) -> Level:
        """Sorted contexts, how many successors each has, those in order within their context, and the figures of both."""
        words = np.unique(symbols)
        place = np.searchsorted(words, symbols).astype(np.uint64)
        base = (np.arange(len(sizes), dtype=np.uint64) * np.uint64(len(words)))
        monotone = np.repeat(base, sizes) + place
        return cls(
            EliasFano.build(contexts), EliasFano.build(np.r_[0, np.cumsum(sizes)]), EliasFano.build(words), EliasFano.build(monotone),
            code(probabilities, step), code(weights, step),
        )

    def find(self, contexts: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pair: code of the probability, of the context's weight, and the position among the context's successors; codes are 0 if missing."""
        codes, weights, ranks = np.zeros(len(symbols), np.uint8), np.zeros(len(symbols), np.uint8), np.zeros(len(symbols), "<u4")
        for i in range(0, len(symbols), SLICE) if self.contexts.n else ():
            own = slice(i, i + SLICE)
            codes[own], weights[own], ranks[own] = self._find(contexts[own], symbols[own])
        return codes, weights, ranks

    def _find(self, contexts: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, weights, ranks = np.zeros(len(symbols), np.uint8), np.zeros(len(symbols), np.uint8), np.zeros(len(symbols), np.int64)
        # Neighbouring questions share their context, which is looked up once.
        new = np.r_[True, contexts[1:] != contexts[:-1]] if len(contexts) else np.empty(0, bool)
        at = self.contexts.find(contexts[new])[np.cumsum(new) - 1]
        known = np.flatnonzero(at >= 0)
        weights[known] = np.asarray(self.weights)[at[known]]
        if not self.words.n:
            return codes, weights, ranks
        word = self.words.find(symbols[known])
        known, word = known[word >= 0], word[word >= 0]
        place = self.successors.find(at[known].astype(np.uint64) * np.uint64(self.words.n) + word.astype(np.uint64))
        known, place = known[place >= 0], place[place >= 0]
        codes[known] = np.asarray(self.codes)[place]
        ranks[known] = place - self.pointers.values(at[known]).astype(np.int64)
        return codes, weights, ranks

    def starts(self, contexts: np.ndarray) -> np.ndarray:
        """Where each context's successors begin among all of the level's; a missing one has the beginning of the next."""
        if not self.contexts.n:
            return np.zeros(len(contexts), np.uint64)
        return self.pointers.values(self.contexts.successor(contexts))

    def to_bytes(self) -> bytes:
        parts = [p for ef in (self.contexts, self.pointers, self.words, self.successors) for p in ef.parts()]
        tail = np.array([len(self.codes), len(self.weights)], np.int64).view(np.uint8)
        return b"".join(np.ascontiguousarray(p).tobytes() for p in (*parts, tail, self.codes, self.weights))

    @classmethod
    def of_buffer(cls, data: np.ndarray) -> Level:
        """A level over a flat buffer of bytes, such as ``numpy.memmap`` gives; nothing is copied."""
        at, sequences = 0, []
        for _ in range(4):
            sequence, at = EliasFano.read(data, at)
            sequences.append(sequence)
        codes, weights = (int(x) for x in np.frombuffer(data[at : at + 16].tobytes(), np.int64))
        at += 16
        return cls(*sequences, data[at : at + codes], data[at + codes : at + codes + weights])

    @classmethod
    def open(cls, path: str) -> Level:
        return cls.of_buffer(np.memmap(path, np.uint8, mode="r"))


# --- blocks of tokens -------------------------------------------------------------------------------------------------


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of bounded size, cut at white space."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and text[end] not in " \t\n\v\f\r":
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def blocks(docs: DataFrame, folds: int, held: int) -> DataFrame:
    """Rows ``BLOCKS``; a long text may go through several blocks."""
    told = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", (remainder("doc_id", folds) == held).alias("held"))

    def pack(items: list[tuple], run: int) -> pd.DataFrame:
        rows, ids, held_out, leads, tokens = zip(*items)
        every = np.concatenate(tokens)
        words, place, times = np.unique(every, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # common words get small numbers, which the table stores in few bytes
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        return pd.DataFrame([{
            "block": uuid.uuid4().hex, "run": run, "rows": np.array(rows, "<i8").tobytes(),
            "ids": np.array([x or 0 for x in ids], "<i8").tobytes(), "no_id": np.array([x is None for x in ids], np.uint8).tobytes(), "held": np.array(held_out, np.uint8).tobytes(),
            "counts": np.array([len(t) for t in tokens], "<i8").tobytes(), "leads": np.concatenate(leads).tobytes(), "words": words[order].tobytes(),
            "tokens": _squeeze(rank[place].astype("<u4")),
        }])

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = uuid.uuid4().int >> 65
        items: list[tuple] = []
        row = size = 0
        for part in parts:
            for doc_id, text, held_out in zip(part["doc_id"], part["text"], part["held"]):
                row += 1
                lead = np.array([BEGIN, BEGIN])
                pieces = list(_pieces(text or ""))
                for number, piece in enumerate(pieces):
                    words = word_hashes(piece.encode("utf-8", "surrogatepass").lower().split())
                    if number == len(pieces) - 1:
                        words = np.r_[words, END]
                    if len(words):
                        items.append((row, None if doc_id is None else int(doc_id), held_out, lead, words))
                        lead = np.r_[lead, words][-2:]
                        size += len(words)
                    if size >= BLOCK:
                        yield pack(items, run)
                        items, size = [], 0
        if items:
            yield pack(items, run)

    return told.mapInPandas(read, BLOCKS)


class Block:
    """A row of BLOCKS as arrays."""

    def __init__(self, row):
        self.words = np.frombuffer(row["words"], np.uint64)
        self.tokens = _spread(row["tokens"], "<u4").astype(np.int64)
        self.counts = np.frombuffer(row["counts"], "<i8")
        self.rows = np.frombuffer(row["rows"], "<i8")
        self.ids = pd.array(np.frombuffer(row["ids"], "<i8"), "Int64")
        self.ids[np.frombuffer(row["no_id"], np.uint8).astype(bool)] = pd.NA
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.leads = np.frombuffer(row["leads"], np.uint64).reshape(-1, 2)
        self.train = np.repeat(~self.held, self.counts)
        self.starts = np.r_[0, np.cumsum(self.counts)[:-1]]
        self.later = np.flatnonzero(self.leads[:, 1] != BEGIN)  # pieces that go on with a text

    def before(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the two tokens before each one."""
        own = self.words[self.tokens]
        one, two = np.empty_like(own), np.empty_like(own)
        one[1:], two[2:] = own[:-1], own[:-2]
        one[self.starts], two[self.starts] = self.leads[:, 1], self.leads[:, 0]
        second = self.starts[self.counts > 1] + 1
        two[second] = self.leads[self.counts > 1, 1]
        return two, one


@dataclass
class Asked:
    """Distinct (context, symbol) pairs of a block in order of their shard, and where each token's pair is among them."""

    shard: np.ndarray
    context: np.ndarray
    symbol: np.ndarray
    times: np.ndarray
    place: np.ndarray
    shards: int
    placed: bool

    @classmethod
    def of(
        cls, context: tuple[np.ndarray, np.ndarray], symbol: tuple[np.ndarray, np.ndarray], train: np.ndarray, shards: int, hot: np.ndarray, placed: bool = False
    ) -> Asked:
        """Contexts and symbols are given as distinct values and each token's position in them, so that pairs sort as whole numbers.

        With ``placed`` a context is a place in a shard of the level before, place * shards + shard, and goes to that shard again.
        """
        (contexts, c), (symbols, w) = context, symbol
        order = np.argsort(symbols)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = rank[w]
        # A split context counts as one context for each part.
        often = np.flatnonzero(np.isin(contexts, hot))
        parts = np.tile(np.arange(HOT_PARTS, dtype=np.uint64), len(often))
        every, part = np.r_[contexts, np.repeat(contexts[often], HOT_PARTS)], np.r_[np.zeros(len(contexts), np.uint64), parts]
        shard = (every if placed else ((every + part) * MIX) >> np.uint64(16)) % np.uint64(shards)
        if len(often):
            base = np.full(len(contexts), -1, np.int64)
            base[often] = len(contexts) + HOT_PARTS * np.arange(len(often))
            split = base[c] >= 0
            c = np.where(split, base[c] + part_of(symbols)[w].astype(np.int64), c)
        by = np.lexsort((part, every, shard)) if len(often) else pair_order(shard, every)
        number = np.empty(len(by), np.int64)
        number[by] = np.arange(len(by))
        keys, where = np.unique(number[c] * max(1, len(symbols)) + place, return_inverse=True)
        of = by[keys // max(1, len(symbols))]
        times = np.bincount(where[train], minlength=len(keys)).astype("<u4")
        return cls(shard[of].astype(np.int32), every[of], symbols[order][keys % max(1, len(symbols))] if len(symbols) else symbols, times, where, shards, placed)

    def by_shard(self) -> Iterator[tuple[int, slice]]:
        borders = np.flatnonzero(np.r_[True, self.shard[1:] != self.shard[:-1], True]) if len(self.shard) else np.empty(0, np.int64)
        for b, e in zip(borders[:-1], borders[1:]):
            yield int(self.shard[b]), slice(b, e)

    def requests(self, block: str) -> pd.DataFrame:
        rows = []
        for shard, own in self.by_shard():
            context, symbol = self.context[own], self.symbol[own]
            new = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
            named = _steps(context[new] // np.uint64(self.shards)) if self.placed else _pack48(context[new])
            symbols = _squeeze(symbol.astype("<u8")) if self.placed else _pack48(symbol)
            rows.append((shard, block, named, _squeeze(np.diff(np.r_[new, len(context)]).astype("<u4")), symbols, _squeeze(self.times[own])))
        return pd.DataFrame(rows, columns=["shard", "block", "contexts", "sizes", "symbols", "times"])

    def collect(self, answers: dict[int, tuple[bytes, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code, weight, rank and place * shards + shard of every distinct pair; the last two where the answers have them."""
        codes, weights = np.zeros(len(self.shard), np.uint8), np.zeros(len(self.shard), np.uint8)
        ranks, places = np.zeros(len(self.shard), np.int64), np.zeros(len(self.shard), np.uint64)
        for shard, own in self.by_shard():
            own_codes, own_weights, own_ranks, own_starts = answers[shard]
            codes[own] = _spread(own_codes, np.uint8)
            context = self.context[own]
            number = np.cumsum(np.r_[True, context[1:] != context[:-1]]) - 1
            weights[own] = _spread(own_weights, np.uint8)[number]
            if own_ranks:
                hits = own.start + np.flatnonzero(codes[own])
                ranks[hits] = _spread(own_ranks, "<u4")
                start = _climb(own_starts)[number[hits - own.start]]
                places[hits] = (start + ranks[hits].astype(np.uint64)) * np.uint64(self.shards) + np.uint64(shard)
        return codes, weights, ranks, places


def _squeeze(values: np.ndarray) -> bytes:
    """Small numbers, most of them alike, byte by byte in zstd behind their size: half of what the shuffle's own codec leaves."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return planes.nbytes.to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _spread(data: bytes, kind: str | type) -> np.ndarray:
    whole = pa.Codec("zstd").decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    planes = np.frombuffer(whole, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _steps(values: np.ndarray) -> bytes:
    """Numbers in order, by their distances."""
    return _squeeze(np.diff(values, prepend=np.uint64(0)).astype("<u8"))


def _climb(data: bytes) -> np.ndarray:
    return np.cumsum(_spread(data, "<u8"), dtype=np.uint64)


def _pack48(values: np.ndarray) -> bytes:
    """Six bytes a number, byte by byte, so that equal high bytes lie together."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _unpack48(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def pair_order(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Places of the pairs in order of the first and then the second number, equal pairs in any order.

    One number holds the first and the leading bits of the second. Pairs that agree in it but not in the bits that don't fit, a few with
    hashes, are put in order by themselves.
    """
    if not len(first):
        return np.empty(0, np.int64)
    first, second = first.astype(np.uint64), second.astype(np.uint64)
    bits = int(second.max()).bit_length()
    left_out = max(0, int(first.max()).bit_length() + bits - 64)
    key = first if bits == left_out else (first << np.uint64(bits - left_out)) | (second >> np.uint64(left_out))
    order = np.argsort(key)
    if left_out:
        key, rest = key[order], second[order]
        same = key[1:] == key[:-1]
        run = np.cumsum(np.r_[True, ~same]) - 1
        mixed = np.zeros(int(run[-1]) + 1, bool)
        mixed[run[1:][same & (rest[1:] != rest[:-1])]] = True
        at = np.flatnonzero(mixed[run])
        order[at] = order[at[np.lexsort((rest[at], run[at]))]]
    return order


def part_of(symbols: np.ndarray) -> np.ndarray:
    """Which part of a split context a following word belongs to."""
    return (symbols * MIX) >> np.uint64(64 - 6)


def _pairs(block: Block) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Context and symbol of each token on level 2, then of the two words before each later piece, as distinct values and positions."""
    words, n = block.words & LOW48, len(block.tokens)
    before, last = block.leads[block.later].T & LOW48
    # Contexts are the block's words, the beginning of a text, and the words before a piece.
    extra = np.unique(np.r_[block.leads[:, 1] & LOW48, before])
    c = np.empty(n + len(last), np.int64)
    c[1:n] = block.tokens[:-1]
    c[block.starts] = len(words) + np.searchsorted(extra, block.leads[:, 1] & LOW48)
    c[n:] = len(words) + np.searchsorted(extra, before)
    contexts, again = np.unique(np.r_[words, extra], return_inverse=True)
    if not len(last):
        return (contexts, again[c]), (words, block.tokens)
    symbols, same = np.unique(np.r_[words, last], return_inverse=True)
    return (contexts, again[c]), (symbols, same[np.r_[block.tokens, len(words) + np.arange(len(last))]])


def _asked_pairs(block: Block, shards: int, hot: np.ndarray) -> Asked:
    """The pairs before later pieces are asked for, not counted once more."""
    return Asked.of(*_pairs(block), np.r_[block.train, np.zeros(len(block.later), bool)], shards, hot)


def _triples(block: Block, two: Asked, answers: tuple[np.ndarray, ...]) -> tuple[np.ndarray, tuple, tuple]:
    """Positions of the tokens whose two words before are a kept pair, with context and symbol on level 3; symbol 0 stands for all unkept pairs.

    The context is the pair's place among all successors of its shard.
    """
    codes, _, ranks, places = answers
    kept = codes > 0
    n = len(block.tokens)
    before = np.r_[-1, two.place[: n - 1]]
    before[block.starts] = -1
    before[block.starts[block.later]] = two.place[n:]
    at = np.flatnonzero((before >= 0) & kept[before])
    pair, own = before[at], two.place[at]
    # The position among the middle word's successors, told apart by the part of a split context.
    symbol = np.where(kept, ((ranks.astype(np.uint64) + np.uint64(1)) << np.uint64(6)) | part_of(two.symbol), np.uint64(0))
    contexts, c = np.unique(places[pair], return_inverse=True)
    symbols, w = np.unique(symbol[own], return_inverse=True)
    return at, (contexts, c), (symbols, w)


def _level_of(rows: pd.DataFrame, hot_totals: dict[int, int], placed: bool, step: float) -> tuple[Level, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shard's level, its distinct questions, which of them each block's questions are, and (name, tokens, successors) of split contexts."""
    names_of, symbols_of = (_climb, lambda x: _spread(x, "<u8")) if placed else (_unpack48, _unpack48)
    context = np.concatenate([np.repeat(names_of(c), _spread(n, "<u4")) for c, n in zip(rows["contexts"], rows["sizes"])])
    symbol = np.concatenate([symbols_of(x) for x in rows["symbols"]])
    times = np.concatenate([_spread(x, "<u4") for x in rows["times"]]).astype(np.int64)
    order = pair_order(context, symbol)
    context, symbol = context[order], symbol[order]
    new = np.r_[True, (context[1:] != context[:-1]) | (symbol[1:] != symbol[:-1])]
    asked = np.empty(len(order), np.int32)
    asked[order] = np.cumsum(new, dtype=np.int32) - 1
    times = np.add.reduceat(times[order], np.flatnonzero(new))
    context, symbol = context[new], symbol[new]
    del order, new
    start = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    number = np.cumsum(np.r_[True, context[1:] != context[:-1]]) - 1
    total = np.add.reduceat(times, start)
    names = context[start]
    for i in np.flatnonzero(np.isin(names, np.array(list(hot_totals), np.uint64))) if hot_totals else ():
        total[i] = hot_totals[int(names[i])]
    keep = (times > 0) & ~((symbol == 0) if placed else np.zeros(len(symbol), bool))
    probability = (times[keep] - DISCOUNT) / np.maximum(1, total[number[keep]])
    successors = np.bincount(number[keep], minlength=len(start))
    followed = np.zeros(len(start), np.int64)
    np.add.at(followed, number[keep], times[keep])
    used = total > 0
    place = np.cumsum(used) - 1
    level = Level.build(
        names[used], np.bincount(place[number[keep]], minlength=int(used.sum())), symbol[keep], probability,
        lower_weight(total[used], followed[used], successors[used]), step,
    )
    split = np.isin(names, np.array(list(hot_totals), np.uint64)) if hot_totals else np.zeros(len(names), bool)
    return level, context, symbol, asked, np.column_stack([names[split].astype(np.int64), followed[split], successors[split]])


def lower_weight(total: np.ndarray, followed: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """What a context's discounts leave to the lower order, in whole numbers up to the one division: never 0."""
    return (total - followed + DISCOUNT * successors) / total


def _answers(requests: DataFrame, hot_totals: dict[int, int], placed: bool, step: float) -> DataFrame:
    """Rows ANSWER, among them one with an empty block for each shard, which has the figures of its split contexts.

    A level lives as one flat buffer in its shard's task and ends with it. ``placed`` is the last level, whose places nobody asks for.
    """

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", ignore_index=True)
        built, context, symbol, asked, split = _level_of(rows, hot_totals, placed, step)
        level = Level.of_buffer(np.frombuffer(built.to_bytes(), np.uint8))
        del built
        codes, weights, ranks = level.find(context, symbol)
        begins = None if placed else level.starts(context)
        shard = int(rows["shard"].iloc[0])
        out = [("", shard, b"", b"", b"", b"", np.ascontiguousarray(split, "<i8").tobytes())]
        begin = 0
        for block, sizes in zip(rows["block"], rows["sizes"]):
            sizes = _spread(sizes, "<u4").astype(np.int64)
            own = asked[begin : begin + int(sizes.sum())]
            begin += len(own)
            found = codes[own]
            first = own[np.r_[0, np.cumsum(sizes)[:-1]]]
            where = (b"", b"") if placed else (_squeeze(ranks[own[found > 0]]), _steps(begins[first]))
            out.append((block, shard, _squeeze(found), _squeeze(weights[first]), *where, b""))
        return pd.DataFrame(out, columns=["block", "shard", "codes", "weights", "ranks", "starts", "hot"])

    return requests.groupBy("shard").applyInPandas(answer, ANSWER)


def _by_shard(rows: pd.DataFrame) -> dict[int, tuple[bytes, ...]]:
    return {int(s): tuple(own) for s, *own in zip(rows["shard"], rows["codes"], rows["weights"], rows["ranks"], rows["starts"])}


def _count_words(held: DataFrame, shards: int) -> DataFrame:
    """Rows (block, shard, counts, known, tokens, common): training counts of a block's words, and the shard's totals in one row of it each."""

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, row in part.iterrows():
                block = Block(row)
                times = np.bincount(block.tokens[block.train], minlength=len(block.words)).astype("<u4")
                shard = (block.words % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                borders = np.searchsorted(shard[order], np.arange(shards + 1))
                yield pd.DataFrame([
                    (s, row["block"], block.words[order[b:e]].tobytes(), _squeeze(times[order[b:e]]))
                    for s, (b, e) in enumerate(zip(borders[:-1], borders[1:])) if e > b
                ], columns=["shard", "block", "words", "times"])

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        words = np.concatenate([np.frombuffer(w, np.uint64) for w in rows["words"]])
        times = np.concatenate([_spread(t, "<u4") for t in rows["times"]]).astype(np.int64)
        names, place = np.unique(words, return_inverse=True)
        total = np.zeros(len(names), "<i8")
        np.add.at(total, place, times)
        sizes = [len(w) // 8 for w in rows["words"]]
        own = np.split(total[place], np.cumsum(sizes)[:-1])
        out = pd.DataFrame({"block": rows["block"], "shard": rows["shard"], "counts": [_squeeze(x) for x in own], "known": 0, "tokens": 0, "common": None})
        order = np.argsort(-total, kind="stable")[: int(1 / HOT_SHARE)]
        common = [(int(w.view(np.int64)), int(t)) for w, t in zip(names[order], total[order])]
        first = pd.DataFrame([{"block": "", "shard": int(rows["shard"].iloc[0]), "counts": b"", "known": int((total > 0).sum()), "tokens": int(total.sum()), "common": common}])
        return pd.concat([first, out], ignore_index=True)

    kinds = "block string, shard int, counts binary, known long, tokens long, common array<struct<word: long, times: long>>"
    asked = held.mapInPandas(ask, "shard int, block string, words binary, times binary")
    return asked.groupBy("shard").applyInPandas(count, kinds)


def score(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    spark = docs.sparkSession
    shards = min(1 << 15, partitions(spark))
    with small_batches(spark):
        kept = stage(blocks(docs, folds, held), "token-blocks")
    with shuffles_dropped(spark):
        counted = stage(_count_words(kept, shards), "word-counts")
    row = counted.where("block = ''").agg(F.coalesce(F.sum("known"), F.lit(0)).alias("v"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()
    vocabulary, tokens = row["v"], row["n"]
    step = step_of(tokens)

    # Fewer than 1 / HOT_SHARE words can have that share of all tokens; the beginning of a text is one more.
    limit = max(2.0, tokens * HOT_SHARE)
    common = counted.where("block = ''").select(F.explode(F.filter("common", lambda c: c["times"] > limit)).alias("c")).select("c.*").collect()
    hot_totals = {int(np.uint64(r["word"] & 0xFFFFFFFFFFFFFFFF) & LOW48): r["times"] for r in common}
    texts = docs.where(remainder("doc_id", folds) != held).count()
    hot_totals[int(BEGIN & LOW48)] = texts
    hot = np.array(sorted(hot_totals), np.uint64)
    none = np.empty(0, np.uint64)

    def ask_pairs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, row in part.iterrows():
                block = Block(row)
                yield _asked_pairs(block, shards, hot).requests(row["block"])

    with shuffles_dropped(spark):
        pairs = stage(_answers(kept.mapInPandas(ask_pairs, REQUEST), hot_totals, placed=False, step=step), "level-2")
    seen = {c: np.zeros(2, np.int64) for c, t in hot_totals.items() if t}
    for r in pairs.where("block = ''").select("hot").collect():
        for c, *figures in np.frombuffer(r["hot"], "<i8").reshape(-1, 3):
            if int(c) in seen:
                seen[int(c)] += figures
    hot_names = np.array(sorted(seen), np.uint64)
    # Weights of split contexts go through the same one-byte code as all others.
    hot_codes = code(np.array([lower_weight(hot_totals[int(c)], *seen[int(c)]) for c in hot_names]), step)

    def ask_triples(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = Block(left.iloc[0])
        two = _asked_pairs(block, shards, hot)
        at, context, symbol = _triples(block, two, two.collect(_by_shard(right)))
        return Asked.of(context, symbol, block.train[at], shards, none, placed=True).requests(left["block"].iloc[0])

    answered = pairs.where("block <> ''").drop("hot")
    asked = kept.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(ask_triples, REQUEST)
    with shuffles_dropped(spark):
        triples = stage(_answers(asked, {}, placed=True, step=step), "level-3")
    every = (
        counted.where("block <> ''").select("block", "shard", F.lit(1).alias("level"), F.col("counts").alias("codes"), *(F.lit(b"").alias(c) for c in ("weights", "ranks", "starts")))
        .unionByName(answered.withColumn("level", F.lit(2)))
        .unionByName(triples.where("block <> ''").drop("hot").withColumn("level", F.lit(3)))
    )

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = Block(left.iloc[0])
        times = np.zeros(len(block.words), np.int64)
        shard = (block.words % np.uint64(shards)).astype(np.int64)
        for s, (raw, *_) in _by_shard(right[right["level"] == 1]).items():
            times[shard == s] = _spread(raw, "<i8")
        single = (times[block.tokens] + 1) / (tokens + vocabulary + 1)
        two = _asked_pairs(block, shards, hot)
        answers = two.collect(_by_shard(right[right["level"] == 2]))
        weights = answers[1]
        if len(hot_names):
            of = np.minimum(np.searchsorted(hot_names, two.context), len(hot_names) - 1)
            weights = np.where(hot_names[of] == two.context, hot_codes[of], weights)
        weight = decode(weights, 1.0, step)
        here = two.place[: len(block.tokens)]
        pair = decode(answers[0], 0.0, step)[here] + weight[here] * single
        at, context, symbol = _triples(block, two, answers)
        three = Asked.of(context, symbol, block.train[at], shards, none, placed=True)
        codes, weights, *_ = three.collect(_by_shard(right[right["level"] == 3]))
        triple = pair.copy()
        triple[at] = decode(codes, 0.0, step)[three.place] + decode(weights, 1.0, step)[three.place] * pair[at]
        ends = np.add.reduceat
        return pd.DataFrame({
            "run": int(left["run"].iloc[0]), "row": block.rows, "doc_id": block.ids, "held_out": block.held,
            "n_tokens": block.counts, "n_known": ends((times[block.tokens] > 0).astype(np.int64), block.starts),
            "base_score": ends(np.log10(single), block.starts), "score": ends(np.log10(triple), block.starts),
        })

    scored = kept.groupBy("block").cogroup(every.groupBy("block")).applyInPandas(
        finish, "run long, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return (
        scored.groupBy("run", "row")
        .agg(
            F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
            F.sum("base_score").alias("base_score"), F.sum("score").alias("score"),
        )
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
    )
