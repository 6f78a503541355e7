"""Conversations repaired at the least cost, decided by whole numbers alone.

A conversation is its rows by turn. Each row is kept, given another role or deleted, and empty rows may be inserted anywhere, so that the
initials of the roles read ``(s?(ua)+)?``. The choice is a shortest path through a graph without cycles: nodes are (row, state of that
pattern, rows inserted before this row), edges are single edits. The weight of an edge is one whole number: its cost in the high digits, and below
them a field of fixed width for the letters of the whole path, in which the edit's letter stands at the place that it has in the path. Places
behind a path's end are zero. So the least sum is the cheapest path, and of several the one whose letters come first in ASCII; no tie is left.

Sums of two paths to one node never meet with one path's letters a beginning of the other's: both have passed the same rows, so the longer
one has inserted more and costs more. Therefore the least number at each node suffices, and also the least one from state to state over a block of
rows. Blocks of ``BLOCK`` rows are solved apart, in parallel, as tables of (state before, state after); the tables of one conversation
are then put together in pairs. A conversation of a few rows is a single block. Equal sequences of role initials and faults are solved once in each worker.

Texts take no part in that. They pass through one sort by conversation, which spills to disk; a row at a time meets its edit. What one conversation puts into a
single task beyond such a stream is one byte a row for the letters, which the result has in one cell anyway, and a digest is a sequential sum by nature.

Defined cases: a NULL role or text counts as one space; rows without a turn come first; rows of one turn are ordered by role, then by the SHA-256
of the text; a repeated row is a duplicate of the one before it; NULL is an id like any other; a role of another initial than s, u or a, or an empty one, is
never kept; a conversation all of whose rows are gone has an empty audit; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from volpanel.session import stage

#: Costs and letters of the edits.
RELABEL, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LETTERS = "\0DIKR"
BITS = 3  # of one letter
BLOCK = 256
#: The pattern (s?(ua)+)?: what follows what; START and A may end it.
START, S, U, A = range(4)
NEXT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
ENDS = (START, A)
ROLE = {"u": "user", "a": "assistant"}
#: A second insertion leads back to where none or one leads, or from START to A; a third one never pays.
INSERTED = 2

VISIBLE = r"[^\x20\x09-\x0D]"
#: A row as one letter for the solver: its role's initial where that is s, u or a, as a capital if the row is truncated; else one of these.
MUST_GO, NO_INITIAL, LATE_NO_INITIAL = "x", "-", "_"


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, ord, turn, role, text, fault, code): rows by turn with their first fault (NULL, blank, duplicate or truncated)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    known = rows.select("conv_id", "turn", role, text).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy("ord")
    last = F.regexp_extract("text", rf"({VISIBLE})[\x20\x09-\x0D]*\z", 1)
    numbered = known.withColumn("ord", F.row_number().over(in_order).cast("long") - 1).withColumn("nth", F.row_number().over(seen))
    fault = F.when(last == "", "blank").when(F.col("nth") > 1, "duplicate").when(~last.rlike(r"[.!?]"), "truncated")
    initial = F.substring("role", 1, 1)
    kept = F.when(initial.isin("s", "u", "a"), initial)
    code = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", F.coalesce(F.upper(kept), F.lit(LATE_NO_INITIAL)))
    return numbered.withColumn("fault", fault).select(
        "conv_id", "ord", "turn", "role", "text", "fault", F.coalesce(code, kept, F.lit(NO_INITIAL)).alias("code")
    )


def row_edits(code: str) -> list[tuple[int, str, str]]:
    """(cost, letter, role initial or '') of what can be done to a row."""
    if code == MUST_GO:
        return [(DELETE, "D", "")]
    late = TRUNCATED if code == LATE_NO_INITIAL or code.isupper() else 0
    own = code.lower()
    keep = [(late, "K", own)] if own in "sua" else []
    return [(DELETE, "D", ""), *keep, (RELABEL + late, "R", "u"), (RELABEL + late, "R", "a")]


@lru_cache(maxsize=1 << 18)
def solve(codes: str, first: bool, last: bool) -> tuple[tuple[int, int, int, str], ...]:
    """(state before, state after, cost, letters) of the cheapest edits of a block of rows.

    The first block starts at START, others anywhere; rows are inserted before a row of the block or, in the last block, at its end.
    """
    width = (INSERTED + 1) * (len(codes) + 1)
    digit = {letter: LETTERS.index(letter) for letter in "DIKR"}
    unit = 1 << (BITS * width)

    def weight(cost: int, letter: str, place: int) -> int:
        return cost * unit + (digit[letter] << (BITS * (width - 1 - place)))

    def better(nodes: dict[int, tuple[int, int]], state: int, sum_: int, length: int) -> None:
        if state not in nodes or sum_ < nodes[state][0]:
            nodes[state] = (sum_, length)

    def with_inserted(nodes: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
        every, layer = dict(nodes), nodes
        for _ in range(INSERTED):
            following: dict[int, tuple[int, int]] = {}
            for state, (sum_, length) in layer.items():
                for initial in "ua":
                    if (state, initial) in NEXT:
                        better(following, NEXT[state, initial], sum_ + weight(INSERT, "I", length), length + 1)
            for state, (sum_, length) in following.items():
                better(every, state, sum_, length)
            layer = following
        return every

    found = []
    for begin in (START,) if first else (START, S, U, A):
        nodes = {begin: (0, 0)}
        for code in codes:
            after: dict[int, tuple[int, int]] = {}
            for state, (sum_, length) in with_inserted(nodes).items():
                for cost, letter, initial in row_edits(code):
                    to = state if not initial else NEXT.get((state, initial))
                    if to is not None:
                        better(after, to, sum_ + weight(cost, letter, length), length + 1)
            nodes = after
        for state, (sum_, length) in (with_inserted(nodes) if last else nodes).items():
            letters = "".join(LETTERS[(sum_ >> (BITS * (width - 1 - place))) & ((1 << BITS) - 1)] for place in range(length))
            found.append((begin, state, sum_ // unit, letters))
    return tuple(found)


def put_together(left: tuple, right: tuple) -> tuple[tuple[int, int, int, str], ...]:
    """The table of two neighbouring blocks from those of each."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for begin, middle, cost, letters in left:
        for begins, end, more, further in right:
            if begins == middle and ((begin, end) not in best or cost + more <= best[begin, end][0]):
                made = (cost + more, letters + further)
                best[begin, end] = min(made, best.get((begin, end), made))
    return tuple((*ends, *made) for ends, made in best.items())


def decide(tables: list[tuple]) -> tuple[int, str]:
    """Cost and letters of a whole conversation, from the tables of its blocks in order."""
    while len(tables) > 1:
        pairs = [put_together(a, b) for a, b in zip(tables[::2], tables[1::2])]
        tables = pairs + tables[len(pairs) * 2 :]
    return min((cost, letters) for begin, end, cost, letters in tables[0] if begin == START and end in ENDS)


def _same(a: object, b: object) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))


def plans(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, block, cost, letters): per block of rows the letters of its edits, and the cost of the whole conversation."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    # Ids go through Python as text, where a NULL doesn't turn the others into floating point.
    coded = rows.select(F.col("conv_id").cast("string").alias("id"), F.floor(F.col("ord") / block).alias("block"), "ord", "code")
    blocks = coded.groupBy("id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "code"))), lambda x: x["code"]), "").alias("codes"))
    last = F.max("block").over(Window.partitionBy("id")) == F.col("block")
    spread = blocks.withColumn("last", last).repartition("id", "block")

    def tables(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            solved = [solve(codes, at == 0, bool(end)) for codes, at, end in zip(part["codes"], part["block"], part["last"])]
            written = [";".join(f"{begin} {end} {cost} {letters}" for begin, end, cost, letters in moves) for moves in solved]
            yield part[["id", "block"]].assign(n=part["codes"].str.len(), moves=written)

    solved = spread.mapInPandas(tables, "id string, block long, n long, moves string")

    def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: list[tuple] = []  # blocks of one conversation
        out: list[tuple] = []

        def close() -> None:
            cost, letters = decide([moves for _, _, _, moves in own])
            at = 0
            for i, (name, number, n, _) in enumerate(own):
                end, left = at, n
                while left:
                    left -= letters[end] != "I"
                    end += 1
                end = len(letters) if i == len(own) - 1 else end
                out.append((name, number, cost, letters[at:end]))
                at = end

        for part in parts:
            for name, number, n, moves in zip(part["id"], part["block"], part["n"], part["moves"]):
                if own and not _same(own[0][0], name):
                    close()
                    own = []
                own.append((name, number, n, tuple((int(a), int(b), int(c), letters) for a, b, c, letters in (m.split(" ") for m in moves.split(";")))))
            yield pd.DataFrame(out, columns=["id", "block", "cost", "letters"])
            out = []
        if own:
            close()
        yield pd.DataFrame(out, columns=["id", "block", "cost", "letters"])

    decided = solved.repartition("id").sortWithinPartitions("id", "block").mapInPandas(whole, "id string, block long, cost long, letters string")
    return decided.select(F.col("id").cast(id_type).alias("conv_id"), "block", "cost", "letters")


class _Walk:
    """Follows the rows of one conversation with their edits and tells each row of the repaired one."""

    def __init__(self) -> None:
        self.state, self.letters, self.at = START, "", 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.at += 1
            yield self.step("a" if self.state == U else "u"), "", "I"

    def step(self, initial: str) -> str:
        self.state = NEXT[self.state, initial]
        return ROLE.get(initial, "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self.step(role[:1])
            yield role, text, "K"
        elif letter == "R":
            yield self.step("a" if self.state == U else "u"), text, "R"


def _walked(rows: DataFrame, decided: DataFrame, block: int, made: Callable[[Iterator], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Streams (id, repaired rows) of each conversation, in order, to ``made``."""
    own = rows.select(F.col("conv_id").cast("string").alias("id"), F.floor(F.col("ord") / block).alias("block"), F.lit(1).alias("kind"), "ord", "role", "text")
    edits = decided.select(
        F.col("conv_id").cast("string").alias("id"), "block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("ord"),
        F.lit("").alias("role"), F.col("letters").alias("text"),
    )
    both = own.unionByName(edits).repartition("id").sortWithinPartitions("id", "block", "kind", "ord")

    def repaired(parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """(True, id, '', '', '') opens a conversation; (False, id, role, text, letter) is a row of it."""
        walk, open_, current = _Walk(), False, None
        for part in parts:
            for name, kind, role, text in zip(part["id"], part["kind"], part["role"], part["text"]):
                if not open_ or not _same(name, current):
                    if open_:
                        yield from ((False, current, *row) for row in walk.inserted())
                    walk, open_, current = _Walk(), True, name
                    yield True, name, "", "", ""
                if kind == 0:
                    walk.letters, walk.at = walk.letters[walk.at :] + text, 0
                else:
                    yield from ((False, name, *row) for row in walk.row(role, text))
        if open_:
            yield from ((False, current, *row) for row in walk.inserted())

    return both.mapInPandas(lambda parts: made(repaired(parts)), schema)


def repaired_rows(rows: DataFrame, decided: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, position, role, text, edit): the repaired conversations, ``rows`` from ``ordered`` and ``decided`` from ``plans``."""

    def made(found: Iterator) -> Iterator[pd.DataFrame]:
        out, position = [], 0
        for opens, name, role, text, letter in found:
            if opens:
                position = 0
                continue
            out.append((name, position, role, text, letter))
            position += 1
            if len(out) >= 4096:
                yield pd.DataFrame(out, columns=["id", "position", "role", "text", "edit"])
                out = []
        yield pd.DataFrame(out, columns=["id", "position", "role", "text", "edit"])

    walked = _walked(rows, decided, block, made, "id string, position long, role string, text string, edit string")
    return walked.select(F.col("id").cast(rows.schema["conv_id"].dataType).alias("conv_id"), "position", "role", "text", "edit")


def repaired_digests(rows: DataFrame, decided: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired rows as ``role:text``, joined by line feeds."""

    def made(found: Iterator) -> Iterator[pd.DataFrame]:
        out, digest, name, begun, empty = [], hashlib.sha256(), None, False, True
        for opens, own, role, text, _ in found:
            if opens:
                if begun:
                    out.append((name, digest.hexdigest()))
                digest, name, begun, empty = hashlib.sha256(), own, True, True
                if len(out) >= 4096:
                    yield pd.DataFrame(out, columns=["id", "repaired_sha256"])
                    out = []
                continue
            digest.update((("" if empty else "\n") + role + ":" + text).encode())
            empty = False
        if begun:
            out.append((name, digest.hexdigest()))
        yield pd.DataFrame(out, columns=["id", "repaired_sha256"])

    walked = _walked(rows, decided, block, made, "id string, repaired_sha256 string")
    return walked.select(F.col("id").cast(rows.schema["conv_id"].dataType).alias("conv_id"), "repaired_sha256")


def counts(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal) per conversation of ``ordered`` rows."""
    along = Window.partitionBy("conv_id").orderBy("ord")
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(along), initial)
    told = rows.select("conv_id", "turn", "fault", pair.alias("pair"), (~F.col("turn").eqNullSafe(F.lag("turn").over(along))).alias("new_turn"))
    number = lambda condition: F.count(F.when(condition, 1))
    span = F.max("turn") - F.min("turn") + 1 - number(F.col("new_turn") & F.col("turn").isNotNull())
    return told.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"),
        *(number(F.col("fault") == kind).alias(kind) for kind in ("blank", "duplicate", "truncated")),
        number(F.col("pair").isNotNull() & ~F.col("pair").isin("su", "ua", "au")).alias("illegal"),
    )


def report(rows: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per id of ``ids`` (conv_id): faults, cost and letters of the repair, and the digest of the repaired conversation."""
    sorted_rows = stage(ordered(rows), "conversation-rows")
    decided = stage(plans(sorted_rows, block), "conversation-plans")
    letters = decided.groupBy("conv_id").agg(
        F.first("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "letters"))), lambda x: x["letters"]), "").alias("audit"),
    )
    every = ids.select("conv_id").distinct().withColumnRenamed("conv_id", "id")
    out = every
    for part in (counts(sorted_rows), letters, repaired_digests(sorted_rows, decided, block)):
        out = out.join(part, F.col("id").eqNullSafe(part["conv_id"]), "left").drop("conv_id")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.select(
        F.col("id").alias("conv_id"), *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the damage that crc32 of ``conv_id:turn`` modulo 20 names: 0 dropped, 1 emptied, 2 without ``.!?``, 3 twice, 4 as user."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(told("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.select("conv_id", "turn", "role", "text", kind.alias("kind")).filter("kind <> 0")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")
