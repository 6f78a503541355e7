"""N-gram Jaccard join with set-relation skipping, and the classes it links.

A document's set holds the 64-bit hashes of its distinct five-word shingles; two documents link at a Jaccard similarity of 0.8 or more. Exact, and
without ever listing the pairs of a group:

1. Documents with one text are one set. A set of which more than a fifth occurs in no other set can't link. A fixed range of the
   hash values shows this for nearly all documents from a fraction of their shingles; the others are then counted in full.
2. What is left enters an inverted index by its prefix: in an order that puts shingles of one set alone first and then goes by hash, any
   two linked sets share one of their first ``n // 5 + 1`` shingles. A list is cut into blocks by set size, so that sets whose sizes exclude
   a link never meet. With u shingles of its own, a set's similarity to another is bounded from above:
   ``min(n_x - u_x, n_y - u_y) >= 0.8 * max(n_x + u_y, n_y + u_x)`` must hold for a link.
3. Answers are derived from those of a highly similar set. Each block has a leader, the set whose prefix is in the longest lists,
   and all others are compared with it; what links to it has the leader's class. In a second round the sets outside that class follow a leader
   of their own.
4. Only sets of one block in different classes can add anything, at least one of them outside the first leader's class. A set near that leader l is kept
   as what it lacks of l and what it has beside l, and two such sets' intersection follows from these short lists and l's answers alone:
   ``o_x + o_y - n_l + |lacks_x & lacks_y| + |beside_x & beside_y|``, with o shingles in common with l. So the pairs of a group of near copies are
   decided where they meet, and only links leave the join. Sets further from their leader (over ``NEAR`` shingles) share
   at most ``min(o_x, o_y) + min(n_x - o_x - u_x, n_y - o_y - u_y)``. And in the list of the first shingle that two sets share,
   whatever stands before it is in one of them alone: there the bound of step 2 holds with u plus the position
   in place of u. Lists are cut into sub-blocks by that sum: whole sub-blocks that it excludes are skipped, in the rest the bounds are
   checked, and what passes is compared set by set.
5. Classes are contracted round by round; every round each class joins the neighbour with the most links or, by turns, the smallest random number, so
   stars around a leader take one round and chains shrink by a constant factor.

All group sizes are handled by joins and partial aggregates over rows, none by one task. Two equal hashes of different shingles would need
about 2**32 distinct shingles in the two documents compared.

Defined cases: NULL and empty texts and texts without words have the empty set and link with nothing, their class is their own id; texts under five words
are one shingle; rows of one id share a class and keep their own shingle count; a NULL id links with nothing and has a NULL class; an empty
table gives an empty table; other columns than doc_id and text don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from volpanel.llm.common import fresh_name, small_batches, text_digest
from volpanel.session import stage, stage_alone

WIDTH = 5
#: Share of the hash values that the first count looks at.
FIRST_LOOK = 0.3
ROUNDS = 60
#: A set is told by its differences from a leader if it lacks so many of the leader's shingles, and has so many others, at most.
NEAR = 64


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word; hashing one costs less than looking it up in a table of known words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, as signed numbers."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not len(words):
        return np.empty(0, np.int64)
    width = min(WIDTH, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ words[i : len(words) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


@F.pandas_udf(ArrayType(LongType()))
def shingle_set(text: pd.Series) -> pd.Series:
    return pd.Series([shingles(t) for t in text], dtype=object)


@F.pandas_udf(StructType([StructField("n", LongType()), StructField("low", ArrayType(LongType()))]))
def first_look(text: pd.Series) -> pd.DataFrame:
    """Size of each text's set, and the part of it in the lowest share of the hash range."""
    limit = int(-(1 << 63) + FIRST_LOOK * (1 << 64))
    sizes, low = [], []
    for t in text:
        found = shingles(t)
        sizes.append(len(found))
        low.append(found[: np.searchsorted(found, limit)].copy())  # a view would hold the whole set
    return pd.DataFrame({"n": sizes, "low": low})


def own_shingles(rows: DataFrame) -> DataFrame:
    """Rows (h, node) whose h is in one row only."""
    return rows.groupBy("h").agg(F.count("*").alias("times"), F.min("node").alias("node")).where("times = 1").select("h", "node")


def _may_link(x: str, y: str, alone: str = "u") -> Column:
    """The bound of step 2 in whole numbers; ``alone`` counts shingles that the other set can't have."""
    return F.expr(
        f"5 * least({x}_n - {x}_{alone}, {y}_n - {y}_{alone}) >= 4 * greatest({x}_n + {y}_{alone}, {y}_n + {x}_{alone})"
    )


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) with the number of shingles they share and whether they link."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("a_tokens"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("b_tokens"))
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    both = F.size("a_tokens") + F.size("b_tokens")
    return (
        pairs.join(right, "b").join(left, "a")
        .select("a", "b", shared.alias("shared"), both.alias("both"))
        .select("a", "b", "shared", (F.expr("100 * shared >= 80 * (both - shared)")).alias("linked"))
    )


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Like ``_compared`` for leaders a and their sets b; also what b lacks of a and has beside it and its own shingles, where both are short."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("a_tokens"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("b_tokens"), F.col("own").alias("b_own"))
    counted = pairs.join(right, "b").join(left, "a").withColumn("shared", F.size(F.array_intersect("a_tokens", "b_tokens")))
    near = F.expr(f"size(a_tokens) - shared <= {NEAR} AND size(b_tokens) - shared - size(b_own) <= {NEAR}")
    return counted.select(
        "a", "b", "shared", F.expr("100 * shared >= 80 * (size(a_tokens) + size(b_tokens) - shared)").alias("linked"),
        F.when(near, F.array_except("a_tokens", "b_tokens")).alias("lacks"),
        F.when(near, F.array_except(F.array_except("b_tokens", "a_tokens"), "b_own")).alias("beside"),
    )


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes in the rows (a, b).

    A round gives each node one neighbour, or itself; one jump halves the chains that this makes, and the links are rewritten. Even rounds, the first
    one too, choose the node with the most links, which takes in a leader and all its sets at once, odd ones that with the smallest random number. Every
    node that is first among its neighbours survives and at least they vanish.
    """
    edges = stage(links.select("a", "b").where("a <> b").distinct(), "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    known = stage(nodes.withColumn("label", F.col("node")), "labels")
    for number in range(ROUNDS):
        if edges.isEmpty():
            break
        either = edges.union(edges.select("b", "a")).toDF("node", "other")
        random = F.xxhash64("other", F.lit(number))
        if number % 2:
            order = random
            choices = either.union(either.select("node", "node").distinct())
        else:
            degrees = stage(either.groupBy("node").agg(F.count("*").alias("links")), "degrees")
            order = F.struct(-F.col("links"), random)
            choices = either.join(degrees.toDF("other", "links"), "other").select("node", "other", "links").union(degrees.select("node", "node", "links"))
        best = stage(choices.groupBy("node").agg(F.min_by("other", order).alias("parent")), "parents")
        jump = best.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        roots = stage(best.join(jump, "parent").select("node", "root"), "roots")
        known = stage(
            known.join(roots.select(F.col("node").alias("label"), "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels"
        )
        a = roots.select(F.col("node").alias("a"), F.col("root").alias("a_root"))
        b = roots.select(F.col("node").alias("b"), F.col("root").alias("b_root"))
        moved = edges.join(a, "a").join(b, "b").where("a_root <> b_root")
        edges = stage(moved.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "links")
    else:
        raise RuntimeError(f"links are not contracted after {ROUNDS} rounds")
    least = known.groupBy("label").agg(F.min("node").alias("component"))
    return known.join(least, "label").select("node", "component")


def size_class(n: Column) -> Column:
    """Linked sets are at most one class apart."""
    return F.floor(F.log(n) / F.lit(math.log(1.25))).cast("int")


def _postings(sets: DataFrame) -> DataFrame:
    """Rows (token, block, node, n, u, p, entries) of lists with several entries; a set is in the blocks of its size class and of the next one.

    A set's own shingles come first in the order and are in no other list, so the prefix goes on with the smallest hashes of the rest;
    p is how many of the set's shingles come before the token.
    """
    prefix = F.expr("slice(array_except(tokens, own), 1, greatest(0, int(n div 5 + 1 - u)))")
    rows = (
        sets.select("node", "n", "u", size_class(F.col("n")).alias("class"), F.posexplode(prefix).alias("position", "token"))
        .select("token", F.explode(F.array("class", F.col("class") + 1)).alias("block"), "node", "n", "u", (F.col("u") + F.col("position")).alias("p"))
    )
    rows = stage(rows, "entries")
    sizes = rows.groupBy("token", "block").agg(F.count("*").alias("entries")).where("entries > 1")
    return rows.join(sizes, ["token", "block"])


def _leaders(postings: DataFrame) -> DataFrame:
    """token, block and l_node, l_n, l_u of the block's entry with the greatest rank."""
    best = postings.groupBy("token", "block").agg(*(F.max_by(c, "rank").alias(f"l_{c}") for c in ("node", "n", "u")))
    return best


def links(sets: DataFrame) -> DataFrame:
    """Links (a, b) between rows (node, n, u, own, tokens) that connect every class; not all links of a class are listed."""
    postings = stage(_postings(sets), "postings")
    # The small random part makes leaders unique, and the same ones in many lists.
    # Mean logarithm of the prefix's list lengths, 0 for own shingles.
    mean = F.sum(F.log2("entries")) / F.first(F.expr("n div 5 + 1"))
    centre = postings.groupBy("node").agg((mean + F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / F.lit(float(1 << 27))).alias("rank"))
    ranked = stage(postings.join(centre, "node").select("token", "block", "node", "n", "u", "p", "rank"), "postings")

    def led(entries: DataFrame, leaders: DataFrame) -> DataFrame:
        y = entries.select("token", "block", *(F.col(c).alias(f"y_{c}") for c in ("node", "n", "u")))
        pairs = y.join(leaders, ["token", "block"]).where("l_node <> y_node").where(_may_link("l", "y"))
        return pairs.select(F.col("l_node").alias("a"), F.col("y_node").alias("b")).distinct()

    def classed(df: DataFrame, classes: DataFrame, prefix: str) -> DataFrame:
        own = classes.select(F.col("node").alias(f"{prefix}_node"), F.col("component").alias(f"{prefix}_c"))
        return df.join(own, f"{prefix}_node", "left").withColumn(f"{prefix}_c", F.coalesce(f"{prefix}_c", f"{prefix}_node"))

    def outside(classes: DataFrame, leaders: DataFrame) -> DataFrame:
        entries = ranked.select("token", "block", *(F.col(c).alias(f"y_{c}") for c in ("node", "n", "u", "p")), "rank")
        both = classed(classed(entries.join(leaders, ["token", "block"]), classes, "y"), classes, "l")
        return both.where("y_c <> l_c")

    leaders = stage(_leaders(ranked), "leaders")
    measured = stage(_measured(led(ranked, leaders), sets), "compared")
    first = measured.where("linked").select("a", "b")
    classes = stage(components(first), "classes")

    left_out = stage(outside(classes, leaders).select("token", "block", F.col("y_node").alias("node"), F.col("y_n").alias("n"), F.col("y_u").alias("u"), "rank"), "outside")
    again = led(left_out, _leaders(left_out)).join(measured.select("a", "b"), ["a", "b"], "left_anti")
    second = stage(_compared(again, sets).where("linked").select("a", "b"), "links")
    classes = stage(components(first.union(second)), "classes")

    def with_leader(df: DataFrame, prefix: str) -> DataFrame:
        """Adds how much a set shares with its block's leader and its differences, none for the leader itself, NULL where they were not compared."""
        told = [F.col(c).alias(f"{prefix}_{n}") for c, n in (("b", "node"), ("shared", "o"), ("lacks", "lacks"), ("beside", "beside"))]
        found = df.join(measured.select(F.col("a").alias("l_node"), *told), ["l_node", f"{prefix}_node"], "left")
        leads, none = F.col("l_node") == F.col(f"{prefix}_node"), F.array().cast("array<long>")
        own = {f"{prefix}_o": F.col(f"{prefix}_n").cast("int"), f"{prefix}_lacks": none, f"{prefix}_beside": none}
        return found.withColumns({c: F.when(leads, v).otherwise(F.col(c)) for c, v in own.items()})

    asking = stage(
        with_leader(outside(classes, leaders), "y").select("token", "block", "l_n", "y_node", "y_n", "y_u", "y_p", "y_c", "y_o", "y_lacks", "y_beside")
        .withColumn("most", F.floor((F.col("y_n") - 5 * F.col("y_p")) / 4)).where("most >= 0"),
        "outside",
    )
    open_lists = asking.select("token", "block").distinct()
    x = ranked.join(open_lists, ["token", "block"]).join(leaders.select("token", "block", "l_node"), ["token", "block"])
    x = x.select("token", "block", "l_node", *(F.col(c).alias(f"x_{c}") for c in ("node", "n", "u", "p")))
    # Three short plans: in one, the driver would track all their shuffles at once.
    x = stage(classed(x, classes, "x").withColumn("part", F.floor(F.log2(F.col("x_p") + 1)).cast("int")), "listed")
    x = with_leader(x, "x")
    parts = F.sequence(F.lit(0), F.floor(F.log2(F.col("most") + 1)).cast("int"))
    through_leader = F.expr(
        "coalesce(9 * (least(x_o, y_o) + least(x_n - x_o - x_u, y_n - y_o - y_u)) >= 4 * (x_n + y_n), true)"
    )
    by_differences = F.expr(
        "x_lacks IS NULL OR y_lacks IS NULL OR "
        "9 * (x_o + y_o - l_n + size(array_intersect(x_lacks, y_lacks)) + size(array_intersect(x_beside, y_beside))) >= 4 * (x_n + y_n)"
    )
    third = (
        asking.withColumn("part", F.explode(parts)).join(x.drop("l_node"), ["token", "block", "part"])
        .where("x_c <> y_c AND x_p <= most").where(_may_link("x", "y", "p")).where(through_leader).where(by_differences)
        .where(F.col("block") == F.greatest(size_class(F.col("x_n")), size_class(F.col("y_n"))))  # of two common blocks, one is enough
        .select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    )
    third = stage(third, "pairs")
    return first.union(second).union(_compared(third, sets).where("linked").select("a", "b"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    looked = docs.select("doc_id", text_digest(F.col("text")).alias("digest"), first_look("text").alias("s"))
    spark = docs.sparkSession
    with small_batches(spark):
        rows = stage(looked.select("doc_id", "digest", F.col("s.n").alias("n"), F.col("s.low").alias("low")), "first-look")
    usable = rows.where("doc_id IS NOT NULL AND n > 0")
    representative = stage(usable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min("n").alias("n")), "representatives")
    # By text, as an id may have several.
    alone = own_shingles(usable.select(F.xxhash64("digest").alias("node"), F.explode("low").alias("h"))).groupBy(F.col("node").alias("told")).agg(F.count("*").alias("own"))
    candidates = stage(representative.join(alone, F.xxhash64("digest") == F.col("told"), "left").where("5 * coalesce(own, 0) <= n").select("node", "digest"), "candidates")
    same_row = (F.col("doc_id") == F.col("node")) & (text_digest(F.col("text")) == F.col("digest"))
    with small_batches(spark):
        held = stage(
            docs.select("doc_id", "text").join(candidates, same_row, "left_semi")
            .select(F.col("doc_id").alias("node"), F.xxhash64(text_digest(F.col("text"))).alias("told"), shingle_set("text").alias("tokens")),
            "sets",
        )
    # At most a fifth of a set that stays is its own, so these lists are short.
    alone = own_shingles(held.select(F.col("told").alias("node"), F.explode("tokens").alias("h"))).groupBy(F.col("node").alias("told")).agg(F.collect_list("h").alias("own"))
    own = F.coalesce("own", F.array().cast("array<long>"))
    sets = stage(
        held.join(alone, "told", "left").select("node", F.size("tokens").alias("n"), F.size(own).alias("u"), own.alias("own"), "tokens").where("5 * u <= n"),
        "sets",
    )
    # An id with several texts links them.
    texts = usable.join(representative.select("digest", "node"), "digest").select("doc_id", "node").distinct()
    least = texts.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("doc_id", "a")
    same_id = texts.join(least, "doc_id").select("a", F.col("node").alias("b"))
    found = components(links(sets).union(same_id))
    by_text = representative.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    return (
        rows.join(by_text, "digest", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, that of its smallest id, and all rows without an id; columns unchanged.

    Of several rows with the class's id the one with the smallest text hash stays.
    """
    rank, id_kept = fresh_name(docs, "rank"), fresh_name(docs, "id_kept")
    kept = stage_alone(docs.sparkSession, lambda: classes(docs).where("doc_id = component_id").select(F.col("doc_id").alias(id_kept)).distinct(), "kept")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64(*docs.columns))
    with_id = docs.join(kept, F.col("doc_id") == F.col(id_kept), "left_semi").withColumn(rank, F.row_number().over(first))
    return with_id.where(F.col(rank) == 1).drop(rank).unionByName(docs.where("doc_id IS NULL"))
