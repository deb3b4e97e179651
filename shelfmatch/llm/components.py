"""Distributed union-find and bucket linking, in DataFrame operations only.

``components`` alternates large-star and small-star steps until the edges are stars around the least
least node of each component. A step is an aggregate and a join on the same key; a node with a 256th of all
edges or more (256 nodes at most) is joined by broadcast, so its neighbours stay spread. Below ``FEW`` edges, a task's work,
the same steps are taken without that, two to a job. Nothing is collected on the driver but a count and a checksum a step.

``link_buckets`` finds the components of "two members of one bucket that pass a test": each member is
tried against the bucket's least member, and then only members whose components still differ are tried
against each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmatch.llm._common import HOT_PARTS, drop, few, join_hot, release, store

SAMPLED = 64  # a node in so many is looked at to find hot keys
FEW = 1 << 20  # rows that one task may hold under one key
WIDE, PIVOTS, GAIN = 32, 4, 8  # of rounds of pivots
SPLIT = 512  # members of a bucket to a task in the last step


def _star(edges: DataFrame, both: bool, n_edges: int) -> DataFrame:
    """One step on stored ``edges(a, b)`` with a > b. Large (both directions): the larger neighbours of
    each node go to its least neighbour; small: the node and its smaller neighbours do."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        near = near.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    joined = near.join(least, "u") if n_edges < FEW else join_hot(near, least, "u", "n", n_edges * (2 if both else 1))
    if both:
        return joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    moved = joined.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` -> stored ``(node, root)`` for every node that has an edge; ``root`` is
    the least node of its component.

    Loops, repeated edges and either direction are allowed; null ends are ignored. No edges give an
    empty table.
    """
    now = store(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _state(now)
    while seen[0]:
        large = _star(now, True, seen[0]).distinct()
        if seen[0] >= FEW:
            large = store(large, "edges")
        small = store(_star(large, False, seen[0]).distinct(), "edges")  # a large step adds no edges
        drop(now, *([large] if seen[0] >= FEW else []))
        now = small
        if seen == (seen := _state(now)):
            break
    out = store(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "components")
    drop(now)
    release(out.sparkSession)
    return out


def _hot_keys(members: DataFrame, total: int) -> list[int]:
    """Keys that hold about a 256th of all members or more, from every 64th node. They only decide how
    a key's members are joined, not which pairs are tried, so a miss costs time and no pair."""
    if total < FEW:
        return []
    some = members.filter(F.pmod(F.xxhash64(F.lit(SAMPLED), "node"), F.lit(SAMPLED)) == 0)
    often = some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(8, total // SAMPLED // HOT_PARTS))
    return [r["key"] for r in often.select("key").collect()]


def _with_first(members: DataFrame) -> DataFrame:
    """``<=>`` infers no filter on one side alone, so both sides are one and the same exchange."""
    least = members.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last").select("key", "first")
    return members.join(least.hint("shuffle_hash"), "key").filter("not (node <=> first)").select("key", "first", "node")


def _rooted(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))


def _several(rooted: DataFrame) -> DataFrame:
    """Stored ``key, node, root, n`` of the buckets whose members are of several components."""
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi").select("key", "n")
    return store(join_hot(rooted, mixed, "key", "n").filter("n is not null"), "several")


def _open_pairs(several: DataFrame) -> int:
    """Pairs of different components in buckets that are large enough for pivots."""
    each = several.filter(F.col("n") > WIDE).groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    return int(each.agg(F.coalesce(F.sum(F.col("c") * (F.col("n") - F.col("c"))), F.lit(0))).first()[0]) // 2


def pivots(several: DataFrame, keep: Callable[[DataFrame], DataFrame], small: int) -> tuple[list[DataFrame], DataFrame]:
    """Stored links that are found without listing pairs, and what is left of stored members ``(key, node, root, n)`` with their roots by these links.

    A round tries all members of a bucket of more than ``WIDE`` against ``PIVOTS`` of them, others each time, so a large group of members that
    are alike becomes one component by few links. Rounds end when no more than ``small`` pairs of different components are left, or
    no more than so many links are to be expected among them, or a round takes less than a ``GAIN``-th off them; all are the caller's to try."""
    links, now, left = [], several, _open_pairs(several)
    while left > small:
        order = [F.struct(F.xxhash64(F.lit(len(links) * PIVOTS + i), "node").alias("o"), "node", "root") for i in range(PIVOTS)]
        chosen = now.filter(F.col("n") > WIDE).groupBy("key").agg(F.array_distinct(F.array(*[F.min(o) for o in order])).alias("p"), F.first("n").alias("size"))
        other = F.filter("p", lambda p: p["root"] != F.col("root"))  # before they are rows
        met = join_hot(now, chosen, "key", "size").filter("p is not null").select("node", F.explode(other).alias("p"))
        tried = store(met.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct(), "pairs")
        found, n_tried = keep(tried), tried.count()
        drop(tried)
        links.append(found)
        if left * found.count() <= small * n_tried:
            break
        labels = components(found.select("a", "b").unionAll(now.filter("node <> root").select("node", "root").distinct()))
        rooted = store(_rooted(now.select("key", "node"), labels), "rooted")
        drop(labels, *([] if now is several else [now]))
        now = _several(rooted)
        drop(rooted)
        if (were := left) - (left := _open_pairs(now)) < were // GAIN:
            break
    return links, now


def link_buckets(members: DataFrame, total: int, keep: Callable[[DataFrame], DataFrame], among: Callable[[DataFrame], DataFrame] | None = None, prepare: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """``members(key long, node long)``, ``total`` of them, no row twice -> ``(node, root)`` of all nodes that are linked to another.

    ``keep`` gets stored candidate pairs ``(a, b)`` and returns those that are links. ``among`` gets the
    members ``(key, node, root, n)`` of buckets whose members are of several components, ``n`` being the
    bucket's size, and returns at least all links ``(a, b)`` among members of one bucket and of different
    components; by default it lists those pairs for ``keep``. So two nodes of a bucket that link end up
    with one root, whatever the bucket's size. ``prepare`` is called once, before the others, with the stored rows ``(key, first, node)``
    of all buckets of two members or more. ``members`` is computed twice, so it should be
    cheap to derive from a stored table; it is dealt by key once, but for hot keys, whose members stay
    where they are and meet the key's least member by broadcast.
    """
    spark = members.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = _hot_keys(members, total)
    rest = members.filter(~F.col("key").isin(hot)) if hot else members
    tried = _with_first(rest.repartition(parts, "key"))
    if hot:
        at_hot = members.filter(F.col("key").isin(hot))
        least = at_hot.groupBy("key").agg(F.min("node").alias("first"))  # as many as hot keys
        tried = tried.unionByName(at_hot.join(F.broadcast(least), "key").filter("node <> first").select("key", "first", "node"))
    tried = store(few(tried), "tried")
    release(spark)
    if prepare is not None:
        prepare(tried)
    pairs = store(tried.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = store(keep(pairs).select("a", "b"), "links")
    drop(pairs)
    labels = components(links)
    drop(links)
    all_of = tried.select("key", "node").unionAll(tried.select("key", F.col("first").alias("node")).distinct())
    rooted = store(_rooted(all_of, labels), "rooted")
    drop(tried)
    several = _several(rooted)
    drop(rooted)
    release(spark)
    if among is None:
        x, y = several.toDF("key", "a", "ra", "n"), several.toDF("key", "b", "rb", "_n")
        found = keep(store(x.join(y, "key").filter("a < b and ra <> rb").select("a", "b").distinct(), "pairs"))
    else:
        found = among(several)
    more = store(found.select("a", "b"), "links")
    drop(several)
    if more.isEmpty():
        return labels
    out = components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))
    drop(labels, more)
    return out


def meet(members: DataFrame, condition) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of stored members ``(key, node, root, n, ...)`` of one bucket and different
    components that meet ``condition(x, y)`` (the two rows' columns by name). It is evaluated in the join, so pairs that don't
    meet it are never rows. Buckets of more than ``SPLIT`` members are spread over a task for every ``SPLIT`` of them."""
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    ends = lambda joined: joined.select(x("node").alias("a"), y("node").alias("b"))
    on = (x("key") == y("key")) & (x("node") < y("node")) & (x("root") != y("root"))
    small = members.filter(F.col("n") <= SPLIT).repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")  # dealt once for both sides
    out = ends(small.alias("x").hint("merge").join(small.alias("y"), on & condition(x, y)))
    large = members.filter(F.col("n") > SPLIT)
    spread = (F.floor(F.col("n") / SPLIT) + 1).cast("int")
    one = large.withColumn("part", F.explode(F.sequence(F.lit(0), spread - 1))).alias("x")
    other = large.withColumn("part", F.pmod(F.xxhash64("node"), spread).cast("int")).alias("y")
    return out.unionAll(ends(one.hint("merge").join(other, (x("part") == y("part")) & on & condition(x, y))))
