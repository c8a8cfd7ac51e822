"""Ancestors, common ancestors and relatedness in an is-a graph given as edges (child, parent)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.operators.topk import ranked
from termweave.sources.settled import settled, spread

IS_A = "116680003"  # fixed value: the relationship type "is a"


def edges(relationships: DataFrame, is_a: str = IS_A) -> DataFrame:
    """Active is-a edges of a raw relationship table (both ends are taken as they are)."""
    good = relationships.where((F.col("active") == "1") & (F.col("typeId") == is_a) & F.col("sourceId").isNotNull() & F.col("destinationId").isNotNull())
    return good.select(F.col("sourceId").cast("string").alias("child"), F.col("destinationId").cast("string").alias("parent")).distinct()


def ancestors(starts: DataFrame, isa: DataFrame, max_depth: int | None = 3, include_self: bool = True, start: str = "concept_id") -> DataFrame:
    """(concept_id, ancestor, distance) with the shortest distance of each ancestor of the given concepts.

    Hop by hop from the starts, so only their part of the graph is touched; pairs already reached are not followed
    again, which also ends cycles. ``max_depth=None`` goes on until nothing new appears, however far that is. Each hop is a
    written table, so plans stay small at any depth. A concept outside the graph has only itself. Null starts are left out.
    """
    isa = settled(isa.select("child", "parent").where("child is not null and parent is not null").distinct())
    first = starts.select(F.col(start).cast("string").alias("concept_id")).where("concept_id is not null").distinct()
    front = settled(first.select("concept_id", F.col("concept_id").alias("ancestor"), F.lit(0).alias("distance")))
    reached, hop = front, 0
    while max_depth is None or hop < max_depth:
        hop += 1
        step = front.join(isa, front["ancestor"] == isa["child"]).select("concept_id", F.col("parent").alias("ancestor")).distinct()
        front = settled(step.join(reached.select("concept_id", "ancestor"), ["concept_id", "ancestor"], "left_anti").withColumn("distance", F.lit(hop)))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached if include_self else reached.where("distance > 0")


def ancestors_few_hops(starts: DataFrame, isa: DataFrame, max_depth: int, start: str = "concept_id") -> DataFrame:
    """The same for depths of up to three by joins over edges written once.

    Each concept's parents are looked up once, and the way on from a parent is found once for all concepts below it. So no
    join has a key with more rows than a concept has children, and what is made stays with its concept.
    """
    if max_depth > 3:
        return ancestors(starts, isa, max_depth, True, start)
    isa = settled(isa.select("child", "parent").where("child is not null and parent is not null"))
    first = starts.select(F.col(start).cast("string").alias("concept_id")).where("concept_id is not null").distinct()
    return _climb(first, spread(isa, "child"), isa, max_depth)


def _climb(nodes: DataFrame, near: DataFrame, isa: DataFrame, depth: int) -> DataFrame:
    """(concept_id, ancestor, distance) of distinct ``nodes`` up to ``depth`` hops, themselves at 0. ``near``: ``isa`` as the
    nodes' own edges are taken from it. An edge may be there more than once."""
    own = nodes.select("concept_id", F.col("concept_id").alias("ancestor"), F.lit(0).alias("distance"))
    if depth < 1:
        return own
    step = near.join(nodes, F.col("child") == F.col("concept_id")).select("concept_id", "parent")
    if depth == 1:
        far = step.select("concept_id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    else:
        above = settled(step.select(F.col("parent").alias("concept_id")).distinct())
        upper = settled(_climb(above, isa, isa, depth - 1))
        upper = upper.select(F.col("concept_id").alias("parent"), "ancestor", (F.col("distance") + 1).alias("distance"))
        far = step.join(upper, "parent")
    nearest = far.where("ancestor <> concept_id").groupBy("concept_id", "ancestor").agg(F.min("distance").alias("distance"))
    return own.unionByName(nearest)


def common_ancestors(pairs: DataFrame, isa: DataFrame, max_depth: int = 3, a: str = "a", b: str = "b", order: str = "total_max", limit: int | None = None) -> DataFrame:
    """(a, b, ancestor, distance_a, distance_b, total_distance, rank) of each distinct pair, nearest first.

    Each side is at most ``max_depth`` away. Order: (total, larger distance, id), or with ``order="total_a_b"`` (total,
    distance_a, distance_b, id).
    """
    known = pairs.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).where("a is not null and b is not null").distinct()
    starts = known.select(F.col("a").alias("concept_id")).union(known.select("b")).distinct()
    closure = ancestors_few_hops(starts, isa, max_depth)
    left = closure.select(F.col("concept_id").alias("a"), "ancestor", F.col("distance").alias("distance_a"))
    right = closure.select(F.col("concept_id").alias("b"), "ancestor", F.col("distance").alias("distance_b"))
    both = known.join(left, "a").join(right, ["b", "ancestor"]).withColumn("total_distance", F.col("distance_a") + F.col("distance_b"))
    keys: list[Column] = [F.col("total_distance")]
    keys += [F.greatest("distance_a", "distance_b")] if order == "total_max" else [F.col("distance_a"), F.col("distance_b")]
    return ranked(both, ["a", "b"], [*keys, F.col("ancestor")], limit).select("a", "b", "ancestor", "distance_a", "distance_b", "total_distance", "rank")


def nearest_common_ancestor(pairs: DataFrame, isa: DataFrame, max_depth: int = 3, a: str = "a", b: str = "b") -> DataFrame:
    return common_ancestors(pairs, isa, max_depth, a, b, limit=1).drop("rank")


def related(pairs: DataFrame, isa: DataFrame, max_depth: int = 3, mode: str = "common_ancestor", a: str = "a", b: str = "b") -> DataFrame:
    """(a, b, related) of each distinct pair. Equal ids are related, a null never is.

    mode "common_ancestor": some ancestor (or self) within ``max_depth`` of each, so siblings count; mode "lineage": one is
    an ancestor of the other within ``max_depth``.
    """
    if mode not in ("common_ancestor", "lineage"):
        raise ValueError(f"unknown mode {mode!r}")
    known = pairs.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).distinct()
    full = known.where("a is not null and b is not null")
    starts = full.select(F.col("a").alias("concept_id")).union(full.select("b")).distinct()
    closure = ancestors_few_hops(starts, isa, max_depth)
    if mode == "lineage":
        up = closure.select(F.col("concept_id").alias("a"), F.col("ancestor").alias("b"))
        hit = full.join(up, ["a", "b"], "left_semi").unionByName(full.join(up.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_semi"))
    else:
        left = closure.select(F.col("concept_id").alias("a"), "ancestor")
        right = closure.select(F.col("concept_id").alias("b"), "ancestor")
        hit = full.join(left, "a").join(right, ["b", "ancestor"], "left_semi").select("a", "b")
    marked = hit.distinct().select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = known.join(marked, F.col("a").eqNullSafe(F.col("x")) & F.col("b").eqNullSafe(F.col("y")), "left")
    return both.select("a", "b", F.coalesce(F.col("x").isNotNull() | (F.col("a") == F.col("b")), F.lit(False)).alias("related"))
