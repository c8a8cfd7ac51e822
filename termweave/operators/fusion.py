"""Fusing several methods' ranked lists into one hierarchy-aware consensus, and comparing them side by side.

Matches are long: row_id, query, method, rank, concept_id, text, score. Everything is kept by row_id, so rows with equal
queries stay apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.functions.prompts import METHODS
from termweave.operators import hierarchy
from termweave.operators.topk import ranked
from termweave.sources.settled import settled



def votes(matches: DataFrame, top_k: int = 3, methods: Sequence[str] = METHODS) -> DataFrame:
    """(row_id, concept_id, points, n_methods, methods, text, ord) of each candidate.

    A match at rank r of the first ``top_k`` gives top_k - r + 1 points (integers, so sums do not depend on order; the
    weight is points / top_k). A concept that one method lists twice gets both. ``text`` is its first one by method order
    and rank; ``ord`` numbers a row's candidates by first appearance, from 0.
    """
    place = F.coalesce(*[F.when(F.col("method") == m, F.lit(i)) for i, m in enumerate(methods)])
    good = matches.where((F.col("rank") <= top_k) & F.col("method").isin(*methods) & F.col("concept_id").isNotNull())
    first = F.struct(place.alias("m"), F.col("rank"))
    out = good.groupBy("row_id", "concept_id").agg(F.sum(F.lit(top_k + 1) - F.col("rank")).cast("int").alias("points"), F.array_sort(F.collect_set("method")).alias("methods"), F.min_by("text", first).alias("text"), F.min(first).alias("seen"))
    return out.withColumn("ord", F.row_number().over(W.partitionBy("row_id").orderBy("seen", "concept_id")) - 1).select("row_id", "concept_id", "points", F.size("methods").alias("n_methods"), "methods", "text", "ord")


def clusters(candidates: DataFrame, isa: DataFrame | None, max_depth: int = 3) -> DataFrame:
    """``candidates`` with ``cluster``: the least ord among candidates connected by relatedness (transitively).

    A row has at most methods x top_k candidates, so its few related pairs are folded over a label array inside the row.
    """
    if isa is None:
        return candidates.withColumn("cluster", F.col("ord"))
    candidates = settled(candidates)
    left = candidates.select("row_id", F.col("concept_id").alias("a"), F.col("ord").alias("i"))
    right = candidates.select("row_id", F.col("concept_id").alias("b"), F.col("ord").alias("j"))
    pairs = settled(left.join(right, "row_id").where("i < j"))
    linked = hierarchy.related(pairs, isa, max_depth).where("related")
    found = pairs.join(linked, ["a", "b"]).groupBy("row_id").agg(F.collect_set(F.struct("i", "j")).alias("links"))
    sized = candidates.groupBy("row_id").agg(F.max("ord").alias("last")).join(found, "row_id")
    labels = sized.withColumn(
        "labels",
        F.aggregate(
            "links",
            F.sequence(F.lit(0), F.col("last")),
            lambda acc, e: F.transform(acc, lambda x: F.when((x == F.get(acc, e["i"])) | (x == F.get(acc, e["j"])), F.least(F.get(acc, e["i"]), F.get(acc, e["j"]))).otherwise(x)),
        ),
    ).select("row_id", "labels")
    return candidates.join(labels, "row_id", "left").withColumn("cluster", F.coalesce(F.get("labels", F.col("ord")), F.col("ord"))).drop("labels")


def cluster_ancestors(clustered: DataFrame, isa: DataFrame, max_depth: int = 3) -> DataFrame:
    """(row_id, cluster, ancestor, total_distance, max_distance): the nearest ancestor (or self) of all members of each
    cluster of two or more, by (total, max, id)."""
    sizes = clustered.groupBy("row_id", "cluster").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    inside = clustered.join(sizes, ["row_id", "cluster"])
    closure = hierarchy.ancestors_few_hops(inside.select("concept_id"), isa, max_depth)
    shared = inside.join(closure, "concept_id").groupBy("row_id", "cluster", "members", "ancestor").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").cast("int").alias("total_distance"), F.max("distance").alias("max_distance")).where("n = members")
    nearest = F.struct("total_distance", "max_distance", "ancestor")
    return shared.groupBy("row_id", "cluster").agg(F.min(nearest).alias("x")).select("row_id", "cluster", "x.ancestor", "x.total_distance", "x.max_distance")


def consensus(matches: DataFrame, isa: DataFrame | None = None, top_k: int = 3, final_top_k: int = 5, max_depth: int = 3, methods: Sequence[str] = METHODS) -> DataFrame:
    """Long consensus: row_id, rank, concept_id, text, source, cluster_points, concept_points, n_methods, methods, members,
    total_distance, max_distance.

    A cluster's points are its members' sum and its methods their union. Every member is a candidate
    (``exact_candidate``), and so is the members' nearest common ancestor unless it is a member itself
    (``common_ancestor``, no points of its own). Order: cluster points, own points, number of methods, then first
    appearance. The best ``final_top_k`` of each row stay. With no hierarchy every candidate is its own cluster.
    """
    grouped = settled(clusters(votes(matches, top_k, methods), isa, max_depth))
    per = W.partitionBy("row_id", "cluster")
    members = grouped.withColumns(
        {
            "cluster_points": F.sum("points").over(per).cast("int"),
            "cluster_methods": F.array_sort(F.array_distinct(F.flatten(F.collect_list("methods").over(per)))),
            "members": F.transform(F.array_sort(F.collect_list(F.struct("ord", "concept_id")).over(per)), lambda x: x["concept_id"]),
        }
    )
    none = F.lit(None).cast("int")
    columns = ("row_id", "concept_id", "text", "source", "cluster", "late", "ord", "cluster_points", "concept_points", "cluster_methods", "members", "total_distance", "max_distance")
    exact = members.select("*", F.lit("exact_candidate").alias("source"), F.lit(0).alias("late"), F.col("points").alias("concept_points"), none.alias("total_distance"), none.alias("max_distance")).select(*columns)
    every = exact
    if isa is not None:
        tops = cluster_ancestors(grouped, isa, max_depth)
        one = members.where(F.col("ord") == F.col("cluster")).select("row_id", "cluster", "cluster_points", "cluster_methods", "members")
        extra = one.join(tops, ["row_id", "cluster"]).where(~F.array_contains("members", F.col("ancestor")))
        every = exact.unionByName(
            extra.select("*", F.col("ancestor").alias("concept_id"), F.concat(F.lit("Common ancestor "), F.col("ancestor")).alias("text"), F.lit("common_ancestor").alias("source"), F.lit(1).alias("late"), F.lit(0).alias("ord"), F.lit(0).alias("concept_points")).select(*columns)
        )
    order = [F.desc("cluster_points"), F.desc("concept_points"), F.desc(F.size("cluster_methods")), F.col("cluster"), F.col("late"), F.col("ord")]
    best = ranked(every, ["row_id"], order, final_top_k)
    return best.select("row_id", "rank", "concept_id", "text", "source", "cluster_points", "concept_points", F.size("cluster_methods").alias("n_methods"), F.col("cluster_methods").alias("methods"), "members", "total_distance", "max_distance")


def final_candidates(rows: DataFrame, found: DataFrame, top_k: int = 3, query: str = "query") -> DataFrame:
    """One row for each input row (row_id, query): the winner and the lists of all kept candidates.

    A row without candidates has null ids, score 0, no methods and empty lists; its members and distances are null.
    """
    score = lambda c: F.bround(c / top_k, 3)
    item = F.struct(
        "rank",
        "concept_id",
        "text",
        "source",
        score(F.col("cluster_points")).alias("score"),
        "members",
        F.when(F.col("total_distance").isNotNull(), F.struct(F.col("total_distance").alias("total"), F.col("max_distance").alias("max"))).alias("distance"),
        "methods",
        "n_methods",
    )
    lists = found.groupBy("row_id").agg(F.sort_array(F.collect_list(item)).alias("c"))
    first = F.get("c", F.lit(0))
    pick = lambda name, kind: F.coalesce(F.transform("c", lambda x: x[name]), F.array().cast(kind))
    return rows.join(lists, "row_id", "left").select(
        "row_id",
        F.col(query).alias("test_name"),
        first["concept_id"].alias("final_concept_id"),
        first["text"].alias("final_match"),
        F.coalesce(first["score"], F.lit(0.0)).alias("support_score"),
        F.coalesce(first["n_methods"], F.lit(0)).alias("n_methods_agreeing"),
        F.coalesce(first["methods"], F.array().cast("array<string>")).alias("agreeing_methods"),
        pick("concept_id", "array<string>").alias("final_candidate_ids"),
        pick("text", "array<string>").alias("final_candidate_matches"),
        pick("score", "array<double>").alias("final_candidate_scores"),
        pick("source", "array<string>").alias("final_candidate_sources"),
        F.transform("c", lambda x: x["members"]).alias("final_candidate_cluster_members"),
        F.transform("c", lambda x: x["distance"]).alias("final_candidate_ancestor_distances"),
    )


def comparison(rows: DataFrame, matches: DataFrame, methods: Sequence[str] = METHODS, query: str = "query") -> DataFrame:
    """One row for each input row with every method's first match: {method}_concept_id, _match, _score (null if none)."""
    top = matches.where("rank = 1").groupBy("row_id").pivot("method", list(methods)).agg(F.first("concept_id").alias("concept_id"), F.first("text").alias("match"), F.first("score").alias("score"))
    named = [F.col(f"{m}_{c}") for m in methods for c in ("concept_id", "match", "score")]
    return rows.select("row_id", F.col(query).alias("test_name")).join(top, "row_id", "left").select("row_id", "test_name", *named)
