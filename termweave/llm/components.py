"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.shared import Scratch


def _are_stars(links: DataFrame) -> bool:
    """Whether every u has one v, and no v is itself a u: then each v is the name of its component."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
    seen = ends.groupBy("node").agg(F.sum("as_u").alias("as_u"), F.max("as_v").alias("as_v"))
    return seen.where("as_u > 1 or as_u = 1 and as_v = 1").count() == 0


def components(links: DataFrame, scratch: Scratch, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b), component being the smallest node reachable.

    Every step keeps at most as many links as there were; a node of very many links is met by partial aggregates and
    a join. Rounds grow with the logarithm of the longest chain. Each round is a written table.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.keep(links, f"{name}-0")
    for k in range(1, max_rounds + 1):
        if _are_stars(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    else:
        raise RuntimeError(f"no stars after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
