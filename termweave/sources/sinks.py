"""Where results go: stage checkpoints by method, kept indexes, result tables, score files."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.sources.terminology import exists

MATCHES = "row_id long, query string, rank int, concept_id string, text string, score double, source string"


def fingerprint(settings: dict[str, object]) -> str:
    """Short name of settings; part of a path, so that changed settings never meet old results."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def digest(df: DataFrame) -> str:
    """Rows and their hashes, in any order: differs when a table differs (by one aggregate over it)."""
    hashes = F.xxhash64(*[F.to_json(f.name) if f.dataType.typeName() in ("map", "struct") else F.col(f"`{f.name}`") for f in df.schema.fields])
    row = df.select(hashes.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1_000_003))).alias("s")).first()
    return f"{row['n']}-{row['x']}-{row['s']}"


class Checkpoints:
    """Each method's matches in a folder of their own, named by the method and its settings."""

    def __init__(self, spark: SparkSession, root: str, fresh: bool = False):
        self.spark, self.root, self.fresh = spark, root.rstrip("/"), fresh

    def path(self, method: str, settings: dict[str, object]) -> str:
        return f"{self.root}/method={method}/settings={fingerprint(settings)}"

    def done(self, method: str, settings: dict[str, object]) -> bool:
        return not self.fresh and exists(self.spark, self.path(method, settings) + "/_SUCCESS")

    def read(self, method: str, settings: dict[str, object]) -> DataFrame:
        return self.spark.read.parquet(self.path(method, settings))

    def once(self, method: str, settings: dict[str, object], make) -> DataFrame:
        """What is there, or what ``make`` gives, written first."""
        if not self.done(method, settings):
            make().write.mode("overwrite").parquet(self.path(method, settings))
        return self.read(method, settings)


def keep_index(postings: DataFrame, root: str, settings: dict[str, object], parts: int = 64) -> str:
    """Writes an n-gram index under a name made of its settings (n, cleaner, pool); returns the path."""
    path = f"{root.rstrip('/')}/ngrams-{fingerprint(settings)}"
    postings.repartition(parts, "ngram").sortWithinPartitions("ngram").write.mode("overwrite").parquet(path)
    return path


def write_results(df: DataFrame, path: str, drop: tuple[str, ...] = ("algorithm_ai_metadata",)) -> None:
    df.drop(*drop).write.mode("overwrite").parquet(path)


def write_scores(df: DataFrame, path: str) -> None:
    """The small table of method scores as one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_pools(pools: dict[str, DataFrame], root: str) -> None:
    """Each pool as a table of its own under ``root``."""
    for name, df in pools.items():
        df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}")


def read_pools(spark: SparkSession, root: str, names: tuple[str, ...] = ("short_terms", "definitions", "isa", "bm25_documents")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root.rstrip('/')}/{n}") for n in names}


def write_vectors(vectors: DataFrame, path: str, expected: int, rows: int = 100_000) -> None:
    """Vectors in files of at most ``rows`` rows; ValueError unless as many as expected were written."""
    vectors.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)
    written = vectors.sparkSession.read.parquet(path).count()
    if written != expected:
        raise ValueError(f"{written} vectors written, {expected} expected")


def read_texts(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The stored texts by key (key, ai_output), or None if there are none yet."""
    return spark.read.parquet(path) if path and exists(spark, f"{path.rstrip('/')}/_SUCCESS") else None
