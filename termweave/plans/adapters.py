"""The driver's tables seen as a terminology: DataFrames here, the same as SQL in termweave.plans.oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.operators.hierarchy import IS_A
from termweave.sources.terminology import FULL_NAME, SYNONYM

PART_OF = "123005000"  # fixed value: another relationship type


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def concepts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_size") % 5 == 0, "0").otherwise("1").alias("active"))


def descriptions(spark: SparkSession, d: str) -> DataFrame:
    one = lambda kind, term: F.struct(F.lit(kind).alias("typeId"), term.alias("term"))
    rows = F.explode(F.array(one(FULL_NAME, F.col("p_name")), one(SYNONYM, F.col("p_type")), one("900000000000550004", F.col("p_brand")), one(SYNONYM, F.lit(None).cast("string"))))
    base = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("conceptId"), F.when(F.col("p_size") % 7 == 0, "0").otherwise("1").alias("active"), rows.alias("x"))
    return base.select("conceptId", "active", "x.*")


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("conceptId"), F.when(F.col("quality") == 1, "1").otherwise("0").alias("active"), F.concat(F.lit("quality "), F.col("quality"), F.lit(" toxic "), F.col("toxic")).alias("term"))


def relationships(spark: SparkSession, d: str) -> DataFrame:
    """Geography (supplier, nation, region) as is-a, customers as part of nations; every fifth supplier edge inactive."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("sourceId"), F.concat(F.lit("n"), "s_nationkey").alias("destinationId"), F.lit(IS_A).alias("typeId"), F.when(F.col("s_suppkey") % 5 == 0, "0").otherwise("1").alias("active"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.lit(IS_A), F.lit("1"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.lit(PART_OF), F.lit("1"))
    return s.union(n).union(c)


def places(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of the geography; region 0 and every seventh supplier are inactive."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 7 == 0, "0").otherwise("1").alias("active"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.lit("1"))
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey"), F.when(F.col("r_regionkey") == 0, "0").otherwise("1"))
    return s.union(n).union(r)


def geography(spark: SparkSession, d: str, parts: bool = True) -> DataFrame:
    """Edges part -> supplier -> nation -> region (one of a part is there once for each of its lines)."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("child"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))
    out = s.union(n)
    if parts:
        out = out.union(table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")))
    return out


def document_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges document -> source and document -> lang, and those -> corpus."""
    docs = table(spark, d, "documents")
    up = F.explode(F.array(F.concat(F.lit("source:"), "source"), F.concat(F.lit("lang:"), "lang")))
    low = docs.select(F.col("doc_id").cast("string").alias("child"), up.alias("parent")).where("parent is not null")
    return low.union(low.select(F.col("parent").alias("child"), F.lit("corpus").alias("parent")).distinct())


def fielded(spark: SparkSession, d: str) -> DataFrame:
    """Documents as term (first 80 characters) and definition (the whole rest)."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("concept_id"), F.substring(t, 1, 80).alias("term"), F.expr("substring(text, 81)").alias("definition"))


def items(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as records: the whole text is the query."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("row_id"), F.col("text").alias("query"))


def whole_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as terms of one text each."""
    return table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("concept_id"), F.col("text").alias("term"))
