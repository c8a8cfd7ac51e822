"""Readers of release files, query tables and ground truth, and the candidate pools built from them."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from termweave.operators.hierarchy import IS_A
from termweave.sources.settled import settled

# Description types of the release format.
FULL_NAME, SYNONYM = "900000000000003001", "900000000000013009"
LABELS = {FULL_NAME: "FSN", SYNONYM: "Synonym"}
#: Cells that some readers take for nulls; Spark does so for empty ones only.
NA_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def strings(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def release_table(spark: SparkSession, path: str, optional: Sequence[str] | None = None, na_words: bool = False) -> DataFrame:
    """A tab-separated release file: header, every column text, quotes are ordinary characters.

    With ``optional`` (its columns), a missing file is an empty table. With ``na_words``, cells like NA become null.
    """
    if optional is not None and not exists(spark, path):
        return spark.createDataFrame([], strings(optional))
    df = spark.read.csv(path, sep="\t", header=True, quote="", escape="")
    return df.select(*[F.when(~F.col(c).isin(*NA_WORDS), F.col(c)).alias(c) for c in df.columns]) if na_words else df


def query_table(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """A CSV table of records, all columns text unless ``schema`` says otherwise, so codes like 250.00 and long ids stay."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=False, escape='"')


def with_query(df: DataFrame, column: str = "diagnosis_text", source: str = "diagnosisstring") -> DataFrame:
    """Adds the query column from a bar-separated source column, if there is one."""
    return df.withColumn(column, F.replace(F.col(source), F.lit("|"), F.lit(" - "))) if source in df.columns else df


def with_row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Numbers rows that have no id of their own, once: the numbered table is written."""
    return df if name in df.columns else settled(df.withColumn(name, F.monotonically_increasing_id()))


def count_report(df: DataFrame) -> DataFrame:
    """(column, rows, nulls) of every column, by one aggregate."""
    sums = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(df.columns)]))
    return sums.select(each.alias("x"), "rows").select("x.column", "rows", "x.nulls")


def code_columns(df: DataFrame, names: Sequence[str] = ("snomed", "icd9", "icd10")) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in names if c in df.columns})


def vectors_from_npy(spark: SparkSession, ids: DataFrame, id_column: str, order: str, path: str, rows: int = 10_000) -> DataFrame:
    """One-off import of a matrix file whose row i belongs to the i-th id by ``order``: (id_column, vector).

    Counts must agree. The file, in a folder that all machines share, is mapped on the executors and read in pieces of
    ``rows`` vectors; ids are numbered by ranges of ``order``, with only the number of rows of each range on the driver.
    """
    import numpy as np
    import pyarrow as pa

    n = ids.count()
    size = len(np.load(path, mmap_mode="r"))
    if size != n:
        raise ValueError(f"{size} vectors for {n} ids")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.load(path, mmap_mode="r")
        for batch in batches:
            for start in batch.column(0).to_pylist():
                part = np.asarray(matrix[start : start + rows], np.float32)
                flat = pa.array(part.ravel())
                ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(part))), pa.ListArray.from_arrays(ends, flat)], names=["place", "vector"])

    vectors = spark.range(0, n, rows).mapInArrow(pieces, "place long, vector array<float>")
    dealt = settled(ids.select(id_column, order).repartitionByRange(F.col(order)).withColumn("part", F.spark_partition_id()))
    counts = sorted(map(tuple, dealt.groupBy("part").count().collect()))
    first = dict(zip((k for k, _ in counts), itertools.accumulate((c for _, c in counts), initial=0), strict=False))
    base = spark.createDataFrame([(k, b) for k, b in first.items()], "part int, base long")
    place = F.row_number().over(W.partitionBy("part").orderBy(order)) - 1
    numbered = dealt.withColumn("inside", place).join(F.broadcast(base), "part").select(id_column, (F.col("base") + F.col("inside")).alias("place"))
    return numbered.join(vectors, "place").select(id_column, "vector")


def active(df: DataFrame) -> DataFrame:
    return df.where(F.col("active") == "1")


def concept_ids(concepts: DataFrame) -> DataFrame:
    return active(concepts).select("id")


def _of_active(df: DataFrame, concepts: DataFrame, column: str) -> DataFrame:
    # release tables have an id column of their own
    return df.join(concept_ids(concepts).select(F.col("id").alias("__concept")), F.col(column) == F.col("__concept"), "left_semi")


def short_terms(concepts: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(concept_id, description, description_type): full names and synonyms of active concepts, each once."""
    rows = _of_active(active(descriptions).where(F.col("typeId").isin(*LABELS)), concepts, "conceptId")
    label = F.when(F.col("typeId") == FULL_NAME, LABELS[FULL_NAME]).otherwise(LABELS[SYNONYM])
    return rows.select(F.col("conceptId").alias("concept_id"), F.col("term").alias("description"), label.alias("description_type")).distinct()


def definitions(concepts: DataFrame, texts: DataFrame) -> DataFrame:
    """(concept_id, definition) of active concepts, each once."""
    return _of_active(active(texts), concepts, "conceptId").select(F.col("conceptId").alias("concept_id"), F.col("term").alias("definition")).distinct()


def isa(concepts: DataFrame, relationships: DataFrame) -> DataFrame:
    """(source_id, destination_id): active is-a edges between active concepts, each once."""
    rows = active(relationships).where(F.col("typeId") == IS_A)
    both = _of_active(_of_active(rows, concepts, "sourceId"), concepts, "destinationId")
    return both.select(F.col("sourceId").alias("source_id"), F.col("destinationId").alias("destination_id")).distinct()


def bm25_documents(concepts: DataFrame, descriptions: DataFrame, texts: DataFrame) -> DataFrame:
    """(conceptId, term, definition, typeId): every active description with a term, once for each definition of its
    concept (null if it has none); nothing is made distinct."""
    named = active(descriptions).select("conceptId", "term", "typeId").join(concept_ids(concepts).select(F.col("id").alias("conceptId")), "conceptId")
    told = active(texts).select("conceptId", F.col("term").alias("definition"))
    return named.join(told, "conceptId", "left").dropna(subset=["term"]).select("conceptId", "term", "definition", "typeId")


def build_terminology(spark: SparkSession, concept: str, description: str, definition: str, relationship: str) -> dict[str, DataFrame]:
    """All pools from the four release files; the definitions file may be missing."""
    c, d, r = (release_table(spark, p) for p in (concept, description, relationship))
    t = release_table(spark, definition, optional=("id", "conceptId", "active", "term"))
    return {"short_terms": short_terms(c, d), "definitions": definitions(c, t), "isa": isa(c, r), "bm25_documents": bm25_documents(c, d, t)}


def ground_truth(spark: SparkSession, path: str, code: str, concept: str = "snomed") -> DataFrame:
    return query_table(spark, path).select(F.trim(F.col(code)).alias("code"), F.trim(F.col(concept)).alias("concept"))
