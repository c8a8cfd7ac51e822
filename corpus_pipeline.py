"""The corpus pipeline: five stages over documents, each written and read again before the next one.

1. language_id: documents without any language (no text, no letter), or that no language's regressor claims, go.
2. line_dedup: later copies of lines, single ones and runs, are deleted from the texts; emptied documents go.
3. near_duplicates: of documents linked by five-word shingles at Jaccard 0.8, the smallest id stays.
4. decontamination: documents that hold an item of the benchmark table go.
5. tokenise: SentencePiece ids of what is left, with decoded and compared texts.
All but the last return the columns of documents.

In every stage: extra columns go through untouched, also ones named like an operator's results; an empty table gives an
empty one; rows repeated whole are judged alike; very long texts are read whole. Each stage says what it does with nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import kernel_langid, latent_leaks, line_runs, piece_codec, shared, signature_trees

#: A text is rejected if the best language's score is under this (0.5: no regressor claims it over the rest).
MIN_LANGUAGE_SCORE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents that are not held out, then keeps what some language claims.

    A null or empty text, or one without letters, is of no language and goes; a null lang teaches nothing. With nothing to
    learn from, no language claims anything and all documents go. Ties between languages go to the first by name.
    """
    model = kernel_langid.train(docs.where(~kernel_langid.held_out()))
    # documents' other columns go through in one, out of the way of the result's names; the text goes once, beside them
    other = F.struct(*[c for c in docs.columns if c != "text"]).alias("document")
    scored = kernel_langid.predict(docs.select(other, "text"), model)
    claimed = scored.where((F.col("lang_pred") != kernel_langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return claimed.select(*["text" if c == "text" else F.col("document")[c].alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated lines, alone or in runs; n_chars follows the text. A document all of whose lines are copies goes.

    The first copy by id (null first), then text and line, stays, so of documents with equal texts one stays; rows repeated
    whole share a place and stay or go together. A null text has no lines and stays.
    """
    own = {c: f"__own_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    out = line_runs.dedup_lines(docs.withColumnsRenamed(own), min_lines=1)
    left = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document that gives its group the name, the one of the smallest id.

    Documents without words are in no group and stay, null texts as well. Rows that share the smallest id stay together;
    rows without an id can't be told apart, so they stay even if their texts are copies.
    """
    found = signature_trees.near_duplicates(docs)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, verbatim or as a paraphrase.

    Null texts hold nothing and stay; so does everything if the benchmark is empty. Of rows that share an id, all go if one
    holds an item; rows without an id go if their own text does.
    """
    named = docs.withColumn("__row", F.xxhash64("text"))
    asked = named.select(F.coalesce("doc_id", "__row").alias("doc_id"), "text")  # a row without an id is known by its text
    leaks = latent_leaks.find_leaks(asked, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = shared.Scratch(spark, "leaks").keep(leaks.select(F.col("doc_id").alias("__gone")).distinct(), "leaks")
    return named.join(gone, F.coalesce("doc_id", "__row") == F.col("__gone"), "left_anti").select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document; a null or empty text has none."""
    import public_tokenizers

    return piece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", tokenise),
]

#: Language ID, the latent search and the tokenizer cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = shared.Scratch(spark, "pipeline")
    last = None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs
