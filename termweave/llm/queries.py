"""Queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from termweave.llm import line_runs, perspectives, prefix_free, signature_trees


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op7_page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm.page_layout import extract_pages

    return extract_pages(_read(spark, sf_dir, "pages"))


def op8_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm.compression_bands import compression_quality

    return compression_quality(_read(spark, sf_dir, "documents"))


def op1_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm.latent_leaks import find_leaks

    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm import kernel_langid as k

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = k.train(docs.where(~k.held_out()))
    return k.predict(docs.select("doc_id", k.held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op3_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = signature_trees.Join(words=3, num=90, den=100)
    return signature_trees.near_duplicates(_read(spark, sf_dir, "documents"), join)


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.llm.perspectives import rotate

    return rotate(_read(spark, sf_dir, "conversations"))


def op5_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_free.remove_repeats(_read(spark, sf_dir, "documents")).drop("kept")


def op6_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from termweave.llm import packed_ids

    return packed_ids.write_and_read(spark, _read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from termweave.llm.piece_codec import encode_documents

    return encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_latent_leaks, op2_kernel_langid, op3_signature_trees, op4_perspectives, op5_prefix_free, op6_packed_ids, op7_page_layout, op8_compression_bands, op9_piece_codec, op10_line_runs)}
SQL: dict[str, str] = {"op3_signature_trees": signature_trees.SQL, "op4_perspectives": perspectives.SQL, "op5_prefix_free": prefix_free.SQL, "op10_line_runs": line_runs.SQL}
