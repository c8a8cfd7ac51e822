"""The mapping pipeline: query texts, several retrieval methods, comparison and consensus, each stage resumable."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from pathlib import PurePath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions import prompts, text
from termweave.operators import bm25, dense, fusion, generation, jaccard
from termweave.sources.settled import settled, spread
from termweave.sources.sinks import Checkpoints, digest, read_texts
from termweave.sources.terminology import with_row_ids


@dataclass(frozen=True)
class MappingConfig:
    """Every setting of one run. ``embed`` turns a text column into vectors; ``generate`` turns metadata into a text."""

    table_path: str = "queries.csv"
    query_column: str = "diagnosis_text"
    context_columns: tuple[str, ...] = ()
    top_k: int = 5
    ngram_size: int = 3
    methods: tuple[str, ...] = fusion.METHODS
    query_block: int = 4096
    consensus_top_k: int = 20
    consensus_final_top_k: int = 10
    consensus_max_depth: int = 3
    fresh_start: bool = False
    embed: Callable[[Column], Column] = field(default=generation.hashing)
    generate: Callable[[], Column] = field(default=generation.template)
    embed_name: str = "hashing"  # names the embedder in checkpoints: change it with the model
    model: Callable[[], generation.Generate] | None = None  # if given, it writes the texts instead of ``generate``
    model_name: str = ""
    temperature: float | None = None
    text_store: str | None = None  # folder of the texts written so far, by key
    attempts: int = 3
    pause: float = 5.0

    @classmethod
    def from_env(cls, prefix: str = "TERMWEAVE_", **given) -> MappingConfig:
        """Settings from variables such as TERMWEAVE_TOP_K; ``given`` ones go first."""
        found = {}
        for f in fields(cls):
            value = os.environ.get(prefix + f.name.upper())
            if value is not None and f.name not in given:
                kind = str(f.type)
                found[f.name] = value.lower() in ("1", "true", "yes") if kind == "bool" else tuple(filter(None, value.split(","))) if kind.startswith("tuple") else int(value) if kind == "int" else float(value) if kind.startswith("float") else value
        return cls(**found | given)

    @property
    def table_name(self) -> str:
        return PurePath(self.table_path).stem


@dataclass(frozen=True)
class Pools:
    """short_terms (concept_id, description), definitions (concept_id, definition), documents (doc_id, concept_id, term,
    definition) and is-a edges (child, parent; may be absent)."""

    short_terms: DataFrame
    definitions: DataFrame
    documents: DataFrame
    isa: DataFrame | None = None


def generated_texts(data: DataFrame, cfg: MappingConfig) -> DataFrame:
    """``data`` with the key of each record's metadata, the text that ``cfg.model`` wrote for it, and the error if it failed.

    Every distinct key is asked for once and given to all its records. Texts of ``cfg.text_store`` are not asked for
    again; new ones are added to it, failures are not, so a later run tries those once more.
    """
    spark = data.sparkSession
    key = prompts.metadata_key(cfg.table_name, cfg.query_column, cfg.context_columns)
    asked = prompts.table_prompt(cfg.table_name, cfg.query_column, cfg.context_columns)
    messages = prompts.messages(asked, prompts.table_examples(cfg.table_name, cfg.query_column, cfg.context_columns))
    done = None if cfg.fresh_start else read_texts(spark, cfg.text_store)
    # cells are dealt out by key, and messages made of them there
    cells = spread(data.select(key.alias("__key"), *[f"`{c}`" for c in dict.fromkeys((cfg.query_column, *cfg.context_columns))]), "__key", rows=generation.ROWS)
    new = settled(generation.generate_missing(cells.select(F.col("__key").alias("key"), messages.alias("messages")), done, cfg.model, cfg.model_name, cfg.temperature, cfg.attempts, cfg.pause))
    every = new if done is None else new.unionByName(settled(done.select("key", "ai_output", F.lit(None).cast("string").alias("error"))))
    if cfg.text_store:
        kept = new.where("ai_output is not null").select("key", "ai_output")
        kept.write.mode("overwrite" if cfg.fresh_start else "append").parquet(cfg.text_store)
    texts = every.select(F.col("key").alias("ai_key"), F.col("ai_output").alias("algorithm_ai_text"), F.col("error").alias("ai_error"))
    return data.withColumn("ai_key", key).join(texts, "ai_key", "left")


def prepare(records: DataFrame, cfg: MappingConfig) -> DataFrame:
    """Records and their three query texts; row_id is added if there is none."""
    made = prompts.semantic_inputs(with_row_ids(records), cfg.table_name, cfg.query_column, cfg.context_columns)
    return generated_texts(made, cfg) if cfg.model else made.withColumn("algorithm_ai_text", cfg.generate())


def _numbered(pool: DataFrame) -> DataFrame:
    return pool.where("text is not null").withColumn("pid", F.xxhash64("concept_id", "text", "source"))


def embedded(pool: DataFrame, cfg: MappingConfig) -> DataFrame:
    """(pid, source, vector) of a pool's texts, written: every search of the pool reads them."""
    return settled(_numbered(pool).select("pid", "source", cfg.embed(F.col("text")).alias("vector")).dropDuplicates(["pid"]))


def _dense(data: DataFrame, column: str, pool: DataFrame, cfg: MappingConfig, vectors: DataFrame | None = None) -> DataFrame:
    """Each distinct text is embedded and searched once; empty texts are searched too, null ones (failed generations) are not.
    ``vectors``: what ``embedded`` gave for the pool, or for a larger one, cut to this one's sources."""
    wanted = data.select(F.col(column).alias("query")).where("query is not null").distinct()
    queries = wanted.select(F.xxhash64("query").alias("qid"), "query", cfg.embed(F.col("query")).alias("vector"))
    vectors = embedded(pool, cfg) if vectors is None else vectors
    found = settled(dense.match_blocks(queries, vectors, "qid", "pid", "vector", cfg.top_k, block=cfg.query_block))
    hit = found.select(F.col("pool_id").alias("pid")).distinct()
    named = found.join(_numbered(pool).join(hit, "pid", "left_semi").dropDuplicates(["pid"]), F.col("pool_id") == F.col("pid"))
    named = named.join(wanted.select(F.xxhash64("query").alias("query_id"), "query"), "query_id")
    return named.select("query", "rank", "concept_id", "text", F.col("similarity").alias("score"), "source")


def stage_settings(queries: DataFrame, pools: dict[str, str], cfg: MappingConfig) -> dict[str, object]:
    """What a method's stored matches depend on: settings, models, and what the queries and pools hold."""
    return {"table": cfg.table_name, "query": cfg.query_column, "context": cfg.context_columns, "k": cfg.top_k, "n": cfg.ngram_size, "embed": cfg.embed_name, "queries": digest(queries), "pools": pools}


def retrieve(data: DataFrame, pools: Pools, cfg: MappingConfig, checkpoints: Checkpoints | None = None) -> DataFrame:
    """Long matches (row_id, query, method, rank, concept_id, text, score, source) of all methods of ``cfg``.

    Every distinct query is matched once and then given to all rows that ask it.
    """
    short = dense.combined_pool(pools.short_terms, pools.definitions.limit(0))
    combined = dense.combined_pool(pools.short_terms, pools.definitions)
    vectors = functools.cache(lambda: embedded(combined, cfg))  # when a method needs them
    source = F.lit(None).cast("string").alias("source")
    index = bm25.build_index(pools.documents, "doc_id")
    names = pools.documents.select("doc_id", "concept_id", F.col("term").alias("text"))
    query = f"`{cfg.query_column}`"
    asked = data.select(F.col(query).cast("string").alias("query"))

    def lexical(found: DataFrame) -> DataFrame:
        return found.join(names, "doc_id").select("query", "rank", "concept_id", "text", "score", source)

    makers: dict[str, tuple[str, Callable[[], DataFrame]]] = {
        "algorithm_1": ("algorithm_1_text", lambda: _dense(data, "algorithm_1_text", short, cfg, vectors().where("source = 'short_term'"))),
        "algorithm_2": ("algorithm_2_text", lambda: _dense(data, "algorithm_2_text", combined, cfg, vectors())),
        "algorithm_ai": ("algorithm_ai_text", lambda: _dense(data, "algorithm_ai_text", combined, cfg, vectors())),
        "multi_match": (query, lambda: lexical(bm25.multi_match(asked, index, "query", cfg.top_k))),
        "elastic_fuzzy": (query, lambda: lexical(bm25.fuzzy_match(asked, index, "query", cfg.top_k))),
        "jaccard": (
            query,
            lambda: jaccard.match_texts(asked, pools.short_terms, "query", "description", "concept_id", cfg.top_k, cfg.ngram_size, text.clean).select(
                "query", "rank", "concept_id", F.col("term").alias("text"), F.col("jaccard_score").alias("score"), source
            ),
        ),
    }
    pooled = {n: digest(df) for n, df in (("terms", pools.short_terms), ("definitions", pools.definitions), ("documents", pools.documents))} if checkpoints else {}
    out: DataFrame | None = None
    for method in cfg.methods:
        column, make = makers[method]
        found = checkpoints.once(method, stage_settings(data.select(column), pooled, cfg), make) if checkpoints else settled(make())
        mine = data.select("row_id", F.col(column).cast("string").alias("query"))
        rows = mine.join(found, "query").select("row_id", "query", F.lit(method).alias("method"), "rank", "concept_id", "text", F.col("score").cast("double").alias("score"), "source")
        out = rows if out is None else out.unionByName(rows)
    return out


def run(records: DataFrame, pools: Pools, cfg: MappingConfig, checkpoints: Checkpoints | None = None) -> dict[str, DataFrame]:
    """matches, comparison and final candidates of all records. With ``fresh_start`` no earlier result is used."""
    if checkpoints and cfg.fresh_start:
        checkpoints = Checkpoints(checkpoints.spark, checkpoints.root, fresh=True)
    data = settled(prepare(records, cfg))
    found = settled(retrieve(data, pools, cfg, checkpoints))
    rows = data.select("row_id", F.col(f"`{cfg.query_column}`").cast("string").alias("query"))
    best = fusion.consensus(found, pools.isa, cfg.consensus_top_k, cfg.consensus_final_top_k, cfg.consensus_max_depth, cfg.methods)
    return {
        "data": data,
        "matches": found,
        "comparison": fusion.comparison(rows, found, cfg.methods),
        "consensus": best,
        "final_candidates": fusion.final_candidates(rows, best, cfg.consensus_top_k),
    }


def map_experiment(outputs: DataFrame, pools: Pools, cfg: MappingConfig) -> DataFrame:
    """(sample_index, prompt_type, shot_type, model, rank, concept_id, text, score, source) of the texts of an experiment
    (run_experiment); failed ones have no matches."""
    data = settled(outputs.select("sample_index", "prompt_type", "shot_type", "model", "ai_output"))
    found = _dense(data, "ai_output", dense.combined_pool(pools.short_terms, pools.definitions), cfg)
    return data.withColumnRenamed("ai_output", "query").join(found, "query").drop("query")
