"""Embedding and text generation behind small interfaces, resumable and with errors kept apart from texts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from termweave.functions import prompts, text
from termweave.sources.settled import spread

#: Rows of one task where messages are made and asked for: thousands of characters each, often of a table of few bytes.
ROWS = 20_000

#: texts -> vectors, and (messages, model, temperature) -> text; loaded once in each Python worker by a factory.
Embed = Callable[[list[str]], list[list[float]]]
Generate = Callable[[list[dict[str, str]], str, float], str]


def hashing(c: Column, dims: int = 64) -> Column:
    """The built-in embedder: no model, no Python."""
    return text.hashed_embedding(c, dims)


def embedder(factory: Callable[[], Embed]) -> Callable[[Column], Column]:
    """An Arrow function around a model that ``factory`` loads once in a task; vectors are scaled to length one, null and
    empty texts are embedded as the empty text."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = factory()
        for batch in batches:
            out = []
            for v in embed([x or "" for x in batch]):
                norm = sum(x * x for x in v) ** 0.5
                out.append([x / norm for x in v] if norm else list(v))
            yield pd.Series(out)

    return run


def transformer(name: str, max_length: int = 64, batch: int = 32) -> Callable[[], Embed]:
    """A factory for ``embedder`` around a public encoder model: mean of the token vectors that the mask keeps. The
    libraries are imported in the worker and only when it is used."""

    def factory() -> Embed:
        import torch
        from transformers import AutoModel, AutoTokenizer

        tokenizer, model = AutoTokenizer.from_pretrained(name), AutoModel.from_pretrained(name).eval()

        def embed(texts: list[str]) -> list[list[float]]:
            out: list[list[float]] = []
            with torch.no_grad():
                for i in range(0, len(texts), batch):
                    cut = tokenizer(texts[i : i + batch], padding=True, truncation=True, max_length=max_length, return_tensors="pt")
                    hidden, mask = model(**cut).last_hidden_state, cut["attention_mask"].unsqueeze(-1).float()
                    out += ((hidden * mask).sum(1) / mask.sum(1).clamp(min=1e-9)).tolist()
            return out

        return embed

    return factory


def embed_missing(texts: DataFrame, done: DataFrame | None, key: str, text_column: str, embed: Callable[[Column], Column]) -> DataFrame:
    """(key, vector) of the rows whose key has no vector yet (a null text has a null vector); append them to what is there
    and run again after a stop."""
    todo = texts if done is None else texts.join(done.select(key), key, "left_anti")
    there = F.col(text_column).cast("string")
    return todo.select(key, F.when(there.isNotNull(), embed(F.coalesce(there, F.lit("")))).alias("vector"))


def template(c: Column | None = None) -> Column:
    """The built-in generator: the metadata (algorithm_ai_metadata if not given) as one sentence."""
    c = F.col("algorithm_ai_metadata") if c is None else c
    facts = F.filter(F.transform(c["context_columns"], lambda k: F.when(F.coalesce(c["context_values"][k], F.lit("")) != "", F.concat(k, F.lit(" "), c["context_values"][k]))), lambda x: x.isNotNull())
    value = F.when(c["query_value"] == "", F.lit(prompts.MISSING)).otherwise(c["query_value"])
    return F.concat(value, F.when(F.size(facts) > 0, F.concat(F.lit(" with "), F.array_join(facts, ", "))).otherwise(F.lit("")), F.lit("."))


def echo() -> Generate:
    """A generator without a model: the query value that the last message names, or that message."""

    def generate(messages: list[dict[str, str]], model: str, temperature: float) -> str:
        last = messages[-1]["content"]
        named = [x.removeprefix("Query value: ") for x in last.split("\n") if x.startswith("Query value: ")]
        return named[0] if named else last

    return generate


def with_retries(call: Callable[[], str], attempts: int = 3, pause: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(text, None), or (None, error) after ``attempts`` failures with pauses of pause x attempt seconds between them."""
    for attempt in range(1, attempts + 1):
        try:
            return call().strip(), None
        except Exception as e:  # any failure of a remote model is an answer here
            error = f"{type(e).__name__}: {e}"
            if attempt < attempts:
                sleep(pause * attempt)
    return None, error


def generate_missing(items: DataFrame, done: DataFrame | None, factory: Callable[[], Generate], model: str = "", temperature: float | None = None, attempts: int = 3, pause: float = 5.0) -> DataFrame:
    """(key, ai_output, error) for each distinct key of ``items`` (key, messages) that is not done; failures have no text.
    Messages are long: items that come dealt out by key, or by what it is made of (``spread``), are not moved again."""
    one = items.groupBy("key").agg(F.first("messages").alias("messages"))
    todo = one if done is None else one.join(done.where("ai_output is not null").select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = factory()
        for batch in batches:
            found = [with_retries(lambda m=m: generate([dict(x.asDict() if hasattr(x, "asDict") else x) for x in m], model, temperature or 0.0), attempts, pause) for m in batch["messages"]]
            yield pd.DataFrame({"key": batch["key"], "ai_output": [t for t, _ in found], "error": [e for _, e in found]})

    return todo.mapInPandas(run, "key string, ai_output string, error string")


def _key(index: str) -> Column:
    return F.concat_ws("|", index, "prompt_type", "shot_type", "model")


def experiment_grid(sample: DataFrame, query_column: str, context_columns: Sequence[str], models: Sequence[str], prompt_types: Sequence[str] = tuple(prompts.PROMPTS), shot_types: Sequence[str] = prompts.SHOTS, index: str = "sample_index") -> DataFrame:
    """sample_index, query_value, prompt_type, shot_type, model, prompt, key, n_messages, messages: every combination, dealt
    out by key before its messages are made."""
    for s in shot_types:
        if s not in prompts.SHOTS:
            raise ValueError(f"unknown shot type {s!r}; known: {list(prompts.SHOTS)}")
    columns = [c for c in sample.columns if c != index]
    kinds = [F.struct(F.lit(k).alias("prompt_type"), prompts.prompt(k, columns, query_column, context_columns).alias("prompt")) for k in prompt_types]
    grid = sample.select(
        index,
        prompts.query_text(query_column).alias("query_value"),
        F.explode(F.array(*kinds)).alias("p"),
    ).select(index, "query_value", "p.*", F.explode(F.array(*map(F.lit, shot_types))).alias("shot_type"))
    grid = grid.select("*", F.explode(F.array(*map(F.lit, models))).alias("model"))
    grid = spread(grid.withColumn("key", _key(index)), "key", rows=ROWS)
    base = prompts.messages(F.col("prompt"))
    shown = base
    if "few_shot" in shot_types:
        for k in prompt_types:
            few = prompts.messages(F.col("prompt"), prompts.experiment_examples(k, query_column, context_columns))
            shown = F.when((F.col("shot_type") == "few_shot") & (F.col("prompt_type") == k), few).otherwise(shown)
    return grid.withColumn("messages", shown).withColumn("n_messages", F.size("messages"))


def run_experiment(grid: DataFrame, factory: Callable[[], Generate], models: Sequence[str], done: DataFrame | None = None, index: str = "sample_index", temperature: float | None = None, attempts: int = 3, pause: float = 5.0) -> DataFrame:
    """``grid`` (of experiment_grid) with key, ai_output and error, each model asked for its own rows. ``done`` (key,
    ai_output) are not asked again; append the new ones to it and run again after a stop."""
    keyed = grid if "key" in grid.columns else grid.withColumn("key", _key(index))
    out = None if done is None else done.select("key", "ai_output", F.lit(None).cast("string").alias("error"))
    for m in models:
        new = generate_missing(keyed.where(F.col("model") == m), done, factory, m, temperature, attempts, pause)
        out = new if out is None else out.unionByName(new)
    return keyed.join(out, "key", "left")


def manifest(spark, **settings: object) -> DataFrame:
    """One row with the run's settings as JSON and the time it was made."""
    import json

    kept = settings | {"system_prompt": settings.get("system_prompt", prompts.SYSTEM_PROMPT), "few_shot_examples": list(prompts.EXAMPLES)}
    return spark.createDataFrame([(json.dumps(kept, sort_keys=True, default=str),)], "settings string").withColumn("run_at", F.current_timestamp())
