"""Ranking inside groups with explicit ties."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | None = None, rank: str = "rank") -> DataFrame:
    """Adds the 1-based rank inside ``by``; with ``k``, only the first k stay (Spark then limits every group before and
    after the shuffle, so a hot group moves k rows from each task)."""
    if k is not None and k < 1:
        raise ValueError("k must be 1 or more")
    out = df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.where(F.col(rank) <= k)


def match_lists(matches: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row for each group with its matches as an array of structs, best first."""
    return matches.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", *[f for f in fields if f != "rank"]))).alias("matches"))


def sample_rows(df: DataFrame, key: Column, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (all if fewer), the same ones for the same seed: those whose salted key hash is lowest."""
    return df.orderBy(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)))), key).limit(n)


class Best:
    """The k best scores of each query that a task has seen so far, so that few of its later rows go on."""

    def __init__(self, k: int, queries: int):
        self.k, self.held = k, np.full((k, queries), -np.inf)

    def cells(self, scores: np.ndarray, at: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(rows, columns) of ``scores`` that can be among the k best of their column, at most k of a column, of equal
        scores the upper rows. Columns are the queries from number ``at`` on; what is not finite is no score."""
        n, mine = scores.shape[0], slice(at, at + scores.shape[1])
        scores = np.where(np.isfinite(scores), scores, -np.inf)
        together = np.partition(np.vstack([self.held[:, mine], scores]), n, axis=0)
        self.held[:, mine] = together[n:]
        row, col = np.nonzero((scores >= together[n]) & (scores > -np.inf))
        order = np.lexsort((row, -scores[row, col], col))
        row, col = row[order], col[order]
        good = np.arange(len(col)) - np.searchsorted(col, col) < self.k
        return row[good], col[good]


def whole_groups(batches: Iterable[pa.RecordBatch], starts) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches cut so that no group of neighbouring rows is in two, each with its groups' first places. ``starts`` says of
    a table which rows begin a group (the first one does in any case)."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        table = (new if rest is None else pa.concat_tables([rest, new])).combine_chunks()
        places = np.flatnonzero(starts(table))
        rest = table.slice(int(places[-1]) if len(places) else 0)
        if len(places) > 1:
            yield table.slice(0, int(places[-1])), places[:-1]
    if rest is not None:
        yield rest, np.array([0])


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
