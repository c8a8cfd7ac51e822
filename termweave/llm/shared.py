"""Shared storage, batching and small DataFrame helpers of the llm operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step handles at once (a longer single text goes alone).
STEP_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local session without it gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # several machines, or processes that stand for them
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="termweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def sweep(spark: SparkSession, hours: float = 24.0) -> int:
    """Deletes what operators left in the shared folder (tables that their lazy results read) more than ``hours`` ago;
    returns the number of folders. To be called between jobs, when no older result is read any more."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    own = re.compile(r"(signature-trees|latent-leaks|line-runs|prefix-free|packed-ids|pipeline|leaks|settled)-[0-9a-f]{32}")
    old = [f.getPath() for f in fs.listStatus(root) if own.fullmatch(f.getPath().getName()) and f.getModificationTime() < (time.time() - 3600 * hours) * 1000]
    for path in old:
        fs.delete(path, True)
    return len(old)


class Scratch:
    """Tables of one operator run in the shared folder. ``keep`` cuts lineage by a written table; ``drop`` and ``only``
    delete what later steps no longer read, and ``sweep`` what results of earlier jobs have read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            at = jvm.org.apache.hadoop.fs.Path(self.path(table))
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def only(self, *tables: str) -> None:
        """Deletes all tables of this run but ``tables``, which a result still reads."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        self.drop(*({f.getPath().getName() for f in fs.listStatus(root)} - set(tables)))

    def tidy(self) -> None:
        """Lets Spark's cleaner remove shuffle files of plans that are no longer referenced."""
        self.spark.sparkContext._jvm.System.gc()


#: What this Python worker keeps from task to task, by a name and its parameters.
_kept: dict[tuple, Any] = {}


def worker_keeps(key: tuple, make: Callable[[], Any]) -> Any:
    """The object called ``key`` that all tasks of a Python worker share; it takes the place of any other one.

    It lives until ``steps`` or ``release`` run for something else: workers are used again by later stages and jobs.
    """
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release(kept: tuple | None = None) -> None:
    """Gives a Python worker's unused memory back, with all that it keeps but ``kept``: workers of earlier stages stay
    alive beside those of the next one."""
    others = _kept.keys() - {kept}
    for key in others:
        del _kept[key]
    if others:
        gc.collect()  # a codec and its store name each other
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def steps(batches: Iterator[pa.RecordBatch], text: int, limit: int = STEP_BYTES, kept: tuple | None = None) -> Iterator[pa.RecordBatch]:
    """Row slices whose texts (column number ``text``) hold at most ``limit`` bytes, one row at least.

    Of what the worker keeps, only ``kept`` stays.
    """
    release(kept)
    for batch in batches:
        column = batch.column(text)
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
    release(kept)


def table_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under names that no other column can clash with."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


class IdFilter:
    """A filter of fixed size for long ids: lets every id of ``ids`` through and few others, whatever their number.

    Only for moving fewer rows before an exact join; at most 2^20 words of bits come to the driver and go out.
    """

    WORDS = 1 << 20

    def __init__(self, ids: DataFrame, column: str):
        h = F.xxhash64(F.col(column))
        bits = ids.select(F.shiftrightunsigned(h, 44).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int")).alias("bit"))
        rows = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        table = np.zeros(self.WORDS, np.int64)
        table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
        self.held = ids.sparkSession.sparkContext.broadcast(table)

    @staticmethod
    def hashed(data: DataFrame, column: str) -> DataFrame:
        """``data`` with the hash that ``passing`` needs as its last column."""
        return data.withColumn("__hash", F.xxhash64(F.col(column)))

    def passing(self, hashes: pa.Array) -> np.ndarray:
        h = hashes.to_numpy()
        return (self.held.value[(h.view(np.uint64) >> np.uint64(44)).astype(np.int64)] >> (h & 63)) & 1 > 0
