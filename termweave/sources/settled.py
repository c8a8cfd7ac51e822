"""Intermediate tables that a plan names often."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

#: Rows of one task where a step holds its rows in memory, so that tasks grow in number and not in size.
ROWS = 250_000


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder (spark.checkpoint.dir) and read again, so that a plan naming it many times
    makes it once and a lost executor costs a read. A local session without the setting gets a folder of its own."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # several machines, or processes that stand for them
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="termweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str, rows: int = ROWS) -> DataFrame:
    """``df`` dealt out by ``by`` to so many tasks that one has about ``rows`` rows (a count of them comes first). The number
    is given, as tasks merged by their compressed bytes can hold very many rows."""
    return df.repartition(max(1, -(-df.count() // rows)), *by)
