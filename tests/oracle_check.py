"""Runs a registered query and its SQL side by side at the smallest size."""

from __future__ import annotations

import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    one = lambda v: f"{v:.6f}" if isinstance(v, float) else repr(v)
    return [names[i] for i in order], sorted(tuple(one(r[i]) for i in order) for r in rows)


def check(spark, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = query(spark, SF)
    ours = normal([tuple(r) for r in df.collect()], df.columns)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    theirs = normal(found.fetchall(), names)
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert ours[1] == theirs[1]
