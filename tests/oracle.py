"""Compares a registered query with its SQL over the driver's tables."""

import glob
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def database():
    import duckdb

    held = duckdb.connect()
    for name in TABLES:
        path = f"{SF_DIR}/{name}.parquet"
        held.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return held


def available() -> bool:
    return bool(glob.glob(f"{SF_DIR}/*.parquet"))


def assert_same(spark, query, sql: str) -> None:
    frame = query(spark, SF_DIR)
    names = sorted(frame.columns)
    wanted = database().sql(sql)
    assert sorted(wanted.columns) == names
    at = [wanted.columns.index(n) for n in names]
    assert sorted(tuple(map(str, (r[n] for n in names))) for r in frame.collect()) == sorted(tuple(str(r[k]) for k in at) for r in wanted.fetchall())
