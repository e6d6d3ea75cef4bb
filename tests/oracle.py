"""Compares a query with its oracle on the shipped tables."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    def plain(x):
        if pd.isna(x):
            return None
        if isinstance(x, (bool, np.bool_)):
            return bool(x)
        return float(x) if isinstance(x, (int, float, np.number)) else str(x)

    cols = sorted(frame.columns)
    return sorted(repr(tuple(plain(x) for x in r)) for r in frame[cols].itertuples(index=False, name=None))


def duck(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).df()


def check(spark, query, sql, sf_dir):
    mine, theirs = query(spark, sf_dir).toPandas(), duck(sql, sf_dir)
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
