"""Compare a query with its DuckDB counterpart on the driver's tables."""

import os
from collections import Counter

import duckdb

DATA = "/root/testdata"


def rows(frame):
    def plain(x):
        if hasattr(x, "item"):
            x = x.item()
        return None if x is None or x != x else x

    cols = sorted(frame.columns)
    return cols, Counter(tuple(plain(x) for x in r) for r in frame[cols].itertuples(index=False))


def expected(sql, sf):
    con = duckdb.connect()
    for f in os.listdir(f"{DATA}/{sf}"):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{sf}/{f}'")
    return con.sql(sql).df()
