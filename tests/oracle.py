"""Comparing a query with its SQL on the same tables."""

from collections import Counter

import duckdb

from rankloom.plans.fixtures import BASE


def plain(v):
    if v is None or type(v).__name__ in ("NAType", "NaTType") or v != v:
        return None
    if isinstance(v, float):
        return round(v, 9)
    return v.item() if hasattr(v, "item") else str(v) if not isinstance(v, (int, bool)) else v


def rows(frame):
    columns = sorted(frame.columns)
    return columns, Counter(tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


def same(spark, name, make, sql, sf):
    c = duckdb.connect()
    for t in BASE:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = rows(make(spark, sf).toPandas()), rows(c.sql(sql).df())
    assert got[0] == want[0], name
    assert got[1] == want[1], (name, list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3])
