"""Side-by-side comparison of a query with its SQL twin on the test tables."""

import datetime
import decimal
import glob
import math
import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def differences(df, c, sql):
    """Rows of one side only, beyond equal multiplicities; an empty list means agreement."""
    r = c.execute(sql)
    there = [d[0] for d in r.description]
    if sorted(there) != sorted(df.columns):
        return [("columns", sorted(df.columns), sorted(there))]
    cols = sorted(there)
    a = sorted((tuple(plain(x[k]) for k in cols) for x in df.collect()), key=repr)
    b = sorted((tuple(plain(x[there.index(k)]) for k in cols) for x in r.fetchall()), key=repr)
    return [] if a == b else [x for x in a if x not in b][:3] + [x for x in b if x not in a][:3] or ["multiplicities"]
