"""Compare a query with its SQL in DuckDB, as sets of rows with multiplicity."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, int) else str(v)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[k]) for k in names) for r in df.collect()), key=str)


def rows_of_duck(c, sql):
    r = c.sql(sql)
    names = sorted(r.columns)
    at = [r.columns.index(n) for n in names]
    return names, sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=str)
