"""Comparison of a query with its SQL, run by DuckDB on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        place = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{place}/*.parquet'" if os.path.isdir(place) else f"CREATE VIEW {t} AS SELECT * FROM '{place}'")
    return con


def rows(frame):
    cells = lambda v: "~" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    names = sorted(frame.columns)
    return names, sorted(tuple(map(cells, r)) for r in frame[names].itertuples(index=False))


def same(spark, sf_dir, query, sql):
    assert rows(query(spark, sf_dir).toPandas()) == rows(connect(sf_dir).execute(sql).df())
