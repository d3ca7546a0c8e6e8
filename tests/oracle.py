"""Compare a query's rows with those of its SQL in DuckDB, without regard to order."""

import glob
import os

import duckdb
import pandas as pd


def connection(folder):
    db = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return db


def plain(frame):
    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return repr(round(float(v), 6)) if isinstance(v, float) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(one, row)) for row in frame[columns].astype(object).itertuples(index=False, name=None)), key=str)


def agree(spark, folder, query, sql):
    got = query(spark, folder).toPandas()
    if sql is None:  # tested against brute force elsewhere; here only that rows are distinct
        assert len(got.columns) and not got.astype(str).duplicated().any()
        return True
    assert plain(got) == plain(connection(folder).execute(sql).df())
    return True
