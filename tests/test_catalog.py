"""Every driver query runs; those with SQL agree with DuckDB."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tracelake import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(frame):
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "~"
        return round(float(v), 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, sql, name):
    found = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.ORACLE_SQL:
        assert rows(found) == rows(sql.execute(catalog.ORACLE_SQL[name]).df())
    else:
        assert len(found.columns)


def test_oracles_have_queries():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
