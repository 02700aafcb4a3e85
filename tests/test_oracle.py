"""Every query with SQL gives what DuckDB gives on the same tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from loregraph.plans import evidence_queries, graph_queries, ingest_queries, knowledge_queries, loss_queries, request_queries, retrieval_queries, search_queries, source_queries, text_queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLANS = (loss_queries, text_queries, retrieval_queries, graph_queries, source_queries, request_queries, ingest_queries, search_queries, knowledge_queries, evidence_queries)
QUERIES = {n: f for p in PLANS for n, f in p.QUERIES.items()}
SQL = {n: s for p in PLANS for n, s in p.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if isinstance(x, (list, tuple, np.ndarray)):
            return "|".join(map(cell, x))
        if x is None or pd.isna(x):
            return ""
        if isinstance(x, bool):
            return str(x)
        try:
            return f"{float(x):.6g}"
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(map(cell, row)) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
