"""Registered queries against their SQL twins in DuckDB, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from threadloom.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float) or hasattr(v, "quantize"):
        return round(float(v), 5) + 0.0
    return v


def _rows(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    found = duck.execute(catalog.oracles()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.collect(), df.columns) == _rows(found.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracles())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, DIR).count() > 0


#: Queries whose operators write tables or loop: each must end on tables without rows.
LOOPING = ["index_knn", "index_search", "turn_messages", "turn_outcomes", "density_shed", "canonical_wire", "assemble_report", "prov_mass_paths", "gated_walk", "reduced_links", "price_series", "lexical_scores", "compiled_documents", "settings_problems", "context_seeds"]


@pytest.mark.parametrize("name", LOOPING)
def test_queries_take_empty_tables(spark, tmp_path, name):
    for t in TABLES:
        spark.read.parquet(f"{DIR}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert catalog.queries()[name](spark, str(tmp_path)).count() == 0
