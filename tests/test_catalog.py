"""Every catalogue query against its DuckDB statement on the smallest tables."""

import duckdb
import pytest

from lithic.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(catalog.SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    mine = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    theirs = sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["balanced_inner_eval", "relation_balanced_rows", "materialized_task_rows", "few_shot_examples"])
def test_same_for_any_partitioning(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(repr, catalog.QUERIES[name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
