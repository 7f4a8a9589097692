"""Queries and operators that do the whole job where an earlier form left rows out."""

from pyspark.sql import functions as F

from lithic.functions import parsing as A
from lithic.plans import catalog

SF = "/root/testdata/sf0.001"


def test_rankings_of_all_answers(spark):
    rows = spark.createDataFrame([("ABCD",), ("DCBA",), ("AABC",), ("ABCE",), ("ACE",), (None,)], "s string")
    assert [r[0] for r in rows.select(A.ranking_agreement(F.lit("ABCD"), F.col("s"))).collect()] == [1, 0, 0, 0, 0, 0]
    events = spark.read.parquet(f"{SF}/events.parquet")
    n, k = events.count(), {r[0]: r[1] for r in events.groupBy(F.col("event_id") % 6).count().collect()}
    for name, per in (("all_pairwise_ranking_scores", {0: 1, 1: 5 / 6}), ("all_ranking_rewards", {0: 1, 1: 0.15 + 0.7 * 5 / 6, 2: 0.15})):
        got = catalog.QUERIES[name](spark, SF).collect()
        assert len(got) == n and all(abs(r[1] - per.get(r.event_id % 6, 0)) < 1e-6 for r in got)
    a = catalog.QUERIES["pairwise_ranking_accuracy"](spark, SF).first()
    assert (a.total, a.parsed) == (n, n - k[3] - k[4]) and abs(a.accuracy - (k[0] + k[1] * 5 / 6) / n) < 1e-6


def test_answers_of_all_turns(spark):
    got = catalog.QUERIES["all_normalized_answers"](spark, SF)
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    assert sorted(map(tuple, got.select("conv_id", "turn").collect())) == sorted(map(tuple, turns.select("conv_id", "turn").collect()))
