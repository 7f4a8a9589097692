"""Golden rows: raw measurements to labels, grammars, rewards, splits."""

import pytest
from pyspark.sql import functions as F

from lithic.functions import labels as L
from lithic.functions import parsing as A
from lithic.functions import rewards as R
from lithic.operators import datasets as D
from lithic.operators import splits as S

RAW = "va double, vb double, iv double, d double, ca boolean, cb boolean, want string, bucket string"


def test_relations(spark):
    rows = [
        (1000.0, 1000.0, 0.0, 10.0, False, False, "disjoint", "0"),
        (1000.0, 1000.0, 0.0, 0.0, False, False, "touching", "0"),
        (1000.0, 1000.0, 1.0, 0.0, False, False, "intersecting", "(0, 0.01]"),
        (1000.0, 216.0, 216.0, 0.0, False, True, "contained", ">0.50"),
        (1000.0, 1000.0, 0.0, 0.5, False, False, "near_miss", "0"),
        (1000.0, 1000.0, 10.0, 0.0, False, False, "intersecting", "(0, 0.01]"),
        (1000.0, 1000.0, 500.0, 0.0, False, False, "intersecting", "(0.20, 0.50]"),
        (1000.0, 1000.0, 510.0, 0.0, False, False, "intersecting", ">0.50"),
        (0.0, 1000.0, 0.0, 1.0, False, False, "invalid", None),
        (float("nan"), 1.0, 0.0, 1.0, False, False, "invalid", None),
        (1000.0, 1000.0, 0.0, float("inf"), False, False, "invalid", "0"),
        (1000.0, 1000.0, 0.0, 0.0, True, False, "invalid", "0"),
        (None, 1000.0, 0.0, 0.0, False, False, "invalid", None),
    ]
    c = F.col
    df = spark.createDataFrame(rows, RAW)
    out = df.select("want", "bucket", L.relation(c("va"), c("vb"), c("iv"), c("d"), c("ca"), c("cb"), F.lit("ok"), F.lit("ok")).alias("got"), L.volume_bucket(L.normalized_intersection(c("va"), c("vb"), c("iv"))).alias("b"))
    for r in out.collect():
        assert (r.got, r.b) == (r.want, r.bucket)


@pytest.mark.parametrize(
    ("task", "output", "want"),
    [
        ("binary_interference", "yes", "yes"), ("binary_interference", "yes\n", "yes"), ("binary_interference", "yes.", None),
        ("relation_classification", "near_miss", "near_miss"), ("volume_bucket", "(0.20, 0.50]", "(0.20, 0.50]"),
        ("axis_aligned_repair", "direction=+x, distance_mm=1.23", None), ("axis_aligned_repair", "direction=+x, distance_mm=1.2", "direction=+x, distance_mm=1.2"),
        ("ranking_normalized_intersection", "ABC", "ABC"), ("ranking_normalized_intersection", "ABCDE", "ABCDE"), ("ranking_normalized_intersection", "AAB", None),
        ("ranking_normalized_intersection", "AB", None), ("ranking_normalized_intersection", "ABCDEF", None), ("ranking_normalized_intersection", "ABCF", None), ("nothing", "yes", None),
    ],
)
def test_grammar(spark, task, output, want):
    assert spark.range(1).select(A.parse_answer(F.lit(task), F.lit(output)).alias("x")).first().x == want


def test_answer_element(spark):
    out = spark.createDataFrame([("<think>a</think><answer> X </answer>",), ("<answer>X</answer>",), ("X",)], "o string")
    assert [tuple(r) for r in out.select(A.candidate(F.col("o")), A.format_score(F.col("o"))).collect()] == [("X", 1.0), ("X", 0.85), ("X", 1.0)]


def test_rewards(spark):
    x = "direction=+x, distance_mm=1.0"
    row = spark.range(1).select(R.axis_reward(F.lit(x), F.lit(x)).alias("a"), R.signed_reward(F.lit("distance_mm=-1.0"), F.lit("distance_mm=1.0")).alias("s"), R.final(F.lit(1.0), F.lit("<answer>bad</answer>"), F.lit(None).cast("string")).alias("f")).first()
    assert row.a == pytest.approx(1.0)
    assert row.s < 0.3
    assert row.f == pytest.approx(0.03)


def test_group_keys(spark):
    row = spark.createDataFrame([("", "p", "c")], "a string, p string, c string").select(S.split_group(F.col("a"), F.col("p"), F.col("c")).alias("x"), S.metadata_group(F.col("c"), F.col("a"), F.col("p")).alias("y")).first()
    assert (row.x, row.y) == ("p", "c")


def test_run_order():
    assert D.run_order([("full", ["canary"]), ("canary", [])]) == ["canary", "full"]
    with pytest.raises(ValueError, match="unknown"):
        D.run_order([("full", ["none"])])
    with pytest.raises(ValueError, match="cycle"):
        D.run_order([("a", ["b"]), ("b", ["a"])])


def test_last_prediction_wins_and_unknown_tasks_stop(spark):
    from pyspark.errors import PySparkException

    from lithic.operators.evaluate import scored

    rows = spark.createDataFrame([("r1", "binary_interference", "yes")], "id string, task_type string, answer string")
    two = spark.createDataFrame([("r1", "no", 1), ("r1", "yes", 2)], "id string, output string, position int")
    assert [(r.parsed, r.correct) for r in scored(rows, two).collect()] == [("yes", True)]
    assert scored(rows, two.drop("position")).count() == 1
    odd = spark.createDataFrame([("r1", "no_such_task", "yes")], "id string, task_type string, answer string")
    with pytest.raises(PySparkException, match="no_such_task"):
        scored(odd, two).collect()


def test_digest_tells_null_places_apart(spark):
    from lithic.functions.hashing import digest

    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", "")], "x string, y string")
    assert df.select(digest("x", "y").alias("d")).distinct().count() == 3
