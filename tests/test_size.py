"""Shared steps that larger tables go through: small code, one pass, the same results."""

import re

import pytest
from pyspark.sql import functions as F

from lithic.functions import canonical as C
from lithic.operators import evaluate as E
from lithic.operators import exports as X
from lithic.plans import catalog

SF = "/root/testdata/sf0.001"
#: Longer methods are never compiled by the JVM: a pass over the geometries then takes five times as long.
JIT = 8_000


def methods(spark, df):
    text = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(df._jdf.queryExecution().executedPlan())
    return [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]


@pytest.fixture
def whole_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def compiled(spark, name):
    sizes = methods(spark, catalog.QUERIES[name](spark, SF))
    assert sizes and max(sizes) <= JIT


NAMES = ["failure_cases", "comparison_table", "aligned_outcomes", "failure_breakdown", "public_rows", "run_report", "zero_shot_requests", "missing_and_unknown_predictions", "parse_answers", "known_predictions", "dispatched_rewards", "per_label_accuracy", "relation_balanced_rows"]


@pytest.mark.parametrize("name", NAMES)
def test_methods_are_compiled(spark, whole_plans, name):
    compiled(spark, name)


def test_canonical_texts_without_python(spark):
    texts = [None, "", "plain", 'a "q" \\ b', "l\n\t\r", "\x00\x08\x0c\x1f\x7f", "\u00e9\u2028", "\U0001f600x\n\""]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", C.quoted(F.col("t")).alias("q")).collect()
    assert {r["k"]: r["q"] for r in rows} == {i: C.canonical(t) for i, t in enumerate(texts)}


def test_keyed_join_as_plain_join(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "id string, a int")
    b = spark.createDataFrame([("x", 5), ("x", 6), (None, 7), ("z", 8)], "id string, b int")
    for how in ("inner", "left", "full_outer", "left_anti"):
        assert sorted(map(repr, E.keyed(a, b, "id", how).collect())) == sorted(map(repr, a.join(b, "id", how).collect()))


def test_failure_report_counts_each_table_once(spark):
    empty = spark.createDataFrame([], "task_type string, parsed string, correct boolean")
    checks = spark.createDataFrame([(1, True, None), (2, False, "timeout"), (3, None, None)], "object_id long, valid boolean, reason string")
    fails = spark.createDataFrame([], "reason string")
    got = {(r["section"], r["name"]): r["n"] for r in X.failure_cases(empty, checks, fails, empty).collect()}
    assert got == {("summary", "rows"): 0, ("summary", "validations"): 3, ("summary", "invalid_validations"): 2, ("summary", "failures"): 0, ("validation_failures", "timeout"): 1, ("validation_failures", None): 1}
