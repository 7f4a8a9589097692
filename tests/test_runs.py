"""Run directories, manifests, logs, plug-ins, and checks that raise."""

import json
import time

import pytest
from pyspark.sql import functions as F

from lithic.functions import canonical as C
from lithic.functions import texts as T
from lithic.operators import exports as X
from lithic.operators import selection as S
from lithic.operators.runner import Materializers, isolated
from lithic.sources import runs as U


def double(x):
    return 2 * x


def wait(seconds):
    time.sleep(seconds)


def test_run_manifest(tmp_path):
    path = tmp_path / "runs.json"
    path.write_text(json.dumps({"runs": [{"name": "full", "depends_on": ["canary"]}, {"name": "canary"}, {"name": "other"}]}))
    m = U.load_run_manifest(str(path))
    assert m["order"] == ["canary", "full", "other"]
    assert U.wanted_runs(m, ["full"]) == ["canary", "full"]
    path.write_text(json.dumps({"runs": [{"name": "a", "depends_on": ["b"]}]}))
    with pytest.raises(ValueError, match="unknown dependency"):
        U.load_run_manifest(str(path))


def test_run_directory(tmp_path):
    run = U.RunDirectory(str(tmp_path / "run")).create({"name": "x"})
    assert run.read("status.json")["state"] == "initialized" and "pyspark" in run.read("run_manifest.json")["environment"]
    (tmp_path / "run" / "out.txt").write_text("hello")
    run.add_artifact("out", "out.txt")
    assert run.broken_artifacts() == []
    (tmp_path / "run" / "out.txt").write_text("changed")
    assert run.broken_artifacts() == ["out"]
    with pytest.raises(FileExistsError):
        U.RunDirectory(str(tmp_path / "run")).create({})
    assert U.manifest_identity({"a": 1, "host": "x"}) == U.manifest_identity({"host": "y", "a": 1}) != U.manifest_identity({"a": 2})


def test_metrics_log_and_tail(tmp_path):
    path = str(tmp_path / "m.jsonl")
    for k in range(1, 6):
        U.append_metrics(path, k, {"loss": 1 / k})
    with pytest.raises(ValueError, match="step 5"):
        U.append_metrics(path, 5, {})
    assert [json.loads(x)["step"] for x in U.tail(path, 2)] == [4, 5]
    assert U.tail(str(tmp_path / "none"), 3) == []
    U.write_shard_progress(str(tmp_path / "p.json"), [{"shard": 1, "status": "validated"}, {"shard": 0, "status": "failed"}])
    assert json.loads((tmp_path / "p.json").read_text())["done"] == 1


def test_file_digests(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.bin").write_bytes(b"abc")
    r = U.file_digests(spark, str(tmp_path / "d")).first()
    assert r.digest == U.sha256_file(tmp_path / "d" / "a.bin") and r.length == 3


def test_isolated():
    assert isolated(double, 4, seconds=60) == (True, 8)
    assert isolated(double, None, seconds=60)[1].startswith("TypeError")
    assert isolated(wait, 60, seconds=0.5) == (False, "timeout")


def test_materializers(spark):
    m, seen = Materializers(), []
    m.register("a")(lambda r: r.select(F.lit("a").alias("task"), "id"))
    m.register("b")(lambda r: r.where("id > 1").select(F.lit("b").alias("task"), "id"))
    rows = m.rows(spark.range(3), ["b", "a"], lambda k, n, t: seen.append((k, n, t)))
    assert sorted(map(tuple, rows.collect())) == [("a", 0), ("a", 1), ("a", 2), ("b", 2)] and seen == [(1, 2, "b"), (2, 2, "a")]
    with pytest.raises(ValueError, match="unknown task: z"):
        m.rows(spark.range(1), ["z"])
    with pytest.raises(ValueError):
        m.register("a")(double)


def test_canonical_json(spark):
    values = [{"b": 1e-6, "a": [True, None, "é\n\""]}, {"z": {"y": 2, "x": 1.5}}, "ü", 3]
    df = spark.createDataFrame([(json.dumps(v, indent=2),) for v in values] + [(None,)], "t string")
    got = [r.c for r in df.select(C.canonical_json(F.col("t")).alias("c")).collect()]
    assert got == [json.dumps(v, sort_keys=True, separators=(",", ":")) for v in values] + [None]


def test_selection_limits(spark):
    rows = spark.range(10).withColumn("task", F.col("id") % 2)
    assert S.require_rows(rows, 10) is rows
    with pytest.raises(ValueError, match="11 rows"):
        S.require_rows(rows, 11)
    assert S.select_rows(rows, "id", None).count() == S.select_rows(rows, "id", 99).count() == 10
    assert [r.task for r in S.select_rows(rows, "id", 4).collect()] == [0, 1, 0, 1]
    with pytest.raises(ValueError, match="unknown strategy"):
        S.select_rows(rows, "id", 1, "other")
    with pytest.raises(ValueError, match="needs the answer"):
        S.select_rows(rows, "id", 1, "stratified_task_answer")
    with pytest.raises(ValueError, match="positive"):
        S.sample_tasks(rows, "id", "task", [], [], 1, 0)


def test_texts_that_stop_or_edge(spark):
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([("def f(x):\n    return def f(", "f", "g")], "code string, old string, new string")
    assert df.select(T.renamed_function(F.col("code"), F.col("old"), F.col("new"))).first()[0] == "def g(x):\n    return def f("
    with pytest.raises(PySparkException, match="cannot rename z"):
        df.select(T.renamed_function(F.col("code"), F.lit("z"), F.col("new"))).collect()
    assert df.select(T.indented_function(F.lit("a = 1\n\nb = a\n"), "make")).first()[0] == "def make():\n    a = 1\n\n    b = a\n"
    assert df.select(X.few_shot_text(F.array().cast("array<struct<prompt:string,answer:string>>"), F.lit("q"))).first()[0] == "Target prompt:\nq"
    assert [df.select(T.size_category(F.lit(n))).first()[0] for n in (1, 1000, 99_999, 100_000, 1_000_000)] == ["n<1K", "1K<n<10K", "10K<n<100K", "100K<n<1M", "n>1M"]
    assert df.select(T.formatted_counts(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(1), F.lit(2)))).first()[0] == "a=1, b=2"
    assert df.select(T.relation_meaning(F.lit("odd")), T.holdout_rule(F.lit("train"))).first()[:] == ("unknown", "none")
