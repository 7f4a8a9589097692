"""Readers, writers and the resumable stream."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.sources import readers as R
from lithic.sources import writers as W
from lithic.streaming.resume import resume

ROW = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], ROW)
    assert W.write_jsonl(df, f"{tmp_path}/x") == 2
    assert sorted(R.read_jsonl(spark, f"{tmp_path}/x", ROW).collect()) == sorted(df.collect())
    assert R.read_optional_jsonl(spark, f"{tmp_path}/none", ROW).count() == 0
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n\n{"id": \n')
    assert [r.id for r in R.completed_ids(spark, f"{tmp_path}/bad.jsonl").collect()] == ["a"]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        R.read_jsonl(spark, f"{tmp_path}/bad.jsonl", ROW).collect()


def test_splits_and_manifest(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 70, "train").otherwise("validation").alias("split"), F.struct("id").alias("s"))
    counts = W.write_splits(df, f"{tmp_path}/d")
    assert counts["train"] == 70 and counts["validation"] == 30 and counts["test_random"] == 0
    with pytest.raises(FileExistsError):
        W.write_splits(df, f"{tmp_path}/d")
    assert R.read_parquet(spark, f"{tmp_path}/d", ("validation",)).count() == 30
    assert W.flattened(df).columns == ["id", "split", "s_json"]
    assert W.write_manifest(df, f"{tmp_path}/m.json", ["split"])["split"] == {"train": 70, "validation": 30}
    assert R.read_document(spark, f"{tmp_path}/m.json")["split"]["train"] == 70


def test_predictions_and_sources(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"row_id": "a", "output": "", "raw_completion": "yes"}\n{"id": "b", "output": "no"}\n')
    assert sorted((r.id, r.output) for r in R.read_predictions(spark, f"{tmp_path}/p.jsonl").collect()) == [("a", "yes"), ("b", "no")]
    for name in ("keep/b.py", "keep/a.py", "drop/c.py", "keep/n.txt"):
        f = tmp_path / "src" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(f"# {name}")
    assert [r.path for r in R.read_sources(spark, f"{tmp_path}/src", ("keep/",)).collect()] == ["keep/a.py", "keep/b.py"]
    assert [r.path for r in R.read_sources(spark, f"{tmp_path}/src", ("keep/",), offset=1, limit=1).collect()] == ["keep/b.py"]


def test_resume(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i, 1) for i in ids], ROW).write.mode("append").parquet(f"{tmp_path}/in")
    go = lambda: resume(spark, f"{tmp_path}/in", ROW, f"{tmp_path}/out", f"{tmp_path}/cp", lambda d: d).awaitTermination()
    rows("a", "b")
    go()
    rows("b", "c")
    go()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c"]


def test_tar_source(spark, tmp_path):
    import io
    import tarfile

    from lithic.sources.archive import register

    with tarfile.open(tmp_path / "s.tar", "w") as tar:
        for name, data in (("keep/b.py", b"b"), ("keep/a.py", b"\xff a"), ("drop/c.py", b"c"), ("../x.py", b"x"), ("keep/n.txt", b"n")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    register(spark)
    got = spark.read.format("tar_sources").option("prefixes", "keep/").option("members", "1").load(f"{tmp_path}/s.tar").collect()
    assert sorted(tuple(r) for r in got) == [("keep/a.py", "� a"), ("keep/b.py", "b")]


def test_config():
    from lithic.sources.config import Config, parse

    assert parse('{"workers": 9}').digest() == Config().digest()
    assert parse('{"seed": 9}').digest() != Config().digest()
    with pytest.raises(ValueError, match="unknown settings: nothing"):
        parse('{"nothing": 1}')
