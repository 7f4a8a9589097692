"""Writers: JSON lines, split-partitioned Parquet, flat public tables, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import SPLITS, exists


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file, by Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def write_jsonl(rows: DataFrame, path: str) -> int:
    """One JSON object a line, nulls kept; returns how many."""
    rows.write.option("ignoreNullFields", "false").json(path)
    return rows.sparkSession.read.text(path).count()


def write_splits(rows: DataFrame, path: str, key: str = "id", splits: tuple[str, ...] = SPLITS[:5]) -> dict[str, int]:
    """Parquet partitioned by split and sorted by `key` within each file; returns rows by split, 0 for empty ones.

    A split goes to as many tasks as its hash ranges of keys, so a large one isn't one task's work. An existing path is
    never overwritten: a new version takes a new path.
    """
    spark = rows.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    spread = F.pmod(F.xxhash64(key), F.lit(16))
    rows.repartition("split", spread).sortWithinPartitions("split", key).write.option("compression", "zstd").partitionBy("split").parquet(path)
    counts = {r["split"]: r["n"] for r in spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {s: counts.get(s, 0) for s in (*splits, *sorted(set(counts) - set(splits)))}


def flattened(rows: DataFrame) -> DataFrame:
    """The public table: nested columns as JSON text in <name>_json, scalars as text."""
    nested = ("struct", "array", "map", "variant")
    return rows.select(*[F.to_json(F.col(f.name)).alias(f"{f.name}_json") if f.dataType.typeName() in nested else F.col(f.name).cast("string").alias(f.name) for f in rows.schema.fields])


def write_manifest(rows: DataFrame, path: str, dimensions: list[str], extra: dict | None = None) -> dict:
    """Counts by each dimension (one grouping-sets pass) as a JSON document; returns it."""
    each = F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).cast("string").alias("v")) for d in dimensions])
    counts = rows.select(F.inline(each)).groupBy("d", "v").agg(F.count(F.lit(1)).alias("n")).collect()
    doc = {d: {str(r["v"]): r["n"] for r in sorted(counts, key=lambda r: str(r["v"])) if r["d"] == d} for d in dimensions} | (extra or {})
    put_text(rows.sparkSession, path, json.dumps(doc, indent=2, sort_keys=True))
    return doc
