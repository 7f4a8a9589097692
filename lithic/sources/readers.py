"""Readers: strict and tolerant JSON lines, Parquet, predictions, source trees, manifests."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Splits that an export knows; a directory may hold other files.
SPLITS = ("train", "validation", "test_random", "test_object_pair_heldout", "test_near_boundary", "test_generator_heldout", "test_topology_heldout", "test_operation_heldout")
PREDICTION = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "row_id", "output", "raw_completion")])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything stands at a path, by Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines with a fixed schema; blank lines don't count.

    strict: the first bad line fails the read. Else bad lines are left out, as for append-only logs.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_optional_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As read_jsonl; a missing file has no rows."""
    return read_jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_document(spark: SparkSession, path: str, schema: T.StructType | None = None) -> dict | None:
    """One JSON document, or None where there is none."""
    if not exists(spark, path):
        return None
    reader = spark.read.option("multiLine", "true")
    row = (reader.schema(schema) if schema else reader).json(path).first()
    return row.asDict(recursive=True) if row else None


def read_parquet(spark: SparkSession, path: str, splits: tuple[str, ...] | None = None) -> DataFrame:
    """A split-partitioned export; `splits` prunes partitions."""
    df = spark.read.parquet(path)
    return df.where(F.col("split").isin(*splits)) if splits else df


def read_split_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All files named after a known split, with the split as a column."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", "*.jsonl").json(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1)
    return df.withColumn("split", name).where(F.col("split").isin(*SPLITS))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(id, output, position): id or row_id, output or raw_completion, empty ones passed over.

    position orders duplicates: by file, then by the row's place in the read.
    """
    df = read_jsonl(spark, path, PREDICTION).withColumn("position", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    pick = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c])
    return df.select(pick("id", "row_id").alias("id"), F.coalesce(pick("output", "raw_completion"), F.lit("")).alias("output"), "position")


def read_sources(spark: SparkSession, path: str, prefixes: tuple[str, ...] = (), offset: int = 0, limit: int | None = None) -> DataFrame:
    """(path, code): *.py files below a directory, sorted by relative path, a slice of them. Bytes that aren't UTF-8 are replaced."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", "true").load(path)
    root = path.split("://")[-1].rstrip("/") + "/"
    rel = F.element_at(F.split(F.col("path"), F.lit(root.replace(".", r"\."))), -1)
    df = df.select(rel.alias("path"), F.col("content").cast("string").alias("code"))
    if prefixes:
        df = df.where(reduce(or_, (F.col("path").startswith(p) for p in prefixes)))
    df = df.orderBy("path").offset(offset)
    return df.limit(limit) if limit is not None else df


def accepted_rows(spark: SparkSession, paths: list[str], schema: T.StructType, key: str = "id") -> DataFrame:
    """Rows of several runs, the first run's row of each id, with the run's number."""
    runs = [read_jsonl(spark, p, schema).withColumn("run", F.lit(k)) for k, p in enumerate(paths)]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    w = Window.partitionBy(key).orderBy("run")
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def completed_ids(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """Ids that an append-only log has finished; a torn last line is passed over."""
    schema = T.StructType([T.StructField(key, T.StringType())])
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return read_jsonl(spark, path, schema, strict=False).where(F.col(key).isNotNull()).distinct()
