"""Corpus pipeline: toxicity, exact dedup, near-dedup, mixing and packing over `documents`.

STAGES are (name, function) in order; each takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents:

1. toxicity: documents that the classifier rejects (score of 0.5 or more) go.
2. exact dedup: of equal texts (A-Z lower-cased) the largest doc_id stays.
3. near-dedup: five-word shingles, similarity of 0.8 or more; one document of each group stays. Rows that
   share an id and are near copies of each other all stay if that id is the least of their group.
4. mixing: sources get target weights; a document is repeated as often as the mix takes it, and goes where it takes none.
5. packing: pieces of the documents in sequences of several lengths.

Rows that a stage's operator can't tell apart (equal id and text) stay once after stage 2. A null doc_id is an id
of its own to every stage but the joins by id, which compare it null-safely. Documents without words leave at mixing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm._common import ascii_lower, fresh_path, table, text_or_empty, written
from lithic.llm.exact_dedup import exact_dedup
from lithic.llm.mixing import mix
from lithic.llm.near_dedup import near_dedup
from lithic.llm.packing import pack
from lithic.llm.routing import routed, without
from lithic.llm.toxicity import toxic_filter

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxic_filter(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_filter(docs.select(COLUMNS))


def exact_filter(docs: DataFrame) -> DataFrame:
    """Documents that exact dedup keeps; rows that repeat an id and a text stay once."""
    row = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2(ascii_lower(text_or_empty()), 256)), 256)
    told = exact_dedup(docs).withColumn("_row", F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_sha256"), 256))
    told = written(told.where("group_size > 1").select("_row", "kept", "group_size"), "pipeline-copies")
    out = without(docs.withColumn("_row", row), "_row", told.where(~F.col("kept")).select("_row"))
    repeats = told.where("kept and group_size > 1").groupBy("_row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_row")
    repeats = written(repeats, "pipeline-repeats")
    if repeats.isEmpty():
        return out.select(COLUMNS)
    again = routed(out, "_row", repeats).join(repeats, "_row")
    once = again.groupBy("_row").agg(F.min(F.struct("text", "doc_id", "lang", "source", "n_chars")).alias("r")).select([F.col(f"r.{c}").alias(c) for c in COLUMNS])
    return without(out, "_row", repeats).select(COLUMNS).union(once)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_filter(docs.select(COLUMNS))


def near_filter(docs: DataFrame) -> DataFrame:
    """Documents that near-dedup keeps, told apart by id and text."""
    key = lambda digest: F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), digest), 256)
    told = near_dedup(docs, digest_col="_digest").where(~F.col("kept")).select(key(F.lower(F.hex("_digest"))).alias("_row"))
    told = written(told, "pipeline-near-copies")
    return without(docs.withColumn("_row", key(F.sha2(text_or_empty(), 256))), "_row", told).select(COLUMNS)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mix(docs.select(COLUMNS), carry=("text", "lang", "n_chars"))
    passes = F.expr("if(size > 0, taken div size, 0)")
    return mixed.where("taken > 0").select(COLUMNS[0], "text", "lang", "source", "n_chars", F.explode(F.sequence(F.lit(1).cast("long"), passes)).alias("_pass")).select(COLUMNS)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", _toxicity),
    ("exact dedup", _exact),
    ("near-dedup", _near),
    ("mixing", _mixing),
    ("packing", _packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
