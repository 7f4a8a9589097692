"""The registered queries of this subpackage: opN_<name> over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._common import documents, table
from .exact_dedup import exact_dedup
from .hamming import top_k
from .mixing import mix
from .near_dedup import near_dedup
from .packing import pack
from .quality import quality
from .repeats import remove_repeats
from .token_output import token_output
from .toxicity import toxicity
from .wrapper import extract


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), width=3, threshold=0.85)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose id is divisible by 100, against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 100 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mixing, op2_near_dedup, op3_toxicity, op4_repeats, op5_token_output, op6_packing, op7_main_text, op8_quality, op9_exact_dedup, op10_top_k)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
             g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.norm) AS text_sha256
        FROM d JOIN g USING (norm)""",
    "op10_top_k": """
        WITH q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x > 0) AS qb FROM embeddings WHERE vec_id % 100 = 0),
             r AS (SELECT vec_id AS neighbour_id, list_transform(embedding, lambda x: x > 0) AS rb FROM embeddings),
             d AS (SELECT query_id, neighbour_id, CAST(list_sum(list_transform(range(1, len(qb) + 1), lambda i: CASE WHEN qb[i] <> rb[i] THEN 1 ELSE 0 END)) AS BIGINT) AS distance
                   FROM q JOIN r ON query_id <> neighbour_id),
             n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM d)
        SELECT query_id, rank, neighbour_id, distance FROM n WHERE rank <= 10""",
}
