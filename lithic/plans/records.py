"""Queries over single records: hashes, checks, summaries, text helpers, the tool-assisted bound."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import hashing as H
from ..functions import labels as L
from ..operators import records as R
from .frames import GEO_SQL, geometries, table
from .geometry import _MOVES, _TASKS, task_rows

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _hex(value: str, digits: int) -> str:
    return f"CAST(concat('0x', substr(sha256({value}), 1, {digits})) AS BIGINT)"


@query(f"SELECT p_partkey AS id, {_hex("'1234:' || p_name", 12)} % 100 AS bucket, round({_hex('p_name', 12)} / (pow(16, 12) - 1), 6) AS unit, {_hex('p_name', 8)} % 6 AS idx, 'sha256:' || sha256(p_name || ':' || p_brand) AS digest FROM part")
def stable_hashes(spark, sf):
    name = F.col("p_name")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), H.stable_bucket(name, 1234, 100).alias("bucket"), F.round(H.stable_unit(name), 6).alias("unit"), H.stable_index(name, 6).alias("idx"), H.digest("p_name", "p_brand").alias("digest"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return R.duplicate_ids(table(spark, sf, "events"), "user_id")


@query("SELECT lang, count(*) AS n, min(n_chars) AS least, max(n_chars) AS greatest, round(avg(n_chars), 6) AS mean FROM documents GROUP BY 1")
def length_summary(spark, sf):
    return R.length_summary(table(spark, sf, "documents"), "lang", F.col("n_chars"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, count(*) OVER (PARTITION BY user_id) AS group_size FROM events")
def group_relative_rank(spark, sf):
    e = R.relative_rank(table(spark, sf, "events").select("event_id", "user_id", "value"), "user_id", "value", "event_id")
    return e.select("event_id", "user_id", "rank", "group_size")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 50 OFFSET 25")
def path_slice(spark, sf):
    return R.page(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", 25, 50)


@query(r"SELECT conv_id, turn, lower(regexp_replace(trim(split_part(trim(text, chr(32) || chr(9) || chr(13) || chr(10)), chr(10), 1), chr(32) || chr(9) || chr(13) || chr(10)), '^[\s" + "\"" + r"''`.,:;!]+|[\s" + "\"" + r"''`.,:;!]+$', '', 'g')) AS answer FROM conversations WHERE turn = 1")
def normalized_answers(spark, sf):
    return table(spark, sf, "conversations").where("turn = 1").select("conv_id", "turn", R.normalized_answer(F.col("text")).alias("answer"))


@query(r"SELECT conv_id, turn, lower(regexp_replace(trim(split_part(trim(text, chr(32) || chr(9) || chr(13) || chr(10)), chr(10), 1), chr(32) || chr(9) || chr(13) || chr(10)), '^[\s" + "\"" + r"''`.,:;!]+|[\s" + "\"" + r"''`.,:;!]+$', '', 'g')) AS answer FROM conversations")
def all_normalized_answers(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", R.normalized_answer(F.col("text")).alias("answer"))


@query("""WITH t AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN '<think>' || text || '</think>' WHEN 1 THEN '<think>so so so so</think>' || text ELSE text END AS x FROM conversations),
    w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(regexp_extract(x, '(?s)<think>(.*?)</think>', 1)), '\\s+'), lambda v: v <> '') AS words FROM t)
    SELECT conv_id, turn, len(words) >= 4 AND len(list_distinct(words)) >= 4 AS reasoned FROM w""")
def nontrivial_reasoning(spark, sf):
    c, k = table(spark, sf, "conversations"), F.col("conv_id") % 3
    x = F.when(k == 0, F.concat(F.lit("<think>"), "text", F.lit("</think>"))).when(k == 1, F.concat(F.lit("<think>so so so so</think>"), "text")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", R.has_reasoning_words(x).alias("reasoned"))


@query("""SELECT page_id, list_transform(string_split(replace(url, '://', '|'), '|'), lambda p: array_to_string(string_split(p, '/')[1:2], '/')) AS subsets, regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g') AS slug FROM pages""")
def source_subsets(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", R.source_subsets(F.replace(u, F.lit("://"), F.lit("|"))).alias("subsets"), R.slug(u).alias("slug"))


@query(f"WITH {GEO_SQL} SELECT pair_id, list_sort(list(geometry_id)) AS ids FROM geo WHERE relation = 'intersecting' GROUP BY 1 HAVING count(*) >= 2")
def counterfactual_groups(spark, sf):
    return R.id_groups(geometries(spark, sf).where("relation = 'intersecting'").select("pair_id", "geometry_id"), "pair_id", "geometry_id")


@query("SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN lower(text) LIKE '%the%' THEN 'has_the' END, CASE WHEN lower(text) LIKE '%nan%' THEN 'nan' END, CASE WHEN lower(text) LIKE '%out of memory%' THEN 'memory' END], lambda v: v IS NOT NULL)) AS rule FROM conversations) GROUP BY 1")
def stop_signals(spark, sf):
    return R.stop_signals(table(spark, sf, "conversations"), "text", {"has_the": "the", "nan": "nan", "memory": "out of memory"})


@query("SELECT 'optimizer_row_outside_train' AS problem, split, count(*) AS n FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'validation' WHEN 1 THEN 'test_random' ELSE 'train' END AS split, o_orderkey % 7 = 0 AS opt FROM orders) WHERE opt AND split <> 'train' GROUP BY split")
def preflight(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(F.when(k % 5 == 0, "validation").when(k % 5 == 1, "test_random").otherwise("train").alias("split"), (k % 7 == 0).alias("opt"))
    return R.preflight(o, "split", "opt")


@query(f"WITH {GEO_SQL} SELECT 'valid' AS kind, 'ok' AS reason, count(*) AS n FROM geo WHERE relation <> 'invalid' GROUP BY ALL UNION ALL SELECT 'valid', strategy, count(*) FROM geo WHERE relation <> 'invalid' GROUP BY ALL")
def manifest_stats(spark, sf):
    g = geometries(spark, sf)
    each = F.array(F.lit("ok"), F.col("strategy"))
    return g.select(F.when(F.col("relation") != "invalid", "valid").otherwise("invalid").alias("kind"), F.explode_outer(each).alias("reason")).groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_TASKS}, t AS (SELECT task_type, CASE WHEN task_type = 'binary_interference' THEN CASE WHEN relation IN ('intersecting', 'contained') THEN 'yes' ELSE 'no' END WHEN task_type = 'relation_classification' THEN relation ELSE answer END = answer AS ok FROM task_rows) SELECT task_type, count(*) AS total, count(*) FILTER (ok) AS n_correct FROM t GROUP BY 1")
def tool_assisted_bound(spark, sf):
    """Answers taken from stored labels: the most that a system with exact measurements can reach."""
    r, t = task_rows(spark, sf, number=False), F.col("task_type")
    mine = F.when(t == "binary_interference", L.binary_answer(F.col("relation"))).when(t == "relation_classification", F.col("relation")).otherwise(F.col("answer"))
    return r.groupBy("task_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(mine == F.col("answer")).alias("n_correct"))


@query(f"""WITH {_MOVES}, six AS (SELECT geometry_id, direction, CASE WHEN substr(geometry_id, 6, 8)::BIGINT % 23 = 0 AND rank = 0 THEN magnitude + 1 ELSE magnitude END AS stored, magnitude FROM rk WHERE relation IN ('intersecting', 'contained'))
    SELECT geometry_id, count(*) FILTER (abs(stored - magnitude) > 1e-9) AS wrong FROM six GROUP BY 1 HAVING count(*) FILTER (abs(stored - magnitude) > 1e-9) > 0""")
def repair_metadata_check(spark, sf):
    """Stored moves recomputed from the boxes at 1e-9; some were tampered with."""
    g = geometries(spark, sf).where(L.interferes(F.col("relation"))).withColumn("six", B.moves("a", "b"))
    stored = F.transform("six", lambda m: m["magnitude"] + F.when((F.col("a_object_id") % 23 == 0) & (m["rank"] == 0), 1.0).otherwise(0.0))
    wrong = F.size(F.filter(F.zip_with(stored, "six", lambda s, m: F.abs(s - m["magnitude"]) > 1e-9), lambda x: x)).cast("long")
    return g.select("geometry_id", wrong.alias("wrong")).where("wrong > 0")
