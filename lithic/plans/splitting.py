"""Queries over splits, audits, balance and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import order_key
from ..operators import sampling as S
from ..operators import splits as P
from .frames import GEO_SQL, geometries, table
from .geometry import _TASKS, task_rows

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _b(value: str, seed: int, m: int) -> str:
    return f"(CAST(concat('0x', substr(sha256('{seed}:' || {value}), 1, 12)) AS BIGINT) % {m})"


def _case(bucket: str, bounds) -> str:
    return "CASE " + " ".join(f"WHEN {bucket} < {b} THEN '{s}'" for b, s in bounds) + " END"


_PLAIN, _BOUND = _case(_b("g", 1234, 100), P.PLAIN), _case(_b("('boundary:' || g)", 1234, 100), P.BOUNDARY)
_HELD = "held AS (SELECT DISTINCT o_orderpriority AS gen FROM orders WHERE " + _b("o_orderpriority", 1234, 100) + " >= 88), heldout AS (SELECT gen FROM held UNION ALL SELECT max(o_orderpriority) FROM orders HAVING (SELECT count(*) FROM held) = 0)"
_ORDERS = "o AS (SELECT o_orderkey AS id, 'cust_' || o_custkey AS g, o_orderpriority AS gen, o_orderstatus AS answer, 'task_' || (o_orderkey % 4) AS task FROM orders)"


def orders(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("g"), F.col("o_orderpriority").alias("gen"), F.col("o_orderstatus").alias("answer"), F.concat(F.lit("task_"), (F.col("o_orderkey") % 4).cast("string")).alias("task"), F.col("o_totalprice").alias("price"))


_SPLITS = f"""{_ORDERS}, {_HELD}, gs AS (SELECT g, bool_or(id % 97 = 0) AS synthetic, bool_or(gen IN (SELECT gen FROM heldout) AND id % 5 = 0) AS heldout, bool_or(id % 11 = 0) AS boundary FROM o GROUP BY g),
    sp AS (SELECT g, CASE WHEN synthetic THEN CASE {_b('g', 1234, 3)} WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test_random' END WHEN heldout THEN 'test_generator_heldout' WHEN boundary THEN {_BOUND} ELSE {_PLAIN} END AS split FROM gs)"""


def _splits(spark, sf):
    o = orders(spark, sf)
    held = P.heldout_generators(o, "gen").select(F.collect_list("generator").alias("held"))  # categories
    g = o.crossJoin(F.broadcast(held)).groupBy("g").agg(F.bool_or(F.col("id") % 97 == 0).alias("synthetic"), F.bool_or(F.array_contains("held", F.col("gen")) & (F.col("id") % 5 == 0)).alias("heldout"), F.bool_or(F.col("id") % 11 == 0).alias("boundary"))
    return P.group_splits(g, "g", "synthetic", "heldout", "boundary").select("g", "split")


@query(f"WITH {_SPLITS} SELECT g, split FROM sp")
def group_split(spark, sf):
    return _splits(spark, sf)


@query(f"WITH {GEO_SQL}, p AS (SELECT pair_id AS g, bool_or(relation IN ('touching', 'near_miss')) AS near FROM geo GROUP BY 1) SELECT g AS pair_id, CASE WHEN near THEN {_BOUND} ELSE {_PLAIN} END AS split FROM p")
def boundary_split(spark, sf):
    g = geometries(spark, sf).groupBy("pair_id").agg(F.bool_or(F.col("relation").isin("touching", "near_miss")).alias("near"))
    return g.select("pair_id", F.when(F.col("near"), P.boundary_split(F.col("pair_id"))).otherwise(P.plain_split(F.col("pair_id"))).alias("split"))


@query(f"WITH {_HELD} SELECT gen AS generator FROM heldout")
def heldout_generators(spark, sf):
    return P.heldout_generators(orders(spark, sf), "gen")


@query(f"""WITH v AS (SELECT DISTINCT p_partkey AS g, trim(unnest([p_brand, p_type])) AS value FROM part), c AS (SELECT value, count(*) AS groups FROM v WHERE value <> '' GROUP BY 1),
    t AS (SELECT count(DISTINCT p_partkey) AS n FROM part)
    SELECT value, groups FROM c, t WHERE n >= 3 AND (SELECT count(*) FROM c) >= 2 AND groups <= greatest(1, n // 5) AND groups < n ORDER BY groups, {_b("('topology:' || value)", 1234, 1000000)}, value LIMIT 1""")
def heldout_rare_value(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("g"), F.array("p_brand", "p_type").alias("tags"))
    return P.heldout_value(p, "g", "tags", "topology")


@query(f"WITH {_ORDERS}, g AS (SELECT DISTINCT g FROM o) SELECT g, CASE WHEN {_b('g', 1234, 1000000)} < 100000 THEN 'inner_eval' ELSE 'inner_train' END AS split FROM g")
def inner_train_eval(spark, sf):
    return P.inner_train_eval(orders(spark, sf), "g")


@query()
def balanced_inner_eval(spark, sf):
    return P.balanced_eval_groups(orders(spark, sf), "g", "task", "answer")


@query(f"""WITH {_SPLITS}, r AS (SELECT DISTINCT split, field, value FROM (SELECT sp.split, 'gen' AS field, o.gen AS value FROM o JOIN sp USING (g) UNION ALL SELECT sp.split, 'g', o.g FROM o JOIN sp USING (g)))
    SELECT a.field, a.value, a.split AS split_a, b.split AS split_b FROM r a JOIN r b ON a.field = b.field AND a.value = b.value AND a.split < b.split""")
def leakage_audit(spark, sf):
    return P.leakage(orders(spark, sf).join(_splits(spark, sf), "g"), "split", ["gen", "g"])


@query(f"""WITH {_TASKS}, s AS (SELECT *, pair_id AS g FROM task_rows), t AS (SELECT *, {_PLAIN} AS split FROM s)
    SELECT split, count(*) AS n_rows, count(DISTINCT pair_id) AS n_groups, list_sort(list_distinct(list(task_type))) AS tasks, count(*) FILTER (answer = 'yes') AS yes, count(*) FILTER (answer = 'no') AS no FROM t GROUP BY split""")
def split_manifest(spark, sf):
    return P.split_manifest(task_rows(spark, sf, number=False).withColumn("split", P.plain_split(F.col("pair_id"))), "split", "pair_id", "task_type", "answer")


@query(f"WITH {_SPLITS} SELECT split, count(*) AS n FROM sp GROUP BY split")
def split_name_list(spark, sf):
    return _splits(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


_T = "t(relation, share) AS (VALUES ('intersecting', 0.4), ('disjoint', 0.3), ('touching', 0.15), ('near_miss', 0.15))"
TARGETS = {"intersecting": 0.4, "disjoint": 0.3, "touching": 0.15, "near_miss": 0.15}
_APP = f"""{_T}, c AS (SELECT relation, share::DOUBLE AS share, count(*) AS available FROM geo JOIN t USING (relation) GROUP BY ALL),
    m AS (SELECT floor(min(available / share))::BIGINT AS base FROM c), n AS (SELECT unnest(range(greatest(1, base - 4), base + 5)) AS total FROM m),
    e AS (SELECT total, relation, available, total * share AS exact, floor(total * share + 1e-9)::BIGINT AS whole FROM n, c),
    f AS (SELECT *, total - sum(whole) OVER (PARTITION BY total) AS lft, row_number() OVER (PARTITION BY total ORDER BY round(exact - whole, 9) DESC, relation) AS r FROM e),
    p AS (SELECT total, relation, available, whole + CASE WHEN r <= lft THEN 1 ELSE 0 END AS part FROM f),
    best AS (SELECT max(total) AS total FROM (SELECT total FROM p GROUP BY total HAVING bool_and(part <= available AND part > 0)))"""


@query(f"WITH {GEO_SQL}, {_APP} SELECT relation, part::BIGINT AS part FROM p JOIN best USING (total)")
def apportion_counts(spark, sf):
    share = spark.createDataFrame(list(TARGETS.items()), "relation string, share double")
    c = geometries(spark, sf).groupBy("relation").agg(F.count(F.lit(1)).alias("available")).join(F.broadcast(share), "relation")
    return S.apportion(c, "relation", "available", "share")


@query(f"""WITH {GEO_SQL}, {_APP}, r AS (SELECT geometry_id, relation, row_number() OVER (PARTITION BY relation ORDER BY sha256('7:' || geometry_id), geometry_id) AS r FROM geo)
    SELECT geometry_id, relation FROM r LEFT JOIN (SELECT relation AS rel, part FROM p JOIN best USING (total)) q ON rel = relation WHERE part IS NULL OR r <= part""")
def relation_balanced_rows(spark, sf):
    g = geometries(spark, sf).select("geometry_id", "relation")
    return S.relation_balanced(g, "relation", "geometry_id", TARGETS, order_key(7, F.col("geometry_id")))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY sha256('7:' || l_orderkey || ':' || l_linenumber), l_orderkey, l_linenumber) AS r,
        count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem), m AS (SELECT l_returnflag, min(n) AS least FROM l GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM l JOIN m USING (l_returnflag) WHERE r <= least""")
def pairwise_cap(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    key = order_key(7, F.col("l_orderkey"), F.col("l_linenumber"))
    return S.cap_to_smallest(li, ["l_returnflag"], "l_linestatus", key, [F.col("l_orderkey"), F.col("l_linenumber")])


@query(f"""WITH {_ORDERS}, a AS (SELECT id, task, answer, row_number() OVER (PARTITION BY task, answer ORDER BY id) AS a FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY a, answer) AS t FROM a)
    SELECT id, task, answer FROM b ORDER BY t, task LIMIT 500""")
def round_robin_limit(spark, sf):
    return S.round_robin(orders(spark, sf).select("id", "task", "answer"), "task", "answer", "id", 500)


@query(f"""WITH {GEO_SQL}, r AS (SELECT geometry_id, relation, row_number() OVER (PARTITION BY relation ORDER BY geometry_id) AS r FROM geo) SELECT geometry_id, relation FROM r ORDER BY r, relation LIMIT 777""")
def relation_round_robin(spark, sf):
    g = geometries(spark, sf).select("geometry_id", "relation").withColumn("all", F.lit("all"))
    return S.round_robin(g, "all", "relation", "geometry_id", 777).select("geometry_id", "relation")


@query(f"""WITH {_ORDERS}, r AS (SELECT id, task, answer, row_number() OVER (PARTITION BY task, answer ORDER BY sha256('7:' || id), id) AS r FROM o) SELECT id, task, answer FROM r ORDER BY r, task, answer LIMIT 300""")
def stratified_sample(spark, sf):
    return S.stratified(orders(spark, sf).select("id", "task", "answer"), ["task", "answer"], "id", 300)


@query("""WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), w AS (SELECT *, least(40, n * 3) AS want FROM n),
    c AS (SELECT doc_id, d.source, d.lang, n, want, unnest(range(1, CAST(ceil(want / n) AS BIGINT) + 1)) AS copy FROM documents d JOIN w ON d.source = w.source AND d.lang = w.lang),
    r AS (SELECT *, row_number() OVER (PARTITION BY source, lang, copy ORDER BY sha256('7:' || copy || ':' || doc_id), doc_id) AS r FROM c)
    SELECT doc_id, source, lang, copy FROM r WHERE (copy - 1) * n + r <= want""")
def balanced_upsample(spark, sf):
    return S.balanced_upsample(table(spark, sf, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id", 40)


@query("WITH g AS (SELECT DISTINCT c_nationkey AS g FROM customer) SELECT g FROM g ORDER BY sha256('7:' || g), g LIMIT (SELECT greatest(1, round_even(count(*) * 0.3, 0)::INT) FROM g)")
def group_subset_by_hash(spark, sf):
    return S.groups_by_hash(table(spark, sf, "customer").select(F.col("c_nationkey").alias("g")), "g", 0.3)


@query("""WITH e AS (SELECT event_id, event_type, round(value / 100, 6) AS reward FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY reward >= 1, reward, event_id) AS r FROM e)
    SELECT event_id, event_type, reward FROM r ORDER BY r > 1, reward >= 1, reward, event_id LIMIT 50""")
def low_reward_diverse(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", F.round(F.col("value") / 100, 6).alias("reward"))
    return S.diverse_low_reward(e, "event_type", "reward", "event_id", 50)


@query(f"""WITH {_ORDERS}, b AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY answer, id) AS o FROM o), top AS (SELECT * FROM b WHERE o <= 400),
    p AS (SELECT a.id, t.id AS example, row_number() OVER (PARTITION BY a.id ORDER BY t.answer, t.id) AS shot FROM o a JOIN top t ON a.task = t.task AND a.g <> t.g) SELECT id, shot, example FROM p WHERE shot <= 3""")
def few_shot_examples(spark, sf):
    return S.few_shot(orders(spark, sf), "task", "g", "answer", "id", 3)
