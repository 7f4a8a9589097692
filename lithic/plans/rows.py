"""Queries over public rows: hashes, texts, selections, requests, views, reports, verification, shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import canonical as C
from ..functions import labels as L
from ..functions import texts as T
from ..operators import evaluate as E
from ..operators import exports as X
from ..operators import materialize as M
from ..operators import pairs as P
from ..operators import selection as S
from .evaluation import _ED, _OUT, _answered, _edits, _scored, predictions
from .frames import BOXES_SQL, GEO_SQL, boxes, geometries, table
from .geometry import _MOVES, _TASKS, task_rows
from .splitting import _ORDERS, orders

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def n(name="n"):
    return F.count(F.lit(1)).alias(name)


# --- hashes
@query("""SELECT event_id, '{"event_id":' || event_id || ',"kind":"' || event_type || '","props":' || replace(props, ': ', ':') || ',"user":null}' AS canonical,
    'sha256:' || sha256('{"event_id":' || event_id || ',"kind":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '"}') AS digest FROM events""")
def canonical_json(spark, sf):
    e = table(spark, sf, "events")
    text = F.concat(F.lit('{"user": null, "props": '), "props", F.lit(', "kind": "'), "event_type", F.lit('", "event_id": '), F.col("event_id").cast("string"), F.lit("}"))
    return e.select("event_id", C.canonical_json(text).alias("canonical"), C.sha256_text(C.canonical_struct(props=F.col("props"), kind=F.col("event_type"), event_id=F.col("event_id"))).alias("digest"))


_REC = """rec AS (SELECT a_object_id, pair_id, geometry_id, relation, strategy, 'sha256:' || sha256(geometry_id) AS gh, 'sha256:' || sha256(strategy) AS th FROM geo WHERE relation <> 'invalid')"""


def _records(spark, sf):
    g = geometries(spark, sf).where("relation <> 'invalid'").select("a_object_id", "pair_id", "geometry_id", "relation", "strategy", "a_generator_id", "a_tag")
    h = F.struct(C.sha256_text(F.lit("code")).alias("source_code_hash"), C.sha256_text(F.lit("object")).alias("object_hash"), C.sha256_text(F.col("strategy")).alias("transform_hash"), C.sha256_text(F.col("geometry_id")).alias("geometry_hash"), C.sha256_text(F.lit("config")).alias("config_hash"))
    return g.withColumn("hashes", h)


@query(f"""WITH {GEO_SQL}, {_REC}, g AS (SELECT pair_id, list(geometry_id ORDER BY geometry_id) AS ids, list(gh ORDER BY geometry_id) AS ghs, list(th ORDER BY geometry_id) AS ths FROM rec GROUP BY pair_id)
    SELECT pair_id, 'sha256:' || sha256('["' || array_to_string(ghs, '","') || '"]') AS geometry_hash, 'sha256:' || sha256('["' || array_to_string(ths, '","') || '"]') AS transform_hash, 'sha256:' || sha256('config') AS config_hash,
        'sha256:' || sha256('{{"geometry_ids":["' || array_to_string(ids, '","') || '"],"prompt":"Rank.","task_type":"ranking_normalized_intersection","template_version":"v1"}}') AS prompt_hash FROM g""")
def group_row_hashes(spark, sf):
    g = _records(spark, sf).groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("geometry_id", "hashes"))).alias("records"))
    h = g.select("pair_id", C.group_row_hashes(F.col("records"), F.lit("Rank."), F.lit("ranking_normalized_intersection"), F.lit("v1")).alias("h"))
    return h.select("pair_id", "h.geometry_hash", "h.transform_hash", "h.config_hash", "h.prompt_hash")


@query(f"""WITH {_TASKS} SELECT t.id, 'v0.1' AS dataset_version, CASE WHEN g.a_object_id % 3 = 0 THEN 'cf_' || g.a_object_id ELSE t.pair_id END AS split_group, t.strategy AS candidate_strategy, g.a_generator_id AS generator_id, [t.geometry_id] AS geometry_ids,
    'sha256:' || sha256('{{"geometry_ids":["' || t.geometry_id || '"],"prompt":"' || t.task_type || '?","task_type":"' || t.task_type || '","template_version":"v1"}}') AS prompt_hash, 'sha256:' || sha256(t.geometry_id) AS geometry_hash, [g.a_tag] AS topology_tags
    FROM task_rows t JOIN geo g USING (geometry_id)""")
def public_rows(spark, sf):
    """Public rows with metadata defaults and hashes, flattened."""
    r = E.keyed(task_rows(spark, sf).select("id", "geometry_id", "task_type", "answer"), _records(spark, sf), "geometry_id")
    r = r.withColumns({"prompt": F.concat("task_type", F.lit("?")), "assembly_group_id": F.lit(None).cast("string"), "counterfactual_group_id": F.when(F.col("a_object_id") % 3 == 0, F.concat(F.lit("cf_"), F.col("a_object_id").cast("string"))), "generator_ids": F.array("a_generator_id"), "tags": F.array("a_tag")})
    p = X.public_rows(r, "v1", F.lit("train"))
    m = F.col("metadata")
    return p.select("id", "dataset_version", m["split_group"].alias("split_group"), m["candidate_strategy"].alias("candidate_strategy"), "generator_id", "geometry_ids", F.col("hashes.prompt_hash").alias("prompt_hash"), F.col("hashes.geometry_hash").alias("geometry_hash"), m["topology_tags"].alias("topology_tags"))


@query(f"""WITH {GEO_SQL} SELECT pair_id, list(geometry_id ORDER BY geometry_id) AS ids, arg_min(relation, geometry_id) AS relation, arg_min(strategy, geometry_id) AS strategy, list(relation ORDER BY geometry_id) AS relations FROM geo GROUP BY pair_id""")
def group_rows(spark, sf):
    return X.group_rows(geometries(spark, sf).select("pair_id", "geometry_id", "relation", "strategy"), "pair_id", "geometry_id")


@query("SELECT p_partkey, 'sha256:' || sha256(p_brand) AS config_hash, 'sha256:' || sha256(p_name) AS object_hash FROM part")
def config_hash_override(spark, sf):
    """One nested field written over, the others kept."""
    h = F.struct(C.sha256_text(F.col("p_name")).alias("object_hash"), C.sha256_text(F.lit("old")).alias("config_hash"))
    p = table(spark, sf, "part").select("p_partkey", h.withField("config_hash", C.sha256_text(F.col("p_brand"))).alias("hashes"))
    return p.select("p_partkey", "hashes.config_hash", "hashes.object_hash")


# --- sources and validations
_OBJ = f"""{BOXES_SQL}, objects AS (SELECT object_id, name, generator_id, lower(p_type) AS op, string_split(name, ' ') AS tags, w * d * h AS bbox_volume FROM boxes JOIN part ON p_partkey = object_id),
    validations AS (SELECT object_id, object_id % 13 <> 0 AS valid, CASE WHEN object_id % 17 <> 0 THEN 'box' END AS bbox, w * d * h * CASE WHEN object_id % 5 = 0 THEN 0.5 ELSE 1.0 END AS volume,
        CASE WHEN object_id % 13 <> 0 THEN NULL WHEN object_id % 2 = 0 THEN 'timeout' ELSE 'empty_solid' END AS reason FROM boxes)"""


def _objects(spark, sf):
    kind = table(spark, sf, "part").select(F.col("p_partkey").alias("object_id"), F.lower("p_type").alias("op"))
    b = boxes(spark, sf).join(kind, "object_id")
    return b.select("object_id", "name", "generator_id", "op", F.split("name", " ").alias("tags"), (F.col("w") * F.col("d") * F.col("h")).alias("bbox_volume"))


def _validations(spark, sf):
    k = F.col("object_id")
    fill = F.when(k % 5 == 0, 0.5).otherwise(1.0)
    return boxes(spark, sf).select("object_id", (k % 13 != 0).alias("valid"), F.when(k % 17 != 0, "box").alias("bbox"), (F.col("w") * F.col("d") * F.col("h") * fill).alias("volume"), F.when(k % 13 != 0, None).when(k % 2 == 0, "timeout").otherwise("empty_solid").alias("reason"))


@query(f"WITH {_OBJ} SELECT o.object_id, o.name FROM objects o JOIN validations v USING (object_id) WHERE valid AND bbox IS NOT NULL")
def validated_objects(spark, sf):
    return S.validated(_objects(spark, sf), _validations(spark, sf), "object_id").select("object_id", "name")


@query(f"WITH {_OBJ} SELECT v.object_id, v.reason, o.generator_id FROM validations v LEFT JOIN (SELECT * FROM objects WHERE object_id % 26 <> 0) o USING (object_id) WHERE NOT valid")
def validation_failures(spark, sf):
    """Failed validations with their source; some sources are unknown."""
    known = _objects(spark, sf).where("object_id % 26 <> 0")
    return S.failed_with_source(_validations(spark, sf), known, "object_id").select("object_id", "reason", "generator_id")


_CAVITY = "regexp_matches(lower(o.name || '|' || o.op), 'cut|hole|slot|shell|ring|tube|pipe|bracket|u_shape|u-shape|cavity|void') OR (bbox_volume > 0 AND volume / bbox_volume < 0.65)"


@query(f"WITH {_OBJ}, f AS (SELECT object_id, {_CAVITY} AS cavity FROM objects o JOIN validations USING (object_id)) SELECT object_id, cavity FROM f")
def cavity_like_objects(spark, sf):
    j = _objects(spark, sf).join(_validations(spark, sf).select("object_id", "volume"), "object_id")
    return j.select("object_id", S.cavity_like(F.array("name", "op"), F.col("volume"), F.col("bbox_volume")).alias("cavity"))


@query("SELECT p_partkey, len(list_intersect(list_concat([lower(p_type)], string_split(p_name, ' ')), ['cut','union','intersect','loft','sweep','fillet','chamfer','shell','hole','extrude','ring','small'])) > 0 AS meets, list_sort(list_filter(string_split(p_name, ' '), lambda t: NOT list_contains(['small', 'red', 'ring'], t))) AS unknown FROM part")
def vocabulary_check(spark, sf):
    """Words outside a vocabulary, and whether any are inside another."""
    tags = F.split("p_name", " ")
    wide = F.array(*map(F.lit, (*S.COMPOUND_OPS, "ring", "small")))
    return table(spark, sf, "part").select("p_partkey", F.arrays_overlap(F.array_union(F.array(F.lower("p_type")), tags), wide).alias("meets"), F.array_sort(F.array_except(tags, F.array(*map(F.lit, ("small", "red", "ring"))))).alias("unknown"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN true ELSE o_orderkey % 4 <> 1 END AS included FROM orders")
def included_rows(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("id"), S.included(F.when(k % 4 != 0, k % 4 != 1)).alias("included"))


_SIMPLE = "CASE WHEN o_orderkey % 50 = 0 THEN 'validation' WHEN o_orderkey % 50 = 1 THEN 'test_random' ELSE 'train' END"
_FREE = f"rows AS (SELECT o_orderkey AS id, o_custkey AS g, o_orderkey // 3 AS pair, {_SIMPLE} AS split FROM orders), free AS (SELECT DISTINCT g FROM rows WHERE g NOT IN (SELECT r.g FROM rows r JOIN rows f ON r.pair = f.pair WHERE f.split IN ('validation', 'test_random')))"


def _linked(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("id"), F.col("o_custkey").alias("g"), F.expr("o_orderkey div 3").alias("pair"), F.when(k % 50 == 0, "validation").when(k % 50 == 1, "test_random").otherwise("train").alias("split"))


@query(f"WITH {_FREE} SELECT g FROM free")
def movable_groups(spark, sf):
    return S.movable_groups(_linked(spark, sf), "g", "split", ["pair"], ["validation", "test_random"])


@query(f"WITH {_FREE}, k AS (SELECT g FROM free ORDER BY sha256('7:' || g), g LIMIT (SELECT greatest(1, round_even(count(*) * 0.25, 0)::INT) FROM free)) SELECT id, CASE WHEN g IN (SELECT g FROM k) THEN 'test_moved' ELSE split END AS split FROM rows")
def redistributed_splits(spark, sf):
    return S.redistributed(_linked(spark, sf), "g", "split", ["pair"], ["validation", "test_random"], "test_moved", 0.25).select("id", "split")


@query("""WITH r AS (SELECT o_orderkey AS k, o_custkey AS g, CASE o_orderstatus WHEN 'F' THEN 'intersecting' WHEN 'P' THEN 'contained' ELSE 'disjoint' END AS rel, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
    p AS (SELECT g, max(CASE WHEN i = 1 THEN k END) AS a, max(CASE WHEN i = 2 THEN k END) AS b, max(CASE WHEN i = 1 THEN rel END) AS ra, max(CASE WHEN i = 2 THEN rel END) AS rb FROM r WHERE i <= 2 GROUP BY g HAVING count(*) = 2)
    SELECT 'pairwise_' || g AS id, CASE WHEN ra <> 'disjoint' AND rb <> 'disjoint' THEN 'both' WHEN ra <> 'disjoint' THEN 'A' WHEN rb <> 'disjoint' THEN 'B' ELSE 'neither' END AS answer FROM p
    UNION ALL SELECT 'row_' || o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 6 <> 0""")
def rebuilt_pairwise_rows(spark, sf):
    """Old pairwise rows go, those rebuilt from the groups' first two rows come in their place."""
    o = table(spark, sf, "orders")
    rel = F.when(F.col("o_orderstatus") == "F", "intersecting").when(F.col("o_orderstatus") == "P", "contained").otherwise("disjoint")
    new = X.pairwise_from(o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("g"), rel.alias("rel")), "g", "k", "rel").select("id", "answer")
    rows = o.select(F.concat(F.lit("row_"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderstatus").alias("answer"), (F.col("o_orderkey") % 6 == 0).alias("old"))
    return S.replaced(rows, F.col("old"), new.withColumn("old", F.lit(False))).drop("old")


# --- samples
@query(f"WITH {_ORDERS} SELECT id, task FROM o ORDER BY sha256('7:' || id), id LIMIT 250")
def random_rows(spark, sf):
    return S.select_rows(orders(spark, sf).select("id", "task"), "id", 250, "random")


@query(f"""WITH {_ORDERS}, r AS (SELECT id, task, row_number() OVER (PARTITION BY task ORDER BY sha256('7:' || id), id) AS r FROM o) SELECT id, task FROM r ORDER BY r, task LIMIT 90""")
def stratified_task_rows(spark, sf):
    return S.select_rows(orders(spark, sf).select("id", "task"), "id", 90, "stratified_task")


@query(f"""WITH {_ORDERS}, a AS (SELECT id, task, answer, row_number() OVER (PARTITION BY task, answer ORDER BY sha256('7:' || id), id) AS a FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY a, answer) AS t FROM a)
    SELECT id, task, answer FROM b ORDER BY t, task LIMIT 90""")
def stratified_answer_rows(spark, sf):
    return S.select_rows(orders(spark, sf).select("id", "task", "answer"), "id", 90, "stratified_task_answer", answer="answer")


@query(f"""WITH {_ORDERS}, s AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'validation' ELSE 'train' END AS split FROM o), r AS (SELECT id, task, row_number() OVER (PARTITION BY task ORDER BY sha256('7:' || id), id) AS r FROM s WHERE split = 'train' AND task IN ('task_1', 'task_2')) SELECT id, task FROM r WHERE r <= 25""")
def sampled_per_task(spark, sf):
    o = orders(spark, sf).select("id", "task", F.when(F.col("id") % 3 == 0, "validation").otherwise("train").alias("split"))
    return S.sample_tasks(o, "id", "task", ["train"], ["task_1", "task_2"], 1000, 25).select("id", "task")


@query(f"WITH {_ORDERS}, r AS (SELECT id, task, row_number() OVER (PARTITION BY task ORDER BY id) AS r FROM o) SELECT id, task FROM r WHERE r <= 12")
def audit_sample(spark, sf):
    return S.first_per(orders(spark, sf).select("id", "task"), ["task"], [F.col("id")], 12)


@query("SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 16 AS batch FROM events")
def row_batches(spark, sf):
    return S.batches(table(spark, sf, "events").select("event_id", "user_id"), "user_id", "event_id", 16)


@query("SELECT user_id, min(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 END) AS round FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1")
def retry_rounds(spark, sf):
    """Round k accepts the keys that have an event of its kind; only what is left is tried again."""
    e = table(spark, sf, "events").select("user_id", "event_type")
    kinds = ("click", "view", "error")
    return S.retried(e, "user_id", lambda left, k: left.join(e.where(F.col("event_type") == kinds[k - 1]), "user_id", "left_semi"), 3)


# --- texts
_MVB = f"{_MOVES}, best AS (SELECT geometry_id, direction, magnitude FROM rk WHERE pos = 1 AND relation IN ('intersecting', 'contained'))"


def _best(spark, sf):
    b = B.best_move(B.moves("a", "b"))
    return geometries(spark, sf).where(L.interferes(F.col("relation"))).select("geometry_id", b["direction"].alias("direction"), b["magnitude"].alias("magnitude"))


@query(f"""WITH {_MVB} SELECT geometry_id, '<think>The least of the allowed moves is ' || direction || ' by ' || printf('%.1f', magnitude + 1e-9) || ' mm.</think><answer>' || direction || '</answer>' AS target_text, direction AS canonical_answer, 'trusted_row_metadata' AS source FROM best""")
def reasoning_targets(spark, sf):
    b = _best(spark, sf).withColumnRenamed("direction", "answer")
    r = X.sft_rows(b, T.reasoning_target(F.lit("repair_direction"), F.col("answer"), F.col("answer"), F.col("magnitude") + 1e-9), "trusted_row_metadata")
    return r.select("geometry_id", "target_text", "canonical_answer", F.col("supervision.target_text_source").alias("source"))


@query(f"""WITH {_TASKS} SELECT task_type, answer, count(*) AS n, '<think>' || CASE task_type WHEN 'binary_interference' THEN 'A shared volume means yes; contact or a gap means no.' WHEN 'relation_classification' THEN 'Name the relation that the exact geometry has.'
    WHEN 'volume_bucket' THEN 'Find the bucket that holds the shared part of the smaller volume.' WHEN 'clearance_bucket' THEN 'Find the bucket that holds the gap.' ELSE 'Check the gap against the required clearance.' END || '</think><answer>' || answer || '</answer>' AS target_text
    FROM task_rows GROUP BY ALL""")
def reasoning_target_counts(spark, sf):
    none = F.lit(None).cast("double")
    r = task_rows(spark, sf, number=False).groupBy("task_type", "answer").agg(n())
    return r.withColumn("target_text", T.reasoning_target(F.col("task_type"), F.col("answer"), F.lit(None).cast("string"), none))


_PROMPT_SQL = "unnest([" + ", ".join("{'task': '" + t + "', 'ask': '" + a.replace("'", "''") + "', 'form': '" + f + "'}" for t, (a, f) in T.EDIT_PROMPTS.items()) + "])"


@query(f"WITH {_MVB}, p AS (SELECT geometry_id, {_PROMPT_SQL} AS p FROM best) SELECT geometry_id, p.task AS task, p.ask || chr(10) || 'geometry: ' || geometry_id || chr(10) || 'Answer with: ' || p.form AS prompt FROM p")
def edit_prompts(spark, sf):
    """Prompts of the eleven edit tasks."""
    b = _best(spark, sf).select("geometry_id", F.explode(F.array(*map(F.lit, T.EDIT_PROMPTS))).alias("task"))
    return b.select("geometry_id", "task", T.edit_prompt(F.col("task"), F.concat(F.lit("geometry: "), "geometry_id")).alias("prompt"))


@query(f"""WITH {_MVB}, t AS (SELECT geometry_id, substr(geometry_id, 6, 8)::BIGINT AS k, unnest(['repair_direction', 'target_clearance_move', 'edit_candidate_ranking', 'binary_interference']) AS task FROM best)
    SELECT geometry_id, task, CASE WHEN task = 'binary_interference' THEN [] ELSE list_sort(list_distinct(list_filter([CASE WHEN k % 3 = 0 THEN 'initial_rotated' WHEN k % 3 = 1 THEN 'initial_axis_aligned' ELSE 'initial_near_boundary' END, CASE WHEN k % 4 = 0 THEN 'unknown:odd' WHEN k % 4 = 1 THEN 'candidate_ranking' END, CASE WHEN k % 5 = 0 THEN 'move_closer' END,
        CASE WHEN k % 7 = 0 THEN 'ambiguous_direction' END, CASE WHEN k % 2 = 0 THEN 'counterfactual_edit_group' END, CASE task WHEN 'repair_direction' THEN 'output_direction' WHEN 'target_clearance_move' THEN 'output_signed_distance' ELSE 'output_candidate_ranking' END], lambda v: v IS NOT NULL))) END AS tags FROM t""")
def edit_difficulty_tags(spark, sf):
    b = _best(spark, sf).select("geometry_id", F.substring("geometry_id", 6, 8).cast("long").alias("k"), F.explode(F.array(*map(F.lit, ("repair_direction", "target_clearance_move", "edit_candidate_ranking", "binary_interference")))).alias("task"))
    k = F.col("k")
    tags = T.edit_tags(
        F.col("task"), F.when(k % 4 == 0, "odd").when(k % 4 == 1, "candidate_ranking"), F.when(k % 5 == 0, "closer"), k % 7 == 0, F.lit("not_a_tag"), F.when(k % 2 == 0, "cf").otherwise(""),
        F.array(F.when(k % 3 == 0, "rotated").when(k % 3 == 1, "axis_aligned").otherwise("near_boundary")),
    )
    return b.select("geometry_id", "task", tags.alias("tags"))


@query("""WITH u AS (SELECT page_id, regexp_replace(replace(substr(url, strpos(url, '://') + 3), chr(92), '/'), '^(\\./|/)+', '') AS p FROM pages), s AS (SELECT page_id, p, CASE WHEN len(string_split(p, '/')) > 2 THEN array_to_string(string_split(p, '/')[1:2], '/') ELSE string_split(p, '/')[1] END AS subset FROM u)
    SELECT page_id, subset, 'src_' || lower(trim(regexp_replace(subset, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS generator_id FROM s""")
def generator_ids(spark, sf):
    path = T.normalized_path(F.substr("url", F.position(F.lit("://"), F.col("url")) + 3))
    return table(spark, sf, "pages").select("page_id", T.source_subset(path).alias("subset"), T.generator_id(path, "src_").alias("generator_id"))


_BLOCK = "'object_a:' || chr(10) || '  translation: [0.0, 0.0, 0.0]' || chr(10) || '  rotation_xyz_deg: [0.0, 0.0, 0.0]' || chr(10) || '  rotation_order: XYZ' || chr(10) || 'object_b:' || chr(10) || '  translation: [' || ox || ', ' || oy || ', ' || oz || ']' || chr(10) || '  rotation_xyz_deg: [0.0, 0.0, ' || rz || ']' || chr(10) || '  rotation_order: XYZ'"
_SCRIPT = f"""{GEO_SQL}, c AS (SELECT geometry_id, a_object_id AS k, (b_min_x + b_max_x) / 2 AS ox, (b_min_y + b_max_y) / 2 AS oy, (b_min_z + b_max_z) / 2 AS oz, (a_object_id % 4) * 15.0::DOUBLE AS rz FROM geo),
    blocks AS (SELECT *, {_BLOCK} AS block FROM c), scripts AS (SELECT *, 'import cadquery as cq' || chr(10) || chr(10) || 'def object_a(): return ' || k || chr(10) || chr(10) || 'def object_b(): return 1' || chr(10) || chr(10) || '# placement' || chr(10) || '# ' || replace(block, chr(10), chr(10) || '# ') AS script FROM blocks)"""


def _scripts(spark, sf):
    g = geometries(spark, sf)
    zero = [F.lit(0.0)] * 3
    block = T.transform_block((zero, zero), ([B.center("b", x) for x in B.AXES], [F.lit(0.0), F.lit(0.0), (F.col("a_object_id") % 4) * F.lit(15.0)]))
    code = T.pair_code(F.concat(F.lit("def object_source(): return "), F.col("a_object_id").cast("string"), F.lit("\n")), F.lit("def object_b(): return 1"))
    return g.select("geometry_id", T.assembly_script(T.renamed_function(code, F.lit("object_source"), F.lit("object_a")), block).alias("script"))


@query(f"WITH {_SCRIPT} SELECT geometry_id, script FROM scripts")
def assembly_scripts(spark, sf):
    """Code of a pair, a function renamed, with its placement."""
    return _scripts(spark, sf)


@query(f"WITH {_SCRIPT} SELECT geometry_id, [ox, oy, oz] AS translation, [0.0, 0.0, rz]::DOUBLE[] AS rotation, 'import cadquery as cq' || chr(10) || chr(10) || 'def object_a(): return ' || k || chr(10) || chr(10) || 'def object_b(): return 1' || chr(10) AS code FROM blocks")
def script_transforms(spark, sf):
    """Placement and code read back from the scripts."""
    s = _scripts(spark, sf)
    return s.select("geometry_id", T.script_numbers(F.col("script"), "translation")[1].alias("translation"), T.script_numbers(F.col("script"), "rotation_xyz_deg")[1].alias("rotation"), T.script_code(F.col("script")).alias("code"))


@query("SELECT source, count(*) AS n, CASE WHEN count(*) < 10 THEN 'tiny' ELSE 'n<1K' END AS size, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents WHERE source IS NOT NULL GROUP BY source HAVING count(*) < 1000 AND count(*) >= 10")
def size_categories(spark, sf):
    d = table(spark, sf, "documents").where("source is not null").groupBy("source").agg(n(), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))
    return d.where("n < 1000 and n >= 10").select("source", "n", T.size_category(F.col("n")).alias("size"), "langs")


# --- runs and reports
_SYSTEM = "Answer with the label only."


@query(f"""WITH {_TASKS}, r AS (SELECT id, task_type || chr(10) || geometry_id AS p FROM task_rows)
    SELECT id, p AS user_content, 'sha256:' || sha256('{{"decoding":{{"max_tokens":64.0,"temperature":0.0}},"eval_version":"zero_shot_v1","id":"' || id || '","messages":[{{"content":"{_SYSTEM}","role":"system"}},{{"content":"' || replace(p, chr(10), '\\n') || '","role":"user"}}],"model":"m"}}') AS eval_request_hash FROM r""")
def zero_shot_requests(spark, sf):
    r = task_rows(spark, sf).select("id", F.concat_ws("\n", "task_type", "geometry_id").alias("prompt"))
    q = X.requests(r, _SYSTEM, F.col("prompt"), "m", "zero_shot_v1", {"temperature": 0.0, "max_tokens": 64.0})
    return q.select("id", F.col("messages")[1]["content"].alias("user_content"), "eval_request_hash")


@query("""WITH e AS (SELECT conv_id, list(text ORDER BY turn) FILTER (turn < 2) AS shown, count(*) FILTER (turn < 2) AS k FROM conversations GROUP BY conv_id)
    SELECT conv_id, CASE WHEN k = 0 THEN '' ELSE array_to_string(list_transform(range(1, k + 1), lambda i: 'Example ' || i || chr(10) || 'Prompt:' || chr(10) || left(shown[i], 20) || chr(10) || 'Answer:' || chr(10) || 'ok'), chr(10) || chr(10)) || chr(10) || chr(10) END || 'Target prompt:' || chr(10) || 'q' AS content FROM e""")
def few_shot_texts(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("turn") < 2, F.struct("turn", F.substring("text", 1, 20).alias("prompt"), F.lit("ok").alias("answer"))))).alias("e"))
    return c.select("conv_id", X.few_shot_text(F.col("e"), F.lit("q")).alias("content"))


@query(f"""WITH {_OUT} SELECT 'm' AS model, count(*) AS row_count, (SELECT count(*) FROM pr) AS prediction_count, (SELECT list_sort(list(DISTINCT task_type)) FROM sc) AS task_types,
    (SELECT string_agg(task_type || ':' || t || ':' || c, ',' ORDER BY task_type) FROM (SELECT task_type, count(*) AS t, count(*) FILTER (correct) AS c FROM sc GROUP BY 1)) AS metrics FROM sc""")
def run_report(spark, sf):
    """A replayed run: requests, stored completions, scores and the report."""
    rows = task_rows(spark, sf).select("id", "task_type", "answer", F.lit("train").alias("split"))
    stored = predictions(rows)
    done = X.evaluated(rows, lambda r: X.requests(r, _SYSTEM, F.col("task_type"), "m", "zero_shot_v1", {"temperature": 0.0}).select("id"), X.Replay(stored))
    r = X.run_report(done, stored, "m")
    metrics = F.array_join(F.transform("metrics", lambda m: F.concat_ws(":", m["task_type"], m["total"].cast("string"), m["n_correct"].cast("string"))), ",")
    return r.select("model", "row_count", "prediction_count", "task_types", metrics.alias("metrics"))


@query(f"WITH {_OUT} SELECT task_type, count(*) AS n, count(*) FILTER (correct) AS n_correct FROM sc WHERE id IN (SELECT id FROM pr) GROUP BY 1")
def known_predictions(spark, sf):
    rows = task_rows(spark, sf).select("id", "task_type", "answer")
    extra = rows.select(F.concat(F.lit("x_"), "id").alias("id"), F.lit("yes").alias("output"))
    k = X.known_predictions(predictions(rows).unionByName(extra), rows)
    return k.groupBy("task_type").agg(n(), F.count_if("correct").alias("n_correct"))


@query(f"""WITH {_OUT} SELECT id, round(CASE WHEN parsed IS NULL THEN CASE WHEN output LIKE '%<answer>%' THEN CASE WHEN output LIKE '<think>%' THEN 0.05 ELSE 0.03 END ELSE 0.0 END
    ELSE greatest(CASE WHEN correct THEN 1.0 ELSE 0.0 END * f, 0.05 * f) END::DOUBLE, 6) AS reward FROM (SELECT *, CASE WHEN output LIKE '<answer>%' THEN 0.85 ELSE 1.0 END AS f FROM sc)""")
def dispatched_rewards(spark, sf):
    """One reward for all base tasks, with the format's part."""
    s = _answered(spark, sf)
    return s.select("id", F.round(X.reward(F.col("task_type"), F.col("answer"), F.col("output")), 6).alias("reward"))


@query(f"""WITH {_ED} SELECT geometry_id, round(greatest(0.1 + 0.3 * same + 0.35 * greatest(0, 1 - err / 0.6) * same + 0.15 * greatest(0, 1 - greatest(0, p - e) / greatest(e, 1e-9)) * same + 0.1 * same * CASE WHEN err <= 0.15 THEN 1 ELSE 0 END, 0.05), 6) AS reward FROM er""")
def dispatched_edit_rewards(spark, sf):
    return _edits(spark, sf).select("geometry_id", F.round(X.reward(F.lit("axis_aligned_repair"), F.col("gold"), F.col("mine")), 6).alias("reward"))


@query(f"""WITH {_OUT}, {_OBJ.replace(BOXES_SQL, '').lstrip().lstrip(',')}, bad AS (SELECT * FROM sc WHERE NOT correct)
    SELECT 'summary' AS section, 'rows' AS name, count(*) AS n FROM sc UNION ALL SELECT 'summary', 'validations', count(*) FROM validations UNION ALL SELECT 'summary', 'invalid_validations', count(*) FROM validations WHERE NOT valid
    UNION ALL SELECT 'summary', 'failures', count(*) FROM geo WHERE relation = 'near_miss' UNION ALL SELECT 'validation_failures', reason, count(*) FROM validations WHERE NOT valid GROUP BY reason
    UNION ALL SELECT 'generation_failures', strategy, count(*) FROM geo WHERE relation = 'near_miss' GROUP BY strategy
    UNION ALL SELECT 'prediction_failures', CASE WHEN parsed IS NULL THEN 'invalid' ELSE 'incorrect' END, count(*) FROM bad GROUP BY ALL UNION ALL SELECT 'failures_by_task', task_type, count(*) FROM bad GROUP BY task_type""")
def failure_cases(spark, sf):
    s = _scored(spark, sf)
    fails = geometries(spark, sf).where("relation = 'near_miss'").select(F.col("strategy").alias("reason"))
    return X.failure_cases(s, _validations(spark, sf), fails, s)


@query(f"WITH {_OUT} SELECT id, task_type, output FROM sc WHERE NOT correct ORDER BY id LIMIT 20")
def first_failures(spark, sf):
    return X.first_failures(_scored(spark, sf), "id").select("id", "task_type", "output")


@query(f"""WITH {GEO_SQL}, o AS (SELECT relation, NOT ({' OR '.join(f'abs((b_min_{x} + b_max_{x}) / 2) > (a_{s} + b_{s}) / 2 + 1e-9' for x, s in zip('xyz', 'wdh', strict=True))}) AS hit FROM geo WHERE relation <> 'invalid')
    SELECT relation, count(*) AS total, count(*) FILTER (hit = (relation IN ('intersecting', 'contained'))) AS n_correct FROM o GROUP BY 1""")
def obb_baseline(spark, sf):
    """Answers of the oriented-box test alone: contact counts as overlap, so touching pairs are told wrong."""
    g = geometries(spark, sf).where("relation <> 'invalid'")
    zero, still = F.lit(0.0), [[F.lit(1.0 if i == j else 0.0) for j in range(3)] for i in range(3)]
    half = {p: [F.col(f"{p}_{c}") / 2 for c in ("w", "d", "h")] for p in "ab"}
    hit = B.oriented_overlap([zero] * 3, half["a"], still, [B.center("b", x) for x in B.AXES], half["b"], still)
    g = P.sealed(g.select("relation", hit.alias("hit")))
    return g.groupBy("relation").agg(n("total"), F.count_if(F.col("hit") == L.interferes(F.col("relation"))).alias("n_correct"))


_SHIFT = ", ".join(f"b_{e}_{x} + CASE d WHEN '+{x}' THEN mm WHEN '-{x}' THEN -mm ELSE 0.0 END AS m_{e}_{x}" for x in "xyz" for e in ("min", "max"))
_INTER = " * ".join(f"greatest(0.0, least(a_max_{x}, m_max_{x}) - greatest(a_min_{x}, m_min_{x}))" for x in "xyz")


@query(f"""WITH {_MOVES}, b AS (SELECT geometry_id, direction, magnitude FROM rk WHERE pos = 1 AND relation IN ('intersecting', 'contained')),
    p AS (SELECT g.*, CASE WHEN a_object_id % 5 = 0 THEN '+x' ELSE direction END AS d, magnitude AS mm FROM geo g JOIN b USING (geometry_id)), m AS (SELECT *, {_SHIFT} FROM p), q AS (SELECT geometry_id, strategy, d, {_INTER} <= 1e-6 * least(va, vb) AS repaired FROM m)
    SELECT strategy, count(*) AS n, count(*) FILTER (repaired) AS repaired FROM q GROUP BY 1""")
def verified_directions(spark, sf):
    """Moves carried out and measured again: boxes apart are a certificate, the rest is measured."""
    g = geometries(spark, sf).where(L.interferes(F.col("relation")))
    best = B.best_move(B.moves("a", "b"))
    g = P.sealed(g.withColumns({"mm": best["magnitude"], "dir": F.when(F.col("a_object_id") % 5 == 0, "+x").otherwise(best["direction"])}))
    moved = P.sealed(g.withColumns(X.verified_move(F.col("dir"), F.col("mm"))))
    overlap = F.when(B.overlaps("a", "b"), B.intersection_volume("a", "b")).otherwise(0.0) > L.POLICY.epsilon_volume(F.col("va"), F.col("vb"))
    return moved.select("strategy", (~overlap).alias("ok")).groupBy("strategy").agg(n(), F.count_if("ok").alias("repaired"))


@query(f"WITH {_TASKS} SELECT id, task_type || '?' AS prompt, answer, task_type FROM task_rows")
def grpo_view(spark, sf):
    """The public view of supervised rows: prompt as messages, no targets."""
    r = task_rows(spark, sf).select("id", F.concat("task_type", F.lit("?")).alias("prompt"), "answer", "task_type")
    v = X.grpo_rows(X.sft_rows(r, F.col("answer"), "native"))
    return v.select("id", F.col("prompt")[0]["content"].alias("prompt"), "answer", "task_type")


# --- shards
@query("WITH c AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1) SELECT source, k AS shard, k * 7 AS offset, least(7, n - k * 7) AS rows FROM (SELECT source, n, unnest(range(0, CAST(ceil(n / 7.0) AS BIGINT))) AS k FROM c)")
def source_shards(spark, sf):
    c = table(spark, sf, "documents").where("source is not null").groupBy("source").agg(n())
    return X.source_shards(c, "source", "n", 7)


@query("WITH s AS (SELECT DISTINCT user_id FROM events), l AS (SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY 1) SELECT user_id FROM s WHERE user_id NOT IN (SELECT user_id FROM l WHERE last = 'click')")
def unfinished_shards(spark, sf):
    """Shards whose last status isn't a good one."""
    e = table(spark, sf, "events")
    progress = e.select("user_id", F.col("event_id").alias("at"), F.when(F.col("event_type") == "click", "validated").otherwise("failed").alias("status"))
    return X.unfinished(e.select("user_id").distinct(), progress, ["user_id"])


# --- fixtures
_FIX = """(VALUES ('geom_000001', 'separated_boxes', 10.0, 20.0), ('geom_000002', 'touching_boxes', 10.0, 10.0), ('geom_000003', 'tiny_overlap_boxes', 10.0, 9.99), ('geom_000004', 'near_miss_boxes', 10.0, 10.5),
    ('geom_000005', 'clear_overlap_boxes', 10.0, 7.0), ('geom_000006', 'contained_boxes', 6.0, 0.0)) AS f(geometry_id, name, size, tx)"""


@query(f"""SELECT geometry_id, name, CASE name WHEN 'separated_boxes' THEN 'disjoint' WHEN 'touching_boxes' THEN 'touching' WHEN 'near_miss_boxes' THEN 'near_miss' WHEN 'contained_boxes' THEN 'contained' ELSE 'intersecting' END AS relation,
    round(greatest(0.0, tx - 5 - size / 2), 6) AS distance FROM {_FIX}""")
def synthetic_fixtures(spark, sf):
    """The axis-aligned fixtures as an inline table, placed and measured."""
    f = spark.sql(f"SELECT geometry_id, name, CAST(size AS DOUBLE) AS size, CAST(tx AS DOUBLE) AS tx FROM {_FIX}")
    bounds = {f"a_{e}_{x}": F.lit(s * 5.0) for x in B.AXES for e, s in (("min", -1), ("max", 1))}
    bounds |= {f"b_{e}_{x}": (F.col("tx") if x == "x" else F.lit(0.0)) + s * F.col("size") / 2 for x in B.AXES for e, s in (("min", -1), ("max", 1))}
    sizes = {f"a_{c}": F.lit(10.0) for c in ("w", "d", "h")} | {f"b_{c}": F.col("size") for c in ("w", "d", "h")}
    return P.measured(f.withColumns(bounds | sizes)).select("geometry_id", "name", "relation", F.round("distance", 6).alias("distance"))
