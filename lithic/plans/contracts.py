"""Contracts of public rows over tampered rows: every rule that a row breaks, counted."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import contracts as K
from ..functions import labels as L
from ..operators import pairs as P
from .frames import GEO_SQL, geometries
from .geometry import _AWAY, _CANDS, _GRID, _MOVES, _TASKS, task_rows

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def counted(rows, rules, by=None):
    """(task, rule, n) of broken rules."""
    keys = [by] if by else []
    out = P.sealed(rows).select(*keys, F.explode(L.broken(rules)).alias("rule"))
    return out.groupBy(*keys, "rule").agg(F.count(F.lit(1)).alias("n"))


def _named(*pairs):
    return "unnest(list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in pairs) + "], lambda v: v IS NOT NULL)) AS rule"


@query(f"""WITH {_TASKS}, x AS (SELECT t.task_type AS task, t.relation, t.answer, g.a_object_id AS a,
        CASE WHEN g.a_object_id % 11 = 0 THEN 'no' WHEN g.a_object_id % 11 = 1 THEN 'disjoint' WHEN g.a_object_id % 11 = 2 THEN '>5' ELSE t.answer END AS mine
      FROM task_rows t JOIN geo g USING (geometry_id)),
    r AS (SELECT task, {_named(('binary_answer', "task = 'binary_interference' AND mine <> answer"), ('relation_answer', "task = 'relation_classification' AND mine <> answer"),
        ('volume_bucket_answer', "task = 'volume_bucket' AND mine <> answer"), ('clearance_bucket_answer', "task = 'clearance_bucket' AND mine <> answer"),
        ('tolerance_answer', "task = 'tolerance_fit' AND mine <> answer"), ('label_status', 'a % 13 = 0'), ('no_geometry', 'a % 17 = 0'), ('prompt_hash', 'a % 19 = 0'), ('hashes', 'a % 23 = 0'))} FROM x)
    SELECT task, rule, count(*) AS n FROM r GROUP BY ALL""")
def row_contracts(spark, sf):
    """Base tasks, answers recomputed from the labels; some answers, statuses, ids and hashes are tampered with."""
    g = geometries(spark, sf)
    rows = task_rows(spark, sf, number=False).select("geometry_id", F.col("task_type").alias("task"), "answer", "relation")
    r = rows.join(g.select("geometry_id", "norm", "distance", F.col("a_object_id").alias("a")), "geometry_id")
    k = F.col("a") % 11
    gone = lambda m, c: F.when(F.col("a") % m != 0, c)
    c = {
        "task": F.col("task"), "answer": F.when(k == 0, "no").when(k == 1, "disjoint").when(k == 2, ">5").otherwise(F.col("answer")), "relation": F.col("relation"),
        "norm": F.col("norm"), "distance": F.col("distance"), "status": F.coalesce(gone(13, F.lit("ok")), F.lit("invalid")), "geometry_ids": gone(17, F.array("geometry_id")),
        "prompt_hash": gone(19, F.lit("sha256:1")), "hashes": F.array(F.lit("sha256:2"), gone(23, F.lit("sha256:3"))),
    }
    return counted(r, K.row_rules(c), "task")


@query(f"""WITH {GEO_SQL}, v AS (SELECT pair_id, a_object_id AS a, geometry_id, relation, norm, row_number() OVER (PARTITION BY pair_id ORDER BY geometry_id) AS r FROM geo),
    p AS (SELECT pair_id, a, max(CASE WHEN r = 1 THEN relation END) AS x, max(CASE WHEN r = 2 THEN relation END) AS y,
            list(norm ORDER BY geometry_id) FILTER (r <= 5) AS norms FROM v GROUP BY pair_id, a HAVING count(*) >= 5),
    e AS (SELECT *, CASE WHEN x IN ('intersecting', 'contained') AND y IN ('intersecting', 'contained') THEN 'both' WHEN x IN ('intersecting', 'contained') THEN 'A'
            WHEN y IN ('intersecting', 'contained') THEN 'B' ELSE 'neither' END AS pw,
            (SELECT string_agg(chr(64 + i::INT), '' ORDER BY norms[i] DESC, i) FROM range(1, 6) t(i)) AS rk FROM p),
    r AS (SELECT 'pairwise_answer' AS rule FROM e WHERE CASE WHEN a % 7 = 0 THEN 'A' ELSE pw END <> pw UNION ALL SELECT 'ranking_answer' FROM e WHERE CASE WHEN a % 5 = 0 THEN 'EDCBA' ELSE rk END <> rk)
    SELECT rule, count(*) AS n FROM r GROUP BY rule""")
def group_contracts(spark, sf):
    """Pairwise and ranking answers over a group's variants."""
    g = geometries(spark, sf).groupBy("pair_id", F.col("a_object_id").alias("a")).agg(F.array_sort(F.collect_list(F.struct("geometry_id", "relation", "norm"))).alias("v")).where("size(v) >= 5")
    g = g.withColumns({"relations": F.transform("v", lambda x: x["relation"]), "norms": F.slice(F.transform("v", lambda x: x["norm"]), 1, 5)})
    pw = L.pairwise_answer(F.get("relations", F.lit(0)), F.get("relations", F.lit(1)))
    order = F.array_sort(F.transform("norms", lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))
    rk = F.array_join(F.transform(order, lambda x: F.char(F.lit(65) + x["i"])), "")
    rows = g.select("*", F.inline(F.array(
        F.struct(F.lit("pairwise_interference").alias("task"), F.when(F.col("a") % 7 == 0, "A").otherwise(pw).alias("answer")),
        F.struct(F.lit("ranking_normalized_intersection").alias("task"), F.when(F.col("a") % 5 == 0, "EDCBA").otherwise(rk).alias("answer")))))
    return counted(rows, K.group_rules(F.col("task"), F.col("answer"), F.col("relations"), F.col("norms")))


_PAIR2 = f"""{_MOVES}, b AS (SELECT geometry_id, substr(geometry_id, 6, 8)::BIGINT % 29 AS k, max(CASE WHEN pos = 1 THEN magnitude END) AS m FROM rk WHERE relation IN ('intersecting', 'contained') GROUP BY ALL)"""


@query(f"""WITH {_PAIR2}, t AS (SELECT *, unnest(['repair_direction', 'repair_translation']) AS task FROM b),
    r AS (SELECT task, {_named(('selected_not_least', 'k = 0'), ('magnitude_differs', 'k = 1'), ('vector_direction', 'k = 2 AND m > 1e-9'), ('selected_vector_differs', '(k = 2 AND m > 0)'),
        ('six_candidates', 'k = 3'), ('directions_repeat', 'k = 3'), ('policy', 'k = 4'), ('objects', 'k = 5'), ('candidate_magnitude', 'k = 6'), ('answer', 'k = 7'))} FROM t)
    SELECT task, rule, count(*) AS n FROM r GROUP BY ALL""")
def repair_contracts(spark, sf):
    """Conservative repairs: selected move, its vector, the six candidates and the tie-break; each tampered once in 29."""
    g = geometries(spark, sf).where(L.interferes(F.col("relation"))).select((F.col("a_object_id") % 29).alias("k"), F.array_sort(B.moves("a", "b")).alias("six"))
    move = lambda x: F.struct(x["direction"].alias("direction"), x["magnitude"].alias("magnitude"), K.vector(x["direction"], x["magnitude"]).alias("vector"))
    g = P.sealed(g.withColumns({"cands": F.transform("six", move), "best": move(F.when(F.col("k") == 0, F.col("six")[1]).otherwise(F.col("six")[0]))}))
    k, best, cands = F.col("k"), F.col("best"), F.col("cands")
    selected = F.struct(
        best["direction"].alias("direction"), F.when(k == 1, best["magnitude"] + 1).otherwise(best["magnitude"]).alias("magnitude"),
        F.when(k == 2, F.transform(best["vector"], lambda v: -v)).otherwise(best["vector"]).alias("vector"),
    )
    cands = F.when(k == 3, F.array_append(cands, cands[5])).when(k == 6, F.transform(cands, lambda x, i: x.withField("magnitude", F.when(i == 5, x["magnitude"] + 1).otherwise(x["magnitude"])))).otherwise(cands)
    m = F.struct(
        F.when(k == 4, "other").otherwise(K.REPAIR_POLICY).alias("policy"), F.when(k == 5, "object_a").otherwise("object_b").alias("movable"), F.lit("object_a").alias("fixed"),
        selected.alias("selected"), cands.alias("candidates"),
    )
    rows = P.sealed(g.select("k", m.alias("m"))).select("*", F.explode(F.array(F.lit("repair_direction"), F.lit("repair_translation"))).alias("task"))
    s = F.col("m")["selected"]
    right = F.when(F.col("task") == "repair_translation", F.format_string("%s %.6f", s["direction"], s["magnitude"])).otherwise(s["direction"])
    rows = P.sealed(rows.withColumn("answer", F.when(F.col("k") == 7, "none").otherwise(right)))
    return counted(rows, K.repair_rules(F.col("m"), F.col("task"), F.col("answer")), "task")


@query(f"""WITH {_MOVES}, b AS (SELECT geometry_id, substr(geometry_id, 6, 8)::BIGINT % 31 AS k, round({_GRID.format('magnitude + 1e-6')}, 1) AS mm,
        row_number() OVER (PARTITION BY geometry_id ORDER BY round({_GRID.format('magnitude + 1e-6')}, 1), rank) AS p FROM rk WHERE relation IN ('intersecting', 'contained')),
    t AS (SELECT *, unnest(['axis_aligned_repair', 'axis_aligned_repair_vector', 'axis_aligned_repair_program']) AS task FROM b WHERE p = 1),
    r AS (SELECT task, {_named(('undershoots', 'k = 0'), ('magnitude_differs', 'k = 1'), ('vector_direction', 'k = 2'), ('structured_translation', 'k = 2'), ('structured_direction', 'k = 3'),
        ('structured_distance', 'k = 4 OR k = 1'), ('not_satisfied', 'k = 5'), ('target', 'k = 6'), ('policy', 'k = 7'), ('answer', 'k = 8'))} FROM t)
    SELECT task, rule, count(*) AS n FROM r GROUP BY ALL""")
def exact_repair_contracts(spark, sf):
    """Exact repairs: label at or above the exact move, vector, structured answer, verification and target."""
    g = P.exact_repair(geometries(spark, sf).where(L.interferes(F.col("relation")))).select((F.col("a_object_id") % 31).alias("k"), F.col("repair.direction").alias("d"), F.col("repair.magnitude").alias("mm"))
    g = P.sealed(g.withColumn("v", K.vector(F.col("d"), F.col("mm"))))
    k = F.col("k")
    m = F.struct(
        F.when(k == 7, "other").otherwise(K.EDIT_POLICY).alias("policy"), F.lit("object_b").alias("movable"), F.lit("object_a").alias("fixed"), F.col("d").alias("direction"),
        F.when(k == 0, F.col("mm") + 1).otherwise(F.col("mm")).alias("exact"), F.when(k == 1, F.col("mm") + 2).otherwise(F.col("mm")).alias("label"),
        F.when(k == 2, F.transform("v", lambda x: -x)).otherwise(F.col("v")).alias("vector"),
        F.struct(F.when(k == 3, "none").otherwise(F.col("d")).alias("direction"), F.when(k == 4, F.col("mm") + 1).otherwise(F.col("mm")).alias("distance"), F.col("v").alias("translation")).alias("structured"),
        (k != 5).alias("satisfies"), F.when(k == 6, "contact").otherwise("clearance").alias("target"),
    )
    rows = P.sealed(g.select("k", m.alias("m"))).select("*", F.explode(F.array(*map(F.lit, ("axis_aligned_repair", "axis_aligned_repair_vector", "axis_aligned_repair_program")))).alias("task"))
    v, t = F.col("m")["vector"], F.col("task")
    right = (
        F.when(t == "axis_aligned_repair_vector", F.format_string("dx=%.1f, dy=%.1f, dz=%.1f", v[0], v[1], v[2]))
        .when(t == "axis_aligned_repair_program", F.format_string("object_b = object_b.translate((%.1f, %.1f, %.1f))", v[0], v[1], v[2]))
        .otherwise(F.format_string("direction=%s, distance_mm=%.1f", F.col("m")["direction"], F.col("m")["label"]))
    )
    rows = P.sealed(rows.withColumn("answer", F.when(k == 8, "none").otherwise(right)))
    return counted(rows, K.exact_rules(F.col("m"), t, F.col("answer")), "task")


@query(f"""WITH {GEO_SQL}, away AS (SELECT a_object_id % 37 AS k, distance, len({_AWAY}) AS ways, unnest([1.5, 0.0, 5.0]) AS goal FROM geo WHERE relation IN ('disjoint', 'near_miss')),
    s AS (SELECT *, CASE goal WHEN 1.5 THEN 'target_clearance_move' WHEN 0.0 THEN 'target_contact_move' ELSE 'centroid_distance_move' END AS task, round(goal - distance + 1e-12, 1) AS mv FROM away WHERE ways = 1),
    r AS (SELECT task, {_named(('unit_direction', 'k = 0'), ('vector_direction', '(k = 0 OR k = 2) AND abs(mv) > 1e-9'), ('too_far_from_exact', 'k = 1'), ('structured_distance', 'k = 3'), ('not_satisfied', 'k = 4'),
        ('target', 'k = 5'), ('policy', 'k = 6'), ('answer', 'k = 7'), ('magnitude_differs', 'k = 8'), ('vector_direction', 'k = 8'))} FROM s)
    SELECT task, rule, count(*) AS n FROM r GROUP BY ALL""")
def move_contracts(spark, sf):
    """Signed moves to a clearance, to contact, or along the line of centroids."""
    g = geometries(spark, sf).where(F.col("relation").isin("disjoint", "near_miss")).withColumn("d", B.away_direction("a", "b")).where("d is not null")
    goals = [F.struct(F.lit(t).alias("task"), F.lit(x).alias("goal"), F.lit(p).alias("policy"), F.lit(kind).alias("kind")) for t, x, p, kind in (("target_clearance_move", 1.5, K.EDIT_POLICY, "clearance"), ("target_contact_move", 0.0, K.EDIT_POLICY, "clearance"), ("centroid_distance_move", 5.0, K.CENTROID_POLICY, "centroid_distance"))]
    g = P.sealed(g.select((F.col("a_object_id") % 37).alias("k"), "d", "distance", F.inline(F.array(*goals))).withColumns({"mv": F.round(F.col("goal") - F.col("distance") + 1e-12, 1), "unit": K.vector(F.col("d"), F.lit(1.0))}))
    k, mv = F.col("k"), F.col("mv")
    m = F.struct(
        F.when(k == 6, "other").otherwise(F.col("policy")).alias("policy"), F.col("policy").alias("wanted_policy"), F.when(k == 5, "none").otherwise(F.col("kind")).alias("target"), F.col("kind").alias("wanted_target"),
        F.when(k == 0, F.transform("unit", lambda x: x * 2)).otherwise(F.col("unit")).alias("direction_vector"), mv.alias("signed"),
        F.when(k == 1, mv + 1).otherwise(F.col("goal") - F.col("distance")).alias("exact"),
        F.transform("unit", lambda x: x * F.when(k == 2, -mv).when(k == 8, F.abs(mv) + 1).otherwise(mv)).alias("vector"),
        F.when(k == 3, mv + 1).otherwise(mv).alias("structured_distance"), (k != 4).alias("satisfies"),
    )
    rows = P.sealed(g.select("task", m.alias("m"), F.when(k == 7, "none").otherwise(F.format_string("distance_mm=%.1f", mv)).alias("answer")))
    return counted(rows, K.signed_rules(F.col("m"), F.col("answer")), "task")


@query(f"""WITH {_CANDS}, b AS (SELECT geometry_id, substr(geometry_id, 6, 8)::BIGINT % 41 AS k, min(mm) AS mm, string_agg(label, '' ORDER BY p) AS rk FROM o GROUP BY ALL),
    t AS (SELECT *, unnest(['edit_candidate_selection', 'edit_candidate_ranking']) AS task FROM b),
    r AS (SELECT task, {_named(('four_candidates', 'k = 0'), ('movement_differs', 'k = 1'), ('flags_missing', 'k = 2'), ('stored_answer', 'k = 3'), ('answer', 'k = 4'))} FROM t)
    SELECT task, rule, count(*) AS n FROM r GROUP BY ALL""")
def candidate_contracts(spark, sf):
    """Candidate edits A to D, their flags, and the stored and given answers."""
    g = geometries(spark, sf).where(L.interferes(F.col("relation"))).select((F.col("a_object_id") % 41).alias("k"), B.best_move(B.moves("a", "b")).alias("b"))
    k = F.col("k")

    def edit(label, factor):
        x = F.col("b.magnitude") * factor
        return F.struct(
            F.lit(label).alias("label"), F.col("b.direction").alias("direction"), x.alias("magnitude"), x.alias("movement"), K.vector(F.col("b.direction"), x).alias("vector"),
            (x >= F.col("b.magnitude")).alias("satisfies"), F.lit(True).alias("no_interference"), F.abs(x - F.col("b.magnitude")).alias("error"),
        )

    g = P.sealed(g.withColumn("edits", F.array(*[edit(a, f) for a, f in zip("ABCD", (0.5, 1.0, 1.5, 2.0), strict=True)])))
    g = P.sealed(g.withColumn("ranking", K.ranked_labels(F.col("edits"))))
    tampered = F.transform("edits", lambda x, i: x.withField("label", F.when((k == 0) & (i == 3), "E").otherwise(x["label"])).withField("magnitude", F.when((k == 1) & (i == 0), x["magnitude"] + 1).otherwise(x["magnitude"])).withField("vector", F.when((k == 1) & (i == 0), K.vector(x["direction"], x["magnitude"] + 1)).otherwise(x["vector"])).withField("no_interference", F.when((k != 2) | (i != 0), x["no_interference"])))
    rows = P.sealed(g.select("k", tampered.alias("edits"), "ranking")).select("*", F.explode(F.array(F.lit("edit_candidate_selection"), F.lit("edit_candidate_ranking"))).alias("task"))
    mine = P.sealed(rows.withColumn("right", F.when(F.col("task") == "edit_candidate_selection", F.substring(K.ranked_labels(F.col("edits")), 1, 1)).otherwise(K.ranked_labels(F.col("edits")))))
    mine = P.sealed(mine.withColumns({"stored": F.when(k == 3, "none").otherwise(F.col("right")), "answer": F.when(k == 4, "none").otherwise(F.col("right"))}))
    return counted(mine, K.candidate_rules(F.col("edits"), F.col("stored"), F.col("task"), F.col("answer")), "task")
