"""Queries over placed pairs: labels, constraints, moves, rows of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import labels as L
from ..operators import materialize as M
from ..operators import pairs as P
from .frames import BOXES_SQL, GEO_SQL, boxes, geometries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def n(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


@query(f"WITH {GEO_SQL} SELECT strategy, relation, count(*) AS n FROM geo GROUP BY ALL")
def relation_counts(spark, sf):
    return geometries(spark, sf).groupBy("strategy", "relation").agg(n())


@query(f"WITH {GEO_SQL} SELECT geometry_id, CASE WHEN relation IN ('intersecting', 'contained') THEN 'yes' WHEN relation <> 'invalid' THEN 'no' END AS answer FROM geo")
def binary_answers(spark, sf):
    return geometries(spark, sf).select("geometry_id", L.binary_answer(F.col("relation")).alias("answer"))


@query(f"""WITH {GEO_SQL} SELECT CASE WHEN norm <= 0 THEN '0' WHEN norm <= 0.01 THEN '(0, 0.01]' WHEN norm <= 0.05 THEN '(0.01, 0.05]' WHEN norm <= 0.2 THEN '(0.05, 0.20]'
           WHEN norm <= 0.5 THEN '(0.20, 0.50]' ELSE '>0.50' END AS bucket, count(*) AS n, round(avg(norm), 6) AS mean_norm FROM geo GROUP BY 1""")
def volume_buckets(spark, sf):
    return geometries(spark, sf).groupBy(L.volume_bucket(F.col("norm")).alias("bucket")).agg(n(), F.round(F.avg("norm"), 6).alias("mean_norm"))


@query(f"""WITH {GEO_SQL} SELECT CASE WHEN relation IN ('intersecting', 'contained') THEN 'intersecting' WHEN relation = 'touching' OR distance <= 1e-4 THEN 'touching'
           WHEN distance <= 0.1 THEN '(0, 0.1]' WHEN distance <= 1 THEN '(0.1, 1]' WHEN distance <= 5 THEN '(1, 5]' ELSE '>5' END AS bucket, count(*) AS n FROM geo GROUP BY 1""")
def clearance_buckets(spark, sf):
    return geometries(spark, sf).groupBy(L.clearance_bucket(F.col("relation"), F.col("distance")).alias("bucket")).agg(n())


@query(f"WITH {GEO_SQL} SELECT strategy, CASE WHEN distance <= 1e-4 THEN 'no' WHEN distance >= 1.0 THEN 'yes' ELSE 'no' END AS answer, count(*) AS n FROM geo GROUP BY ALL")
def tolerance_fit(spark, sf):
    return geometries(spark, sf).groupBy("strategy", L.tolerance_fit(F.col("distance"), 1.0).alias("answer")).agg(n())


@query(f"""WITH {GEO_SQL},
    bad AS (SELECT geometry_id, va, vb, norm, aabb_overlap, a_in_b, b_in_a, eps, exact_overlap,
              CASE WHEN a_object_id % 13 = 0 THEN -iv ELSE iv END AS iv, CASE WHEN a_object_id % 17 = 0 THEN distance + 2 ELSE distance END AS distance,
              CASE WHEN a_object_id % 19 = 0 THEN 'contained' ELSE relation END AS relation FROM geo),
    rules AS (SELECT geometry_id, unnest([CASE WHEN iv < 0 THEN 'intersection_negative' END,
              CASE WHEN exact_overlap <> (iv > eps) THEN 'exact_overlap_differs' END,
              CASE WHEN iv > eps AND NOT aabb_overlap THEN 'overlap_without_aabb' END,
              CASE WHEN NOT aabb_overlap AND distance <= 1e-4 THEN 'contact_without_aabb' END,
              CASE WHEN relation IN ('intersecting', 'contained') AND NOT iv > eps THEN 'relation_without_overlap' END,
              CASE WHEN relation = 'contained' AND NOT (a_in_b OR b_in_a) THEN 'contained_without_flag' END,
              CASE WHEN relation = 'contained' AND abs(iv - least(va, vb)) > eps THEN 'contained_volume_differs' END,
              CASE WHEN relation = 'touching' AND distance > 1e-4 THEN 'touching_distance' END,
              CASE WHEN relation = 'near_miss' AND NOT (distance > 1e-4 AND distance <= 1) THEN 'near_miss_distance' END,
              CASE WHEN relation = 'disjoint' AND NOT distance > 1 THEN 'disjoint_distance' END]) AS rule FROM bad)
    SELECT rule, count(*) AS n FROM rules WHERE rule IS NOT NULL GROUP BY rule""")
def label_violations(spark, sf):
    """Tampered labels: every rule that a row breaks, counted."""
    k = F.col("a_object_id")
    bad = geometries(spark, sf).withColumns({"iv": F.when(k % 13 == 0, -F.col("iv")).otherwise(F.col("iv")), "distance": F.when(k % 17 == 0, F.col("distance") + 2).otherwise(F.col("distance")), "relation": F.when(k % 19 == 0, "contained").otherwise(F.col("relation"))})
    names = {"va": "va", "vb": "vb", "iv": "iv", "norm": "norm", "distance": "distance", "relation": "relation", "exact_overlap": "exact_overlap", "aabb": "aabb_overlap", "a_in_b": "a_in_b", "b_in_a": "b_in_a"}
    rules = L.label_rules({a: F.col(c) for a, c in names.items()} | {"status": F.lit("ok")})
    return bad.select(F.explode(L.broken(rules)).alias("rule")).groupBy("rule").agg(n())


def _cells(spark, sf):
    b = boxes(spark, sf)
    at = {"x": F.col("object_id") % 97, "y": F.col("object_id") % 89, "z": F.col("object_id") % 83}
    half = {"x": "w", "y": "d", "z": "h"}
    return b.select("object_id", "generator_id", *[(at[x] - F.col(half[x]) / 2).alias(f"min_{x}") for x in B.AXES], *[(at[x] + F.col(half[x]) / 2).alias(f"max_{x}") for x in B.AXES])


_CELLS = BOXES_SQL + """, cells AS (SELECT object_id, generator_id, object_id % 97 - w / 2 AS min_x, object_id % 97 + w / 2 AS max_x,
    object_id % 89 - d / 2 AS min_y, object_id % 89 + d / 2 AS max_y, object_id % 83 - h / 2 AS min_z, object_id % 83 + h / 2 AS max_z FROM boxes)"""
_MEET = " AND ".join(f"a.min_{x} <= b.max_{x} AND b.min_{x} <= a.max_{x}" for x in "xyz")


@query(f"WITH {_CELLS} SELECT a.generator_id, a.object_id AS a_id, b.object_id AS b_id FROM cells a JOIN cells b ON a.generator_id = b.generator_id AND a.object_id < b.object_id AND {_MEET}")
def aabb_overlap_pairs(spark, sf):
    return P.overlapping_pairs(_cells(spark, sf), "generator_id", "object_id").select(F.col("a_generator_id").alias("generator_id"), F.col("a_object_id").alias("a_id"), F.col("b_object_id").alias("b_id"))


@query(f"WITH {GEO_SQL} SELECT geometry_id, round(d0, 6) AS distance, round(iv0, 6) AS intersection, aabb_overlap FROM geo")
def aabb_distance(spark, sf):
    g = geometries(spark, sf)
    return g.select("geometry_id", F.round(B.distance("a", "b"), 6).alias("distance"), F.round(B.intersection_volume("a", "b"), 6).alias("intersection"), "aabb_overlap")


_TURN_SQL = """
    turned AS (SELECT *, sin(radians(ry)) AS sy, cos(radians(ry)) AS cy, sin(radians(rx)) AS sx, cos(radians(rx)) AS cx, sin(radians(rz)) AS sz, cos(radians(rz)) AS cz
               FROM (SELECT *, (object_id % 4) * 30.0 AS rx, (object_id % 5) * 15.0 AS ry, (object_id % 6) * 45.0 AS rz, object_id % 10 AS tx FROM boxes)),
    m AS (SELECT *, cy*cz AS m00, sx*sy*cz-cx*sz AS m01, cx*sy*cz+sx*sz AS m02, cy*sz AS m10, sx*sy*sz+cx*cz AS m11, cx*sy*sz-sx*cz AS m12, -sy AS m20, sx*cy AS m21, cx*cy AS m22 FROM turned)"""


@query(f"""WITH {BOXES_SQL},{_TURN_SQL}
    SELECT object_id, round(tx + (abs(m00)*w + abs(m01)*d + abs(m02)*h)/2, 6) AS max_x, round(tx - (abs(m00)*w + abs(m01)*d + abs(m02)*h)/2, 6) + 0.0 AS min_x,
           round((abs(m10)*w + abs(m11)*d + abs(m12)*h)/2, 6) AS max_y, round((abs(m20)*w + abs(m21)*d + abs(m22)*h)/2, 6) AS max_z FROM m""")
def transform_aabb(spark, sf):
    k, half = F.col("object_id"), [F.col(c) / 2 for c in ("w", "d", "h")]
    turn = B.rotation((k % 4) * 30.0, (k % 5) * 15.0, (k % 6) * 45.0)
    out = B.transformed(half, turn, [(k % 10).cast("double"), F.lit(0.0), F.lit(0.0)])
    return boxes(spark, sf).select("object_id", *[F.round(out[c], 6).alias(c) for c in ("max_x", "min_x", "max_y", "max_z")])


# For turns about z only, the 15 axes come down to the z span and four directions in the plane.
@query(f"""WITH {GEO_SQL}, t AS (SELECT *, radians((a_object_id % 4) * 15.0) AS r FROM geo),
    c AS (SELECT *, (b_min_x + b_max_x)/2 AS ox, (b_min_y + b_max_y)/2 AS oy, (b_min_z + b_max_z)/2 AS oz, cos(r) AS c, sin(r) AS s FROM t)
    SELECT geometry_id, NOT (abs(oz) > (a_h + b_h)/2 + 1e-9
        OR abs(ox) > a_w/2 + (b_w*abs(c) + b_d*abs(s))/2 + 1e-9 OR abs(oy) > a_d/2 + (b_w*abs(s) + b_d*abs(c))/2 + 1e-9
        OR abs(ox*c + oy*s) > b_w/2 + (a_w*abs(c) + a_d*abs(s))/2 + 1e-9 OR abs(-ox*s + oy*c) > b_d/2 + (a_w*abs(s) + a_d*abs(c))/2 + 1e-9) AS overlap FROM c""")
def obb_overlap(spark, sf):
    g = geometries(spark, sf)
    zero, still = F.lit(0.0), [[F.lit(1.0 if i == j else 0.0) for j in range(3)] for i in range(3)]
    turn = B.rotation(zero, zero, (F.col("a_object_id") % 4) * 15.0)
    half = {p: [F.col(f"{p}_{c}") / 2 for c in ("w", "d", "h")] for p in "ab"}
    return g.select("geometry_id", B.oriented_overlap([zero] * 3, half["a"], still, [B.center("b", x) for x in B.AXES], half["b"], turn).alias("overlap"))


_SIX = "[" + ", ".join(f"{{'magnitude': greatest(0.0, a_max_{x} - b_min_{x}), 'rank': {2 * k}, 'direction': '+{x}'}}, {{'magnitude': abs(least(0.0, a_min_{x} - b_max_{x})), 'rank': {2 * k + 1}, 'direction': '-{x}'}}" for k, x in enumerate("xyz")) + "]"
_MOVES = f"{GEO_SQL}, mv AS (SELECT geometry_id, strategy, relation, unnest({_SIX}) AS m FROM geo), rk AS (SELECT geometry_id, strategy, relation, m.magnitude, m.rank, m.direction, row_number() OVER (PARTITION BY geometry_id ORDER BY m.magnitude, m.rank) AS pos FROM mv)"


@query(f"WITH {_MOVES} SELECT geometry_id, direction, round(magnitude, 6) AS magnitude FROM rk WHERE relation IN ('intersecting', 'contained')")
def repair_moves(spark, sf):
    g = geometries(spark, sf).where(L.interferes(F.col("relation")))
    return g.select("geometry_id", F.explode_outer(B.moves("a", "b")).alias("m")).select("geometry_id", "m.direction", F.round("m.magnitude", 6).alias("magnitude"))


@query(f"WITH {_MOVES} SELECT geometry_id, direction AS answer, round(magnitude, 6) AS magnitude FROM rk WHERE pos = 1 AND relation IN ('intersecting', 'contained')")
def repair_best_direction(spark, sf):
    best = B.best_move(B.moves("a", "b"))
    return geometries(spark, sf).where(L.interferes(F.col("relation"))).select("geometry_id", best["direction"].alias("answer"), F.round(best["magnitude"], 6).alias("magnitude"))


@query(f"WITH {_MOVES} SELECT geometry_id, direction || ' ' || printf('%.6f', magnitude) AS answer FROM rk WHERE pos = 1 AND relation IN ('intersecting', 'contained')")
def repair_translation_text(spark, sf):
    best = B.best_move(B.moves("a", "b"))
    return geometries(spark, sf).where(L.interferes(F.col("relation"))).select("geometry_id", F.format_string("%s %.6f", best["direction"], best["magnitude"]).alias("answer"))


@query(f"""WITH {_MOVES} SELECT strategy, count(*) AS n, count(*) FILTER (gap < 0.15) AS ambiguous, round(avg(gap), 6) AS mean_margin
    FROM (SELECT geometry_id, strategy, max(magnitude) - min(magnitude) AS gap FROM rk WHERE pos <= 2 AND relation IN ('intersecting', 'contained') GROUP BY ALL) GROUP BY strategy""")
def repair_ambiguity(spark, sf):
    g = geometries(spark, sf).where(L.interferes(F.col("relation"))).select("strategy", B.move_margin(B.moves("a", "b")).alias("gap"))
    return g.groupBy("strategy").agg(n(), F.count_if(F.col("gap") < 0.15).alias("ambiguous"), F.round(F.avg("gap"), 6).alias("mean_margin"))


_AWAY = "list_filter([" + ", ".join(f"CASE WHEN b_min_{x} > a_max_{x} THEN '+{x}' WHEN a_min_{x} > b_max_{x} THEN '-{x}' END" for x in "xyz") + "], lambda v: v IS NOT NULL)"


@query(f"WITH {GEO_SQL} SELECT geometry_id, CASE WHEN len({_AWAY}) = 1 THEN {_AWAY}[1] END AS direction FROM geo")
def away_direction(spark, sf):
    return geometries(spark, sf).select("geometry_id", B.away_direction("a", "b").alias("direction"))


def _move_sql(name: str, target: str) -> str:
    return f"""WITH {GEO_SQL}, away AS (SELECT geometry_id, distance, CASE WHEN len({_AWAY}) = 1 THEN {_AWAY}[1] END AS direction, round({target} - distance + 1e-12, 1) AS mv FROM geo WHERE relation IN ('disjoint', 'near_miss', 'touching'))
    SELECT geometry_id, direction, mv AS {name} FROM away WHERE direction IS NOT NULL AND abs(distance + mv - ({target})) <= 0.15"""


def _moved(spark, sf, name: str, target):
    """Signed move along the separating axis to a target clearance; none where the rounded move misses it by more than 0.15."""
    g = geometries(spark, sf).where(F.col("relation").isin("disjoint", "near_miss", "touching"))
    g = g.withColumns({"direction": B.away_direction("a", "b"), name: F.round(target - F.col("distance") + 1e-12, 1)})
    return g.where(F.col("direction").isNotNull() & (F.abs(F.col("distance") + F.col(name) - target) <= 0.15)).select("geometry_id", "direction", name)


@query(_move_sql("signed_mm", "1.5"))
def clearance_move(spark, sf):
    return _moved(spark, sf, "signed_mm", F.lit(1.5))


@query(_move_sql("signed_mm", "0.0"))
def contact_move(spark, sf):
    return _moved(spark, sf, "signed_mm", F.lit(0.0))


_CD = "sqrt(" + " + ".join(f"pow((a_min_{x}+a_max_{x})/2 - (b_min_{x}+b_max_{x})/2, 2)" for x in "xyz") + ")"


@query(f"WITH {GEO_SQL} SELECT geometry_id, round({_CD}, 6) AS centroid_distance, round({_CD} + 5.0, 6) AS target FROM geo WHERE {_CD} > 0")
def centroid_move(spark, sf):
    d = F.sqrt(sum(((B.center("a", x) - B.center("b", x)) ** 2 for x in B.AXES), F.lit(0.0)))
    return geometries(spark, sf).withColumn("c", d).where("c > 0").select("geometry_id", F.round("c", 6).alias("centroid_distance"), F.round(F.col("c") + 5.0, 6).alias("target"))


_GRID = "ceil(({}) * 10 - 1e-9) / 10"


def _exact_sql(need: str) -> str:
    return f"""WITH {_MOVES}, g AS (SELECT geometry_id, direction, rank, round({_GRID.format(need)}, 1) AS mm FROM rk WHERE relation IN ('intersecting', 'contained')),
    best AS (SELECT *, row_number() OVER (PARTITION BY geometry_id ORDER BY mm, rank) AS p FROM g)
    SELECT geometry_id, 'direction=' || direction || ', distance_mm=' || printf('%.1f', mm) AS answer FROM best WHERE p = 1"""


def _axis_answer(df: DataFrame) -> DataFrame:
    return df.select("geometry_id", F.format_string("direction=%s, distance_mm=%.1f", F.col("repair.direction"), F.col("repair.magnitude")).alias("answer"))


@query(_exact_sql("magnitude + 1e-6"))
def axis_repair_answers(spark, sf):
    return _axis_answer(P.exact_repair(geometries(spark, sf).where(L.interferes(F.col("relation")))))


@query(_exact_sql("magnitude + 0.5 - 1e-4"))
def target_clearance_answers(spark, sf):
    return _axis_answer(P.exact_repair(geometries(spark, sf).where(L.interferes(F.col("relation"))), clearance_mm=0.5))


def _vector_sql(fmt: str) -> str:
    v = ", ".join(f"CASE direction WHEN '+{x}' THEN magnitude WHEN '-{x}' THEN -magnitude ELSE 0.0 END" for x in "xyz")
    return f"WITH {_MOVES} SELECT geometry_id, printf('{fmt}', {v}) AS answer FROM (SELECT geometry_id, direction, relation, round({_GRID.format('magnitude + 1e-6')}, 1) AS magnitude, row_number() OVER (PARTITION BY geometry_id ORDER BY round({_GRID.format('magnitude + 1e-6')}, 1), rank) AS p FROM rk) WHERE p = 1 AND relation IN ('intersecting', 'contained')"


def _vector_answer(spark, sf, fmt: str):
    g = P.exact_repair(geometries(spark, sf).where(L.interferes(F.col("relation"))))
    d, m = F.col("repair.direction"), F.col("repair.magnitude")
    return g.select("geometry_id", F.format_string(fmt, *[F.when(d == f"+{x}", m).when(d == f"-{x}", -m).otherwise(0.0) for x in B.AXES]).alias("answer"))


@query(_vector_sql("dx=%.1f, dy=%.1f, dz=%.1f"))
def vector_repair_answers(spark, sf):
    return _vector_answer(spark, sf, "dx=%.1f, dy=%.1f, dz=%.1f")


@query(_vector_sql("object_b = object_b.translate((%.1f, %.1f, %.1f))"))
def program_repair_answers(spark, sf):
    return _vector_answer(spark, sf, "object_b = object_b.translate((%.1f, %.1f, %.1f))")


_CANDS = f"""{_MOVES}, best AS (SELECT geometry_id, magnitude AS mm FROM rk WHERE pos = 1 AND relation IN ('intersecting', 'contained')),
    e AS (SELECT geometry_id, mm, unnest([{{'label': 'A', 'f': 0.5}}, {{'label': 'B', 'f': 1.0}}, {{'label': 'C', 'f': 1.5}}, {{'label': 'D', 'f': 2.0}}]) AS c FROM best),
    s AS (SELECT geometry_id, mm, c.label AS label, c.f * mm AS movement, c.f * mm >= mm AS satisfies, abs(c.f * mm - mm) AS err FROM e),
    o AS (SELECT *, row_number() OVER (PARTITION BY geometry_id ORDER BY NOT satisfies, movement, err, label) AS p FROM s)"""


@query(f"WITH {_CANDS} SELECT geometry_id, string_agg(label, '' ORDER BY p) AS ranking, min(CASE WHEN p = 1 THEN label END) AS selection FROM o GROUP BY geometry_id")
def candidate_ranking(spark, sf):
    g = geometries(spark, sf).where(L.interferes(F.col("relation"))).select("geometry_id", B.best_move(B.moves("a", "b"))["magnitude"].alias("mm"))
    ranked = M.ranked_candidates(M.candidate_edits(F.col("mm")))
    return g.select("geometry_id", ranked.alias("ranking"), F.substring(ranked, 1, 1).alias("selection"))


_VAR = f"{GEO_SQL}, v AS (SELECT pair_id, geometry_id, relation, norm, relation IN ('intersecting', 'contained') AS pos, row_number() OVER (PARTITION BY pair_id, relation IN ('intersecting', 'contained') ORDER BY geometry_id) AS r FROM geo)"


@query(f"""WITH {_VAR}, p AS (SELECT pair_id, max(CASE WHEN pos AND r = 1 THEN geometry_id END) AS p0, max(CASE WHEN pos AND r = 2 THEN geometry_id END) AS p1,
           max(CASE WHEN NOT pos AND r = 1 THEN geometry_id END) AS n0, max(CASE WHEN NOT pos AND r = 2 THEN geometry_id END) AS n1 FROM v WHERE r <= 2 GROUP BY pair_id),
    u AS (SELECT pair_id, p0 AS first, n0 AS second, 'A' AS answer FROM p UNION ALL SELECT pair_id, n0, p0, 'B' FROM p UNION ALL SELECT pair_id, p0, p1, 'both' FROM p UNION ALL SELECT pair_id, n0, n1, 'neither' FROM p)
    SELECT * FROM u WHERE first IS NOT NULL AND second IS NOT NULL""")
def pairwise_rows(spark, sf):
    g = geometries(spark, sf)
    return M.pairwise_rows(g.withColumn("positive", L.interferes(F.col("relation"))), "pair_id", "geometry_id", "positive")


@query(f"""WITH {GEO_SQL}, t AS (SELECT pair_id, norm, chr(64 + row_number() OVER (PARTITION BY pair_id ORDER BY geometry_id)::INT) AS letter, row_number() OVER (PARTITION BY pair_id ORDER BY geometry_id) AS r FROM geo)
    SELECT pair_id, string_agg(letter, '' ORDER BY norm DESC, letter) AS answer FROM t WHERE r <= 5 GROUP BY pair_id HAVING count(*) >= 3""")
def variant_ranking(spark, sf):
    return M.variant_ranking(geometries(spark, sf), "pair_id", "geometry_id", "norm")


_TASKS = f"""{GEO_SQL}, tasks AS (
    SELECT geometry_id, pair_id, strategy, relation, 'binary_interference' AS task_type, CASE WHEN relation IN ('intersecting', 'contained') THEN 'yes' ELSE 'no' END AS answer FROM geo WHERE relation <> 'invalid'
    UNION ALL SELECT geometry_id, pair_id, strategy, relation, 'relation_classification', relation FROM geo WHERE relation <> 'invalid'
    UNION ALL SELECT geometry_id, pair_id, strategy, relation, 'volume_bucket', CASE WHEN norm <= 0 THEN '0' WHEN norm <= 0.01 THEN '(0, 0.01]' WHEN norm <= 0.05 THEN '(0.01, 0.05]' WHEN norm <= 0.2 THEN '(0.05, 0.20]' WHEN norm <= 0.5 THEN '(0.20, 0.50]' ELSE '>0.50' END FROM geo WHERE relation <> 'invalid'
    UNION ALL SELECT geometry_id, pair_id, strategy, relation, 'clearance_bucket', CASE WHEN relation IN ('intersecting', 'contained') THEN 'intersecting' WHEN distance <= 1e-4 THEN 'touching' WHEN distance <= 0.1 THEN '(0, 0.1]' WHEN distance <= 1 THEN '(0.1, 1]' WHEN distance <= 5 THEN '(1, 5]' ELSE '>5' END FROM geo WHERE relation <> 'invalid'
    UNION ALL SELECT geometry_id, pair_id, strategy, relation, 'tolerance_fit', CASE WHEN distance > 1e-4 AND distance >= 1.0 THEN 'yes' ELSE 'no' END FROM geo WHERE relation <> 'invalid'),
    task_rows AS (SELECT *, task_type || '_' || lpad(row_number() OVER (PARTITION BY task_type ORDER BY geometry_id)::VARCHAR, 8, '0') AS id FROM tasks)"""


def task_rows(spark, sf, number=True):
    return M.task_rows(geometries(spark, sf), number=number)


@query(f"WITH {_TASKS} SELECT id, geometry_id, pair_id, task_type, answer, relation, strategy FROM task_rows")
def materialized_task_rows(spark, sf):
    return task_rows(spark, sf).select("id", "geometry_id", "pair_id", "task_type", "answer", "relation", "strategy")


@query(f"""WITH {_TASKS} SELECT id, CASE task_type WHEN 'binary_interference' THEN 'Do the two objects interfere? Answer yes or no.' WHEN 'relation_classification' THEN 'Classify the relation of the two objects.'
    WHEN 'volume_bucket' THEN 'Which bucket holds the normalized intersection volume?' WHEN 'clearance_bucket' THEN 'Which bucket holds the clearance?' ELSE 'Is a clearance of 1.0 mm kept? Answer yes or no.' END || chr(10) || 'geometry: ' || geometry_id AS prompt FROM task_rows""")
def prompt_text(spark, sf):
    return task_rows(spark, sf).select("id", M.prompt(F.col("task_type"), F.col("geometry_id")).alias("prompt"))


@query(f"""WITH {GEO_SQL} SELECT geometry_id, list_sort(list_distinct(list_filter([CASE WHEN relation IN ('touching', 'near_miss') THEN 'near_boundary' END, CASE WHEN relation = 'contained' THEN 'contained' END,
    CASE WHEN norm > 0 AND norm <= 0.05 THEN 'tiny_overlap' END, CASE WHEN aabb_overlap AND relation IN ('touching', 'near_miss', 'disjoint') THEN 'aabb_false_positive' END, a_tag, b_tag], lambda v: v IS NOT NULL))) AS tags FROM geo""")
def difficulty_tags(spark, sf):
    return geometries(spark, sf).select("geometry_id", M.difficulty_tags().alias("tags"))


@query(f"""WITH {_MOVES}, b AS (SELECT r.geometry_id, r.strategy, r.direction AS best, CASE WHEN hash_k % 3 = 0 THEN '+x' ELSE r.direction END AS out FROM (SELECT *, substr(geometry_id, 6, 8)::BIGINT AS hash_k FROM rk) r WHERE pos = 1 AND relation IN ('intersecting', 'contained')),
    v AS (SELECT b.*, m.magnitude AS mine, bm.magnitude AS need FROM b JOIN rk m ON b.geometry_id = m.geometry_id AND m.direction = b.out JOIN rk bm ON b.geometry_id = bm.geometry_id AND bm.pos = 1)
    SELECT strategy, count(*) AS total, count(*) FILTER (mine <= need + 1e-9) AS repaired, count(*) FILTER (out = best) AS exact FROM v GROUP BY strategy""")
def verification_breakdown(spark, sf):
    """Outputs (a third of them '+x' whatever is right) applied by the stored magnitude: does it part the boxes?"""
    g = geometries(spark, sf).where(L.interferes(F.col("relation"))).withColumn("six", B.moves("a", "b"))
    g = g.withColumn("best", B.best_move(F.col("six")))
    g = g.withColumn("out", F.when(F.col("a_object_id") % 3 == 0, "+x").otherwise(F.col("best.direction")))
    mine = F.filter("six", lambda m: m["direction"] == F.col("out"))[0]["magnitude"]
    return g.groupBy("strategy").agg(n("total"), F.count_if(mine <= F.col("best.magnitude") + 1e-9).alias("repaired"), F.count_if(F.col("out") == F.col("best.direction")).alias("exact"))


