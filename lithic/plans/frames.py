"""Domain frames derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pairs as P


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, w, d, h, generator_id, tag, name from `part`."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("object_id"),
        (F.lit(1.0) + F.col("p_size")).alias("w"),
        (F.lit(1.0) + F.col("p_partkey") % 7).alias("d"),
        (F.lit(1.0) + F.col("p_partkey") % 11).alias("h"),
        F.col("p_brand").alias("generator_id"),
        F.element_at(F.split("p_name", " "), -1).alias("tag"),
        F.col("p_name").alias("name"),
    )


def geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placed and measured pairs: ring of boxes x strategies."""
    # Inferring constraints from the long chain of labels takes the optimizer seconds and finds nothing to push.
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    ring = P.ring_pairs(boxes(spark, sf_dir), ["generator_id", "name"], "object_id")
    placed = P.candidates(ring, F.col("a_object_id"))
    key = F.concat(F.lit("geom_"), F.lpad(F.col("a_object_id").cast("string"), 8, "0"), F.lit("_"), F.lpad(F.col("spec").cast("string"), 2, "0"))
    return P.measured(placed).withColumns({"geometry_id": key, "pair_id": F.concat(F.lit("pair_"), F.lpad(F.col("a_object_id").cast("string"), 8, "0"))})


# The same frames as DuckDB SQL, for the oracles.
_STRATEGY_SQL = """
    VALUES (1, 'clear_disjoint'), (2, 'broad_random_disjoint'), (3, 'bbox_touching'), (4, 'near_miss'), (5, 'tiny_clearance'),
           (6, 'mid_clearance'), (7, 'small_overlap'), (8, 'medium_overlap'), (9, 'deep_overlap'), (10, 'cavity_center_probe')"""
BOXES_SQL = """
    boxes AS (SELECT p_partkey AS object_id, 1.0::DOUBLE + p_size AS w, (1 + p_partkey % 7)::DOUBLE AS d, (1 + p_partkey % 11)::DOUBLE AS h,
                     p_brand AS generator_id, split_part(p_name, ' ', -1) AS tag, p_name AS name FROM part)"""


def _axis_sql(k: int, axis: str, size: str) -> str:
    off = f"(CASE WHEN axis = {k} THEN sgn * ((sa + sb) / 2 + gap) ELSE 0.0 END)"
    return f"-a_{size} / 2 AS a_min_{axis}, a_{size} / 2 AS a_max_{axis}, {off} - b_{size} / 2 AS b_min_{axis}, {off} + b_{size} / 2 AS b_max_{axis}"


GEO_SQL = f"""{BOXES_SQL},
    ring AS (SELECT *, row_number() OVER w AS pos, count(*) OVER () AS n FROM boxes WINDOW w AS (ORDER BY generator_id, name, object_id)),
    pairs AS (SELECT {', '.join(f'{p}.{c} AS {p}_{c}' for p in 'ab' for c in ('object_id', 'w', 'd', 'h', 'generator_id', 'tag', 'name'))},
                     a.object_id % 3 AS axis, CASE WHEN a.object_id % 6 < 3 THEN 1.0 ELSE -1.0 END AS sgn
              FROM ring a JOIN ring b ON b.pos = a.pos % a.n + 1 AND a.pos <> b.pos),
    spans AS (SELECT *, CASE axis WHEN 0 THEN a_w WHEN 1 THEN a_d ELSE a_h END AS sa, CASE axis WHEN 0 THEN b_w WHEN 1 THEN b_d ELSE b_h END AS sb FROM pairs),
    strategies(spec, strategy) AS ({_STRATEGY_SQL}),
    cand AS (SELECT spans.*, spec, strategy,
                    CASE spec WHEN 1 THEN 10.0 WHEN 2 THEN 2 + a_object_id % 7 WHEN 3 THEN 0.0 WHEN 4 THEN 0.5 WHEN 5 THEN 0.0625 WHEN 6 THEN 3.0
                              WHEN 7 THEN -0.125 * least(sa, sb) WHEN 8 THEN -0.25 * least(sa, sb) WHEN 9 THEN -0.5 * least(sa, sb) ELSE -0.5 * (sa + sb) END AS gap
             FROM spans CROSS JOIN strategies),
    placed AS (SELECT *, {', '.join(_axis_sql(k, a, s) for k, (a, s) in enumerate((('x', 'w'), ('y', 'd'), ('z', 'h'))))} FROM cand),
    raw AS (SELECT *, a_w * a_d * a_h AS va, b_w * b_d * b_h AS vb,
                   {' AND '.join(f'a_min_{x} <= b_max_{x} AND b_min_{x} <= a_max_{x}' for x in 'xyz')} AS aabb_overlap,
                   {' * '.join(f'greatest(0.0, least(a_max_{x}, b_max_{x}) - greatest(a_min_{x}, b_min_{x}))' for x in 'xyz')} AS iv0,
                   sqrt({' + '.join(f'pow(greatest(0.0, a_min_{x} - b_max_{x}, b_min_{x} - a_max_{x}), 2)' for x in 'xyz')}) AS d0 FROM placed),
    vol AS (SELECT *, CASE WHEN aabb_overlap THEN iv0 ELSE 0.0 END AS iv, 1e-6 * least(va, vb) AS eps FROM raw),
    flags AS (SELECT *, iv > eps AS exact_overlap, CASE WHEN iv > eps THEN 0.0 ELSE d0 END AS distance,
                     va <= vb + eps AND abs(iv - va) <= eps AS a_in_b, vb <= va + eps AND abs(iv - vb) <= eps AS b_in_a, iv / least(va, vb) AS norm FROM vol),
    geo AS (SELECT *, CASE WHEN a_in_b OR b_in_a THEN CASE WHEN exact_overlap THEN 'contained' ELSE 'invalid' END WHEN exact_overlap THEN 'intersecting'
                           WHEN distance <= 1e-4 THEN 'touching' WHEN distance <= 1.0 THEN 'near_miss' ELSE 'disjoint' END AS relation,
                   'geom_' || lpad(a_object_id::VARCHAR, 8, '0') || '_' || lpad(spec::VARCHAR, 2, '0') AS geometry_id,
                   'pair_' || lpad(a_object_id::VARCHAR, 8, '0') AS pair_id FROM flags)"""
