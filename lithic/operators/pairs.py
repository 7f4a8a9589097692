"""Pairing, placing and measuring objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import labels as L

#: Placements of b beside a: strategy -> gap between facing sides, from the spans `sa` and `sb` along the axis and the pair's index.
STRATEGIES = {
    "clear_disjoint": lambda sa, sb, i: F.lit(10.0),
    "broad_random_disjoint": lambda sa, sb, i: (F.lit(2) + i % 7).cast("double"),
    "bbox_touching": lambda sa, sb, i: F.lit(0.0),
    "near_miss": lambda sa, sb, i: F.lit(0.5),
    "tiny_clearance": lambda sa, sb, i: F.lit(0.0625),
    "mid_clearance": lambda sa, sb, i: F.lit(3.0),
    "small_overlap": lambda sa, sb, i: -0.125 * F.least(sa, sb),
    "medium_overlap": lambda sa, sb, i: -0.25 * F.least(sa, sb),
    "deep_overlap": lambda sa, sb, i: -0.5 * F.least(sa, sb),
    "cavity_center_probe": lambda sa, sb, i: -0.5 * (sa + sb),
}


def sealed(df: DataFrame, *derived: str) -> DataFrame:
    """The same rows with the derived columns (default: all) behind a one-element generator: later filters stay above it.

    Pushed down, a filter on a derived label would repeat the whole chain of formulas that the label stands for. Columns
    that aren't derived go past the generator, so those that a query doesn't read are pruned.
    """
    if not derived:
        return df.select(F.inline_outer(F.array(F.struct("*"))))
    kept = [c for c in df.columns if c not in derived]
    return df.select(*kept, F.inline_outer(F.array(F.struct(*derived)))).select(*df.columns)


def ring_pairs(objects: DataFrame, majors: list[str], *order: str) -> DataFrame:
    """Each object with the next one of a ring over (*majors, *order): columns a_* and b_*.

    Objects are sorted within each run of equal `majors`; only the ends of those runs, one row each, are joined across
    runs. The list of runs is short (combinations of categories), so its window is small; a single object has no partner.
    """
    major = F.struct(*majors)
    cols = objects.columns
    one = F.struct(*[F.col(c) for c in cols])
    w = Window.partitionBy(*majors).orderBy(*order)
    near = objects.select(one.alias("a"), F.lead(one).over(w).alias("b"), major.alias("_run"))
    firsts = objects.groupBy(major.alias("_run")).agg(F.min_by(one, F.struct(*[F.col(c) for c in order])).alias("_first"))
    around = Window.orderBy(F.col("_run").asc())
    nexts = firsts.select("_run", F.coalesce(F.lead("_first").over(around), F.first("_first").over(around)).alias("_next"))
    linked = near.join(F.broadcast(nexts), near["_run"].eqNullSafe(nexts["_run"])).select("a", F.coalesce("b", "_next").alias("b"))
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return linked.where(~same).select(*[F.col(f"a.{c}").alias(f"a_{c}") for c in cols], *[F.col(f"b.{c}").alias(f"b_{c}") for c in cols])


def candidates(pairs: DataFrame, index: Column, strategies: dict | None = None) -> DataFrame:
    """One row per pair and strategy, b placed along an axis and side that cycle with the pair's index."""
    strategies = strategies or STRATEGIES
    side = (index % 6).cast("int")
    placed = pairs.withColumns({"_i": index, "axis": (side % 3).cast("int"), "sign": F.when(side < 3, 1.0).otherwise(-1.0)})
    span = lambda p: F.when(F.col("axis") == 0, F.col(f"{p}_w")).when(F.col("axis") == 1, F.col(f"{p}_d")).otherwise(F.col(f"{p}_h"))
    specs = F.array(*[F.struct(F.lit(k).cast("long").alias("spec"), F.lit(n).alias("strategy"), gap(span("a"), span("b"), F.col("_i")).alias("gap")) for k, (n, gap) in enumerate(strategies.items(), 1)])
    out = placed.select("*", span("a").alias("_sa"), span("b").alias("_sb"), F.explode_outer(specs).alias("_s")).select("*", "_s.*").drop("_s")
    shift = F.col("sign") * ((F.col("_sa") + F.col("_sb")) / 2 + F.col("gap"))
    bounds = {}
    for k, (axis, size) in enumerate(zip(B.AXES, ("w", "d", "h"), strict=True)):
        off = F.when(F.col("axis") == k, shift).otherwise(0.0)
        bounds |= {f"a_min_{axis}": -F.col(f"a_{size}") / 2, f"a_max_{axis}": F.col(f"a_{size}") / 2, f"b_min_{axis}": off - F.col(f"b_{size}") / 2, f"b_max_{axis}": off + F.col(f"b_{size}") / 2}
    return sealed(out.withColumns(bounds).drop("_i", "_sa", "_sb"), *bounds)


def measured(placed: DataFrame, policy: L.LabelPolicy = L.POLICY) -> DataFrame:
    """The analytic box kernel: volumes, overlap, distance, flags, statuses, and the relation they give.

    The cheap test comes first: boxes that don't meet have no intersection to compute.
    """
    out = placed.withColumns({"va": B.volume("a"), "vb": B.volume("b"), "aabb_overlap": B.overlaps("a", "b")})
    out = out.withColumns({"iv": F.when(F.col("aabb_overlap"), B.intersection_volume("a", "b")).otherwise(0.0), "boolean_status": F.when(F.col("aabb_overlap"), "ok").otherwise("skipped_aabb_disjoint")})
    eps = policy.epsilon_volume(F.col("va"), F.col("vb"))
    over = F.col("iv") > eps
    out = out.withColumns({
        "exact_overlap": over,
        "distance": F.when(over, 0.0).otherwise(B.distance("a", "b")),
        "a_in_b": (F.col("va") <= F.col("vb") + eps) & (F.abs(F.col("iv") - F.col("va")) <= eps),
        "b_in_a": (F.col("vb") <= F.col("va") + eps) & (F.abs(F.col("iv") - F.col("vb")) <= eps),
        "norm": L.normalized_intersection(F.col("va"), F.col("vb"), F.col("iv")),
    })
    out = out.withColumn("relation", L.relation(*[F.col(c) for c in ("va", "vb", "iv", "distance", "a_in_b", "b_in_a", "boolean_status")], F.lit("ok"), policy))
    out = out.withColumn("distance_status", F.when(L.interferes(F.col("relation")), "skipped_positive_overlap").otherwise("ok"))
    return sealed(out, *[c for c in out.columns if c not in placed.columns])


def overlapping_pairs(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """Pairs of boxes of one key whose bounds meet, each once.

    The grid's cells are as wide as the widest box, so boxes that meet start in neighbouring cells: a box is joined from
    the cell of its lower corner with those that start in the 27 cells around it, and only then the bounds are tested.
    """
    wide = rows.agg(*[F.greatest(F.lit(1e-9), F.max(F.col(f"max_{x}") - F.col(f"min_{x}"))).alias(f"_w{x}") for x in B.AXES])
    placed = rows.crossJoin(F.broadcast(wide)).withColumns({f"_c{x}": F.floor(F.col(f"min_{x}") / F.col(f"_w{x}")).cast("long") for x in B.AXES})  # one row of widths
    a = placed.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns], *[f"_c{x}" for x in B.AXES])
    around = placed
    for x in B.AXES:
        around = around.withColumn(f"_c{x}", F.explode(F.sequence(F.col(f"_c{x}") - 1, F.col(f"_c{x}") + 1)))
    b = around.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns], *[F.col(f"_c{x}").alias(f"_d{x}") for x in B.AXES])
    same = F.col(f"a_{key}") == F.col(f"b_{key}")
    for x in B.AXES:
        same = same & (F.col(f"_c{x}") == F.col(f"_d{x}"))
    return a.join(b, same & (F.col(f"a_{id_col}") < F.col(f"b_{id_col}"))).where(B.overlaps("a", "b")).drop(*[f"_{p}{x}" for p in "cd" for x in B.AXES])


def grid_step(x: Column) -> Column:
    """The 0.1 grid's value at or above x (to 1e-9)."""
    return F.round(F.ceil(x * 10 - 1e-9) / 10, 1)


def exact_repair(placed: DataFrame, clearance_mm: float | None = None, policy: L.LabelPolicy = L.POLICY) -> DataFrame:
    """For boxes, the least move on the 0.1 grid in each direction that ends the overlap strictly, or reaches a clearance.

    Closed form of a search by bisection: facing sides part by the overlap, plus the clearance less the tolerance.
    """
    six = B.moves("a", "b")
    need = lambda m: grid_step(m + 1e-6) if clearance_mm is None else grid_step(m + clearance_mm - policy.touching_mm)
    stepped = F.transform(six, lambda m: F.struct(need(m["magnitude"]).alias("magnitude"), m["rank"].alias("rank"), m["direction"].alias("direction")))
    return placed.withColumn("repair", F.array_min(stepped))
