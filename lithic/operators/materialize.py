"""Rows of questions and answers from measured pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L

#: Fixed texts of the prompts.
PROMPTS = {
    "binary_interference": "Do the two objects interfere? Answer yes or no.",
    "relation_classification": "Classify the relation of the two objects.",
    "volume_bucket": "Which bucket holds the normalized intersection volume?",
    "clearance_bucket": "Which bucket holds the clearance?",
    "tolerance_fit": "Is a clearance of 1.0 mm kept? Answer yes or no.",
}


def task_rows(geometries: DataFrame, required_mm: float = 1.0, number: bool = True) -> DataFrame:
    """One row per valid geometry and task; with `number` also `id`, the task and a dense number by geometry_id.

    Every valid geometry has a row of every task, so geometries are numbered, once, not their rows.
    """
    rel, norm, d = F.col("relation"), F.col("norm"), F.col("distance")
    answers = {"binary_interference": L.binary_answer(rel), "relation_classification": rel, "volume_bucket": L.volume_bucket(norm), "clearance_bucket": L.clearance_bucket(rel, d), "tolerance_fit": L.tolerance_fit(d, required_mm)}
    tasks = F.array(*[F.struct(F.lit(t).alias("task_type"), a.alias("answer")) for t, a in answers.items()])
    valid = geometries.where(rel != "invalid")
    if number:
        valid = numbered(valid.withColumn("_all", F.lit("")), "_all", "geometry_id")
    rows = valid.select("geometry_id", "pair_id", "strategy", "relation", *(["id"] if number else []), F.explode_outer(tasks).alias("t")).select("*", "t.*").drop("t")
    return rows.withColumn("id", F.concat("task_type", "id")) if number else rows


def numbered(rows: DataFrame, task: str, order: str, ranges: int = 256) -> DataFrame:
    """`id` = task, an underscore and a dense number from 1 in the order of `order`, which is unique within a task.

    A window over a whole task would be one task's work. The order is cut into ranges by quantiles of a sample of its
    values, drawn by hash whatever their order and of bounded size; a row's number is its rank within its range plus the
    rows of earlier ranges.
    """
    h = F.xxhash64(order)
    sample = rows.select(order, h.alias("_h")).where(F.pmod("_h", F.lit(101)) == 0).orderBy("_h").limit(20_000).select(order)
    edges = sorted(r[0] for r in sample.collect())
    bounds = sorted(set(edges[:: max(1, len(edges) // ranges)]))

    # Bounds at or below a value: first whole blocks of 16, then inside the next one. One tree of 256 comparisons would be
    # a method that the JVM doesn't compile.
    blocks = [bounds[i : i + 16] for i in range(0, len(bounds), 16)] or [[]]
    x, one = F.col(order), lambda c: F.when(c, 1).otherwise(0)
    whole = sum((one(F.lit(b[0]) <= x) for b in blocks[1:]), F.lit(0))
    table = F.array(*[F.array(*map(F.lit, b)) for b in blocks])
    inside = sum((one(F.get(F.col("_block"), F.lit(i)) <= x) for i in range(len(blocks[0]))), F.lit(0))
    placed = rows.withColumn("_whole", whole).withColumn("_block", F.get(table, F.col("_whole")))
    placed = placed.withColumn("_part", F.when(x.isNull(), len(bounds)).otherwise(F.col("_whole") * 16 + inside)).drop("_whole", "_block")
    counts = placed.groupBy(task, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(task, "_part", F.coalesce(F.sum("_n").over(Window.partitionBy(task).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_r", F.row_number().over(Window.partitionBy("_part", task).orderBy(F.col(order).asc_nulls_last())))
    number = F.col("_before") + F.col("_r")
    out = ranked.join(F.broadcast(before), [task, "_part"])  # one row per task and range
    return out.withColumn("id", F.concat(F.col(task), F.lit("_"), F.lpad(number.cast("string"), 8, "0"))).drop("_part", "_before", "_r")


def prompt(task: Column, geometry_id: Column) -> Column:
    text = F.coalesce(*[F.when(task == t, F.lit(p)) for t, p in PROMPTS.items()])
    return F.concat(text, F.lit("\ngeometry: "), geometry_id)


def pairwise_rows(variants: DataFrame, group: str, key: str, positive: str) -> DataFrame:
    """Up to four ordered pairs of each group: the first two positive and the first two negative variants by key."""
    firsts = [F.array_sort(F.collect_list(F.when(F.col(positive) == side, F.col(key)))) for side in (True, False)]
    g = variants.groupBy(group).agg(firsts[0].alias("p"), firsts[1].alias("q"))
    p0, p1, q0, q1 = F.get("p", F.lit(0)), F.get("p", F.lit(1)), F.get("q", F.lit(0)), F.get("q", F.lit(1))
    pairs = F.array(*[F.struct(a.alias("first"), b.alias("second"), F.lit(x).alias("answer")) for a, b, x in ((p0, q0, "A"), (q0, p0, "B"), (p0, p1, "both"), (q0, q1, "neither"))])
    return g.select(group, F.explode_outer(pairs).alias("r")).select(group, "r.*").where("first is not null and second is not null")


def variant_ranking(variants: DataFrame, group: str, key: str, value: str, most: int = 5, least: int = 3) -> DataFrame:
    """Letters of a group's first `most` variants by key, ordered by falling value; groups of fewer than `least` have none."""
    w = Window.partitionBy(group).orderBy(key)
    top = variants.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w)).where(f"_r <= {most}")
    item = F.struct((-F.col(value)).alias("v"), F.char(F.lit(64) + F.col("_r")).alias("letter"))
    g = top.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("items")).where(F.size("items") >= least)
    return g.select(group, F.array_join(F.transform("items", lambda x: x["letter"]), "").alias("answer"))


def candidate_edits(need: Column) -> Column:
    """Four candidate moves A-D as multiples of the least one: what it moves, whether it suffices, and by how much it errs."""
    return F.array(*[F.struct(F.lit(c).alias("label"), (need * f).alias("movement"), (need * f >= need).alias("satisfies"), F.abs(need * f - need).alias("error")) for c, f in zip("ABCD", (0.5, 1.0, 1.5, 2.0), strict=True)])


def ranked_candidates(edits: Column) -> Column:
    """Labels from best to worst: sufficient ones first, then by movement, error and label."""
    keyed = F.transform(edits, lambda e: F.struct((~e["satisfies"]).alias("a"), e["movement"].alias("b"), e["error"].alias("c"), e["label"].alias("label")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda e: e["label"]), "")


def difficulty_tags() -> Column:
    rel, norm = F.col("relation"), F.col("norm")
    tags = [
        F.when(rel.isin("touching", "near_miss"), "near_boundary"),
        F.when(rel == "contained", "contained"),
        F.when((norm > 0) & (norm <= 0.05), "tiny_overlap"),
        F.when(F.col("aabb_overlap") & rel.isin("touching", "near_miss", "disjoint"), "aabb_false_positive"),
        F.col("a_tag"),
        F.col("b_tag"),
    ]
    return F.array_sort(F.array_distinct(F.filter(F.array(*tags), lambda t: t.isNotNull())))
