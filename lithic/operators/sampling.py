"""Balancing, capping and sampling with total orders, so every choice is the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import order_key


def _rank(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def _hash_rank(df: DataFrame, by: list[str], key: Column, ties: list[Column], name: str) -> DataFrame:
    """Rank of each row within its class by a hexadecimal hash, then ties. No task sorts a class.

    The hash's first digits cut a class into 4,096 ranges of equal width; a row's rank is that within its range plus the
    rows of the class's earlier ranges, of which there is a short list.
    """
    cut = df.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, 3)).withColumn("_at", F.struct(*by, "_range"))
    n = cut.groupBy("_at").agg(F.count(F.lit(1)).alias("_in"))
    before = n.select("_at", F.coalesce(F.sum("_in").over(Window.partitionBy(*[f"_at.{c}" for c in by]).orderBy("_at._range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range", *by).orderBy("_key", *ties))  # plain columns: structs have no sort prefix
    return cut.withColumn("_inside", inside).join(before, "_at").withColumn(name, F.col("_before") + F.col("_inside")).drop("_key", "_at", "_range", "_before", "_inside")


def cap_to_smallest(rows: DataFrame, part: list[str], answer: str, key: Column, ties: list[Column], classes: int | None = None) -> DataFrame:
    """Each class of each part keeps as many rows as the smallest class has, lowest keys (hashes) first, then ties.

    classes: how many classes a part must have; parts that lack some stay as they are.
    """
    counts = rows.groupBy(*part, answer).agg(F.count(F.lit(1)).alias("_n"))
    least = counts.groupBy(*part).agg(F.min("_n").alias("_least"), F.count(F.lit(1)).alias("_k"))
    ranked = _hash_rank(rows, [*part, answer], key, ties, "_r").join(least, part)
    whole = F.lit(False) if classes is None else F.col("_k") < classes
    return ranked.where(whole | (F.col("_r") <= F.col("_least"))).drop("_r", "_least", "_k")


def round_robin(rows: DataFrame, task: str, answer: str, key: str, limit: int) -> DataFrame:
    """The first `limit` rows when tasks take turns, and within a task answers take turns, each by `key`.

    Only the first `limit` rows of each (task, answer) can be taken, so the rest never reaches the last sort.
    """
    one = _rank(rows, [task, answer], [F.col(key)], "_a").where(F.col("_a") <= limit)
    two = _rank(one, [task], [F.col("_a"), F.col(answer)], "_t").where(F.col("_t") <= limit)
    return two.orderBy("_t", task).limit(limit).drop("_a", "_t")


def apportion(counts: DataFrame, name: str, available: str, share: str) -> DataFrame:
    """Largest total that shares by largest remainders without more than is available of any class, and each class's part.

    `counts` has a row per class. A candidate total lies between floor(min(available / share)) and that plus the classes.
    """
    top = counts.agg(F.floor(F.min(F.col(available) / F.col(share))).cast("long").alias("base"), F.count(F.lit(1)).alias("k"))
    totals = top.select(F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("base") - F.col("k")), F.col("base") + F.col("k"))).alias("total"), "k")
    each = totals.crossJoin(F.broadcast(counts.select(name, available, share)))  # a few totals x a few classes
    each = each.withColumn("exact", F.col("total") * F.col(share)).withColumn("whole", F.floor(F.col("exact") + 1e-9).cast("long"))
    w = Window.partitionBy("total")
    each = each.withColumn("left", F.col("total") - F.sum("whole").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.round(F.col("exact") - F.col("whole"), 9).desc(), name)))
    each = each.withColumn("part", F.col("whole") + F.when(F.col("r") <= F.col("left"), 1).otherwise(0))
    good = each.groupBy("total").agg(F.bool_and((F.col("part") <= F.col(available)) & (F.col("part") > 0)).alias("ok")).where("ok").agg(F.max("total").alias("total"))
    return each.join(F.broadcast(good), "total").select(name, F.col("part").cast("long").alias("part"))


def relation_balanced(rows: DataFrame, relation: str, group: str, targets: dict[str, float], key: Column) -> DataFrame:
    """Rows of the targeted relations cut to the apportioned counts, lowest group keys first; other relations stay.

    If a targeted relation is missing the rows stay as they are.
    """
    spark = rows.sparkSession
    share = spark.createDataFrame(list(targets.items()), f"{relation} string, share double")
    counts = rows.groupBy(relation).agg(F.count(F.lit(1)).alias("available")).join(F.broadcast(share), relation)
    whole = counts.agg((F.count(F.lit(1)) == len(targets)).alias("whole"))
    parts = apportion(counts, relation, "available", "share")
    ranked = _hash_rank(rows.where(F.col(relation).isin(list(targets))), [relation], key, [F.col(group)], "_r")
    cut = ranked.join(F.broadcast(parts), relation, "left").crossJoin(F.broadcast(whole)).where(~F.col("whole") | (F.col("_r") <= F.col("part"))).drop("_r", "part", "whole")
    return cut.unionByName(rows.where(~F.coalesce(F.col(relation).isin(list(targets)), F.lit(False))))


def stratified(rows: DataFrame, strata: list[str], key: str, limit: int, seed: int = 7) -> DataFrame:
    """`limit` rows, strata taking turns, hash order within each."""
    h = order_key(seed, F.col(key))
    ranked = _rank(rows, strata, [h, F.col(key)], "_r").where(F.col("_r") <= limit)
    return ranked.orderBy("_r", *strata).limit(limit).drop("_r")


def balanced_upsample(rows: DataFrame, strata: list[str], key: str, target: int, most_repeats: int = 3, seed: int = 7) -> DataFrame:
    """min(target, rows * most_repeats) rows of each stratum: whole shuffled passes are repeated, `copy` counts them from 1."""
    n = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    all_ = rows.join(n, strata).withColumn("_want", F.least(F.lit(target), F.col("_n") * most_repeats))
    copies = all_.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("_want") / F.col("_n")))))
    ranked = _hash_rank(copies, [*strata, "copy"], order_key(seed, F.col("copy"), F.col(key)), [F.col(key)], "_r")
    return ranked.where((F.col("copy") - 1) * F.col("_n") + F.col("_r") <= F.col("_want")).drop("_n", "_want", "_r")


def groups_by_hash(rows: DataFrame, group: str, fraction: float, seed: int = 7) -> DataFrame:
    """The max(1, round(groups * fraction)) groups of the lowest sha256 scores, half to even."""
    g = rows.select(group).distinct()
    t = g.agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * fraction).cast("int")).alias("k"))
    k = t.first()["k"]
    return g.orderBy(order_key(seed, F.col(group)), group).limit(k)


def diverse_low_reward(rows: DataFrame, task: str, reward: str, key: str, limit: int) -> DataFrame:
    """First the lowest reward of each task, then the rest by reward; rewards of 1 or more come last in either."""
    full = F.col(reward) >= 1
    ranked = _rank(rows, [task], [full, F.col(reward), F.col(key)], "_r").where(F.col("_r") <= limit)
    return ranked.orderBy(F.col("_r") > 1, full, F.col(reward), F.col(key)).limit(limit).drop("_r")


def few_shot(rows: DataFrame, task: str, group: str, answer: str, key: str, shots: int) -> DataFrame:
    """(key, example): up to `shots` rows of the same task from another group, by (answer, key).

    A row needs at most `shots` rows outside its group, so a task keeps its first rows only: for each group at most
    `shots`, and of these those of the first `shots` + 1 groups' worth; no row is compared with a whole task.
    """
    w = Window.partitionBy(task, group).orderBy(answer, key)
    firsts = rows.select(task, group, answer, key).withColumn("_g", F.row_number().over(w)).where(F.col("_g") <= shots)
    ordered = firsts.withColumn("_o", F.row_number().over(Window.partitionBy(task).orderBy(answer, key))).where(F.col("_o") <= 2 * shots)
    pool = ordered.groupBy(task).agg(F.array_sort(F.collect_list(F.struct("_o", F.col(group).alias("g"), F.col(key).alias("k")))).alias("pool"))
    mine = rows.join(F.broadcast(pool), task)
    picked = F.slice(F.filter("pool", lambda p: p["g"] != F.col(group)), 1, shots)
    return mine.select(key, F.posexplode(picked).alias("pos", "p")).select(key, (F.col("pos") + 1).cast("long").alias("shot"), F.col("p.k").alias("example"))
