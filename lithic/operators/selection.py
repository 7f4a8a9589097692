"""Which rows go on: validated sources, eligible groups, samples by strategy, replaced and moved subsets, retries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from .sampling import round_robin, stratified

# Words that tell of a cavity, operations that make compounds, and the fill ratio below which a part is hollow.
CAVITY_WORDS = ("cut", "hole", "slot", "shell", "ring", "tube", "pipe", "bracket", "u_shape", "u-shape", "cavity", "void")
COMPOUND_OPS = ("cut", "union", "intersect", "loft", "sweep", "fillet", "chamfer", "shell", "hole", "extrude")
HOLLOW = 0.65


def is_valid(valid: Column, bbox: Column) -> Column:
    return F.coalesce(valid, F.lit(False)) & bbox.isNotNull()


def validated(objects: DataFrame, validations: DataFrame, key: str) -> DataFrame:
    """Objects with a valid record that has bounds."""
    return objects.join(validations.where(is_valid(F.col("valid"), F.col("bbox"))), key, "left_semi")


def failed_with_source(validations: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """Failed validations with what is known of their source; unknown sources stay, with nulls."""
    return validations.where(~F.coalesce("valid", F.lit(False))).join(objects, key, "left")


def cavity_like(texts: Column, volume: Column, bbox_volume: Column) -> Column:
    """A word that tells of a cavity in any of the texts (an array), or little of the bounds filled."""
    named = F.exists(texts, lambda t: F.coalesce(F.lower(t).rlike("|".join(CAVITY_WORDS)), F.lit(False)))
    return named | F.coalesce((bbox_volume > 0) & (volume / bbox_volume < HOLLOW), F.lit(False))


def compoundish(ops_a: Column, ops_b: Column) -> Column:
    return F.arrays_overlap(F.array_union(ops_a, ops_b), F.array(*map(F.lit, COMPOUND_OPS)))


def included(flag: Column) -> Column:
    """Rows are in unless a flag says no; without one they are in."""
    return F.coalesce(flag, F.lit(True))


def movable_groups(rows: DataFrame, group: str, split: str, links: list[str], forbidden: list[str]) -> DataFrame:
    """Groups none of whose links (pair, assembly) also stands in a forbidden split."""
    out = rows.select(group).distinct()
    for link in links:
        held = rows.where(F.col(split).isin(forbidden) & F.col(link).isNotNull()).select(link).distinct()
        out = out.join(rows.join(held, link).select(group).distinct(), group, "left_anti")
    return out


def moved_to(rows: DataFrame, groups: DataFrame, group: str, split: str, target: str) -> DataFrame:
    """Rows of the groups get the target split, others keep theirs."""
    chosen = groups.select(F.col(group), F.lit(True).alias("_moved")).distinct()
    return rows.join(chosen, group, "left").withColumn(split, F.when(F.col("_moved"), target).otherwise(F.col(split))).drop("_moved")


def redistributed(rows: DataFrame, group: str, split: str, links: list[str], forbidden: list[str], target: str, fraction: float, seed: int = 7) -> DataFrame:
    """A share of the movable groups, lowest hashes first, goes to the target split. The audit of leaks is the caller's."""
    from .sampling import groups_by_hash

    return moved_to(rows, groups_by_hash(movable_groups(rows, group, split, links, forbidden), group, fraction, seed), group, split, target)


def replaced(rows: DataFrame, old: Column, new: DataFrame) -> DataFrame:
    """Rows without the old subset, and the new rows; an unknown outcome isn't in the subset."""
    return rows.where(~F.coalesce(old, F.lit(False))).unionByName(new)


def require_rows(rows: DataFrame, limit: int) -> DataFrame:
    """The rows themselves; fewer than `limit` of them stop the run. No more than `limit` are counted."""
    found = rows.limit(limit).count()
    if found < limit:
        raise ValueError(f"{limit} rows were asked for, there are {found}")
    return rows


def select_rows(rows: DataFrame, key: str, limit: int | None, strategy: str = "stratified_task", task: str = "task", answer: str | None = None, seed: int = 7) -> DataFrame:
    """A sample in a shuffled order that depends on keys only; without a limit (or a large one) all rows, shuffled.

    random: the first by hash; stratified_task: tasks take turns; stratified_task_answer: and answers within a task.
    """
    if strategy not in ("random", "stratified_task", "stratified_task_answer"):
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy == "stratified_task_answer" and answer is None:
        raise ValueError("stratified_task_answer needs the answer column")
    shuffled = [order_key(seed, F.col(key)), F.col(key)]
    if limit is None or limit <= 0 or rows.limit(limit + 1).count() <= limit:
        return rows.orderBy(*shuffled)
    if strategy == "random":
        return rows.orderBy(*shuffled).limit(limit)
    if strategy == "stratified_task":
        return stratified(rows, [task], key, limit, seed)
    hashed = rows.withColumn("_h", F.struct(*shuffled))
    return round_robin(hashed, task, answer, "_h", limit).drop("_h")


def sample_tasks(rows: DataFrame, key: str, task: str, splits: list[str], tasks: list[str], most: int, per_task: int | None, seed: int = 7) -> DataFrame:
    """Rows of the splits and tasks: so many a task, tasks taking turns, or (None) the first `most` by hash."""
    if per_task is not None and per_task <= 0:
        raise ValueError("rows per task must be positive")
    found = rows.where(F.col("split").isin(splits) & F.col(task).isin(tasks))
    if per_task is None:
        return found.orderBy(order_key(seed, F.col(key)), key).limit(most)
    return first_per(found, [task], [order_key(seed, F.col(key)), F.col(key)], per_task, "_turn").orderBy("_turn", task).drop("_turn")


def first_per(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each group. Spark cuts each partition to k a group before it shuffles."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k)
    return ranked.withColumnRenamed("_r", rank) if rank else ranked.drop("_r")


def batches(rows: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """`batch`: rows of each group in order, so many a batch."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(at / size).cast("long"))


def retried(keys: DataFrame, key: str, attempt: Callable[[DataFrame, int], DataFrame], rounds: int) -> DataFrame:
    """Rounds of attempts on what no earlier round accepted: attempt(remaining, round) gives accepted keys.

    (key, round) of accepted keys. The rounds are few; each is an anti-join on the plan, not a collected list.
    """
    left, out = keys.select(key).distinct(), None
    for k in range(1, rounds + 1):
        good = attempt(left, k).select(key).distinct().withColumn("round", F.lit(k))
        out = good if out is None else out.unionByName(good)
        left = left.join(good, key, "left_anti")
    return out
