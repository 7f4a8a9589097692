"""Leakage-safe deterministic splits of groups, and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_bucket

SEED = 1234
#: Fixed bounds of hash buckets.
PLAIN = ((70, "train"), (80, "validation"), (90, "test_object_pair_heldout"), (100, "test_random"))
BOUNDARY = ((75, "train"), (85, "validation"), (90, "test_random"), (93, "test_object_pair_heldout"), (100, "test_near_boundary"))


def _by_bounds(bucket: Column, bounds: tuple[tuple[int, str], ...]) -> Column:
    out = F.when(bucket < bounds[0][0], bounds[0][1])
    for bound, name in bounds[1:]:
        out = out.when(bucket < bound, name)
    return out


def plain_split(group: Column, seed: int = SEED) -> Column:
    return _by_bounds(stable_bucket(group, seed, 100), PLAIN)


def boundary_split(group: Column, seed: int = SEED) -> Column:
    return _by_bounds(stable_bucket(F.concat(F.lit("boundary:"), group), seed, 100), BOUNDARY)


def synthetic_split(group: Column, seed: int = SEED) -> Column:
    b = stable_bucket(group, seed, 3)
    return F.when(b == 0, "train").when(b == 1, "validation").otherwise("test_random")


def split_group(assembly: Column, pair: Column, counterfactual: Column) -> Column:
    """Key that a row is split by: assembly, else pair, else counterfactual group; empty keys don't count."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (assembly, pair, counterfactual)])


def metadata_group(counterfactual: Column, assembly: Column, pair: Column) -> Column:
    """Key that a row's metadata names: counterfactual, else assembly, else pair."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (counterfactual, assembly, pair)])


def heldout_generators(rows: DataFrame, generator: str, seed: int = SEED, least: int = 88) -> DataFrame:
    """Generators held out: those whose bucket of 100 is `least` or more, else the last by name; none of fewer than two."""
    names = rows.where(F.col(generator).isNotNull()).select(F.col(generator).alias("generator")).distinct()
    all_ = names.agg(F.count(F.lit(1)).alias("n"), F.max("generator").alias("last"), F.coalesce(F.bool_or(stable_bucket(F.col("generator"), seed, 100) >= least), F.lit(False)).alias("some"))
    picked = (stable_bucket(F.col("generator"), seed, 100) >= least) | (~F.col("some") & (F.col("generator") == F.col("last")))
    return names.crossJoin(F.broadcast(all_)).where((F.col("n") >= 2) & picked).select("generator")  # one row of totals


def heldout_value(rows: DataFrame, group: str, values: str, namespace: str, preferred: tuple[str, ...] = (), seed: int = SEED) -> DataFrame:
    """One rare value of an array column: in at most a fifth of the groups; by preference, count, hash, name.

    Needs three groups and two values; else no row.
    """
    exploded = rows.select(F.col(group).alias("g"), F.explode(values).alias("value")).select("g", F.trim("value").alias("value")).where("value <> ''").distinct()
    counts = exploded.groupBy("value").agg(F.count(F.lit(1)).alias("groups"))
    totals = rows.agg(F.count_distinct(group).alias("all")).crossJoin(counts.agg(F.count(F.lit(1)).alias("kinds")))
    rank = F.lit(len(preferred))
    for k, p in reversed(list(enumerate(preferred))):
        rank = F.when(F.col("value") == p, k).otherwise(rank)
    fit = counts.crossJoin(F.broadcast(totals)).where("`all` >= 3 and kinds >= 2 and groups <= greatest(1, `all` div 5) and groups < `all`")
    return fit.select("value", "groups", rank.alias("r"), stable_bucket(F.concat(F.lit(f"{namespace}:"), F.col("value")), seed, 1_000_000).alias("h")).orderBy("r", "groups", "h", "value").limit(1).select("value", "groups")


def group_splits(groups: DataFrame, group: str, synthetic: str, heldout: str, boundary: str, seed: int = SEED) -> DataFrame:
    """`split` of each group: synthetic, generator-held-out and near-boundary groups by their own rules, the rest by hash."""
    g = F.col(group)
    return groups.withColumn("split", F.when(F.col(synthetic), synthetic_split(g, seed)).when(F.col(heldout), "test_generator_heldout").when(F.col(boundary), boundary_split(g, seed)).otherwise(plain_split(g, seed)))


def inner_train_eval(rows: DataFrame, group: str, fraction: float = 0.1, seed: int = SEED) -> DataFrame:
    """Groups to 'inner_eval' by hash below `fraction`; never none and never all of two or more groups."""
    g = rows.select(F.col(group).alias("g")).distinct().withColumn("h", stable_bucket(F.col("g"), seed, 1_000_000))
    cut = int(fraction * 1_000_000)
    t = g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("h") < cut).alias("e"), F.min(F.struct("h", "g")).alias("lo"), F.max(F.struct("h", "g")).alias("hi"))
    chosen = F.when((F.col("e") == 0) & (F.col("n") > 1), F.col("g") == F.col("lo.g")).when((F.col("e") == F.col("n")) & (F.col("n") > 1), F.col("g") != F.col("hi.g")).otherwise(F.col("h") < cut)
    return g.crossJoin(F.broadcast(t)).select(F.col("g").alias(group), F.when(chosen, "inner_eval").otherwise("inner_train").alias("split"))  # one row of totals


def balanced_eval_groups(rows: DataFrame, group: str, task: str, answer: str, fraction: float = 0.1, most_answers: int = 12, seed: int = SEED) -> DataFrame:
    """Groups for evaluation that cover every (task, answer) stratum, rarest first, then fill up by hash to the fraction.

    Strata are few (at most `most_answers` a task) and each gives one candidate group, so the cover is a short list on
    the driver; the fill is a running sum over hash order, by ranges. Returns (group, reason).
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    kinds = rows.groupBy(task).agg(F.count_distinct(answer).alias("k")).where(f"k > 1 and k <= {most_answers}").select(task)
    members = rows.join(F.broadcast(kinds), task).select(group, task, answer).distinct().join(sizes, group)
    key = F.struct(stable_bucket(F.concat_ws(":", task, answer, group), seed, 1_000_000).alias("h"), F.col("size"), F.col(group).alias("g"))
    strata = members.groupBy(task, answer).agg(F.count(F.lit(1)).alias("groups"), F.min(key).alias("best")).orderBy("groups", task, answer).collect()  # a row per stratum
    # What each stratum's candidate covers, in one job: a candidate has few rows.
    candidates = sorted({s["best"]["g"] for s in strata})
    held: dict[str, set[tuple]] = {g: set() for g in candidates}
    for r in members.where(F.col(group).isin(candidates)).select(group, task, answer).collect():
        held[r[group]].add((r[task], r[answer]))
    cover: list[str] = []
    for s in strata:
        if not any((s[task], s[answer]) in held[g] for g in cover):
            cover.append(s["best"]["g"])
    chosen = sizes.withColumn("covers", F.col(group).isin(cover) if cover else F.lit(False))
    t = chosen.agg(F.greatest(F.lit(1), F.bround(F.sum("size") * fraction)).alias("target"), F.coalesce(F.sum(F.when(F.col("covers"), F.col("size"))), F.lit(0)).alias("held"))
    rest = chosen.where("not covers").withColumn("h", stable_bucket(F.col(group), seed, 1_000_000))
    # Running sum in hash order: sums of 1,000 hash ranges first, then within each range.
    rest = rest.withColumn("part", F.floor(F.col("h") / 1000))
    before = rest.groupBy("part").agg(F.sum("size").alias("s")).select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("part").orderBy("h", group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    filled = rest.withColumn("inside", inside).join(F.broadcast(before), "part").crossJoin(F.broadcast(t)).where("held + before + inside < target")
    return chosen.where("covers").select(group, F.lit("cover").alias("reason")).union(filled.select(group, F.lit("fill").alias("reason")))


def leakage(rows: DataFrame, split: str, fields: list[str]) -> DataFrame:
    """(field, value, split_a, split_b): values that stand in two splits. Distinct first, so the self-join is small."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    d = rows.select(F.col(split).alias("s"), F.inline(pairs)).where("value is not null and value <> ''").distinct()
    per = d.groupBy("field", "value").agg(F.array_sort(F.collect_set("s")).alias("splits")).where(F.size("splits") > 1)
    two = F.flatten(F.transform("splits", lambda a: F.transform(F.filter("splits", lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))
    return per.select("field", "value", F.inline(two))


def split_manifest(rows: DataFrame, split: str, group: str, task: str, answer: str) -> DataFrame:
    """Rows, groups, tasks and yes/no answers of each split."""
    return rows.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(group).alias("n_groups"), F.array_sort(F.collect_set(task)).alias("tasks"), F.count_if(F.col(answer) == "yes").alias("yes"), F.count_if(F.col(answer) == "no").alias("no"))
