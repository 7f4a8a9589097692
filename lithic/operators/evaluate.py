"""Scoring predictions against rows: joins, accuracies, confusion, comparisons, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing as P
from .pairs import sealed


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def keyed(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on a key; text keys go with their hash, so that sorts compare numbers: ids share long beginnings."""
    if dict(left.dtypes)[key] != "string" or dict(right.dtypes)[key] != "string":
        return left.join(right, key, how)
    return _hashed(left, key).join(_hashed(right, key), ["_hash", key], how).drop("_hash")


def _hashed(df: DataFrame, key: str) -> DataFrame:
    return df if "_hash" in df.columns else df.withColumn("_hash", F.xxhash64(key))


def latest(predictions: DataFrame, key: str, position: str, output: str) -> DataFrame:
    """One output per key: the last by position. A grouped maximum, so a key that repeats often is pre-aggregated."""
    last = F.max(output) if position == output else F.max_by(F.col(output), F.col(position))
    by = ["_hash", key] if "_hash" in predictions.columns else [key]
    return predictions.groupBy(*by).agg(last.alias(output))


def answered(rows: DataFrame, predictions: DataFrame, key: str = "id", position: str = "position") -> DataFrame:
    """Rows with `output`, '' if missing.

    Of several predictions for a row the last by `position` counts; without that column the greatest output does, so
    every row stands once and reruns agree.
    """
    by = position if position in predictions.columns else "output"
    if dict(predictions.dtypes)[key] == "string":
        predictions = _hashed(predictions, key)
    joined = keyed(rows, latest(predictions, key, by, "output"), key, "left")
    return joined.drop("_hash").withColumn("output", F.coalesce("output", F.lit("")))


def judged(answers: DataFrame, unwrap: bool = True, suffix: str = "") -> DataFrame:
    """Answered rows with `parsed` (null if invalid) and `correct`. A task without a grammar stops the run."""
    text = P.candidate(F.col("output")) if unwrap else F.col("output")
    parsed = answers.withColumn(f"parsed{suffix}", P.parse_answer(P.require_known(F.col("task_type")), text))
    correct = F.coalesce(F.col(f"parsed{suffix}") == F.col("answer"), F.lit(False))
    return sealed(parsed.withColumn(f"correct{suffix}", correct), f"parsed{suffix}", f"correct{suffix}")


def scored(rows: DataFrame, predictions: DataFrame, key: str = "id", unwrap: bool = True, position: str = "position") -> DataFrame:
    """Rows with `output` ('' if missing), `parsed` (null if invalid) and `correct`: answered(), then judged()."""
    return judged(answered(rows, predictions, key, position), unwrap)


def accuracy(scored_rows: DataFrame, *by: str) -> DataFrame:
    n, good, bad = F.count(F.lit(1)), F.count_if("correct"), F.count_if(F.col("parsed").isNull())
    return scored_rows.groupBy(*by).agg(n.alias("total"), good.alias("n_correct"), bad.alias("n_invalid"), F.round(ratio(good, n), 6).alias("accuracy"), F.round(ratio(bad, n), 6).alias("invalid_rate"))


def grouped_accuracy(rows: DataFrame, dimensions: list[str], correct: str) -> DataFrame:
    """Accuracy in total and by each dimension: one pass with grouping sets."""
    each = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    g = rows.select(F.col(correct).alias("ok"), F.inline(each)).groupBy("dimension", "value")
    return g.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("n_correct"), F.round(ratio(F.count_if("ok"), F.count(F.lit(1))), 6).alias("accuracy"))


def precision_recall(rows: DataFrame, gold: str, mine: str) -> DataFrame:
    """Per label of gold or predicted: support, precision, recall, f1; and 'macro' and 'weighted' averages."""
    cells = rows.groupBy(F.col(gold).cast("string").alias("g"), F.col(mine).cast("string").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.inline(F.array(F.struct(F.col("g").alias("label"), F.lit(True).alias("is_gold"), "g", "m", "n"), F.struct(F.col("m").alias("label"), F.lit(False).alias("is_gold"), "g", "m", "n"))))
    per = sides.where("label is not null").groupBy("label").agg(
        F.sum(F.when(F.col("is_gold") & (F.col("g") == F.col("m")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("is_gold"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("is_gold"), F.col("n")).otherwise(0)).alias("predicted"),
    )
    per = per.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    per = per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    cols = ("precision", "recall", "f1")
    macro = per.agg(F.lit("macro").alias("label"), F.sum("support").alias("support"), *[ratio(F.sum(c), F.count(F.lit(1))).alias(c) for c in cols])
    weighted = per.agg(F.lit("weighted").alias("label"), F.sum("support").alias("support"), *[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in cols])
    out = per.select("label", "support", *cols).unionByName(macro).unionByName(weighted)
    return out.select("label", F.col("support").cast("long").alias("support"), *[F.round(c, 6).alias(c) for c in cols])


def systems(judgements: DataFrame, *names: str) -> DataFrame:
    """One row per row and system, of rows that hold each system's verdict as parsed_<name> and correct_<name>."""
    each = F.array(*[F.struct(F.lit(x).alias("system"), F.col(f"parsed_{x}").alias("parsed"), F.col(f"correct_{x}").alias("correct")) for x in names])
    return judgements.select("task_type", "answer", F.inline(each))


def comparison(*systems: tuple[str, DataFrame]) -> DataFrame:
    """Stacked accuracies of named systems, by task and system."""
    out = None
    for name, acc in systems:
        part = acc.select("task_type", F.lit(name).alias("system"), "total", "accuracy", "invalid_rate")
        out = part if out is None else out.unionByName(part)
    return out.orderBy("task_type", "system")


def comparison_markdown(rows: DataFrame) -> DataFrame:
    return rows.select(F.format_string("| %s | %s | %d | %.4f | %.4f |", "task_type", "system", "total", "accuracy", "invalid_rate").alias("line"))


def aligned(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """How often both, only one, or none of two systems is right on the rows of either."""
    j = keyed(a.select(key, F.col("correct").alias("x")), b.select(key, F.col("correct").alias("y")), key, "full_outer")
    return outcomes(j, F.col("x"), F.col("y"))


def outcomes(rows: DataFrame, first: Column, second: Column) -> DataFrame:
    """The counts of aligned() where both verdicts stand in one row."""
    x, y = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    return rows.groupBy(F.when(x & y, "both").when(x, "only_first").when(y, "only_second").otherwise("neither").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def unmatched(rows: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Rows without a prediction and predictions without a row."""
    missing = keyed(rows.select(key), predictions.select(key), key, "left_anti").select(key, F.lit("missing").alias("problem"))
    return missing.unionByName(keyed(predictions.select(key), rows.select(key), key, "left_anti").select(key, F.lit("unknown").alias("problem")))


def failures(scored_rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Counts of wrong and of invalid rows by each dimension."""
    bad = scored_rows.where(~F.col("correct")).withColumn("kind", F.when(F.col("parsed").isNull(), "invalid").otherwise("incorrect"))
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    return bad.select("kind", F.inline(each)).groupBy("kind", "dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def edit_categories(gold: Column, mine: Column, tolerance: float = 0.15) -> Column:
    """What is wrong with a signed or axis edit: sorted category names, empty if nothing."""
    (ed, e), (pd, p) = P.axis_parts(gold), P.axis_parts(mine)
    names = [
        F.when(mine.isNull(), "invalid_output"),
        F.when(ed != pd, "wrong_direction"),
        F.when((F.substring(ed, 2, 1) == F.substring(pd, 2, 1)) & (ed != pd), "wrong_sign"),
        F.when((ed == pd) & (p < e - tolerance), "under_move"),
        F.when((ed == pd) & (p > e + tolerance), "over_move"),
    ]
    return F.array_sort(F.filter(F.array(*names), lambda x: x.isNotNull()))


def top_errors(rows: DataFrame, text: str, position: str, k: int = 20) -> DataFrame:
    """The k most frequent texts; ties by first position."""
    return rows.groupBy(text).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first")).orderBy(F.col("n").desc(), "first").limit(k).select(text, "n")


def numeric_error(rows: DataFrame, by: str, expected: Column, mine: Column, comparable: Column, tolerance: float = 0.15) -> DataFrame:
    """Mean absolute error over comparable rows, and the share of all rows within the tolerance."""
    error = F.when(comparable, F.abs(mine - expected))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count(error).alias("comparable"), F.round(F.avg(error), 6).alias("mae"), F.round(ratio(F.count_if(error <= tolerance + 1e-9), F.count(F.lit(1))), 6).alias("within"))


def ranking_accuracy(rows: DataFrame, gold: Column, parsed: Column) -> DataFrame:
    """Sum of the pairwise agreements over the count of all rows; a null `parsed` counts as 0."""
    total = F.count(F.lit(1))
    return rows.agg(total.alias("total"), F.count(parsed).alias("parsed"), F.round(ratio(F.sum(P.ranking_agreement(gold, parsed)), total), 6).alias("accuracy"))


def best_checkpoint(log: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """Of each run the step of the greatest finite value; the first wins ties."""
    good = log.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))
    return good.groupBy(run).agg(F.max_by(F.struct(step, value), F.struct(F.col(value), -F.col(step))).alias("b")).select(run, f"b.{step}", f"b.{value}")


def answer_balance(rows: DataFrame, part: list[str], answer: str, least: float = 0.10, most: float = 0.70, fewest: int = 30) -> DataFrame:
    """Share of each answer within its part, and why it is out of balance ('' if it isn't)."""
    c = rows.groupBy(*part, answer).agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*part)))
    why = F.concat_ws(",", F.when(F.col("n") < fewest, "low_count"), F.when(F.col("share") < least, "low_share"), F.when(F.col("share") > most, "high_share"))
    return c.select(*part, answer, "n", F.round("share", 6).alias("share"), why.alias("reason"))
