"""Checks, summaries and text helpers on single records and small groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    """Ids that stand on more than one row, with their count."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_empty(violations: DataFrame, what: str, shown: int = 5) -> None:
    """Raise with the first violations in sorted order, so the message doesn't depend on partitions."""
    found = sorted(map(str, violations.orderBy(*violations.columns).limit(shown).collect()))
    if found:
        raise ValueError(f"{what}: {'; '.join(found)}")


def length_summary(rows: DataFrame, by: str, length: Column) -> DataFrame:
    """Count, least, greatest and mean length of each group; nulls where it has none."""
    return rows.groupBy(by).agg(F.count(length).alias("n"), F.min(length).alias("least"), F.max(length).alias("greatest"), F.round(F.avg(length), 6).alias("mean"))


def relative_rank(rows: DataFrame, batch: str, reward: str, key: str) -> DataFrame:
    """1-based rank by falling reward within a batch, ties by key, and the batch's size. Batches are small by nature."""
    w = Window.partitionBy(batch)
    return rows.withColumns({"rank": F.row_number().over(w.orderBy(F.col(reward).desc(), key)).cast("long"), "group_size": F.count(F.lit(1)).over(w)})


def page(rows: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(order).offset(offset).limit(limit)


def normalized_answer(text: Column) -> Column:
    """First line in lower case, without quotes and marks at its ends; '' for empty text."""
    first = F.split(F.trim(text, F.lit(" \t\r\n")), "\n")[0]
    return F.lower(F.regexp_replace(F.trim(first, F.lit(" \t\r\n")), r"^[\s\"'`.,:;!]+|[\s\"'`.,:;!]+$", ""))


def has_reasoning_words(text: Column, least: int = 4) -> Column:
    """At least so many words, and so many different ones, between the think tags."""
    inner = F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1)
    words = F.filter(F.split(F.lower(inner), r"\s+"), lambda w: w != "")
    return (F.size(words) >= least) & (F.size(F.array_distinct(words)) >= least)


def source_subsets(source_id: Column) -> Column:
    """First two path segments of each part of an id whose parts are set apart by '|'."""
    return F.transform(F.split(source_id, r"\|"), lambda p: F.array_join(F.slice(F.split(p, "/"), 1, 2), "/"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")


def id_groups(rows: DataFrame, group: str, key: str, least: int = 2) -> DataFrame:
    """Sorted ids of each group of at least `least` rows (variants of one source, a few each)."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(key)).alias("ids")).where(F.size("ids") >= least)


def stop_signals(lines: DataFrame, text: str, rules: dict[str, str]) -> DataFrame:
    """How many lines hold each rule's substring, whatever the case."""
    hits = F.array(*[F.when(F.lower(text).contains(s.lower()), name) for name, s in rules.items()])
    return lines.select(F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def preflight(rows: DataFrame, split: str, train_only: str) -> DataFrame:
    """Problems of a training set, one row each: rows for the optimizer that aren't from public train, empty splits."""
    outside = rows.where(F.col(train_only) & (F.col(split) != "train")).groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    return outside.select(F.lit("optimizer_row_outside_train").alias("problem"), F.col(split).alias("split"), "n")


def dataset_card(counts: dict[str, dict[str, int]], title: str) -> str:
    """Markdown of small count tables."""
    parts = [f"# {title}"]
    for name, table in counts.items():
        parts += [f"\n## {name}\n", "| value | rows |", "| --- | ---: |", *(f"| {k} | {v:,} |" for k, v in sorted(table.items()))]
    return "\n".join(parts) + "\n"
