"""Whole-dataset operations: statistics, merges, caches, dedupe, comparisons, supervision tables, run order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _named(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("dimension"), value.cast("string").alias("value"))


def stats(rows: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """(dimension, value, n) over scalar and array dimensions in one pass; an array counts each distinct value once a row."""
    parts = []
    for name, c in dimensions.items():
        is_array = rows.select(c.alias("c")).schema["c"].dataType.typeName() == "array"
        values = F.array_distinct(c) if is_array else F.array(c)
        parts.append(F.transform(values, partial(_named, name)))
    return rows.select(F.inline(F.concat(*parts))).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def first_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The first row of each key by position."""
    packed = rows.groupBy(key).agg(F.min_by(F.struct("*"), F.col(position)).alias("r"))
    return packed.select("r.*")


def upsert_cache(keys: DataFrame, cache: DataFrame, key: str, value: str, compute) -> DataFrame:
    """Values for all keys: from the cache, else computed. compute: keys frame -> (key, value). `hit` tells which."""
    known = keys.join(cache, key).select(key, value, F.lit(True).alias("hit"))
    fresh = compute(keys.join(cache, key, "left_anti")).select(key, value, F.lit(False).alias("hit"))
    return known.unionByName(fresh)


def merged_manifests(shards: DataFrame, source: str, order: str, sums: list[str], firsts: list[str]) -> DataFrame:
    """One row per source: sums that are null only if all are, other fields from the first shard."""
    return shards.groupBy(source).agg(*[F.sum(c).alias(c) for c in sums], *[F.min_by(c, order).alias(c) for c in firsts])


def renumbered_shards(rows: DataFrame, shard: str, task: str, old: str) -> DataFrame:
    """New dense ids per task over shards in order; the old id is kept with its shard's prefix.

    Numbers within a shard and task come from a window of that part; the shards' offsets from their counts.
    """
    inside = F.row_number().over(Window.partitionBy(task, shard).orderBy(old))
    n = rows.groupBy(task, shard).agg(F.count(F.lit(1)).alias("_n"))
    before = n.select(task, shard, F.coalesce(F.sum("_n").over(Window.partitionBy(task).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = rows.withColumn("_i", inside).join(F.broadcast(before), [task, shard])  # a row per task and shard
    return out.withColumns({"number": F.col("_before") + F.col("_i"), "original": F.concat(F.lit("shard"), F.col(shard).cast("string"), F.lit(":"), F.col(old).cast("string"))}).drop("_i", "_before")


def different(left: DataFrame, right: DataFrame, name: str, digest: str) -> DataFrame:
    """Artifacts whose digests differ or that one side lacks; missing on both sides is equal."""
    j = left.select(name, F.col(digest).alias("left_digest")).join(right.select(name, F.col(digest).alias("right_digest")), name, "full_outer")
    return j.where(~F.col("left_digest").eqNullSafe(F.col("right_digest")))


def run_order(edges: list[tuple[str, list[str]]]) -> list[str]:
    """Topological order of a small run graph, names in lexicographic order where free; cycles and unknown names raise."""
    needs = {r: set(d) for r, d in edges}
    if unknown := sorted({d for ds in needs.values() for d in ds} - set(needs)):
        raise ValueError(f"unknown dependency: {', '.join(unknown)}")
    out: list[str] = []
    while needs:
        free = sorted(r for r, d in needs.items() if not d - set(out))
        if not free:
            raise ValueError(f"cycle among {', '.join(sorted(needs))}")
        out.append(free[0])
        del needs[free[0]]
    return out


def packed_chunks(docs: DataFrame, key: str, lengths: Column, size: int, shards: int) -> DataFrame:
    """Concatenate token streams shard by shard in key order and cut chunks of `size`: (shard, chunk, first key, tokens).

    A stream's tokens are spread over the chunks they fall into by a running sum; the last chunk of a shard may be short.
    """
    d = docs.select(F.col(key).alias("k"), lengths.cast("long").alias("len"), F.pmod(F.col(key), F.lit(shards)).alias("shard")).where("len > 0")
    w = Window.partitionBy("shard").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("at", F.coalesce(F.sum("len").over(w), F.lit(0)))
    spread = d.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("len") - 1) / size))))
    part = F.least(F.col("at") + F.col("len"), (F.col("chunk") + 1) * size) - F.greatest(F.col("at"), F.col("chunk") * size)
    return spread.groupBy("shard", "chunk").agg(F.min("k").alias("first_key"), F.sum(part).alias("tokens"))


# Words that mark a useful reasoning sentence, by kind.
SHAPE = ("box", "width", "depth", "height", "size", "volume")
MOTION = ("translate", "move", "shift", "rotate", "offset")
DECISION = ("therefore", "so", "overlap", "touch", "answer", "clear")


def segment_score(text: Column) -> Column:
    """Weighted count of marker words; a number in the sentence counts, too."""
    low = F.lower(text)
    hits = lambda words, w: sum((F.when(low.rlike(rf"\b{x}\b"), w).otherwise(0) for x in words), F.lit(0))
    return (hits(SHAPE, 1) + hits(MOTION, 2) + hits(DECISION, 3) + F.when(low.rlike("[0-9]"), 1).otherwise(0)).cast("long")


def segments(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Sentences of a text with their place: cut after . ! ? or at line ends, trimmed, empty ones left out."""
    marked = F.regexp_replace(F.col(text), r"([.!?])\s+", "$1\n")
    parts = F.filter(F.transform(F.split(marked, r"\n+"), lambda s: F.trim(s)), lambda s: s != "")
    return rows.select(key, F.posexplode(parts).alias("pos", "segment"))


def shortened(rows: DataFrame, key: str, least: int = 128, most: int = 256) -> DataFrame:
    """(key, kept, words): the best-scored segments of a text up to `most` words, in their order; one fold per text."""
    scored = rows.withColumns({"score": segment_score(F.col("segment")), "words": F.size(F.split("segment", r"\s+"))})
    g = scored.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("pos").alias("p"), F.col("words").alias("w"), "segment"))).alias("best"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, best in zip(b[key], b["best"], strict=True):
                kept, total = [], 0
                for s in best:
                    if total >= least:
                        break
                    if total + s["w"] <= most:
                        kept.append((s["p"], s["segment"]))
                        total += s["w"]
                out.append((k, " ".join(t for _, t in sorted(kept)), total))
            yield pd.DataFrame(out, columns=[key, "kept", "words"])

    return g.mapInPandas(fold, f"{key} long, kept string, words long")
