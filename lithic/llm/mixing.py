"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length within each source. A source's target is so many whole passes over it and a
rest; the rest is filled from the counts: a like share of every length, then the longest lengths while they fit, then
a bounded-knapsack dynamic programme over what remains, which comes as near the target as the lengths allow. Which
documents of a length are taken is decided by a seeded hash, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, text_or_empty, written

#: The dynamic programme covers a remaining budget of up to this, or four times the longest document if that is more.
KNAPSACK, MOST = 1 << 16, 1 << 24
#: Documents of one source and length are ranked in buckets of about RANKED rows, at most BUCKETS of them.
RANKED, BUCKETS = 256, 1 << 16
#: Rows of the plan (source, length) that may be broadcast, some 60 bytes each.
PLAN_ROWS = 500_000


def cycle_weights(sources: list[str | None]) -> dict[str | None, float]:
    """1, 2, 3, repeating, over the sources by code point, null last."""
    ordered = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    return {s: 1.0 + k % 3 for k, s in enumerate(ordered)}


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], total: float, most: float = 3.0) -> dict[str | None, float]:
    """Shares of `total` by weight; no target above `most` times its source, the excess goes to the others by weight."""
    out, free, left = {}, {s for s in sizes if weights.get(s, 0) > 0}, float(total)
    while free:
        scale = sum(weights[s] for s in free)
        full = {s for s in free if left * weights[s] / scale > most * sizes[s]}
        if not full:
            out |= {s: left * weights[s] / scale for s in free}
            break
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        free -= full
    return {s: out.get(s, 0.0) for s in sizes}


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take (at most `counts`) so that their sum is as near `budget` as it gets.

    Exact where the remaining budget after the like share fits the dynamic programme's bound.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    bound = min(MOST, max(KNAPSACK, 4 * int(lengths.max())))
    take = np.floor(counts * (max(0, budget - bound // 2) / total)).astype(np.int64)
    left = budget - int((lengths * take).sum())
    for k in np.argsort(-lengths, kind="stable"):  # the longest first, down to what the programme covers
        if left <= bound:
            break
        n = min(int(counts[k] - take[k]), (left - bound) // int(lengths[k]) + 1, left // int(lengths[k]))
        take[k] += n
        left -= n * int(lengths[k])
    room = left + int(lengths.max())  # the nearest sum may lie above the budget
    first = np.full(room + 1, -1, np.int64)  # the step at which each sum is first reached
    first[0] = 0
    reach = 1
    mask = (1 << (room + 1)) - 1
    steps = []
    for k in np.argsort(lengths, kind="stable"):
        n, size = int(counts[k] - take[k]), int(lengths[k])
        if size == 0 or n == 0 or size > room:
            continue
        n, power = min(n, room // size), 1
        while n > 0:  # binary splitting: 1, 2, 4, ... copies at once
            copies = min(power, n)
            grown = reach | ((reach << (copies * size)) & mask)
            steps.append((k, copies))
            fresh = grown & ~reach
            if fresh:
                bits = np.unpackbits(np.frombuffer(fresh.to_bytes(room // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits[: room + 1])] = len(steps)
            reach, n, power = grown, n - copies, power * 2
        if first[left] >= 0:
            break
    reached = np.flatnonzero(first >= 0)
    at = int(reached[np.lexsort((reached, np.abs(reached - left)))[0]])
    while at > 0:
        k, copies = steps[first[at] - 1]
        take[k] += copies
        at -= copies * int(lengths[k])
    return take


def mix(docs: DataFrame, weights: Callable[[list[str | None]], dict[str | None, float]] = cycle_weights, share: float = 1.0, most: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: (id, size, source, source_size, target, taken), and the columns in `carry`.

    size: words of the text (a null text has none); taken: words that the mix takes, size times 0 to `most` passes.
    The list of sources, one row each with its size, is the mix's specification and comes to the driver; documents
    don't. Documents without words are never taken. Rows of one source and size
    that repeat an id (or have none) are told apart by their text; of those that repeat that, too, the wanted number is taken.
    Empty table: no rows.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").cast("string").alias("_source"), size.alias("_size"), F.xxhash64(F.col(f"`{text_col}`").cast("string"), F.lit(seed)).alias("_tie"), *[F.col(f"`{c}`").alias(f"_carry_{c}") for c in carry])
    narrow = written(base.select("_id", "_source", "_size", "_tie"), "op1-sizes")
    histogram = written(narrow.groupBy("_source", "_size").agg(F.count(F.lit(1)).alias("_count")), "op1-lengths")
    sizes = {r["_source"]: r["n"] for r in histogram.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_count")).alias("n")).collect()}
    goal = targets(sizes, weights(list(sizes)), share * sum(sizes.values()), most)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        """All lengths of one source with their counts: no more rows than the source has distinct lengths."""
        source = pdf["_source"].iloc[0]
        source = None if pd.isna(source) else source
        total, want = sizes[source], goal[source]
        passes = int(want // total) if total else 0
        pdf = pdf.sort_values("_size", kind="stable")
        extra = fill(pdf["_size"].to_numpy(), pdf["_count"].to_numpy(), round(want - passes * total) if passes < most else 0)
        return pd.DataFrame({"_source": [source] * len(pdf), "_size": pdf["_size"].to_numpy(), "_count": pdf["_count"].to_numpy(), "_passes": passes, "_extra": extra, "_source_size": total, "_target": want})

    shape = "_source string, _size long, _count long, _passes long, _extra long, _source_size long, _target double"
    plans = written(histogram.groupBy("_source").applyInPandas(plan, shape), "op1-plan")
    bounded = plans.count() <= PLAN_ROWS
    lookup = F.broadcast(plans) if bounded else plans.hint("shuffle_merge")

    def planned(rows: DataFrame) -> DataFrame:
        same = rows["_source"].eqNullSafe(lookup["_source"]) & (rows["_size"] == lookup["_size"])
        return rows.join(lookup, same).select(rows["*"], *[lookup[c] for c in ("_count", "_passes", "_extra", "_source_size", "_target")])

    # Where some but not all documents of a source and length are taken once more, they are ranked by hash:
    # buckets by the hash's high bits are counted, and only the bucket where the count runs out is ranked by rows.
    h = F.xxhash64("_id", F.lit(seed))
    wide = F.least(F.ceil(F.col("_count") / RANKED), F.lit(BUCKETS))
    bucket = F.floor((F.shiftrightunsigned(h, 11) / float(1 << 53)) * wide)
    split = planned(narrow).where((F.col("_extra") > 0) & (F.col("_extra") < F.col("_count"))).withColumns({"_hash": h, "_bucket": bucket})
    per_bucket = split.groupBy("_source", "_size", "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.first("_extra").alias("_extra"))
    edges = per_bucket.withColumn("_before", F.expr("coalesce(sum(_n) over (partition by _source, _size order by _bucket rows between unbounded preceding and 1 preceding), 0)"))
    edges = edges.where((F.col("_before") < F.col("_extra")) & (F.col("_before") + F.col("_n") >= F.col("_extra"))).select("_source", "_size", F.col("_bucket").alias("_edge"), (F.col("_extra") - F.col("_before")).alias("_of_edge"))
    edges = written(edges, "op1-edges")
    edge = F.broadcast(edges) if bounded else edges  # one row at most for each row of the plan
    inside = split.join(edge, split["_source"].eqNullSafe(edge["_source"]) & (split["_size"] == edge["_size"]) & (split["_bucket"] == edge["_edge"])).select(split["_source"], split["_size"], split["_hash"], split["_tie"], "_of_edge")
    # The hash at which the edge's bucket is cut; rows with that very hash (copies of an id) are told apart by their text,
    # and of rows with the same text as well, _last out of _copies are taken.
    order = "over (partition by _source, _size order by _hash, _tie)"
    ranked = inside.withColumns({"_rank": F.expr(f"row_number() {order}"), "_last": F.expr(f"row_number() {order} - rank() {order} + 1"), "_copies": F.expr("count(*) over (partition by _source, _size, _hash, _tie)")})
    cut = written(ranked.where("_rank = _of_edge").select("_source", "_size", F.col("_hash").alias("_cut"), F.col("_tie").alias("_cut_tie"), "_last", "_copies"), "op1-cuts")
    cuts = F.broadcast(cut) if bounded else cut

    out = planned(base).withColumns({"_hash": h, "_bucket": bucket})
    out = out.join(edge.select(F.col("_source").alias("_es"), F.col("_size").alias("_ez"), "_edge"), F.col("_source").eqNullSafe(F.col("_es")) & (F.col("_size") == F.col("_ez")), "left")
    out = out.join(cuts.select(F.col("_source").alias("_cs"), F.col("_size").alias("_cz"), "_cut", "_cut_tie", "_last", "_copies"), F.col("_source").eqNullSafe(F.col("_cs")) & (F.col("_size") == F.col("_cz")), "left")
    at_edge = (F.col("_extra") > 0) & (F.col("_extra") < F.col("_count")) & (F.col("_bucket") == F.col("_edge"))
    tied = F.coalesce(at_edge & (F.col("_hash") == F.col("_cut")) & (F.col("_tie") == F.col("_cut_tie")) & (F.col("_last") < F.col("_copies")), F.lit(False))
    if cut.where("_last < _copies").isEmpty():
        out = out.withColumn("_number", F.lit(0))
    else:  # only rows that nothing tells apart are numbered
        number = F.row_number().over(Window.partitionBy("_source", "_size", "_hash", "_tie").orderBy("_id", *[f"_carry_{c}" for c in carry]))
        out = out.where(~tied).withColumn("_number", F.lit(0)).unionByName(out.where(tied).withColumn("_number", number))
    upto = (F.col("_hash") < F.col("_cut")) | ((F.col("_hash") == F.col("_cut")) & ((F.col("_tie") < F.col("_cut_tie")) | ((F.col("_tie") == F.col("_cut_tie")) & (F.col("_number") <= F.col("_last")))))
    once = F.when(F.col("_extra") >= F.col("_count"), True).when(F.col("_extra") <= 0, False).when(F.col("_bucket") < F.col("_edge"), True).when(F.col("_bucket") > F.col("_edge"), False).otherwise(upto)
    taken = F.col("_size") * (F.col("_passes") + F.when(F.coalesce(once, F.lit(False)), 1).otherwise(0))
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_source").alias("source"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.cast("long").alias("taken"), *[F.col(f"_carry_{c}").alias(c) for c in carry])
