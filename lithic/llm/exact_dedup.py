"""Exact dedup: counting quotient filters per partition, merged by sorted remainders, then byte verification.

1. Every partition packs the 64-bit fingerprints of its texts into counting quotient filters, one for each
   range of quotients: a fingerprint that occurs a million times takes one remainder and one counter.
2. The filters of a range meet in one task and merge by their sorted remainders. Nothing is lost or added by
   a merge, so a count above one is exact for the fingerprint. A range holds about half a partition's rows.
3. Texts whose fingerprint has such a count are grouped by their bytes. Spark aggregates within each partition
   first, so a text that a third of all rows share is shuffled once by each partition.
4. Documents get their class by fingerprint and digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, written
from .routing import routed

class CountingQuotientFilter:
    """A multiset of 64-bit fingerprints: quotient = the high bits, remainder = the rest.

    Remainders lie sorted in runs, one run for each quotient that occurs. `occupied` has a bit for each
    quotient of the range, `run_ends` a bit for each slot that ends a run, `counter` a bit for each slot that
    holds a count instead of a remainder: a fingerprint seen c > 1 times is its remainder and then c.
    """

    def __init__(self, quotient_bits: int, low: int, high: int, occupied: np.ndarray, run_ends: np.ndarray, counter: np.ndarray, slots: np.ndarray):
        self.quotient_bits, self.low, self.high = quotient_bits, low, high
        self.occupied, self.run_ends, self.counter, self.slots = occupied, run_ends, counter, slots

    @classmethod
    def of(cls, prints: np.ndarray, counts: np.ndarray, quotient_bits: int, low: int, high: int) -> CountingQuotientFilter:
        """From sorted distinct fingerprints whose quotients are in [low, high), with their counts."""
        shift = np.uint64(64 - quotient_bits)
        quotient = (prints >> shift).astype(np.int64) - low
        remainder = prints & np.uint64((1 << (64 - quotient_bits)) - 1)
        occupied = np.zeros(high - low, bool)
        occupied[quotient] = True
        many = counts > 1
        at = np.arange(len(prints)) + np.concatenate([[0], np.cumsum(many)[:-1]]) if len(prints) else np.zeros(0, np.int64)
        slots = np.zeros(len(prints) + int(many.sum()), np.uint64)
        counter, ends = np.zeros(len(slots), bool), np.zeros(len(slots), bool)
        slots[at] = remainder
        slots[at[many] + 1] = counts[many].astype(np.uint64)
        counter[at[many] + 1] = True
        last = np.ones(len(prints), bool)
        last[:-1] = quotient[1:] != quotient[:-1]
        ends[at[last] + many[last]] = True
        return cls(quotient_bits, low, high, occupied, ends, counter, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their counts."""
        quotients = np.flatnonzero(self.occupied) + self.low
        run = np.cumsum(self.run_ends) - self.run_ends
        holds = ~self.counter
        prints = (quotients[run[holds]].astype(np.uint64) << np.uint64(64 - self.quotient_bits)) | self.slots[holds]
        counts = np.ones(len(prints), np.int64)
        of = np.cumsum(holds) - 1
        counts[of[self.counter]] = self.slots[self.counter].astype(np.int64)
        return prints, counts

    def to_bytes(self) -> bytes:
        head = np.array([self.quotient_bits, self.low, self.high, len(self.slots)], np.int64)
        return head.tobytes() + np.packbits(self.occupied).tobytes() + np.packbits(self.run_ends).tobytes() + np.packbits(self.counter).tobytes() + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, low, high, n = (int(x) for x in np.frombuffer(data, np.int64, 4))
        at, parts = 32, []
        for size in (high - low, n, n):
            step = (size + 7) // 8
            parts.append(np.unpackbits(np.frombuffer(data, np.uint8, step, at), count=size).astype(bool))
            at += step
        return cls(bits, low, high, *parts, np.frombuffer(data[at:], np.uint64, n))

    def merged(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """The sum of both multisets: equal remainders of a quotient add their counts."""
        assert (self.quotient_bits, self.low, self.high) == (other.quotient_bits, other.low, other.high)
        (a, m), (b, n) = self.items(), other.items()
        prints, counts = counted(np.concatenate([a, b]), np.concatenate([m, n]))
        return CountingQuotientFilter.of(prints, counts, self.quotient_bits, self.low, self.high)


def counted(prints: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints with the sums of their counts."""
    order = np.argsort(prints, kind="stable")
    prints = prints[order]
    counts = np.ones(len(prints), np.int64) if counts is None else counts[order]
    first = np.ones(len(prints), bool)
    first[1:] = prints[1:] != prints[:-1]
    at = np.flatnonzero(first)
    return prints[first], np.add.reduceat(counts, at) if len(at) else counts


def repeated_fingerprints(prints: DataFrame, column: str = "fp", quotient_bits: int | None = None) -> DataFrame:
    """Fingerprints (long) that occur more than once in `prints`, as (fp, n), by merged counting quotient filters.

    Nulls are left out; an empty table gives no rows. `quotient_bits` (from the number of partitions if None)
    sets how many quotients there are; 16 quotients make a range that is merged by one task.
    """
    parts = max(1, prints.select(column).rdd.getNumPartitions())
    bits = quotient_bits or max(10, min(24, (64 * parts - 1).bit_length()))
    span = 16

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64)]
        for b in batches:
            held.append(b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        prints, counts = counted(np.concatenate(held))
        at = (prints >> np.uint64(64 - bits)).astype(np.int64) // span
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else []
        bounds = np.append(starts, len(at)).astype(int)
        rows = [(int(at[i]), CountingQuotientFilter.of(prints[i:j], counts[i:j], bits, int(at[i]) * span, int(at[i] + 1) * span).to_bytes()) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["range", "filter"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        filters = [CountingQuotientFilter.from_bytes(x) for x in pdf["filter"]]
        while len(filters) > 1:  # pairwise, so each remainder is copied a logarithmic number of times
            filters = [a.merged(b) for a, b in zip(filters[::2], filters[1::2], strict=False)] + (filters[-1:] if len(filters) % 2 else [])
        prints, counts = filters[0].items()
        many = counts > 1
        return pd.DataFrame({"fp": prints[many].view(np.int64), "n": counts[many]})

    return prints.select(F.col(column).cast("long")).mapInArrow(build, "range long, filter binary").groupBy("range").applyInPandas(merge, "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (id, keep_id, group_size long, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z only. Of equal texts the largest id stays. A null
    text counts as empty, and empty texts form one group. Null ids compare below all others; a group of null
    ids only has keep_id null and keeps its rows. Rows that repeat an id and a text are all returned, each
    kept if its id is keep_id. Other columns of `docs` are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    norm = ascii_lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), norm.alias("_norm")).withColumn("_fp", F.xxhash64("_norm"))

    dups = written(repeated_fingerprints(base, "_fp"), "op9-fingerprints")
    # Only texts that may have an equal leave their partition; a few do by chance, and the grouping is by bytes.
    alike = routed(base, "_fp", dups.select(F.col("fp").alias("_fp")))
    classes = (
        alike.groupBy("_fp", "_norm")
        .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("_fp", F.sha2("_norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    classes = written(classes, "op9-classes").withColumn("_found", F.lit(True))
    narrow = base.select("_id", "_fp", F.sha2("_norm", 256).alias("text_sha256"))
    keep = F.when(F.col("_found"), F.col("keep_id")).otherwise(F.col("_id"))
    return (
        narrow.join(classes, ["_fp", "text_sha256"], "left")
        .select(F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("_id").eqNullSafe(keep).alias("kept"), "text_sha256")
    )
