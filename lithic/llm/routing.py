"""Let rows that may match a large set of keys through, by a table of bits of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the table of bits, 64 bits each: a row for each key, so at most 64 million cells, some 16 MB, are broadcast.
#: Where there are more keys than that serves, nothing is broadcast and every row may match.
LEAST_WORDS, MOST_WORDS = 1 << 12, 1 << 20


def flagged(rows: DataFrame, column: str, keys: DataFrame, how: str, count: int | None = None) -> DataFrame:
    """`rows` with `_may`: whether `column` may be among `keys` (same name). how: left, or inner to leave most others out.

    count: how many keys there are, at most; counted if None.
    """
    count = keys.count() if count is None else count
    words = LEAST_WORDS
    while words < count and words < MOST_WORDS:
        words *= 2
    if count > words * 16:
        return rows.withColumn("_may", F.lit(True))
    h = F.xxhash64(F.col(column))
    word, bit = F.floor(F.pmod(h, F.lit(words * 64)) / 64).cast("long"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{column}`), 64) as int))")
    table = keys.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    return rows.withColumn("_word", word).join(F.broadcast(table), "_word", how).withColumn("_may", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")


def routed(rows: DataFrame, column: str, keys: DataFrame, count: int | None = None) -> DataFrame:
    """`rows` whose `column` may be among `keys` (same name); a few others pass by chance, none is lost.

    The rest never leaves its partition. The caller joins exactly afterwards.
    """
    return flagged(rows, column, keys, "inner", count).where("_may").drop("_may")


def without(rows: DataFrame, column: str, keys: DataFrame, count: int | None = None) -> DataFrame:
    """`rows` whose `column` isn't among `keys` (same name). Only rows that may be among them are shuffled; nulls stay."""
    marked = flagged(rows, column, keys, "left", count)
    unsure = marked.where("_may").drop("_may").join(keys.select(column).distinct(), column, "left_anti")
    return marked.where("not _may").drop("_may").unionByName(unsure)
