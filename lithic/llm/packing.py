"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, and a sequence costs its length, its attention (the square of the length) and an
overhead. Pieces go by falling size into the open bin that they fill best; where none has room, the bin is opened that
costs least for each token that it can get, which is looked up in what is left to pack. This is done for every run of
neighbouring lengths that can hold the pieces, each single length among them, and every bin shrinks to the least permitted length
that holds its contents; the cheapest of the packings stays, so no single length does better. Pieces are dealt out by
hash into shards of about SHARD pieces that are packed each by itself, so no task holds more and at most one unfilled
bin of each kind is left in a shard.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD, written

CAPACITIES = (512, 1024, 2048, 4096)
SHARD = 20_000
#: Tokens' worth of cost that every sequence has besides its length, and the length at which attention costs as much as
#: the rest of a model of width 2,048.
OVERHEAD, ATTENTION = 32.0, 12_288.0


def sequence_cost(capacity: int, overhead: float = OVERHEAD, attention: float = ATTENTION) -> float:
    return capacity + capacity * capacity / attention + overhead


def best_fit(sizes: np.ndarray, opens: tuple[int, ...], cost: Callable[[int], float], shrunk: Callable[[int], int]) -> tuple[np.ndarray, list[int]]:
    """Bin of each size and use of each bin, of bins that are opened at the lengths `opens`. shrunk: the length for a use."""
    bins, used, rooms = np.full(len(sizes), -1, np.int64), [], {}
    held = 0  # bit r is set if a bin with r tokens of room is open
    many = np.bincount(sizes).tolist() if len(sizes) else []
    left = sum(1 << z for z, n in enumerate(many) if n)  # bit z is set if a piece of z tokens is left

    def gets(size: int, capacity: int) -> int:
        """Tokens that a new bin with this piece can get from what is left, the largest fitting pieces first."""
        room = capacity - size
        fits = left & ((1 << (room + 1)) - 1)
        while fits:
            z = fits.bit_length() - 1
            room -= z * min(many[z], room // z)
            fits &= (1 << min(z, room + 1)) - 1
        return capacity - room

    for k in np.argsort(-np.asarray(sizes), kind="stable"):
        size = int(sizes[k])
        many[size] -= 1
        if not many[size]:
            left &= ~(1 << size)
        fits = held >> size
        if fits:
            room = size + ((fits & -fits).bit_length() - 1)
            b = rooms[room].pop()
            if not rooms[room]:
                held &= ~(1 << room)
        else:
            filled = [(gets(size, c), c) for c in opens if c >= size]
            room = min((cost(shrunk(n)) / n, c) for n, c in filled)[1]
            b = len(used)
            used.append(0)
        bins[k], used[b] = b, used[b] + size
        if room > size:
            rooms.setdefault(room - size, []).append(b)
            held |= 1 << (room - size)
    return bins, used


def pack_bins(sizes: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> tuple[np.ndarray, list[int], list[int]]:
    """Bin of each size, and capacity and use of each bin. Sizes are from 1 to the largest capacity."""
    capacities, largest = tuple(sorted(capacities)), int(np.max(sizes, initial=0))

    def shrunk(n: int) -> int:
        return next(c for c in capacities if c >= n)

    best = None
    for i in range(len(capacities)):
        for j in range(i, len(capacities)):
            if capacities[j] >= largest:
                bins, used = best_fit(sizes, capacities[i : j + 1], cost, shrunk)
                total = sum(cost(shrunk(n)) for n in used)
                if best is None or total < best[0]:
                    best = total, bins, used
    _, bins, used = best
    return bins, [shrunk(n) for n in used], used


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, attention: float = ATTENTION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (id, copy, piece, start, size, bin_id, bin_capacity, bin_used, bin_start).

    A document's size is its words; one above the largest capacity is cut into pieces of it and a rest, from `start`.
    bin_id names the bin, bin_start the piece's place in it. A document without words (or text) is one piece of size 0
    without a bin. Rows that repeat an id and a size are told apart by `copy`, from 0. Null ids are packed as others.
    Other columns aren't read; an empty table gives no rows.
    """
    largest, limits = max(capacities), tuple(sorted(capacities))
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    narrow = written(docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), size.alias("_size")), "op6-sizes")
    last = F.greatest(F.lit(0).cast("long"), F.expr(f"(_size - 1) div {largest}"))  # number of a document's last piece
    rows = narrow.groupBy("_id", "_size").agg(F.count(F.lit(1)).alias("_n"))
    pieces = rows.select("_id", "_size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_copy"))
    pieces = pieces.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_piece"))
    pieces = pieces.withColumn("_start", F.col("_piece") * largest).withColumn("_part", F.least(F.lit(largest), F.col("_size") - F.col("_start")).cast("long"))
    shards = max(1, -(-(narrow.agg(F.sum(last + 1)).first()[0] or 0) // SHARD))
    pieces = pieces.withColumn("_shard", F.pmod(F.xxhash64("_id", "_size", "_copy", "_piece"), F.lit(shards)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_part", "_id", "_copy", "_piece"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        full = pdf["_part"].to_numpy() > 0
        sizes = pdf["_part"].to_numpy()[full]
        bins, capacity, used = pack_bins(sizes, limits, lambda c: sequence_cost(c, overhead, attention))
        own = pd.Series(sizes).groupby(bins).cumsum().to_numpy() - sizes
        out = pd.DataFrame({"id": pdf["_id"], "copy": pdf["_copy"], "piece": pdf["_piece"], "start": pdf["_start"], "size": pdf["_part"]})
        for name, values in (("bin_id", (np.int64(pdf["_shard"].iloc[0]) << 32) + bins), ("bin_capacity", np.array(capacity, np.int64)[bins]), ("bin_used", np.array(used, np.int64)[bins]), ("bin_start", own)):
            column = pd.array([pd.NA] * len(pdf), "Int64")
            column[full] = values
            out[name] = column
        return out.rename(columns={"id": id_col})

    return pieces.groupBy("_shard").applyInPandas(run, f"`{id_col}` long, copy long, piece long, start long, size long, bin_id long, bin_capacity long, bin_used long, bin_start long")
