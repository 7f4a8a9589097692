"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit for each component, set if it is above 0. Codes are cut into segments of 16 bits, each with a
table from its values to the codes. A search probes every segment at radius 0, 1, 2, ...: after radius s all codes within
SEGMENTS * (s + 1) - 1 bits have been seen, so it ends once the kth verified distance is covered.

Equal codes fall together first (each keeps its k + 1 least ids, the most that a result can name), so a vector that a
third of the rows share is one entry. Distinct codes are dealt into shards by hash; each shard builds its tables once and
reads the queries from the shared folder block by block, TOGETHER of them at a time. One shard searched first, with a task
for each block of queries, bounds every query's kth distance, so the others stop at it and return few rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, fresh_path, written

SEGMENT = 16
SHARD, QUERY_BLOCK, TOGETHER = 100_000, 4096, 64


def codes_of(vectors: pa.Array) -> np.ndarray:
    """(n, segments) uint16 codes of lists of floats. A null or missing component is not above 0."""
    counts = np.asarray(vectors.value_lengths().fill_null(0))
    width = max(SEGMENT, -(-int(counts.max(initial=0)) // SEGMENT) * SEGMENT)
    flat = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    bits = np.zeros((len(counts), width), bool)
    row = np.repeat(np.arange(len(counts)), counts)
    bits[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint16)


class MultiIndex:
    """Tables of one shard's distinct codes."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.segments = codes, codes.shape[1]
        self.order, self.starts = [], []
        for s in range(self.segments):
            order = np.argsort(codes[:, s], kind="stable").astype(np.int32)
            self.order.append(order)
            self.starts.append(np.searchsorted(codes[order, s], np.arange((1 << SEGMENT) + 1)).astype(np.int32))

    _masks: dict[int, np.ndarray] = {}

    @classmethod
    def masks(cls, radius: int) -> np.ndarray:
        if radius not in cls._masks:
            cls._masks[radius] = np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT), radius)], np.uint16)
        return cls._masks[radius]

    def search(self, codes: np.ndarray, times: np.ndarray, k: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of codes that hold the k nearest rows of each query (a code counts `times` rows), none beyond its bound.

        Queries are searched together: in each step the radius grows for those whose kth distance isn't covered yet.
        """
        n = len(self.codes)
        active, seen, distance = np.arange(len(codes)), np.zeros(0, np.int64), np.zeros(0, np.int64)
        limit = bounds.astype(np.int64).copy()
        for radius in range(SEGMENT + 1):
            keys = [np.zeros(0, np.int64)]
            for s in range(self.segments):
                probes = (codes[active, s][:, None] ^ self.masks(radius)[None, :]).astype(np.int64).reshape(-1)
                a = self.starts[s][probes]
                size = self.starts[s][probes + 1] - a
                hit = np.flatnonzero(size)
                a, size = a[hit], size[hit]
                rows = self.order[s][np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                keys.append(np.repeat(active[hit // len(self.masks(radius))], size).astype(np.int64) * n + rows)
            found = np.unique(np.concatenate(keys))
            at = np.searchsorted(seen, found)
            fresh = found[(at == len(seen)) | (seen[np.minimum(at, max(0, len(seen) - 1))] != found)] if len(seen) else found
            q, row = np.divmod(fresh, n)
            seen, distance = np.concatenate([seen, fresh]), np.concatenate([distance, np.bitwise_count(self.codes[row] ^ codes[q]).sum(1).astype(np.int64)])
            order = np.argsort(seen, kind="stable")
            seen, distance = seen[order], distance[order]
            # The kth distance of each query so far
            q, row = np.divmod(seen, n)
            order = np.lexsort((distance, q))
            total = np.cumsum(times[row[order]])
            first = np.searchsorted(q[order], np.arange(len(codes)))
            before = np.concatenate([[0], total])[first]
            enough = np.searchsorted(total, before + k)
            ends = np.searchsorted(q[order], np.arange(len(codes)), side="right")
            whole = enough < ends
            limit[whole] = np.minimum(limit[whole], distance[order][enough[whole]])
            active = active[self.segments * (radius + 1) - 1 < limit[active]]
            if not len(active):
                break
        q, row = np.divmod(seen, n)
        near = distance <= limit[q]
        return q[near], row[near], distance[near]


def _blocks(path: str) -> Iterator[pd.DataFrame]:
    """The written queries, a block at a time."""
    files, base = pafs.FileSystem.from_uri(path)
    for info in sorted(files.get_file_info(pafs.FileSelector(base, allow_not_found=True)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with pq.ParquetFile(files.open_input_file(info.path)) as f:
                for batch in f.iter_batches(QUERY_BLOCK):
                    yield batch.to_pandas()


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbour_id, distance): for each query row its k nearest other rows of `rows`, ties by id.

    A query's own id is left out of its result. Null ids and null vectors are neither queries nor neighbours; a query
    with fewer than k others has as many rows. A query id that repeats has one result, of its vector with the least code.
    Codes of unequal length are filled up with zeros. Other columns aren't read; empty tables give no rows.
    """
    spark = rows.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = codes_of(b.column(1))
            # trailing zero segments go, so vectors of any length compare
            raw = [c.tobytes().rstrip(b"\0") for c in codes]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["id", "code"])

    def coded(df: DataFrame) -> DataFrame:
        kept = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v")).where("id is not null and v is not null")
        return kept.mapInArrow(encode, "id long, code binary")

    with bounded_batches(spark, rows=10_000, mb=8):
        ids = written(coded(rows), "op10-codes")
    asked = coded(queries).groupBy("id").agg(F.min("code").alias("code"))
    # The k + 1 least ids of each code: first within salted parts, so that a hot code's rows are sorted by many tasks.
    part = ids.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    part = part.distinct().withColumn("_r", F.expr("row_number() over (partition by code, _salt order by id)")).where(f"_r <= {k + 1}")
    few = part.withColumn("_r", F.expr("row_number() over (partition by code order by id)")).where(f"_r <= {k + 1}")
    distinct = written(few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "op10-distinct")
    total, longest = distinct.agg(F.count(F.lit(1)), F.max(F.octet_length("code"))).first()
    segments = max(1, -(-(longest or 1) // 2))
    shards = max(1, -(-total // SHARD), min(spark.sparkContext.defaultParallelism, total // 2000))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int"))

    def wide(codes: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(c.ljust(2 * segments, b"\0")[: 2 * segments] for c in codes), np.uint16).reshape(len(codes), segments)

    def nearest(path: str, one_block: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            own = f"{path}/block={int(pdf['block'].iloc[0])}" if one_block else path
            pdf = pdf.sort_values("code", kind="stable", ignore_index=True)
            index, times = MultiIndex(wide(pdf["code"])), pdf["ids"].map(len).to_numpy()
            starts = np.cumsum(times) - times
            ids = np.concatenate([np.asarray(x, np.int64) for x in pdf["ids"]])
            out = []
            for block in _blocks(own):
                asked, codes, bounds = block["id"].to_numpy(), wide(block["code"]), block["bound"].to_numpy()
                for i in range(0, len(asked), TOGETHER):
                    q, row, d = index.search(codes[i : i + TOGETHER], times, k + 1, bounds[i : i + TOGETHER])
                    n = times[row]  # each code's rows
                    neighbour = ids[np.repeat(starts[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    query, d = asked[i : i + TOGETHER][np.repeat(q, n)], np.repeat(d, n)
                    other = np.flatnonzero(neighbour != query)
                    order = other[np.lexsort((neighbour[other], d[other], query[other]))]
                    rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
                    order = order[rank < k]
                    out.append(pd.DataFrame({"query_id": query[order], "neighbour_id": neighbour[order], "distance": d[order]}))
            return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "neighbour_id": [], "distance": []}, dtype="int64")

        return run

    shape = "query_id long, neighbour_id long, distance long"
    first, all_ = fresh_path(spark, "op10-queries"), fresh_path(spark, "op10-bounded")
    longest_bound = F.lit(SEGMENT * segments).cast("long").alias("bound")
    with bounded_batches(spark, rows=10_000, mb=8):
        asked = written(asked, "op10-asked")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK), min(spark.sparkContext.defaultParallelism, asked.count() // 16))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    asked.select("id", "code", longest_bound, block.alias("block")).repartition(blocks, "block").write.partitionBy("block").parquet(first)
    ranked = F.expr("row_number() over (partition by query_id order by distance, neighbour_id)")
    # The first shard's rows go to a task for each block of queries.
    spread = dealt.where("shard = 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = spread.groupBy("shard", "block").applyInPandas(nearest(first, True), shape)
    if shards > 1:
        sample = written(found, "op10-first")
        bounds = sample.withColumn("rank", ranked).where(f"rank = {k}").select(F.col("query_id").alias("id"), F.col("distance").alias("_kth"))
        spark.read.schema("id long, code binary, bound long, block int").parquet(first).join(bounds, "id", "left").select("id", "code", F.coalesce("_kth", "bound").alias("bound")).write.parquet(all_)
        found = sample.union(dealt.where("shard > 0").groupBy("shard").applyInPandas(nearest(all_, False), shape))
    return found.withColumn("rank", ranked.cast("long")).where(f"rank <= {k}").select("query_id", "rank", "neighbour_id", "distance")
