"""MinHash near-dedup with b-bit signatures.

1. Each text becomes the set of its hashed word shingles; equal sets fall together by a 128-bit digest of the set, so
   a group of copies goes on as one node. A node keeps HASHES minima: whole ones make BANDS band keys, and the low
   BITS bits of each are packed into the signature.
2. Nodes that share a band key are candidates. Buckets of the same nodes fall together (copies meet in most bands).
   Within a bucket the bit counts of two signatures' difference give the similarity, corrected for chance collisions of
   BITS bits; a breadth-first search over the implicit graph of pairs near enough (the threshold less MARGIN standard
   errors) gives a spanning forest, never the pairs themselves. Many buckets are searched at once, a node of each in a
   step. Buckets above BLOCK nodes are dealt out as pairs of blocks, so no task need hold more than two and none is left out.
3. The forests' components hold every pair that may be linked. Their members' full sets are fetched, and the same
   search on exact intersections confirms the links. Components above MEMBERS nodes or BLOCK_SHINGLES go as pairs of
   blocks, too.

A pair at the threshold shares no band with a chance of (1 - s^ROWS)^BANDS: 6e-11 at 0.85, 5e-8 at 0.8. Its estimate falls
below the margin with one of 5e-10 or 3e-10. Together: 6e-10 at 0.85, 5e-8 at 0.8.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, fixed, text_or_empty, whole_groups, written
from .graph import components
from .routing import routed

HASHES, BITS, ROWS = 128, 4, 4
BANDS = HASHES // ROWS
MARGIN = 7.0
BLOCK, MEMBERS, BLOCK_SHINGLES = 2048, 256, 1 << 20
_MIX = np.random.default_rng(20240229).integers(1, 1 << 63, HASHES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(20240301).integers(1, 1 << 63, HASHES, dtype=np.int64).astype(np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, one text after another, and how many each has.

    Words are runs of other than ASCII white space, A-Z in lower case. A text of fewer than `width` words has one
    shingle, the whole of it; a text without words has none.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.string()))))
    flat = lists.flatten().dictionary_encode()
    word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
    token = word[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
    offsets = lists.offsets.to_numpy().astype(np.int64) - (lists.offsets[0].as_py() if len(lists) else 0)
    n = np.diff(offsets)
    blank = (n == 1) & (np.asarray(pc.list_value_length(lists)) == 1)
    if blank.any():  # an empty text splits into one empty word
        empty = xxhash.xxh3_64_intdigest("")
        n[blank] = np.where(token[offsets[:-1][blank]] == np.uint64(empty), 0, 1)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    at = offsets[:-1][doc] + np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    last = np.minimum(at + width, offsets[:-1][doc] + n[doc])
    h = np.full(len(doc), 0x243F6A8885A308D3, np.uint64) + (last - at).astype(np.uint64)
    for k in range(width):
        h = np.where(at + k < last, _mixed(h * np.uint64(0xD6E8FEB86659FD93) + token[np.minimum(at + k, max(0, len(token) - 1))]), h) if len(token) else h
    order = np.lexsort((h, doc))
    h = h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[fresh], np.bincount(doc[fresh], minlength=len(n))


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, HASHES) uint32: the minima of each set under each hash function. Sets aren't empty."""
    out = np.empty((len(starts), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((hashes * _MIX[k] + _ADD[k]) >> np.uint64(32), starts)
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """Signatures: BITS low bits of each minimum, in uint64 words."""
    per = 64 // BITS
    lanes = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(low), HASHES // per, per)
    return np.bitwise_or.reduce(lanes << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2)


_LANE = np.uint64(sum(1 << (BITS * k) for k in range(64 // BITS)))


def estimated(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures, row by row: bit counts of the difference, less chance collisions."""
    x = one ^ other
    for step in [1 << k for k in range(BITS.bit_length() - 1)][::-1]:
        x = x | (x >> np.uint64(step))
    same = 1 - np.bitwise_count(x & _LANE).sum(1) / HASHES
    chance = 2.0**-BITS
    return (same - chance) / (1 - chance)


def forests(bucket: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges of spanning forests of implicit graphs, one for each run of equal values in `bucket`.

    near(i, j) tells which nodes i and j, pairs of one bucket, are neighbours. In each step one node of each bucket that
    has unreached nodes left is compared with those, so a dense group costs few steps and no pair is looked at twice.
    """
    row, reached = np.arange(len(bucket)), np.zeros(len(bucket), bool)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    while len(row):
        change = np.ones(len(row), bool)
        change[1:] = bucket[row[1:]] != bucket[row[:-1]]
        start, of = np.flatnonzero(change), np.cumsum(change) - 1
        first = np.where(reached[row], row, row + len(bucket))  # reached nodes go first, else a new tree begins
        chosen = np.minimum.reduceat(first, start) % len(bucket)
        open_ = ~reached[row] & (row != chosen[of])
        i, j = chosen[of][open_], row[open_]
        hit = near(i, j) if len(i) else np.zeros(0, bool)
        out.append((i[hit], j[hit]))
        reached[j[hit]] = True
        keep = row != chosen[of]
        row, of = row[keep], of[keep]
        unreached = np.bincount(of[~reached[row]], minlength=len(start)) > 0
        row = row[unreached[of]]
    a, b = zip(*out, strict=True) if out else ((), ())
    return np.concatenate([*a, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*b, np.zeros(0, np.int64)]).astype(np.int64)


def runs(*columns: np.ndarray) -> np.ndarray:
    """The number of each row's run of equal rows."""
    change = np.zeros(len(columns[0]), bool)
    for c in columns:
        change[1:] |= (c[1:] != c[:-1]) if c.ndim == 1 else (c[1:] != c[:-1]).any(1)
    return np.cumsum(change)


def linked_sets(bucket: np.ndarray, sizes: np.ndarray, items: np.ndarray, least_part: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """near() for forests(): whether 10,000 * intersection >= least_part * union. items: the sets one after another."""
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(bucket, sizes)
    order = np.lexsort((items, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (items[order][1:] != items[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    code = np.empty(len(order), np.int64)  # equal items of one bucket have one code
    code[order] = np.cumsum(fresh) - 1
    flag = np.zeros(int(fresh.sum()), bool)

    def members(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.cumsum(sizes[rows]) - sizes[rows]
        return code[np.repeat(starts[rows] - first, sizes[rows]) + np.arange(sizes[rows].sum())], first

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        may = np.flatnonzero(10_000 * np.minimum(sizes[i], sizes[j]) >= least_part * np.maximum(sizes[i], sizes[j]))
        if len(may):
            own, _ = members(np.unique(i[may]))
            flag[own] = True
            held, first = members(j[may])
            both = np.add.reduceat(flag[held].astype(np.int64), first)
            flag[own] = False
            out[may] = 10_000 * both >= least_part * (sizes[i[may]] + sizes[j[may]] - both)
        return out

    return near


def near_dedup(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", digest_col: str | None = None) -> DataFrame:
    """One row per row of `docs`: (id, n_shingles, component_id, kept).

    Rows are linked if their shingle sets' intersection is at least `threshold` of their union. component_id is the
    least id that a row reaches over links, kept whether it is the row's own. Texts without words and rows with a
    null id are linked with nothing; a null id has component_id null and stays. Rows that repeat an id and a text are
    all returned. Other columns aren't read; an empty table gives no rows. digest_col: a further column, the text's SHA-256.
    """
    spark = docs.sparkSession
    least_part = round(threshold * 10_000)
    enough = threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / HASHES * 16 / 15)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), text_or_empty(text_col).alias("_text"), *([F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("_digest")] if digest_col else []))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, counts = shingle_sets(b.column(1), width)
            ends = np.cumsum(counts)
            raw = memoryview(hashes.tobytes())
            nodes = [xxhash.xxh3_128_digest(raw[8 * (e - n) : 8 * e]) if n else None for e, n in zip(ends, counts, strict=True)]
            full = counts > 0
            lows = minima(hashes, (ends - counts)[full])
            sign = iter(packed(lows).view(np.uint8).reshape(len(lows), HASHES * BITS // 8))
            bands = np.zeros((len(lows), BANDS), np.uint64)
            for k in range(ROWS):
                bands = _mixed(bands * np.uint64(0xD6E8FEB86659FD93) + lows[:, k::ROWS])
            keys = iter(_mixed(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array([next(sign).tobytes() if f else None for f in full], pa.binary()), pa.array([next(keys) if f else None for f in full], pa.list_(pa.int64())), *b.columns[2:]], ["_id", "n", "node", "sig", "keys", *b.schema.names[2:]])

    with bounded_batches(spark, rows=512, mb=2):
        signed = written(base.mapInArrow(sign, "_id long, n long, node binary, sig binary, keys array<long>" + (", _digest binary" if digest_col else "")), "op2-signatures")
    nodes = signed.where("node is not null and _id is not null")
    # Copies collapse here: one row for each distinct set, aggregated within the partitions first.
    classes = written(nodes.groupBy("node").agg(F.min("_id").alias("least"), F.first("sig").alias("sig"), F.first("keys").alias("keys")), "op2-classes")

    keyed = classes.select("node", F.explode("keys").alias("key"))
    same = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *same).where("size > 1")
    once = shared.groupBy("size", "x1", "x2").agg(F.min("key").alias("key"))  # one of the buckets that hold the same nodes
    members = written(keyed.join(once, "key").select("key", "node", "size"), "op2-members")
    dealt = blocks(members, "key", F.col("size"), BLOCK, "node").join(classes.select("node", "sig"), "node").select("key", "pair", "node", "sig")

    def near_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 2):
            sig = fixed(t.column(3), np.uint64, HASHES * BITS // 64)
            a, b = forests(runs(t.column(0).to_numpy(), t.column(1).to_numpy()), lambda i, j: estimated(sig[i], sig[j]) >= enough)  # noqa: B023
            yield pa.RecordBatch.from_arrays([t.column(2).combine_chunks().take(pa.array(x)) for x in (a, b)], ["a", "b"])

    with bounded_batches(spark, rows=8192, mb=4):
        likely = components(dealt.repartition("key", "pair").sortWithinPartitions("key", "pair", "node").mapInArrow(near_forest, "a binary, b binary"))
    likely = written(likely, "op2-likely")

    # Full sets of the members of likely components only, made anew from their texts.
    wanted = classes.select("node", "least").join(likely, "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, counts = shingle_sets(b.column(1), width)
            ends, raw = np.cumsum(counts), hashes.tobytes()
            parts = [raw[8 * (e - n) : 8 * e] for e, n in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh3_128_digest(p) for p in parts], pa.binary()), pa.array(parts, pa.binary())], ["least", "node", "set"])

    texts = routed(base.where("_id is not null"), "_id", wanted.select(F.col("least").alias("_id")), likely.count())
    found = texts.mapInArrow(sets, "least long, node binary, set binary").dropDuplicates(["least", "node"])
    with bounded_batches(spark, rows=512, mb=4):
        full = written(found.join(wanted, ["least", "node"]).select("root", "node", "set"), "op2-sets")
    weight = full.groupBy("root").agg(F.sum(F.octet_length("set") / 8).alias("shingles"), F.count(F.lit(1)).alias("nodes"))
    # As many nodes to a block as keep it at BLOCK_SHINGLES on average
    per = F.least(F.lit(MEMBERS), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_SHINGLES) * F.col("nodes") / F.col("shingles"))))
    sized = full.join(weight.select("root", "nodes", per.alias("per")), "root")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 2):
            bucket = runs(fixed(t.column(0), np.uint64, 2), t.column(1).to_numpy())
            sets = t.column(3).combine_chunks()
            sizes = pc.binary_length(sets).to_numpy().astype(np.int64) // 8
            items = np.frombuffer(b"".join(sets.to_pylist()), np.uint64)
            a, b = forests(bucket, linked_sets(bucket, sizes, items, least_part))
            yield pa.RecordBatch.from_arrays([t.column(2).combine_chunks().take(pa.array(x)) for x in (a, b)], ["a", "b"])

    dealt = blocks(sized, "root", F.col("nodes"), F.col("per"), "node", "set")
    with bounded_batches(spark, rows=2048, mb=4):
        links = components(dealt.repartition("root", "pair").sortWithinPartitions("root", "pair", "node").mapInArrow(confirm, "a binary, b binary"))
    known = classes.select("node", "least").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = known.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = written(known.join(first, "root").select("node", "component_id"), "op2-components")
    digest = ["_digest"] if digest_col else []
    out = signed.select("_id", "n", *digest, F.when(F.col("_id").isNotNull(), F.col("node")).alias("node")).join(labels, "node", "left")
    component = F.coalesce("component_id", "_id")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"), *[F.col(c).alias(digest_col) for c in digest])


def blocks(rows: DataFrame, group: str, size, most, node: str, *carry: str) -> DataFrame:
    """Deal each group's rows out as pairs of blocks of about `most` rows: (group, pair, node, carry...).

    A group of one block is one task; of k blocks, k (k - 1) / 2 tasks that hold each pair of blocks once, so any two
    rows of the group meet, and no task gets more than two blocks.
    """
    count = F.ceil(size / most).cast("int")
    mine = F.pmod(F.xxhash64(node, F.lit(3)), count).cast("int")
    dealt = rows.withColumns({"_k": count}).withColumn("_b", mine)
    others = F.when(F.col("_k") <= 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("_k") - 1), lambda x: x != F.col("_b")))
    spread = dealt.withColumn("_o", F.explode(others))
    pair = F.least("_b", "_o").cast("long") * F.lit(1 << 24) + F.greatest("_b", "_o")
    return spread.select(group, pair.alias("pair"), node, *carry)
