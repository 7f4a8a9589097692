"""Token ids in fixed-width bit-packed files, and their vectorised readers.

A file holds whole documents, at most FILE_TOKENS ids unless one document alone has more:

    magic "LBP1" | uint32 bits, block | uint64 documents, ids, blocks | int64 document ids | uint8 id-is-null
    | uint32 ids of each document | uint64 byte offset of each block, and the end | blocks

A block packs `block` ids (a multiple of 64) of `bits` bits each into little-endian 64-bit words; the last one is
filled up with zeros. `bits` is the least that holds every id of the vocabulary, so id i starts at bit i * bits of
its block, and any range of ids can be unpacked from the blocks that hold it.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, fresh_path, text_or_empty, written

MAGIC, LANES = b"LBP1", 64
FILE_TOKENS, BLOCK = 4 << 20, 4096
#: Shards at most, and tasks at most that read the files back.
MOST_SHARDS, MOST_READERS = 20_000, 20_000
#: Pieces that a worker keeps encoded; beyond it they are encoded anew.
CACHE = 400_000


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """uint64 words: 64 ids fill `bits` words exactly. The last group is filled up with zeros."""
    lanes = np.zeros((-(-len(ids) // LANES), LANES), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(lanes), bits), np.uint64)
    for k in range(LANES):
        word, shift = divmod(k * bits, 64)
        words[:, word] |= lanes[:, k] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, k] >> np.uint64(64 - shift)
    return words.reshape(-1)


def unpack(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed words, as uint32."""
    words = words.reshape(-1, bits)
    lanes, mask = np.empty((len(words), LANES), np.uint32), np.uint64((1 << bits) - 1)
    for k in range(LANES):
        word, shift = divmod(k * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        lanes[:, k] = x & mask
    return lanes.reshape(-1)[:n]


def file_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    blocks = -(-len(ids) // block)
    words = pack(ids, bits)
    full = block // LANES * bits * 8
    offsets = np.minimum(np.arange(blocks + 1, dtype=np.uint64) * np.uint64(full), np.uint64(words.nbytes))
    head = MAGIC + np.array([bits, block], np.uint32).tobytes() + np.array([len(doc_ids), len(ids), blocks], np.uint64).tobytes()
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([head, np.array([d or 0 for d in doc_ids], np.int64).tobytes(), null.tobytes(), lengths.astype(np.uint32).tobytes(), offsets.tobytes(), words.astype("<u8").tobytes()])


class PackedFile:
    """A reader over the bytes of one file."""

    def __init__(self, data: bytes):
        assert data[:4] == MAGIC, "not a packed token file"
        self.bits, self.block = (int(x) for x in np.frombuffer(data, np.uint32, 2, 4))
        n, self.n_ids, blocks = (int(x) for x in np.frombuffer(data, np.uint64, 3, 12))
        at = 36
        ids, null = np.frombuffer(data, np.int64, n, at), np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null, strict=True)]
        self.lengths = np.frombuffer(data, np.uint32, n, at + 9 * n)
        self.offsets = np.frombuffer(data, np.uint64, blocks + 1, at + 13 * n)
        self.data, self.at = data, at + 13 * n + 8 * (blocks + 1)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids [start, stop) of the file: only the blocks that hold them are unpacked."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        a, b = int(self.offsets[first]), int(self.offsets[last + 1])
        words = np.frombuffer(self.data, "<u8", (b - a) // 8, self.at + a)
        return unpack(words, self.bits, len(words) // self.bits * LANES)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        start = int(self.lengths[:k].sum(dtype=np.int64))
        return self.ids(start, start + int(self.lengths[k]))


class Encoder:
    """Ids of whole texts by a `tokenizers` file, equal to its encode() of each text.

    A tokenizer that drops white space and looks at no more than one word at a time gives the same ids word by
    word, so each distinct word of a batch is encoded once and recent ones are kept. Where the file's normaliser or
    pre-tokenizer is of another kind, or a text holds the string of a special token's start, whole texts are encoded.
    """

    #: Plain words: letters of Latin-1, then other marks without an apostrophe, which starts pieces of its own.
    PLAIN = r"^(?P<head>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!#-&(-/:;=?@\[-`{-~]*)$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.full = Tokenizer.from_file(path)
        self.vocabulary = self.full.get_vocab_size(with_added_tokens=True)
        self.marks = sorted({t["content"][:2] for t in spec.get("added_tokens", [])})
        self.by_word = self._word_by_word(spec)
        self.bare = Tokenizer(self.full.model)
        self._clear()

    @staticmethod
    def _word_by_word(spec: dict) -> bool:
        norm = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        shape = [(p.get("type"), p.get("behavior"), p.get("invert"), p.get("add_prefix_space")) for p in pre]
        return (
            norm == ["NFC", "Replace", "Lowercase"]
            and shape == [("Split", "Removed", True, None), ("ByteLevel", None, None, False)]
            and pre[0]["pattern"]["Regex"] == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout") and not (spec.get("post_processor") or {})
        )

    def _clear(self) -> None:
        """Piece 0 is empty."""
        self.where: dict[str, int] = {"": 0}
        self.starts, self.lens, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _keep(self, pieces: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        self.where.update(zip(pieces, range(len(self.starts), len(self.starts) + len(pieces)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
        self.lens, self.flat = np.concatenate([self.lens, lens]), np.concatenate([self.flat, ids])

    def _pieces(self, strings: pa.Array, whole: bool) -> np.ndarray:
        """Numbers of the kept pieces. whole: of words that the whole tokenizer must see; else of lower-case pieces."""
        coded = strings.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        keys = ["\0" + w for w in distinct] if whole else distinct
        fresh = [k for k in keys if k not in self.where]
        if fresh and whole:
            out = [e.ids for e in self.full.encode_batch_fast([k[1:] for k in fresh], add_special_tokens=False)]
            self._keep(fresh, np.array([i for ids in out for i in ids], np.uint32), np.array([len(ids) for ids in out], np.int64))
        elif fresh:
            e = self.bare.encode_batch([[byte_level(p) for p in fresh]], is_pretokenized=True, add_special_tokens=False)[0]
            self._keep(fresh, np.array(e.ids, np.uint32), np.bincount(np.array(e.word_ids, np.int64), minlength=len(fresh)))
        at = np.fromiter((self.where[k] for k in keys), np.int64, len(keys))
        return at[coded.indices.to_numpy(zero_copy_only=False)] if len(keys) else np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (nulls: empty) one after another, and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = np.zeros(len(texts), bool) if self.by_word else np.ones(len(texts), bool)
        for m in self.marks if self.by_word else ():
            odd |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
        if odd.any():
            parts = [np.array(e.ids, np.uint32) for e in self.full.encode_batch_fast(texts.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)]
            if odd.all():
                return np.concatenate([*parts, np.zeros(0, np.uint32)]), np.array([len(p) for p in parts], np.int64)
            ids, n = self.encode(texts.filter(pa.array(~odd)))
            cuts = np.concatenate([[0], np.cumsum(n)])
            rest, own = iter([ids[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]), iter(parts)
            merged = [next(own) if o else next(rest) for o in odd]
            return np.concatenate(merged), np.array([len(p) for p in merged], np.int64)
        lists = pc.ascii_split_whitespace(texts)  # also gives empty strings at the ends, which have no ids
        words = lists.flatten().dictionary_encode()
        if len(self.where) > CACHE:
            self._clear()
        parts = pc.extract_regex(words.dictionary, self.PLAIN)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        heads, tails = np.zeros(len(plain), np.int64), np.zeros(len(plain), np.int64)
        kept = parts.drop_null()
        heads[plain] = self._pieces(pc.utf8_lower(kept.field("head")), False)
        tails[plain] = self._pieces(kept.field("tail"), False)
        heads[~plain] = self._pieces(words.dictionary.filter(pa.array(~plain)), True)
        index = words.indices.to_numpy(zero_copy_only=False)
        piece = np.column_stack([heads[index], tails[index]]).reshape(-1)
        each = self.lens[piece]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = self.flat[np.repeat(self.starts[piece] - ends[:-1], each) + np.arange(ends[-1])]
        before = ends[::2]
        cuts = before[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return ids, np.diff(cuts)


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """The worker's encoder of a file: later tasks in the same process find its pieces encoded."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _byte_table() -> dict[int, str]:
    """The visible character that a byte-level vocabulary writes for each byte: itself if visible, else from 256 up."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_TABLE = _byte_table()


def byte_level(piece: str) -> str:
    return piece if piece.isascii() else piece.encode().decode("latin-1").translate(_TABLE)


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = 20_000) -> DataFrame:
    """Encode whole texts, append `end_id`, and write packed files in ascending id order (null ids first).

    Ties of an id go by a hash of the text, then by their ids' bytes, so reruns write the same bytes, and an id that a
    third of all rows share is cut into shards like others. There are MOST_SHARDS at most; beyond that they get longer. Returns the manifest, one row per file:
    (shard, file, path, documents, ids, start), start = ids of all documents in earlier files. Nulls are
    empty texts (the end id alone). An empty table writes no file. Other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    rows = base.count()
    shards = max(1, min(MOST_SHARDS, -(-rows // shard_rows)))
    # Bounds of the shards by quantiles of the ids: one column is read, and no text is encoded for a sample. A bound that
    # stands several times is an id with rows for several shards, which are told apart by the hash.
    least = np.iinfo(np.int64).min
    known = F.coalesce("_id", F.lit(least))
    cuts = base.agg(F.percentile_approx(known, [i / shards for i in range(1, shards)], 20 * shards)).first()[0] if shards > 1 else []
    bounds = np.array(sorted(cuts or []), np.int64)
    base = base.withColumn("_tie", F.xxhash64("_text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer_path)
        for b in batches:
            ids, n = encoder.encode(b.column(1))
            ends = np.cumsum(n + 1)
            out = np.full(int(ends[-1]) if len(n) else 0, end_id, np.uint32)
            hold = np.ones(len(out), bool)
            hold[ends - 1] = False
            out[hold] = ids
            # ids of the vocabulary below 65,536 travel as 16 bits
            data, width = (out.astype("<u2"), 2) if max(encoder.vocabulary, end_id + 1) <= 1 << 16 else (out.astype("<u4"), 4)
            offsets = np.concatenate([[0], ends * width]).astype(np.int32)
            key, tie = pc.fill_null(b.column(0), least).to_numpy(), b.column(2).to_numpy()
            shard = np.searchsorted(bounds, key, side="left")
            many = np.maximum(1, np.searchsorted(bounds, key, side="right") - shard)
            share = (tie.astype(np.float64) + 2.0**63) / 2.0**64
            shard = shard + np.minimum(many - 1, np.floor(share * many).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), b.column(0), b.column(2), pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)])], ["shard", "id", "tie", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = max(encoder_for(tokenizer_path).vocabulary, end_id + 1)
        bits, width = (vocabulary - 1).bit_length(), "<u2" if vocabulary <= 1 << 16 else "<u4"
        files, base_path = pafs.FileSystem.from_uri(folder)
        held: list[tuple[int | None, np.ndarray]] = []
        state = {"shard": None, "file": 0, "held": 0}

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                lengths, ids = np.array([len(x) for _, x in held], np.int64), np.concatenate([x for _, x in held])
                name = f"tokens-{state['shard']:07d}-{state['file']:05d}.lbp"
                own = f"{base_path}/_tmp/{name}.{uuid.uuid4().hex}"  # a retried task writes the same bytes, then renames
                files.create_dir(f"{base_path}/_tmp", recursive=True)
                with files.open_output_stream(own) as out:
                    out.write(file_bytes([d for d, _ in held], lengths, ids, bits))
                files.move(own, f"{base_path}/{name}")
                yield pa.RecordBatch.from_pydict({"shard": [state["shard"]], "file": [state["file"]], "path": [f"{folder}/{name}"], "documents": [len(held)], "ids": [len(ids)]}, pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))
                held.clear()
                state.update(file=state["file"] + 1, held=0)

        for b in batches:
            for shard, doc, data in zip(*(b.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                ids = np.frombuffer(data, width)
                if shard != state["shard"] or state["held"] + len(ids) > FILE_TOKENS:
                    yield from flush()
                    if shard != state["shard"]:
                        state.update(shard=shard, file=0)
                held.append((doc, ids))
                state["held"] += len(ids)
        yield from flush()

    encoded = base.mapInArrow(encode, "shard int, id long, tie long, ids binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "id", "tie", "ids")
    manifest_path = fresh_path(spark, "op5-manifest")
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)  # an empty table writes no file, but can be read
    with bounded_batches(spark, rows=1024, mb=4):
        encoded.mapInArrow(write, "shard int, file int, path string, documents long, ids long").write.parquet(manifest_path)
    manifest = spark.read.parquet(manifest_path)
    # One number for each shard comes to the driver, no more than the job has tasks.
    totals = {r["shard"]: r["n"] for r in manifest.groupBy("shard").agg(F.sum("ids").alias("n")).collect()}
    before, run = [], 0
    for s in sorted(totals):
        before.append((s, run))
        run += totals[s]
    offsets = spark.createDataFrame(before, "shard int, _before long")
    return manifest.join(F.broadcast(offsets), "shard").withColumn("start", F.expr("_before + coalesce(sum(ids) over (partition by shard order by file rows between unbounded preceding and 1 preceding), 0)")).drop("_before")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents of the written files: (doc_id, start, n_tokens, ids_crc32), from the files' own bytes."""
    spark = manifest.sparkSession

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base_path = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for start, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with files.open_input_file(f"{base_path}/{name}") as f:
                    file = PackedFile(f.read())
                ids = file.ids().astype("<u4")
                ends = np.cumsum(file.lengths, dtype=np.int64)
                begins = ends - file.lengths
                crcs = [zlib.crc32(ids[i:j]) for i, j in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, pa.int64()), pa.array(begins + start), pa.array(file.lengths.astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One short row for each file is dealt out; workers open the files themselves, one at a time.
    rows = manifest.select("start", F.element_at(F.split("path", "/"), -1).alias("_name"))
    parts = max(1, min(rows.count(), MOST_READERS))
    with bounded_batches(spark, rows=64):
        return written(rows.repartition(parts).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long"), "op5-read")


def token_output(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Write the packed files of `docs` and read them back: (doc_id, start, n_tokens, ids_crc32)."""
    folder = folder or fresh_path(docs.sparkSession, "op5-tokens")
    return read_tokens(write_tokens(docs, tokenizer_path, folder), folder)
