"""Removal of long repeated byte strings, by prefix-free parsing.

Equal strings of `length` bytes must meet, so the corpus order is cut into ranges by content: the trigger t(p) of a
position p is the least rolling hash among the `window` positions from p on (the last of equal ones). It lies in the
string and depends on nothing else, so equal strings have equal triggers and equal bytes from the trigger on.

1. Each trigger gives the fingerprint of the `length` - `window` + 1 bytes from it on, the part that every string of its
   positions holds. Fingerprints that occur once can't be in a repeated string: merged counting quotient filters find them.
2. The other triggers go on with their context, the bytes of all their strings. Equal contexts fall together with their
   count, whether they stem from copies of a text or from a passage of many texts, and equal contexts at a constant
   distance (as in a text of one repeated line) are one row. All strings of a context that occurs twice are repeated.
3. Different contexts of one fingerprint meet in one task, and are brought into corpus order by prefix-free parsing: a
   rolling hash cuts them into phrases that overlap by ROLL bytes, the suffix array of the dictionary of distinct phrases
   and the suffix array of the parse are made by prefix doubling, and a position's place is that of its phrase suffix,
   then that of the parse suffix behind it. A string is repeated if a neighbour in this order shares `length` bytes, which
   the ranks of both arrays tell without comparing bytes. A fingerprint of more than GROUP contexts is dealt out by its
   strings' hashes instead.
4. Repeated positions become spans of their texts, and each distinct text is cut once.

Matches never cross texts, so there is no order of the whole corpus to keep; order within a fingerprint is all that is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, fresh_path, text_or_empty, whole_groups, written
from .exact_dedup import repeated_fingerprints
from .quality import arrow_bytes
from .routing import flagged, routed

LENGTH, WINDOW, ROLL = 400, 128, 16
#: Contexts of one fingerprint that one task sorts, some 500 bytes each.
GROUP = 4096
#: Positions of text that one step of the parser holds in its arrays; longer texts go in several steps.
STEP = 1 << 17
#: A phrase begins where the hash of ROLL bytes is divisible by this.
PHRASE = 32
#: Words of the table of bits that routes triggers: 64 cells each, 16 cells for each fingerprint, so 64 MB at most. Where
#: there are more fingerprints than that serves, triggers are joined with them instead.
LEAST_WORDS, MOST_WORDS = 1 << 14, 1 << 23

_TABLE = np.random.default_rng(400).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    filled = 1
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * np.uint64(pow(base, filled, 1 << 64))
        filled += more
    return out


_UP, _DOWN = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Prefixes:
    """Hashes of any substring of `data` from one array of prefix sums."""

    def __init__(self, data: np.ndarray):
        global _UP, _DOWN
        if len(data) + 1 > len(_UP):
            _UP, _DOWN = _powers(_BASE, 2 * len(data) + 2), _powers(_INVERSE, 2 * len(data) + 2)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * _DOWN[: len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray | slice, length: int) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * _UP[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * _UP[:n])


def triggers(data: np.ndarray, lengths: np.ndarray, length: int = LENGTH, window: int = WINDOW) -> tuple[Prefixes, np.ndarray, np.ndarray, np.ndarray]:
    """Over texts laid one after another: the triggers, and the first and last position that each stands for.

    Positions are those where a string of `length` bytes starts within its text.
    """
    prefix = Prefixes(data)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return prefix, none, none, none
    roll = prefix.all(ROLL)
    key = (roll & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(roll), dtype=np.uint64))
    span = 1
    while span * 2 <= window:  # minima over 1, 2, 4, ... positions
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < window:
        key = np.minimum(key[: len(key) - (window - span)], key[window - span :])
    ends = np.cumsum(lengths)
    begins, room = ends - lengths, np.maximum(0, lengths - length + 1)
    p = np.repeat(begins - (np.cumsum(room) - room), room) + np.arange(int(room.sum()))
    t = (np.uint64(0xFFFFFFFF) - (key[p] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    fresh = np.ones(len(p), bool)
    fresh[1:] = (t[1:] != t[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(p))[: len(first)] - 1
    return prefix, t[first], p[first], p[last]


def steps(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of distinct texts of about STEP bytes: (numbers, bytes, lengths, places in their texts).

    A text of more than STEP positions goes in pieces that overlap by `length` - 1 bytes, so each position is in one step.
    """
    data, lengths = arrow_bytes(texts)
    begins = np.cumsum(lengths) - lengths
    pieces = np.maximum(1, -(-(lengths - length + 1) // STEP))
    number = np.repeat(np.arange(len(lengths)), pieces)
    at = (np.arange(len(number)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STEP
    size = np.minimum(lengths[number] - at, STEP + length - 1)
    i = 0
    while i < len(number):
        j = i + 1
        total = int(size[i])
        while j < len(number) and total + size[j] <= STEP and at[j] == 0:
            total += int(size[j])
            j += 1
        first = begins[number[i]] + at[i]
        yield number[i:j], data[first : first + total], size[i:j], at[i:j]
        i = j


def bit_table(path: str, words: int) -> np.ndarray:
    """The table of bits that was written to `path`."""
    files, base = pafs.FileSystem.from_uri(path)
    table = np.zeros(words, np.uint64)
    for info in files.get_file_info(pafs.FileSelector(base)):
        if info.path.endswith(".parquet"):
            t = pq.read_table(info.path, filesystem=files)
            table[t.column("word").to_numpy()] = t.column("bits").to_numpy().view(np.uint64)
    return table


_TABLES: dict[str, np.ndarray] = {}


def kept_bit_table(path: str, words: int) -> np.ndarray:
    if path not in _TABLES:
        _TABLES.clear()
        _TABLES[path] = bit_table(path, words)
    return _TABLES[path]


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Ranks:
    """Ranks of all suffixes of sequences laid one after another, by prefix doubling.

    symbols: numbers above 0, each sequence followed by one 0; a suffix ends at the 0 of its own sequence. A rank is the
    number of smaller suffixes, so that only those that still have equals are looked at again. levels holds (n, ranks by
    the first n symbols), from 7 on for bytes; the last ranks are those of whole suffixes, equal for equal ones.
    """

    def __init__(self, symbols: np.ndarray, most: int):
        at = np.arange(len(symbols))
        zeros = np.flatnonzero(symbols == 0)
        self.end = zeros[np.searchsorted(zeros, at)]  # the 0 that ends each position's sequence
        key, n = symbols.astype(np.uint64), 1
        if int(symbols.max(initial=0)) < 512:  # seven bytes and their marks fit a word
            for k in range(1, 7):
                key = (key << np.uint64(9)) | symbols[np.minimum(at + k, self.end)].astype(np.uint64)
            n = 7
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(symbols), np.int32)
        self.levels: list[tuple[int, np.ndarray]] = []
        active = self._split(rank, order, key[order], np.zeros(len(order), np.int32), n)
        while n < most and len(active):
            first = rank[active]
            pair = (first.astype(np.uint64) << np.uint64(32)) | rank[np.minimum(active + n, self.end[active])].astype(np.uint64)
            order = np.argsort(pair, kind="stable")
            rank, n = rank.copy(), 2 * n
            active = self._split(rank, active[order], pair[order], first[order], n)
        self.rank = rank

    def _split(self, rank: np.ndarray, at: np.ndarray, key: np.ndarray, before: np.ndarray, n: int) -> np.ndarray:
        """Give positions, sorted by key within classes that begin at `before`, their ranks; those that have equals and go on."""
        index = np.arange(len(at))
        own, old = np.ones(len(at), bool), np.ones(len(at), bool)
        own[1:], old[1:] = key[1:] != key[:-1], before[1:] != before[:-1]
        start = np.maximum.accumulate(np.where(own, index, 0))
        rank[at] = before + (start - np.maximum.accumulate(np.where(old, index, 0))).astype(np.int32)
        self.levels.append((n, rank))
        alone = own & np.append(own[1:], True)
        return np.sort(at[~alone & (at + n <= self.end[at])])

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n symbols from i and from j on are equal; both sequences go on for so many."""
        sizes = np.array([k for k, _ in self.levels])
        out = self.rank[i] == self.rank[j]
        todo = np.flatnonzero(~out)
        level = np.searchsorted(sizes, n[todo], side="right") - 1
        for k in np.unique(level):  # two overlapping runs of a power of two cover n symbols
            size, rank = self.levels[k]
            own = todo[level == k]
            a, b, m = i[own], j[own], n[own]
            equal = rank[a] == rank[b]
            at = np.minimum(size, m - size)
            while equal.any() and (at > 0).any():
                equal &= (at <= 0) | (rank[a + at] == rank[b + at])
                at = np.where(at >= m - size, 0, np.minimum(at + size, m - size))
            out[own] = equal
        return out


def repeated_positions(data: np.ndarray, lengths: np.ndarray, length: int) -> np.ndarray:
    """Of all strings of `length` bytes, which occur at another place, too: by prefix-free parsing.

    data holds the contexts one after another; the answers are for each context's lengths - length + 1 strings.
    """
    begins, n = np.cumsum(lengths) - lengths, lengths - length + 1
    text = np.repeat(np.arange(len(lengths)), lengths)
    # Phrases: from each start of a text or trigger to the end of the next trigger, or of the text.
    roll = Prefixes(data).all(ROLL) if len(data) >= ROLL else np.zeros(0, np.uint64)
    cut = np.flatnonzero(roll % np.uint64(PHRASE) == 0)
    cut = cut[(cut + ROLL <= (begins + lengths)[text[cut]]) & (cut > begins[text[cut]])]
    start = np.sort(np.concatenate([begins, cut]))
    of = text[start]
    last = np.ones(len(start), bool)
    last[:-1] = of[1:] != of[:-1]
    stop = np.where(last, (begins + lengths)[of], np.append(start[1:], 0) + ROLL)
    raw = data.tobytes()
    coded = pa.array([raw[a:b] for a, b in zip(start, stop, strict=True)], pa.binary()).dictionary_encode()
    phrase = coded.indices.to_numpy()
    size = (stop - start).astype(np.int64)
    # The dictionary, a 0 behind each phrase, and its suffix array
    words, width = arrow_bytes(coded.dictionary)
    dict_begin = np.cumsum(width + 1) - (width + 1)
    symbols = np.zeros(len(words) + len(width), np.int64)
    symbols[np.arange(len(words)) + np.repeat(np.arange(len(width)), width)] = words.astype(np.int64) + 1
    dictionary = Ranks(symbols, int(width.max()))
    # The parse, a 0 behind each text, and its suffix array; phrases by their order
    place = np.arange(len(start)) + of
    parse = np.zeros(len(start) + len(lengths), np.int64)
    parse[place] = dictionary.rank[dict_begin[phrase]] + 1
    tails = Ranks(parse, length)
    # Corpus order of the strings: phrase suffix, then the parse suffix behind it
    position = np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    at = np.searchsorted(start, position, side="right") - 1
    suffix = dict_begin[phrase[at]] + position - start[at]
    order = np.lexsort((tails.rank[place[at] + 1], dictionary.rank[suffix]))
    a, b = order[:-1], order[1:]
    # Neighbours that share `length` bytes: in the phrase suffix, or in it and the phrases behind it
    x, y, room = suffix[a], suffix[b], (stop[at] - position)
    need = np.minimum(room[a], room[b])
    same = dictionary.same(x, y, np.minimum(need, length)) & ((need >= length) | (dictionary.rank[x] == dictionary.rank[y]))
    todo = np.flatnonzero(same & (need < length))
    i, j, left = at[a[todo]] + 1, at[b[todo]] + 1, length - need[todo] + ROLL
    while len(todo):  # a phrase behind the next, until `length` bytes are covered
        have = np.minimum(size[i], size[j])
        equal = phrase[i] == phrase[j]
        covers = have >= left
        fine = equal.copy()
        other = np.flatnonzero(~equal & covers)
        fine[other] = dictionary.same(dict_begin[phrase[i[other]]], dict_begin[phrase[j[other]]], left[other])
        same[todo[~fine]] = False
        on = fine & ~covers
        left = (left - have + ROLL)[on]
        todo, i, j = todo[on], i[on] + 1, j[on] + 1
    out = np.zeros(len(position), bool)
    out[a[same]] = True
    out[b[same]] = True
    return out


def places(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of equal key at a constant distance as one row: (index of its first place, step, places)."""
    order = np.lexsort((at, key))
    same = key[order][1:] == key[order][:-1]
    step = np.where(same, at[order][1:] - at[order][:-1], 0)
    # A place begins a row unless the distances before and behind it are the same, or it is the last of its key.
    begins = np.ones(len(order), bool)
    begins[1:] = ~same
    begins[1:-1] |= (step[1:] != step[:-1]) & same[1:]
    first = np.flatnonzero(begins)
    count = np.diff(np.append(first, len(order)))
    return order[first], np.where(count > 1, np.append(step, 0)[first], 0), count


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept_text).

    Every byte covered by a string of `length` bytes that also starts anywhere else, in the same text or another, is
    removed; strings overlap freely and are judged on the input. spans: the maximal removed runs, as (start, stop) of
    bytes; kept_text: what is left, with a replacement character where a cut parts a character. A null text is empty.
    Rows that repeat a text count as places of their own. Other columns aren't read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    anchor = length - window + 1
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(text_col).alias("_text"))
    long_enough = base.where(F.octet_length("_text") >= length).select("_text")

    def distinct_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        coded = texts.dictionary_encode()
        return coded.dictionary, np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, times = distinct_texts(b.column(0))
            for number, data, lengths, _ in steps(texts, length):
                prefix, t, first, _ = triggers(data, lengths, length, window)
                often = times[number][np.searchsorted(np.cumsum(lengths), first, side="right")] > 1
                fp, n = np.unique(np.concatenate([h := prefix.hash(t, anchor), h[often]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, np.minimum(n, 2)).view(np.int64))], ["fp"])

    with bounded_batches(spark, rows=1024, mb=2):
        prints = written(repeated_fingerprints(long_enough.mapInArrow(fingerprints, "fp long"), "fp").select("fp"), "op4-fingerprints")
    words = LEAST_WORDS
    count = prints.count()
    while words * 4 < count and words < MOST_WORDS:
        words *= 2
    table_path = fresh_path(spark, "op4-bits")
    by_table = count <= words * 16
    if by_table:
        prints.groupBy(F.expr(f"pmod(fp, {words * 64}L) div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(fp, 64L) as int))")).alias("bits")).write.parquet(table_path)

    def found(batches: Iterator[pa.RecordBatch], joined: bool, contexts: bool) -> Iterator[pa.RecordBatch]:
        """Triggers that may be repeated: of the table of bits, or (joined) at the places in the batch's second column."""
        for b in batches:
            texts, times = distinct_texts(b.column(0))
            if joined:
                own_places = [np.array(x, np.int64) for x in b.column(1).to_pylist()]  # joined texts are distinct
            digests: dict[int, bytes] = {}
            for number, data, lengths, base_at in steps(texts, length):
                prefix, t, first, last = triggers(data, lengths, length, window)
                fp = prefix.hash(t, anchor)
                ends = np.cumsum(lengths)
                piece = np.searchsorted(ends, first, side="right")
                at = first - (ends - lengths)[piece] + base_at[piece]
                if joined:
                    on = np.zeros(len(t), bool)
                    for k in np.unique(number):
                        mine = number[piece] == k
                        on[mine] = np.isin(at[mine], own_places[k])
                    on = np.flatnonzero(on)
                elif contexts:
                    c = fp % np.uint64(words * 64)
                    on = np.flatnonzero((kept_bit_table(table_path, words)[(c >> np.uint64(6)).astype(np.int64)] >> (c & np.uint64(63))) & np.uint64(1))
                else:
                    on = np.arange(len(t))
                if not len(on):
                    continue
                whose, span = number[piece[on]], (last - first)[on]
                for k in np.unique(whose):
                    if int(k) not in digests:
                        digests[int(k)] = hashlib.md5(texts[int(k)].as_buffer()).digest()
                if not contexts:
                    yield pa.RecordBatch.from_arrays([pa.array(fp[on].view(np.int64)), pa.array([digests[int(k)] for k in whose], pa.binary()), pa.array(at[on])], ["fp", "text", "at"])
                    continue
                content = mixed(prefix.hash(first[on], span + length) + mixed(fp[on] + span.astype(np.uint64)))
                row, step, n = places(mixed(content + whose.astype(np.uint64)), at[on])
                # Bytes once for each context of the step
                _, lead, back = np.unique(content[row], return_index=True, return_inverse=True)
                raw = data.tobytes()
                parts = [raw[first[on][row[k]] : last[on][row[k]] + length] for k in lead]
                sums = [hashlib.md5(x).digest() for x in parts]
                once = np.full(len(row), -1)
                once[lead] = np.arange(len(lead))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp[on][row].view(np.int64)), pa.array([digests[int(k)] for k in whose[row]], pa.binary()), pa.array(at[on][row]), pa.array(step), pa.array(n), pa.array(n * times[whose[row]]), pa.array(span[row]), pa.array([sums[k] for k in back.reshape(-1)], pa.binary()), pa.array([parts[k] if k >= 0 else None for k in once], pa.binary())],
                    ["fp", "text", "at", "step", "n", "times", "span", "digest", "context"],
                )

    shape = "fp long, text binary, at long, step long, n long, times long, span long, digest binary, context binary"
    with bounded_batches(spark, rows=1024, mb=2):
        if by_table:
            items = written(long_enough.mapInArrow(lambda b: found(b, False, True), shape), "op4-contexts")
        else:  # too many for a table: each text gets the places of its repeated triggers by joins
            copies = long_enough.groupBy(F.unhex(F.md5("_text")).alias("text"), "_text").agg(F.count(F.lit(1)).alias("_copies"))
            copies = written(copies, "op4-texts")
            triggered = copies.select("_text").mapInArrow(lambda b: found(b, False, False), "fp long, text binary, at long")
            wanted = triggered.join(prints, "fp", "left_semi").groupBy("text").agg(F.collect_list("at").alias("ats"))
            items = copies.join(wanted, "text").select("_text", "ats").mapInArrow(lambda b: found(b, True, True), shape)
            items = written(items.join(copies.select("text", "_copies"), "text").withColumn("times", F.col("times") * F.col("_copies")).select("fp", "text", "at", "step", "n", "times", "span", "digest", "context"), "op4-contexts")
    narrow = written(items.groupBy("fp", "digest").agg(F.sum("times").alias("times"), F.first("span").alias("span")), "op4-digests")
    several = written(narrow.groupBy("fp").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "op4-sizes")
    sized = routed(items.where("context is not null").select("fp", "digest", "context"), "fp", several.select("fp")).dropDuplicates(["fp", "digest"]).join(several, "fp")

    def order_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by fingerprint; whole groups of it are brought into order together."""
        for t in whole_groups(batches, 1, rows=1024, mb=1):
            data, lengths = arrow_bytes(t.column(2).combine_chunks())
            n = lengths - length + 1
            context = np.repeat(np.arange(len(n)), n)
            hit = np.flatnonzero(repeated_positions(data, lengths, length))
            position = hit - (np.cumsum(n) - n)[context[hit]]
            own, begin = np.unique(context[hit], return_index=True)
            if len(own):
                rows = pa.array(own)
                yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks().take(rows), t.column(1).combine_chunks().take(rows), pa.array(np.minimum.reduceat(position, begin)), pa.array(np.maximum.reduceat(position, begin))], ["fp", "digest", "low", "high"])

    result = "fp long, digest binary, low long, high long"
    small = sized.where(F.col("size") <= GROUP).select("fp", "digest", "context").repartition("fp").sortWithinPartitions("fp").mapInArrow(order_groups, result)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                rows = b.slice(k, 512)
                data, lengths = arrow_bytes(rows.column(2))
                prefix, n = Prefixes(data), lengths - length + 1
                context = np.repeat(np.arange(len(n)), n)
                position = np.arange(len(context)) - np.repeat(np.cumsum(n) - n, n)
                take = pa.array(context)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take), pa.array(prefix.hash((np.cumsum(lengths) - lengths)[context] + position, length).view(np.int64)), pa.array(position)], ["fp", "digest", "string", "position"])

    each = sized.where(F.col("size") > GROUP).select("fp", "digest", "context").mapInArrow(strings, "fp long, digest binary, string long, position long")
    many = each.groupBy("fp", "string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp", "string")
    large = each.join(many, ["fp", "string"]).groupBy("fp", "digest").agg(F.min("position").alias("low"), F.max("position").alias("high"))

    twice = narrow.where("times > 1").select("fp", "digest", F.lit(0).cast("long").alias("low"), F.col("span").alias("high"))
    with bounded_batches(spark, rows=1024, mb=2):
        hits = written(twice.union(small).union(large).groupBy("fp", "digest").agg(F.min("low").alias("low"), F.max("high").alias("high")), "op4-hits")
    hit_places = items.select("fp", "digest", "text", "at", "step", "n").distinct().join(hits, ["fp", "digest"])
    run = F.struct((F.col("at") + F.col("low")).alias("a"), (F.col("at") + F.col("high") + length).alias("b"), "step", "n")
    spans = written(hit_places.groupBy("text").agg(F.collect_list(run).alias("runs")), "op4-spans")

    keyed = base.select("_id", "_text", F.unhex(F.md5("_text")).alias("text"))
    marked = flagged(keyed, "text", spans.select("text"), "left")
    texts = marked.where("_may").groupBy("text", "_text").agg(F.count(F.lit(1)).alias("_n"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, raw, runs in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                ranges = []
                for r in runs:
                    if r["step"] <= r["b"] - r["a"]:  # they touch
                        ranges.append((r["a"], r["b"] + r["step"] * (r["n"] - 1)))
                    else:
                        ranges += [(r["a"] + k * r["step"], r["b"] + k * r["step"]) for k in range(r["n"])]
                ranges, at, left = merged_spans(ranges), 0, []
                for x, y in ranges:
                    left.append(raw[at:x])
                    at = y
                rest = b"".join([*left, raw[at:]])
                out.append((key, sum(y - x for x, y in ranges), len(ranges), hashlib.sha256(rest).hexdigest(), [{"start": x, "stop": y} for x, y in ranges], rest.decode("utf-8", "replace")))
            if out:
                span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string(), span_type, pa.string()), strict=True)], ["text", "_removed", "_spans", "_sha", "_ranges", "_kept"])

    with bounded_batches(spark, rows=512, mb=2):
        done = written(texts.join(spans, "text").select("text", "_text", "runs").mapInArrow(cut, "text binary, _removed long, _spans long, _sha string, _ranges array<struct<start:long,stop:long>>, _kept string"), "op4-cut")
    bare = [F.lit(None).cast(done.schema[c].dataType).alias(c) for c in done.columns if c != "text"]
    rows = marked.where("_may").join(done, "text", "left").unionByName(marked.where("not _may").select("*", *bare))
    nothing, none = F.lit(0).cast("long"), F.array().cast(done.schema["_ranges"].dataType)
    return rows.select(
        F.col("_id").alias(id_col), F.octet_length("_text").cast("long").alias("n_bytes"), F.coalesce("_removed", nothing).alias("n_removed"), F.coalesce("_spans", nothing).alias("n_spans"),
        F.coalesce("_sha", F.sha2("_text", 256)).alias("kept_sha256"), F.coalesce("_ranges", none).alias("spans"), F.coalesce("_kept", "_text").alias("kept_text"),
    )
