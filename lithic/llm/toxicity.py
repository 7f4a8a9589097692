"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams with word marks, its vector their mean, a text's vector the mean
of its words, and a linear softmax over two labels stands on top. Embeddings and softmax are fitted together, so a
misspelt or inflected word that no training text has still gets the vectors of the n-grams it shares with known ones.
The model is linear behind the averages, so scoring needs one number for each n-gram.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import bounded_batches, written
from .labelled import scored, training_sample

GRAMS, BUCKETS, DIM = (3, 4, 5), 1 << 17, 4
#: Steps of descent at least, so a small sample is gone over more often.
STEPS = 700
#: Bounds of the sample that the model is fitted on: rows labelled 0 and 1, and MB of text.
ROWS_PER_LABEL, SAMPLE_MB = (4500, 1500), 16


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of '<word>' for each word, and the number of the word that each belongs to (ascending)."""
    text = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), lengths)
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters to the word's end
    grams, owners = [], []
    for n in GRAMS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + codes[k : len(codes) - n + 1 + k]
        h ^= h >> np.uint64(29)
        h = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
        fits = room[: len(h)] >= n
        grams.append(h[fits].astype(np.int32))
        owners.append(word[: len(h)][fits])
    if not grams:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    gram, owner = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return gram[order], owner[order]


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-case words of a batch, the word of each token, and how many tokens each text has."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    flat = lists.flatten().dictionary_encode()
    return flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


class SubwordSoftmax:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.out, self.bias = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = 7, batch: int = 64, rate: float = 1.0, seed: int = 1) -> SubwordSoftmax:
        if not len(texts):
            return self
        known: dict[str, int] = {}
        pairs, lengths = [], []
        for at in range(0, len(texts), 256):  # blocks of texts, so only the counts of words are held for all
            found, token, n = words_of(pa.array(texts[at : at + 256], pa.string()))
            token = np.fromiter((known.setdefault(w, len(known)) for w in found), np.int32, len(found))[token]
            lengths.append(n)
            pairs += [np.unique(t, return_counts=True) for t in np.split(token, np.cumsum(n)[:-1])]
        pairs = [(w, c.astype(np.int32)) for w, c in pairs]
        counts, words = np.concatenate(lengths), list(known)
        del known, found, token
        grams, sizes = [], [np.zeros(1, np.int64)]
        for at in range(0, len(words), 20_000):  # blocks of words, as the n-grams of all at once would take much memory
            part, owner = word_grams(words[at : at + 20_000])
            grams.append(part)
            sizes.append(np.bincount(owner, minlength=len(words[at : at + 20_000])))
        gram, starts = np.concatenate(grams), np.cumsum(np.concatenate(sizes))
        del words, grams, sizes
        rng, params = np.random.default_rng(seed), [self.table, self.out, self.bias]
        seen = [np.full_like(p, 1e-6) for p in params]
        for _ in range(max(epochs, min(60, -(-STEPS // -(-len(texts) // batch))))):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                own = [i for i in order[at : at + batch] if counts[i]]
                if not own:
                    continue
                w = np.concatenate([pairs[i][0] for i in own])
                doc = np.repeat(np.arange(len(own)), [len(pairs[i][0]) for i in own])
                share = (np.concatenate([pairs[i][1] for i in own]) / counts[own][doc]).astype(np.float32)
                used, w = np.unique(w, return_inverse=True)
                n = starts[used + 1] - starts[used]
                first = np.cumsum(n) - n
                g = gram[np.repeat(starts[used] - first, n) + np.arange(n.sum())]
                vectors = np.add.reduceat(self.table[g], first) / n[:, None]
                d_first = np.searchsorted(doc, np.arange(len(own)))
                mean = np.add.reduceat(vectors[w] * share[:, None], d_first)
                z = mean @ self.out + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(own)), labels[own]] -= 1
                p /= len(own)
                up = (p @ self.out.T)[doc] * share[:, None]
                to_word = np.stack([np.bincount(w, up[:, k], len(used)) for k in range(DIM)], 1) / n[:, None]
                each = np.repeat(to_word, n, axis=0)
                grad = np.stack([np.bincount(g, each[:, k], BUCKETS) for k in range(DIM)], 1).astype(np.float32)
                for param, s, d in zip(params, seen, (grad, mean.T @ p, p.sum(0)), strict=True):
                    s += d * d
                    param -= (rate * d / np.sqrt(s)).astype(np.float32)
        return self

    def weights(self) -> tuple[np.ndarray, float]:
        """Of each n-gram, its share of the logit for label 1; and the bias."""
        return self.table @ (self.out[:, 1] - self.out[:, 0]), float(self.bias[1] - self.bias[0])


def probabilities(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    words, token, counts = words_of(texts)
    gram, owner = word_grams(words)
    n = np.bincount(owner, minlength=len(words))
    each = np.bincount(owner, weights[gram], len(words)) / np.maximum(n, 1)
    total = np.concatenate([[0.0], np.cumsum(each[token])])
    ends = np.cumsum(counts)
    return 1 / (1 + np.exp(-((total[ends] - total[ends - counts]) / np.maximum(counts, 1) + bias)))


def _fitted(docs: DataFrame, labels: DataFrame, label_col: str, rows_per_label: tuple[int, int], sample_mb: int) -> tuple[np.ndarray, float]:
    """Weights and bias; the memory that the fit took goes back to the system, as the driver lives on."""
    out = SubwordSoftmax().fit(*training_sample(docs, labels, label_col, rows_per_label, sample_mb)).weights()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    return out


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", threshold: float = 0.5, rows_per_label: tuple[int, int] = ROWS_PER_LABEL, sample_mb: int = SAMPLE_MB) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs`, scored from its whole text.

    Learns from a bounded sample of the labelled rows that aren't held out. A null text counts as empty; an empty
    text gets the model's bias alone, so equal texts always score alike. Without any label the scores are those
    of the untrained table. Other columns aren't read; an empty table gives no rows.
    """
    weights, bias = _fitted(docs, labels, label_col, rows_per_label, sample_mb)
    kept = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS floats, whatever the input
    return scored(docs, lambda t: probabilities(t, kept.value, bias), threshold)


def toxic_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """`docs` less the rows that score at `threshold` or more, written in one pass without a join. All columns are kept."""
    weights, bias = _fitted(docs, labels, "toxic", ROWS_PER_LABEL, SAMPLE_MB)
    kept, at = docs.sparkSession.sparkContext.broadcast(weights), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(probabilities(pc.fill_null(b.column(at), "").cast(pa.string()), kept.value, bias) < threshold))

    with bounded_batches(docs.sparkSession, rows=1024, mb=2):
        return written(docs.mapInArrow(run, docs.schema), "op3-kept")
