"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole document.

Bytes are embedded, a bank of learned filters slides over them, and each chunk of CHUNK bytes (chunks overlap by
half) is max-pooled: a chunk that repeats itself wakes few filters, odd marks wake their own. A hidden layer reads the
pooled chunk; the document is the maximum and the mean of its chunks' hidden units, combined into one probability.
Every byte of the text is covered, however long it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .labelled import scored, training_sample

EMBED, WIDTH, STRIDE, FILTERS, HIDDEN, HALF = 8, 8, 2, 32, 16, 64
CHUNK = 2 * HALF
#: Bounds of the sample that the model is fitted on: rows labelled 0 and 1, and MB of text.
ROWS_PER_LABEL, SAMPLE_MB = (1500, 2500), 16


def laid_out(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes + 1 of each text, after WIDTH zeros and filled up with zeros to whole half chunks (two at least), and how many each has.

    A filter that reaches beyond a text's last half chunk reads the zeros before the next text, and none reads further
    than that, so a text scores the same in any batch."""
    halves = np.maximum(2, -(-(lengths + WIDTH) // HALF))
    out = np.zeros(int(halves.sum()) * HALF + WIDTH, np.uint16)
    begins = (np.cumsum(halves) - halves) * HALF + WIDTH
    source = np.cumsum(lengths) - lengths
    out[np.repeat(begins - source, lengths) + np.arange(len(data))] = data.astype(np.uint16) + 1
    return out, halves


class ByteConvNet:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        f = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {
            "embed": f(257, EMBED, scale=0.5), "filters": f(WIDTH * EMBED, FILTERS, scale=0.15), "filter_bias": np.zeros(FILTERS, np.float32),
            "hidden": f(FILTERS, HIDDEN, scale=0.25), "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": f(2 * HIDDEN, scale=0.2), "bias": np.zeros(1, np.float32),
        }
        self.p["embed"][0] = 0

    def halves(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest answer of each filter in each half chunk, and where: filters start at every STRIDE-th byte."""
        n = (len(codes) - WIDTH) // HALF
        e = self.p["embed"][codes]
        step = WIDTH // STRIDE
        answers = np.empty((n * HALF // WIDTH, step, FILTERS), np.float32)
        for k in range(step):  # each phase is a view of the embedded bytes, so nothing is copied for the windows
            own = e[k * STRIDE : k * STRIDE + n * HALF].reshape(-1, WIDTH * EMBED)
            np.matmul(own, self.p["filters"], out=answers[:, k])
        per = answers.reshape(n, HALF // STRIDE, FILTERS)
        return per.max(1) + self.p["filter_bias"], per

    def documents(self, best: np.ndarray, halves: np.ndarray) -> dict[str, np.ndarray]:
        """From half chunks to logits. A document of h half chunks has h - 1 chunks."""
        first = np.cumsum(halves) - halves
        last = np.zeros(len(best), bool)
        last[first + halves - 1] = True
        left = np.flatnonzero(~last)
        a, b = best[left], best[left + 1]
        pooled = np.maximum(np.maximum(a, b), 0)
        hid = np.maximum(pooled @ self.p["hidden"] + self.p["hidden_bias"], 0)
        chunks = halves - 1
        begin = np.cumsum(chunks) - chunks
        most, mean = np.maximum.reduceat(hid, begin), np.add.reduceat(hid, begin) / chunks[:, None]
        doc = np.concatenate([most, mean], 1)
        return {"left": left, "right_wins": b > a, "pooled": pooled, "hid": hid, "begin": begin, "chunks": chunks, "most": most, "doc": doc, "z": doc @ self.p["out"] + self.p["bias"][0]}

    def probability(self, data: np.ndarray, lengths: np.ndarray, block: int = 1 << 20) -> np.ndarray:
        """Blocks of documents bound the memory; one long document goes by itself, in pieces of half chunks."""
        codes, halves = laid_out(data, lengths)
        n = int(halves.sum())
        step = block // HALF
        best = np.concatenate([self.halves(codes[i * HALF : min(n, i + step) * HALF + WIDTH])[0] for i in range(0, n, step)])
        return 1 / (1 + np.exp(-self.documents(best, halves)["z"].astype(float)))

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = 5, batch: int = 24, rate: float = 0.004, seed: int = 1) -> ByteConvNet:
        if not len(texts):
            return self
        raw = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
        rng, m, v, t = np.random.default_rng(seed), {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(raw))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                grad = self._gradients(*laid_out(np.concatenate([raw[i] for i in own]), np.array([len(raw[i]) for i in own])), labels[own])
                t += 1
                for k, g in grad.items():  # Adam
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= (rate * 0.6**epoch * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def _gradients(self, codes: np.ndarray, halves: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        best, per = self.halves(codes)
        x = self.documents(best, halves)
        dz = ((1 / (1 + np.exp(-x["z"])) - labels) / len(labels)).astype(np.float32)
        g = {"bias": dz.sum(keepdims=True), "out": x["doc"].T @ dz}
        d_doc = dz[:, None] * self.p["out"]
        of = np.repeat(np.arange(len(labels)), x["chunks"])
        d_most, d_mean = d_doc[:, :HIDDEN], d_doc[:, HIDDEN:]
        top = x["hid"] == x["most"][of]
        ties = np.add.reduceat(top.astype(np.float32), x["begin"])
        d_hid = (d_mean / x["chunks"][:, None])[of] + top * (d_most / ties)[of]
        d_hid = d_hid * (x["hid"] > 0)
        g |= {"hidden": x["pooled"].T @ d_hid, "hidden_bias": d_hid.sum(0)}
        d_pool = (d_hid @ self.p["hidden"].T) * (x["pooled"] > 0)
        d_best = np.zeros_like(best)
        d_best[x["left"]] += d_pool * ~x["right_wins"]
        d_best[x["left"] + 1] += d_pool * x["right_wins"]
        g["filter_bias"] = d_best.sum(0)
        where = per.argmax(1)  # the window of each half chunk that won for each filter
        start = np.arange(len(best))[:, None] * HALF + where * STRIDE
        d_filters, d_embed = np.zeros_like(self.p["filters"]), np.zeros((257, EMBED), np.float32)
        for j in range(WIDTH):
            code = codes[start + j]
            rows = slice(j * EMBED, (j + 1) * EMBED)
            d_filters[rows] = np.einsum("hfe,hf->ef", self.p["embed"][code], d_best, optimize=True)
            flat = code.reshape(-1)
            for k in range(EMBED):
                d_embed[:, k] += np.bincount(flat, (d_best * self.p["filters"][j * EMBED + k]).reshape(-1), 257)
        d_embed[0] = 0
        return g | {"filters": d_filters, "embed": d_embed}


def arrow_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array of strings without nulls, one text after another, and their lengths."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), np.diff(at)


def quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.3, rows_per_label: tuple[int, int] = ROWS_PER_LABEL, sample_mb: int = SAMPLE_MB) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs`, scored from all bytes of its text.

    Learns from a bounded sample of the labelled rows that aren't held out. A null text counts as empty; an empty
    text is a chunk of padding and scores as such. Without any label the scores are those of the untrained network.
    Other columns aren't read; an empty table gives no rows.
    """
    texts, y = training_sample(docs, labels, label_col, rows_per_label, sample_mb)
    net = docs.sparkSession.sparkContext.broadcast(ByteConvNet().fit(texts, y))  # a few thousand numbers

    def score(batch: pa.Array) -> np.ndarray:
        return net.value.probability(*arrow_bytes(batch)) if len(batch) else np.zeros(0)

    return scored(docs, score, threshold)
