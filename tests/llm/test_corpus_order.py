"""Prefix-free parsing against sorted suffixes, and its bounds on repetitive text."""

import random
from collections import Counter

import numpy as np
import pytest

from lithic.llm import repeats as R


@pytest.mark.parametrize("phrase", [1, 3, 32])
@pytest.mark.parametrize("letters", ["a", "ab", "abcdefgh"])
def test_repeated_positions(monkeypatch, phrase, letters):
    monkeypatch.setattr(R, "PHRASE", phrase)
    rng = random.Random(len(letters) * 10 + phrase)
    length = 40
    stock = ["".join(rng.choice(letters) for _ in range(70)) for _ in range(6)]
    texts = [t.encode() for t in ("".join(rng.choice(stock)[rng.randint(0, 30) :] for _ in range(2)) for _ in range(40)) if len(t) >= length]
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    wanted = [seen[t[p : p + length]] > 1 for t in texts for p in range(len(t) - length + 1)]
    got = R.repeated_positions(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), length)
    assert got.tolist() == wanted


@pytest.mark.parametrize("least", [1, 600])
def test_ranks_are_the_suffix_array(least):
    rng = random.Random(5)
    words = [[least * rng.randint(1, 3) for _ in range(rng.randint(1, 30))] for _ in range(20)]
    symbols = np.array([s for w in words for s in [*w, 0]])
    suffixes = [w[k:] for w in words for k in range(len(w) + 1)]
    rank = R.Ranks(symbols, 31).rank
    order = {tuple(s): k for k, s in enumerate(sorted({tuple(s) for s in suffixes}))}
    assert np.unique(rank, return_inverse=True)[1].tolist() == [order[tuple(s)] for s in suffixes]


def test_places_are_progressions():
    at = np.array([5, 6, 7, 8, 20, 40, 1])
    row, step, n = R.places(np.array([0, 0, 0, 0, 0, 0, 1]), at)
    assert [(at[k], s, c) for k, s, c in zip(row, step, n, strict=True)] == [(5, 1, 3), (8, 0, 1), (20, 20, 2), (1, 0, 1)]
    assert sorted(int(at[k] + s * i) for k, s, c in zip(row, step, n, strict=True) for i in range(c)) == sorted(at.tolist())


def test_repetitive_texts_stay_small(spark):
    """A text of one byte goes in a few rows of places, and texts above a step go in pieces."""
    rows = [(1, "a" * 1_000_000), (2, "xyz" * 100_000 + "q"), (3, "hello" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_removed, r.n_spans, [(s.start, s.stop) for s in r.spans]) for r in R.remove_repeats(docs).collect()}
    assert got == {1: (1_000_000, 1, [(0, 1_000_000)]), 2: (300_000, 1, [(0, 300_000)]), 3: (1500, 1, [(0, 1500)])}


def test_more_fingerprints_than_a_table_serves(spark, monkeypatch):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = prose(120)
    rows = [(k, prose(30) + passage + prose(k)) for k in range(20)] + [(20, None), (21, prose(200))]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    by_table = sorted(tuple(r)[:5] for r in R.remove_repeats(docs).collect())
    monkeypatch.setattr(R, "LEAST_WORDS", 1)
    monkeypatch.setattr(R, "MOST_WORDS", 1)
    assert sorted(tuple(r)[:5] for r in R.remove_repeats(docs).collect()) == by_table
    assert any(r[2] for r in by_table)
