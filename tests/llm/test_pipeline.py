"""Pipeline stages against plain recomputations on a small fixture (toxicity is tested by held-out accuracy)."""

from collections import Counter

import corpus_pipeline as C
from lithic.llm.mixing import cycle_weights, targets


def words(t):
    return len((t or "").split())


def test_stages_after_toxicity(spark, make_docs, tmp_path):
    base = " ".join(f"w{k}" for k in range(40))
    rows = [(1, base, "a"), (2, base.upper(), "b"), (2, base.upper(), "b"), (3, base.replace("w39", "x"), "a"), (4, " ".join(f"v{k}" for k in range(30)), "b"), (5, None, "b"), (6, "", "a"), (7, "five more words than three", None), (8, "short one", "a")]
    docs = make_docs(rows).select(C.COLUMNS)

    exact = C.exact_filter(docs)
    assert exact.columns == C.COLUMNS
    assert sorted(r.doc_id for r in exact.collect()) == [2, 3, 4, 6, 7, 8]  # the larger id of equal texts, repeats once

    near = dict(C.STAGES)["near-dedup"](spark, exact, "")
    left = sorted(r.doc_id for r in near.collect())
    assert left == [2, 4, 6, 7, 8]  # 35 of 37 shingles in common

    mixed = dict(C.STAGES)["mixing"](spark, near, "")
    assert mixed.columns == C.COLUMNS
    sizes = Counter()
    for r in near.collect():
        sizes[r.source] += words(r.text)
    goal = targets(dict(sizes), cycle_weights(list(sizes)), sum(sizes.values()))
    took = Counter()
    for r in mixed.collect():
        took[r.source] += words(r.text)
    longest = {s: max(words(r.text) for r in near.collect() if r.source == s) for s in sizes}
    assert all(abs(took[s] - goal[s]) <= longest[s] for s in sizes)
    assert all(n <= 3 for n in Counter(r.doc_id for r in mixed.collect()).values())

    packed = dict(C.STAGES)["packing"](spark, mixed, "").collect()
    assert sum(r.size for r in packed) == sum(took.values())
    assert all(r.bin_used <= r.bin_capacity for r in packed if r.bin_id is not None)
