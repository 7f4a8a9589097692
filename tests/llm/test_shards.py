"""Several shards and blocks of queries, and ids that many rows share."""

import numpy as np

from lithic.llm import hamming as H
from lithic.llm import token_output as T


def test_top_k_over_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "SHARD", 150)
    monkeypatch.setattr(H, "QUERY_BLOCK", 5)
    monkeypatch.setattr(H, "TOGETHER", 3)
    v = np.random.default_rng(1).normal(size=(700, 48))
    v[200:260] = v[7]  # equal codes
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    got = {}
    for r in H.top_k(df, df.where("vec_id % 20 = 0"), k=5).collect():
        got.setdefault(r.query_id, []).append((r.distance, r.neighbour_id))
    bits = v > 0
    want = {q: sorted((int((bits[q] ^ bits[k]).sum()), k) for k in range(700) if k != q)[:5] for q in range(0, 700, 20)}
    assert {q: sorted(x) for q, x in got.items()} == want
    assert H.top_k(df, df.where("vec_id < 0")).count() == 0


def test_shards_of_ids_that_many_rows_share(spark, tmp_path):
    import public_tokenizers

    rows = [(None if i % 3 == 0 else (7 if i % 3 == 1 else i), f"word{i} hello {i % 5}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = f"file://{tmp_path}/tokens"
    m = T.write_tokens(docs.repartition(5), public_tokenizers.path("word_bpe_49k.json"), folder, shard_rows=50)
    assert m.agg({"documents": "max"}).first()[0] < 100  # no shard holds a third of the rows
    got = T.read_tokens(m, folder).orderBy("start").collect()
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys) == sorted(-1 if i is None else i for i, _ in rows)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False))
    again = T.token_output(docs.repartition(2), public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/again").orderBy("start").collect()
    assert [r.ids_crc32 for r in again] == [r.ids_crc32 for r in got]
