"""Tables that repeat ids, or have none."""

from lithic.llm.mixing import mix


def test_near_copies_go_by_row(spark, make_docs):
    import corpus_pipeline as C

    words = [f"w{k}" for k in range(60)]
    rows = [(3, " ".join(words)), (5, " ".join([*words, "end"])), (5, "a clean text that has no partner at all"), (None, "none")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.text for r in C._near(spark, docs, "").collect()) == sorted(t for k, (_, t) in enumerate(rows) if k != 1)


def test_mix_keeps_to_the_plan(spark):
    for texts in ([f"word{k}" for k in range(30)], ["word"] * 30, ["word", "other", "third"] * 10):
        for ids in ([None] * 30, [7] * 30, [k // 15 for k in range(30)]):
            rows = [(i, t, s) for s in "abc" for i, t in zip(ids, texts, strict=True)]
            got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=("text",)).collect()
            assert len(got) == 90
            for s in "abc":
                mine = [r for r in got if r.source == s]
                assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.5
