"""Awkward rows, empty tables and clashing columns, for every operator and pipeline stage."""

import pytest

from lithic.llm.exact_dedup import exact_dedup
from lithic.llm.hamming import top_k
from lithic.llm.mixing import mix
from lithic.llm.near_dedup import near_dedup
from lithic.llm.packing import pack
from lithic.llm.quality import quality
from lithic.llm.repeats import remove_repeats
from lithic.llm.token_output import token_output
from lithic.llm.toxicity import toxic_filter, toxicity
from lithic.llm.wrapper import extract


def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "mixing": lambda d, _: mix(d),
    "near_dedup": lambda d, _: near_dedup(d),
    "toxicity": lambda d, y: toxicity(d, y),
    "repeats": lambda d, _: remove_repeats(d),
    "token_output": lambda d, _: token_output(d, path()),
    "quality": lambda d, y: quality(d, y),
    "exact_dedup": lambda d, _: exact_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(spark, awkward, labels, name):
    got = OPERATORS[name](awkward, labels)
    ids = lambda df: sorted((r[0] is None, r[0] or 0) for r in df.select("doc_id").collect())
    assert ids(got) == ids(awkward)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, make_docs, labels, name):
    assert OPERATORS[name](make_docs([]), labels.limit(0)).count() == 0


def test_packing_edges(spark, awkward, make_docs):
    assert pack(make_docs([])).count() == 0
    rows = pack(awkward).collect()
    assert sum(r.size for r in rows) == sum(len(r.text.split(" ")) for r in awkward.where("doc_id in (6, 7)").collect()) + 6 * 3 + 2 + 1 + 6 + 1
    assert all((r.bin_id is None) == (r.size == 0) for r in rows)


def test_filter_keeps_columns(spark, awkward, labels, make_docs):
    assert toxic_filter(awkward, labels).columns == awkward.columns
    assert toxic_filter(make_docs([]), labels).count() == 0


def test_pages_edges(spark):
    rows = [(1, "http://a/x", "<p>one"), (1, "http://a/x", "<p>one"), (2, None, None), (None, "", ""), (3, "http://a/y", "<article><p>two<div class=comments><p>no</div></article><footer>f</footer>"), (4, "b", "</p></div><<<&amp;"), (5, "http://a/z", "<div>" * 3000 + "deep")]
    got = {(r.page_id, r.text, r.n_chars) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {(1, "one", 3), (2, "", 0), (None, "", 0), (3, "two", 3), (5, "deep", 4)} <= got
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_vectors_edges(spark):
    rows = [(1, [1.0, -1.0]), (2, [1.0, -1.0]), (2, [1.0, -1.0]), (3, None), (None, [1.0]), (4, []), (5, [-1.0, None]), (6, [float("nan")] * 3), (7, [1.0] * 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.rank, r.neighbour_id, r.distance) for r in top_k(df, df.where("vec_id = 1"), k=3).orderBy("rank").collect()]
    assert got == [(1, 2, 0), (2, 4, 1), (3, 5, 1)]
    assert top_k(df.limit(0), df.limit(0)).count() == 0


def test_stages(spark, awkward, make_docs, tmp_path):
    import corpus_pipeline as C

    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (awkward, make_docs([])):
        docs = start.select(C.COLUMNS)
        for k, (_, stage) in enumerate(C.STAGES):
            out = f"{tmp_path}/{start.count()}-{k}"
            stage(spark, docs, str(tmp_path)).write.parquet(out)
            docs = spark.read.parquet(out)
            if k < len(C.STAGES) - 1:
                assert docs.columns == C.COLUMNS
