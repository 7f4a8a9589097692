"""Each operator against a plain recomputation on small fixtures."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lithic.llm.exact_dedup import CountingQuotientFilter, counted, exact_dedup, repeated_fingerprints
from lithic.llm.graph import components
from lithic.llm.hamming import top_k
from lithic.llm.mixing import cycle_weights, fill, mix, targets
from lithic.llm.near_dedup import BITS, HASHES, estimated, minima, near_dedup, packed
from lithic.llm.packing import pack, pack_bins
from lithic.llm.quality import ByteConvNet, arrow_bytes, quality
from lithic.llm.repeats import merged_spans, remove_repeats
from lithic.llm.token_output import Encoder, PackedFile, file_bytes, pack as pack_bits, token_output, unpack
from lithic.llm.toxicity import SubwordSoftmax, probabilities
from lithic.llm.wrapper import extract, match, parse


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_quotient_filter_merges_losslessly():
    rng = np.random.default_rng(1)
    a, b = (rng.choice(rng.integers(0, 1 << 63, 300, dtype=np.int64), 500).astype(np.uint64) for _ in range(2))
    for x, y in ((a, b), (a, a), (a, a[:0])):
        f, g = (CountingQuotientFilter.of(*counted(v), 8, 0, 256) for v in (x, y))
        m = CountingQuotientFilter.from_bytes(f.merged(g).to_bytes())
        prints, counts = m.items()
        assert dict(zip(prints.tolist(), counts.tolist(), strict=True)) == Counter(np.concatenate([x, y]).tolist())
        assert (np.diff(prints.astype(object)) > 0).all()


def test_repeated_fingerprints(spark):
    df = spark.createDataFrame([(i % 70 - 35,) for i in range(100)] + [(None,)], "fp long").repartition(5)
    assert {(r.fp, r.n) for r in repeated_fingerprints(df).collect()} == {(i - 35, 2) for i in range(30)}


def test_exact_dedup(spark, make_docs):
    rows = [(1, "Aa"), (2, "aA"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "b")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(make_docs(rows)).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (4, 1, True), 5: (6, 2, False), 6: (6, 2, True), 7: (7, 1, True)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, k) for k in range(501, 560)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


@pytest.mark.parametrize(("width", "part"), [(3, 85), (5, 80)])
def test_near_dedup(spark, make_docs, width, part):
    rng = random.Random(3)
    rows = [(k, prose(rng, rng.randint(1, 80))) for k in range(60)]
    for k in range(60, 220):
        words = rng.choice(rows)[1].split(" ")
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "new" + str(rng.randint(0, 3))
        rows.append((k, " ".join(words).upper() if k % 2 else " ".join(words)))
    sets = {}
    for i, t in rows:
        w = t.lower().split(" ")
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or {tuple(w)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= part * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(make_docs(rows), width, part / 100).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_dedup_blocks(spark, make_docs, monkeypatch):
    """Buckets and components far above a block give the same classes."""
    import lithic.llm.near_dedup as N

    rng = random.Random(4)
    base = prose(rng, 60).split(" ")
    rows = []
    for k in range(90):
        w = list(base)
        w[k % 60] = f"x{k}"
        rows.append((k, " ".join(w)))
    whole = sorted(near_dedup(make_docs(rows), 3, 0.85).collect())
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 500)
    assert sorted(near_dedup(make_docs(rows), 3, 0.85).collect()) == whole


def test_b_bit_estimate():
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 62, 800, dtype=np.int64).astype(np.uint64)
    sets = [np.concatenate([common, rng.integers(0, 1 << 62, 200, dtype=np.int64).astype(np.uint64)]) for _ in range(30)]
    low = minima(np.concatenate(sets), np.arange(30) * 1000)
    sig = packed(low)
    assert sig.shape == (30, HASHES * BITS // 64)
    assert abs(estimated(sig[0], sig[1:]).mean() - 800 / 1200) < 0.05
    assert estimated(sig[0], sig[:1])[0] == 1


def test_fill_is_as_near_as_can_be():
    rng = np.random.default_rng(6)
    for _ in range(60):
        lengths = np.unique(rng.integers(0, 30, rng.integers(1, 5)))
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(0, 150))
        took = fill(lengths, counts, budget)
        assert (took >= 0).all() and (took <= counts).all()
        best = min(abs(sum(a * b for a, b in zip(lengths, c, strict=True)) - budget) for c in itertools.product(*[range(n + 1) for n in counts]))
        assert abs(int((lengths * took).sum()) - budget) == best


def test_targets_reshare():
    assert cycle_weights(["b", None, "a", "c"]) == {"a": 1, "b": 2, "c": 3, None: 1}
    got = targets({"a": 10, "b": 1000, "c": 0}, {"a": 3, "b": 1, "c": 2}, 1010)
    assert got == {"a": 30, "b": 980, "c": 0}


def test_mix(spark, make_docs):
    rng = random.Random(7)
    rows = [(k, prose(rng, rng.randint(1, 40)), rng.choice(["a", "b", "c", "d", None])) for k in range(300)] + [(k, "same three words", "a") for k in range(300, 1500)]
    got = mix(make_docs(rows)).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all() and (got["taken"] % got["size"] == 0).all()
    each = got.groupby(got["source"].fillna("null")).agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(each["taken"] - each["target"]) <= 3).all()
    again = mix(make_docs(rows[::-1]).repartition(7)).toPandas()
    assert got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()


def brute_repeats(rows, length):
    seen = Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, t in raw:
        seen.update(t[p : p + length] for p in range(len(t) - length + 1))
    out = {}
    for i, t in raw:
        runs = merged_spans([(p, p + length) for p in range(len(t) - length + 1) if seen[t[p : p + length]] > 1])
        keep, at = b"", 0
        for a, b in runs:
            keep, at = keep + t[at:a], b
        keep += t[at:]
        out[i] = (len(t), sum(b - a for a, b in runs), len(runs), hashlib.sha256(keep).hexdigest())
    return out


@pytest.mark.parametrize(("length", "window", "group"), [(60, 16, 2048), (60, 16, 2), (400, 128, 2048)])
def test_repeats(spark, make_docs, monkeypatch, length, window, group):
    import lithic.llm.repeats as M

    monkeypatch.setattr(M, "GROUP", group)
    rng = random.Random(8)
    passage = [prose(rng, 30 if length < 100 else 160) for _ in range(4)]
    rows = []
    for k in range(60):
        parts = [prose(rng, rng.randint(0, 60)) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passage)[rng.randint(0, 40) :])
        rows.append((k, rng.choice(["", "é"]).join(parts)))
    rows += [(60, "ab" * 900), (61, "x" * length), (62, "x" * (length - 1)), (63, None), (64, rows[0][1]), (65, rows[0][1] + "!")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(make_docs(rows), length, window).collect()}
    assert got == brute_repeats(rows, length)


def test_bit_packing():
    rng = np.random.default_rng(9)
    for bits in (1, 7, 16, 17, 31):
        ids = rng.integers(0, 1 << bits, 10_000).astype(np.uint32)
        assert (unpack(pack_bits(ids, bits), bits, len(ids)) == ids).all()
        lengths = np.array([0, 1, 9000, 999])
        f = PackedFile(file_bytes([4, None, 6, 7], lengths, ids, bits))
        assert f.doc_ids == [4, None, 6, 7] and (f.ids() == ids).all() and (f.ids(4090, 4200) == ids[4090:4200]).all()
        assert (f.document(3) == ids[9001:]).all() and len(f.document(0)) == 0


TEXTS = ["", " ", " a  b c\tİstanbul it's don't \x1cx\x85y <|endoftext|> z <| q", "É'SÀ Straße!!'s %%%a$$$ éx ﬁ 12a3 ΑΣ Σ x_y µm", "a,b.C", "The quick brown fox, jumps!"]


def test_token_output(spark, make_docs):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    full = Encoder(path).full
    rows = [(k * 3 % 17, t) for k, t in enumerate([*TEXTS, None])]
    want, start = {}, 0
    for i, t in sorted(rows):
        ids = [*full.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_output(make_docs(rows), path).collect()} == want


def test_pack_bins():
    rng = np.random.default_rng(10)
    sizes = rng.integers(1, 129, 400)
    bins, capacity, used = pack_bins(sizes, (32, 64, 128))
    assert (np.bincount(bins, sizes) == used).all() and all(u <= c for u, c in zip(used, capacity, strict=True))
    assert all(c == min(x for x in (32, 64, 128) if x >= u) for u, c in zip(used, capacity, strict=True))
    assert sum(capacity) < 1.05 * sizes.sum()


def test_pack_covers_documents(spark, make_docs):
    rows = [(k, "w " * (k * 37 % 900)) for k in range(60)]
    got = pack(make_docs(rows), (64, 256)).collect()
    by = defaultdict(int)
    for r in got:
        by[r.doc_id] += r.size
    assert by == {k: k * 37 % 900 for k in range(60)}
    spans = defaultdict(list)
    for r in got:
        if r.size:
            spans[r.bin_id].append((r.bin_start, r.size))
    assert all(sum(n for _, n in v) == max(a + n for a, n in v) for v in spans.values())


def test_top_k(spark):
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(400, 40))
    vectors[100:200] = vectors[0]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in top_k(df, df.where("vec_id % 50 = 0"), k=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.distance, r.neighbour_id))
    bits = vectors > 0
    for q in range(0, 400, 50):
        assert got[q] == sorted((int((bits[q] ^ bits[k]).sum()), k) for k in range(400) if k != q)[:7]


def test_toxicity_generalises():
    rng = random.Random(12)
    stems = ["vequ", "lowei"]
    make = lambda bad: prose(rng, 40) + (f" {rng.choice(stems)}{prose(rng, 1)} {rng.choice(stems)}{prose(rng, 1)} " if bad else " ") + prose(rng, 20)
    texts, y = zip(*[(make(k % 2), k % 2) for k in range(1000)], strict=True)
    weights, bias = SubwordSoftmax().fit(list(texts[:800]), np.array(y[:800])).weights()
    p = probabilities(pa.array(texts[800:]), weights, bias)
    assert ((p >= 0.5) == np.array(y[800:])).mean() > 0.9


def test_quality_network():
    rng = random.Random(13)
    good = lambda: prose(rng, 120)
    bad = lambda: " ".join(prose(rng, 1) + "!!%%" for _ in range(90))
    texts, y = zip(*[((good() if k % 2 else bad()), k % 2) for k in range(300)], strict=True)
    net = ByteConvNet().fit(list(texts[:200]), np.array(y[:200]), epochs=3)
    p = net.probability(*arrow_bytes(pa.array(texts[200:])))
    assert ((p >= 0.3) == np.array(y[200:])).mean() > 0.95
    one = np.array([net.probability(*arrow_bytes(pa.array([t])))[0] for t in texts[200:]])
    assert np.allclose(p, one, atol=1e-5)


def test_quality_is_the_same_in_any_batch(spark):
    """Texts of all lengths around a half chunk, long and empty ones: neighbours and partitions change nothing."""
    rng = random.Random(29)
    texts = ["".join(rng.choice("ab !é") for _ in range(n)) for n in [*range(0, 140), 1000, 70_000]]
    net = ByteConvNet(5)
    alone = np.array([net.probability(*arrow_bytes(pa.array([t])))[0] for t in texts])
    order = rng.sample(range(len(texts)), len(texts))
    mixed = net.probability(*arrow_bytes(pa.array([texts[i] for i in order])), block=256)
    assert np.allclose(alone[order], mixed, atol=1e-6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(len(texts))], "doc_id long, quality int")
    one, many = ({r.doc_id: r.score for r in quality(docs.repartition(n), labels).collect()} for n in (1, 7))
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-6 for k in one)


def test_quality_gradient():
    from lithic.llm.quality import laid_out

    net = ByteConvNet(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, lengths = arrow_bytes(pa.array([prose(random.Random(1), 60), "zz " * 50]))
    codes, halves = laid_out(data, lengths)
    y = np.array([1, 0])

    def loss():
        z = net.documents(net.halves(codes)[0].astype(np.float64), halves)["z"]
        return float(np.mean(np.logaddexp(0, z) - y * z))

    grad = net._gradients(codes, halves, y)
    for name, at in (("out", (3,)), ("hidden", (2, 1)), ("filters", (5, 4)), ("bias", (0,))):
        old, step = net.p[name][at], 1e-3
        net.p[name][at] = old + step
        up = loss()
        net.p[name][at] = old - step
        down = loss()
        net.p[name][at] = old
        assert grad[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def test_tree_matching():
    a, b = parse("<ul><li>1<li>2<li><b>3</b></ul><p>x"), parse("<ul><li>1<li><b>3</b></ul><div>y</div><p>x")
    names = Counter(x.tag for x, _ in match(a, b))
    assert names == {"#root": 1, "ul": 1, "li": 2, "b": 1, "p": 1}


def test_wrapper(spark):
    page = lambda k, body: (k, f"http://h.example/{k}", f"<html><head><title>t</title></head><body><div class=x><p>Same promise on all pages</p></div><div class=y><p>{body}</p><p>A &amp; B<br>C</p></div><nav>menu</nav><div id='comments-list'><p>me too</p></div></body></html>")
    rows = [page(k, f"story {k} of many") for k in range(12)] + [page(0, "story 0 of many")] * 3
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract(df).collect()}
    assert got[3] == "story 3 of many"  # the constant blocks are template
    few = {r.page_id: r.text for r in extract(df.where("page_id in (1, 2)")).collect()}
    assert few[1] == "Same promise on all pages\nstory 1 of many\nA & B C"
