"""Vectors, urls, archives, the pipeline and the registered queries."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestry.llm import embeddings, urlfilter, warc
from contestry.llm.common import scratch
from contestry.llm.oracles import ORACLE_SQL
from contestry.llm.queries import QUERIES

from ..oracle import connect, rows_from, rows_of


@pytest.mark.parametrize("block", [2048, 7])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "ROWS", 90)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    x[200:240] = x[0] + 0.2 * rng.normal(size=(40, 16))
    x[250] = 1e-30 * x[5]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (304, [1.0]), (305, [float("inf")] + [1.0] * 15), (306, [])]
    df = spark.createDataFrame([(i, v, 3, 9) for i, v in rows], "vec_id long, embedding array<double>, label int, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    label = np.arange(300)
    for _ in range(300):
        label = np.array([label[near[i]].min() for i in range(300)])
    for i in range(300):
        assert got[i] == (near[i].sum() - 1, label[i], label[i] == i), i
    assert all(got[i] == (0, i, True) for i in range(300, 307))


def _topic(n, planted, dim=32):
    """Vectors of one topic of mutual cosine 0.8, some of them with a partner of cosine 0.91 or so."""
    rng = np.random.default_rng(5)
    axis = np.zeros(dim)
    axis[0] = 1

    def unit(v):
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def off_axis(k):
        v = rng.normal(size=(k, dim))
        v[:, 0] = 0
        return unit(v)

    own = off_axis(n)
    part = np.sqrt(0.8) * axis + np.sqrt(0.2) * own
    other = unit(0.55 * own[:planted] + np.sqrt(1 - 0.55**2) * unit(off_axis(planted)))
    return np.concatenate([part, np.sqrt(0.8) * axis + np.sqrt(0.2) * other])


@pytest.mark.parametrize("copies", [0, 300])
def test_links_inside_a_dense_topic(spark, copies):
    """Rounds go on until few links are missed, also beside a group of copies that every pass finds."""
    x = _topic(800, 150)
    x = np.concatenate([x, np.repeat(x[:1] * [-1.0], copies, axis=0)])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").cache()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9).sum(axis=1) - 1

    def recall(**how):
        got = np.zeros(len(x), np.int64)
        for r in embeddings.near_vectors(df, window=8, **how).collect():
            got[r.vec_id] = r.n_links
        assert (got <= near).all()
        return got[:950].sum() / near[:950].sum()

    assert near[:950].sum() > 1000
    assert recall() >= 0.95
    if not copies:
        assert recall(passes=4, missed=1.0) < 0.8


def test_repeated_vectors_and_other_lengths(spark):
    u, v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, u), (2, v), (5, u), (5, v), (7, w), (7, None), (8, [1.0, 1.0]), (9, [2.0, 2.0]), (10, [1.0, 1.0, 1.0, 1.0]), (None, u), (None, u)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (5, 1, 1, False), (5, 1, 1, False), (7, 0, 7, True), (7, 0, 7, True),
                          (8, 1, 8, True), (9, 1, 8, False), (10, 0, 10, True), (None, 0, None, True), (None, 0, None, True)], key=str)


def test_very_long_vectors(spark):
    x = np.random.default_rng(3).normal(size=(3, 20_000))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate([*x, x[1] * 2])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect())
    assert got == [(0, 0, 0), (1, 1, 1), (2, 0, 2), (3, 1, 1)]


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_vectors(none).collect() == []


def test_urls(spark):
    rows = [(1, "http://A.Example.NET/en/x?q#f"), (2, "https://m.example.com/de/1"), (3, "ftp://foo.org/fr/"), (4, "http://foo.org"), (5, None), (6, "no scheme"),
            (7, "http://net/"), (8, "http://a.net?x=/en/"), (9, "http://example.net/en"), (10, "http://notexample.net/en/"), (11, "x://y://z/p"), (1, "http://A.Example.NET/en/x?q#f")]
    df = spark.createDataFrame([(i, u, "r") for i, u in rows], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in urlfilter.judge(df).collect()}
    assert got == {1: ("a.example.net", "/en/x", "example.net/en/"), 2: ("m.example.com", "/de/1", "example.com/de/"), 3: ("foo.org", "/fr/", "org/fr/"),
                   4: ("foo.org", "", None), 5: ("", "", None), 6: ("", "", None), 7: ("net", "/", "net/"), 8: ("a.net", "", None),
                   9: ("example.net", "/en", "net/"), 10: ("notexample.net", "/en/", "net/"), 11: ("y:", "", None) if False else ("y:", "//z/p", None)}
    assert urlfilter.judge(df).count() == len(rows)
    assert {r.verdict for r in urlfilter.judge(df).collect()} <= {"allow", "block"}
    assert urlfilter.judge(df.where("false")).collect() == []


def test_names_are_segmented():
    model = urlfilter.Segmenter({"cheap": 50, "pills": 40, "shop": 60, "chea": 3, "p": 2})
    assert model.split("cheappillsshop") == ["cheap", "pills", "shop"]
    assert "".join(model.split("unknownpills")) == "unknownpills" and model.split("") == []


def test_naive_bayes_learns_from_ruled_pages(spark):
    rows = [(i, f"http://casino{'win' if i % 2 else 'luck'}.example.com/de/{i}") for i in range(60)]
    rows += [(100 + i, f"http://garden{'rose' if i % 2 else 'tree'}.example.net/en/{i}") for i in range(60)]
    rows += [(200, "http://casinowin.example.org/it/1"), (201, "http://gardenrose.example.org/it/1")]
    got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[200] == "block" and got[201] == "allow"


def test_archives(spark):
    big = "<p>" + "x" * 200
    rows = [(5, "http://b.example.com/1", big), (3, "http://a.example.com/2", big), (9, None, big), (4, "http://a.example.com/2", "short"), (6, "http://c.example.com/", "short"),
            (7, "http://a.example.com/2", None), (8, "bad url\r\nX: y", ""), (10, "http://é.example.com/ü", "é" * 60), (11, "http://x.example.com/", "é" * 60), (3, "http://a.example.com/2", big)]
    df = spark.createDataFrame([(i, u, h, "d") for i, u, h in rows], "page_id long, url string, html string, digest string")
    folder = scratch(spark, "test-warc")
    directory = warc.write_archives(df, folder)
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(directory, folder).collect())
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = min((j for j, _, g in rows if (g or "") == (h or "")), default=i)
        again = len(data) >= 100 and first < i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=lambda r: r[:4])
    hits = warc.lookup(directory, folder, spark.createDataFrame([("http://a.example.com/2",), ("http://zz.example.com/",), ("http://A.example.com/2#x",)], "url string"))
    assert sorted(r.page_id for r in hits.collect()) == [3, 3, 3, 3, 4, 4, 7, 7]
    assert warc.round_trip(df.where("false")).collect() == []


def test_lookups_cross_blocks_and_files(spark, monkeypatch):
    df = spark.range(1200).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 7, F.lit(".example.com/")).alias("url"), F.lit("x").alias("html"))
    folder = scratch(spark, "test-warc")
    directory = warc.write_archives(df, folder)
    assert directory.count() > 4
    hits = warc.lookup(directory, folder, spark.createDataFrame([("http://h3.example.com/",)], "url string"))
    assert sorted(r.page_id for r in hits.collect()) == [i for i in range(1200) if i % 7 == 3]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert rows_of(QUERIES[name](spark, sf)) == rows_from(connect(sf), ORACLE_SQL[name])


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        path = scratch(spark, f"test-{name}")
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        assert 0.5 * n < after.count() <= docs.count()
        docs = after
    assert docs.where("NOT same").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
