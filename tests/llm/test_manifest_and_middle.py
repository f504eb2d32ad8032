"""Merkle manifest, fill-in-the-middle and quality scores against plain loops, and their defined cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestry.llm import fim, merkle, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, pos int, path string, label string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, s, n, "h", 1, "p", "l", 2) for i, t, g, s, n in rows], SCHEMA)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, t, g, s, n):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, g, n, t)])


def climb(nodes):
    """The root, and for every leaf its pairs of siblings, by plain recursion."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, a in enumerate(at):
            run = level[a // 8 * 8:a // 8 * 8 + 8]
            paths[k].append(("".join(run[:a % 8]), "".join(run[a % 8 + 1:])))
        level = [H(*level[k:k + 8]) for k in range(0, len(level), 8)]
        at = [a // 8 for a in at]
    return level[0], paths


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, inner = [], []
    for g in order:
        members = sorted(groups[g], key=lambda x: x[:3])
        top, paths = climb([m[2] for m in members])
        tops.append(top)
        inner.append((members, paths))
    root, above = climb(tops)
    out = []
    for top, more, (members, paths) in zip(tops, above, inner):
        for m, p in zip(members, paths):
            i, t, g, s, n = m[3]
            path, node = p + more, m[2]
            if i is not None and zlib.crc32(str(i).encode()) % 3 == 0:
                low = None if t is None else t.translate({c: c + 32 for c in range(65, 91)})
                node = leaf(i, low, g, s, n)
            for b, a in path:
                node = H(b, node, a)
            out.append((str(i), m[2], top, root, H(*[b + a for b, a in path]), node, node == root))
    return sorted(out)


def manifest_rows():
    rng = random.Random(5)
    rows = [(i, rng.choice(["Some Text", "all small", "", None, "ÄB é" * 50]), "en", "src", 5) for i in range(700)]
    rows += [(i, "Text", None, None, None) for i in range(700, 709)]
    rows += [(i, "T", f"g{i % 11}", "hot", i) for i in range(710, 760)] + [(800, "alone", "solo", "s", 1), (800, "alone", "solo2", "s", 1)]
    rows += [(5, "again", "en", "src", 5)] * 3 + [(None, "no id", "en", "s", 2), (None, None, "en", "s", 2), (801, "Long " * 60000, "é", "s", 3)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts,block", [(1, 512), (7, 64)])
def test_manifest(spark, monkeypatch, parts, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = manifest_rows()
    out = merkle.audit(table(spark, rows).repartition(parts)).withColumn("proof", F.sha2(merkle.siblings(F.col("path")), 256))
    got = sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.verified) for r in out.collect())
    assert got == plain_manifest(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("rows", [[], [(1, "One", "en", "s", 3)], [(1, "a", None, "s", 3), (2, "B", "x", None, 3)]])
def test_small_manifests(spark, rows):
    got = merkle.audit(table(spark, rows)).select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256), "folded_root", "verified")
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == (plain_manifest(rows) if rows else [])


def test_changed_documents_are_found(spark):
    rows = manifest_rows()[:200]
    published = merkle.audit(table(spark, rows))
    changed = [(i, "changed" if i == rows[0][0] else t, g, s, n) for i, t, g, s, n in rows if i is not None]
    seen = {r.doc_id: r.verified for r in merkle.verify(table(spark, changed + [(9999, "new", "en", "s", 1)]), published).collect()}
    assert not seen[rows[0][0]] and not seen[9999]
    assert all(seen[i] for i, *_ in changed if i not in (rows[0][0], 5))


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middle_rows():
    rng = random.Random(3)
    text = lambda: "".join(rng.choice(["a", "é", "漢", "😀", " ", "  ", "\n", "\t", "b<", "P>", " ", "\x1c"]) for _ in range(rng.randint(0, 60)))
    rows = [(i, text()) for i in range(300)]
    rows += [(i, t) for i, t in enumerate(["", None, " ", "\n\n", "x", " x", "x ", "has <P> in it", "<S>", "a<M>", "word " * 40000, "é" * 50000, "tail \n"], 400)]
    return rows + [(None, "no id at all"), (7, rows[7][1])]


def expected_middle(i, text):
    text = text or ""
    u = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, text
    form = "spm" if h[3] % 100 < 80 else "psm"
    return len(u), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("batch", [512, 3])
def test_middle(spark, monkeypatch, batch):
    monkeypatch.setattr(fim, "small_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch)))
    rows = middle_rows()
    docs = spark.createDataFrame([(i, t, 1, "f", "o") for i, t in rows], "doc_id long, text string, n int, form string, output string")
    got = fim.transform(docs).collect()
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got], key=key) == sorted(
        [(i, *expected_middle(i, t)) for i, t in rows], key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(r.restored_sha256 for r in fim.round_trip(docs).collect()) == sorted(sha(t) for _, t in rows)
    assert fim.round_trip(docs.where("false")).collect() == []


@pytest.mark.parametrize("unit,pattern", [("line", re.compile(r"[^\n]*\n|[^\n]+")), ("char", re.compile(r".", re.S))])
def test_other_units(spark, unit, pattern):
    rows = [(i, t) for i, t in middle_rows() if i is not None]
    for r in fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), unit=unit, percent=100, seed=1).collect():
        u = pattern.findall(r.text)
        assert r.n == len(u)
        if r.form != "plain":
            ends = np.cumsum([0] + [len(x) for x in u])
            assert r.prefix_chars in ends and r.prefix_chars + r.middle_chars in ends


def test_wavelet_ranks():
    x = np.random.default_rng(1).integers(0, 8, 1000).astype(np.uint8)
    w, at = fim.Wavelet(x), np.array([0, 1, 7, 8, 9, 500, 999, 1000])
    for s in range(8):
        assert list(w.rank(s, at)) == [int((x[:k] == s).sum()) for k in at]


def quality_rows(n=900, informative=True, seed=2):
    rng = random.Random(seed)
    words = [f"wort{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if informative and not good:
            w = rng.choice([[x + rng.choice("#$%|") for x in w], [x.upper() + "!" for x in w], w[:3] * 12])
        rows.append((i, " ".join(w)))
        labels.append((i, int(good)))
    return rows, labels


def test_quality_is_learned(spark):
    rows, labels = quality_rows()
    docs = spark.createDataFrame([(i, t, 7, 0.5) for i, t in rows], "doc_id long, text string, label int, score double")
    got = quality.score(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    held = [(r.predicted, dict(labels)[r.doc_id]) for r in got if r.held_out]
    assert len(got) == len(rows) and len(held) > 100
    assert np.mean([p for p, y in held if y]) >= 0.98 and np.mean([1 - p for p, y in held if not y]) >= 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_labels_that_say_nothing(spark):
    rows, labels = quality_rows(1200, informative=False)
    y = dict(labels)
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    held = np.array([(r.score, y[r.doc_id]) for r in got if r.held_out])
    rate = held[:, 1].mean()
    assert ((held[:, 0] - held[:, 1]) ** 2).mean() <= rate * (1 - rate) + 0.01


def test_quality_cases(spark):
    rows, labels = quality_rows(300)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "lang " * 100000), (None, "no id"), (3, rows[3][1]), (1004, rows[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(1000, 1), (1001, 0), (5, None), (5, 0), (5, 1), (7777, 1)], "doc_id long, quality int")
    a = sorted((str(r.doc_id), r.score) for r in quality.score(docs, known).collect())
    assert a == sorted((str(r.doc_id), r.score) for r in quality.score(docs.repartition(9), known).collect())
    assert len(a) == len(rows) and all(0 <= s <= 1 for _, s in a)
    score = dict(a)
    assert score["1000"] == score["1001"] == score["1002"] and score["1004"] == score["4"]
    assert {r.score for r in quality.score(docs, known.where("false")).collect()} == {0.0}
    assert {r.score for r in quality.score(docs, known.where("quality = 1")).collect()} == {1.0}
    assert quality.score(docs.where("false"), known).collect() == []
    kept = quality.keep_good(docs.withColumn("label", F.lit("x")), known)
    assert kept.columns == ["doc_id", "text", "label"] and 0 < kept.count() < len(rows)


def test_dual_coordinate_descent_reaches_the_optimum():
    """The gap between the primal loss and the dual one closes."""
    rng = np.random.default_rng(4)
    n = 120
    good = rng.integers(0, 2, n)
    sets = [np.unique(rng.integers(0, 40, 12) + 15 * g) for g in good]
    edge = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    ex = quality.Examples(edge, np.concatenate(sets).astype(np.int32), good)
    use = np.ones(n, bool)
    ratios = ex.ratios(use)
    scaled = np.where(ratios == 0, 1, ratios)
    w = ex.fit(use, ratios) / scaled
    length = np.array([np.sqrt((ratios[s] ** 2).sum()) for s in sets])
    y, cost = 2.0 * good - 1, quality.COST * 0.5 / np.array([np.mean(good == g) for g in (0, 1)])[good]
    primal = lambda v: 0.5 * v @ v + sum(c * max(0, 1 - t * (v[s] @ ratios[s]) / k) for c, t, s, k in zip(cost, y, sets, length))
    best = primal(w)
    for _ in range(300):
        assert best <= primal(w + rng.normal(size=len(w)) * rng.choice([1e-3, 1e-2, 0.1]) * (np.abs(w) > 0)) + 0.02
