"""Text quality by a naive Bayes support vector machine.

A text is the set of its hashed n-grams: words and punctuation in small letters (one and two in a row), forms of words
(capitals, digits, length; one to three in a row) and, as indicators too, the tenths of its words that have each form
or repeat an earlier pair of words. Indicators are scaled by the logarithm of the ratio of the classes' count shares,
each text to unit length, and a linear hinge-loss model is fitted by dual coordinate descent, with both classes of
equal weight. Margins become chances by a logistic curve, fitted on margins of texts that neither the ratios nor the
model of their fold have seen; so labels that say nothing give the base rate to all.

The model is learned from a bounded sample of the labelled rows (``sample_rows``, those of smallest hash); its weights
are ``BUCKETS`` numbers whatever the input's size, and every whole text is scored with them in one scan.

Defined cases: null and empty texts have no n-grams but the indicators of nothing, and get a score like any other.
Repeated labels of one document count once, 0 if any says so; null labels are no labels. Texts of the sample that are
equal but for capitals and blanks count once. Without labelled rows every score is 0, with one class its rate.
Repeated rows give a row each. Only text is an input of a score; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _expand
from .common import giving_back, pick, small_batches
from .neardup import _mix
from .toxicity import held_out

#: Labelled rows of the sample; hashed n-grams; folds of the calibration; rounds, cost and smoothing of the fit.
SAMPLE_ROWS, BUCKETS, FOLDS = 16384, 1 << 18, 3
ROUNDS, COST, SMOOTH = 12, 1.0, 1.0
#: Score from which a text counts as good; characters that are taken up together.
THRESHOLD, TOGETHER = 0.3, 1 << 20
_POWER = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
#: Kinds of tokens: small letters, first capital, capitals, digits, mixed, end marks, other marks; then pairs seen before.
KINDS = 7


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its class (0 blank, 1 letter, 2 capital, 3 digit, 4 mark) and its small letter."""
    kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in map(chr, range(0x110000)):
        if c.isalpha():
            kind[ord(c)] = 2 if c.isupper() else 1
            lower[ord(c)] = ord(c.lower()[0])
        elif c.isdigit():
            kind[ord(c)] = 3
        elif not c.isspace() and c.isprintable():
            kind[ord(c)] = 4
    return kind, lower


def _some(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in runs of about ``TOGETHER`` characters."""
    run, size = [], 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= TOGETHER:
            yield run
            run, size = [], 0
    if run:
        yield run


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash, kind and form of every token, in order."""
    kinds, lower = _characters()
    code = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
    kind = kinds[code]
    inside = (kind > 0) & (kind < 4)
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    start = np.flatnonzero(inside & ~before | (kind == 4))
    size = np.flatnonzero(inside & ~after | (kind == 4)) - start + 1
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    if not len(start):
        return text, np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    flat = _expand(start, size)
    first = np.cumsum(size) - size
    power = np.cumprod(np.full(int(size.max()), _POWER))
    word = _mix(np.add.reduceat((lower[code[flat]].astype(np.uint64) + np.uint64(1)) * power[flat - np.repeat(start, size)], first))
    capitals, digits = (np.add.reduceat((kind[flat] == k).astype(np.int64), first) for k in (2, 3))
    what = np.full(len(start), 4)
    what[(capitals == 0) & (digits == 0)] = 0
    what[(capitals == 1) & (digits == 0) & (kind[start] == 2)] = 1
    what[(capitals == size) & (size > 1)] = 2
    what[digits == size] = 3
    mark = kind[start] == 4
    what[mark] = 6
    what[mark & np.isin(code[start], np.array([ord(c) for c in ".,;:?"], np.uint32))] = 5
    return text, word, what, what * 4 + np.digitize(size, [4, 9, 16])


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every distinct n-gram, in order of text."""
    text, word, what, form = _tokens(texts)
    n = len(texts)
    one = np.append(text[1:] == text[:-1], False)[:len(text)]  # the next token is of the same text
    two = one & np.append(one[1:], False)[:len(text)]
    following = np.append(word[1:], np.uint64(0))[:len(word)]
    pair = _mix(word * _SECOND + following)
    f = form.astype(np.uint64) + np.uint64(1)
    f2, f3 = (np.append(f[k:], np.zeros(min(k, len(f)), np.uint64)) for k in (1, 2))
    forms = [f, f * np.uint64(64) + f2, (f * np.uint64(64) + f2) * np.uint64(64) + f3]
    rows = [text, text[one], text, text[one], text[two]]
    keys = [word, pair[one], _mix(forms[0]), _mix(forms[1][one]), _mix(forms[2][two])]
    # Repeated pairs: all but the first of each in its text.
    order = np.lexsort((pair[one], text[one]))
    t, p = text[one][order], pair[one][order]
    again = np.append(False, (t[1:] == t[:-1]) & (p[1:] == p[:-1]))[:len(t)]
    shares = np.stack([np.bincount(text[what == k], minlength=n) for k in range(KINDS)] + [np.bincount(t[again], minlength=n)], 1)
    tenths = np.minimum(10 * shares // np.maximum(np.bincount(text, minlength=n), 1)[:, None] + (shares > 0), 10)
    rows.append(np.repeat(np.arange(n), KINDS + 1))
    keys.append(_mix((tenths + 16 * np.arange(KINDS + 1) + (1 << 32)).ravel().astype(np.uint64)))
    both = np.concatenate(rows).astype(np.int64) * BUCKETS + (np.concatenate(keys) >> np.uint64(64 - 18)).astype(np.int64)
    both = np.unique(both)
    return both // BUCKETS, both % BUCKETS


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    rows, cells, done = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for run in _some(texts):
        row, cell = _features(run)
        rows.append(row + done)
        cells.append(cell)
        done += len(run)
    return np.concatenate(rows), np.concatenate(cells)


class Examples:
    """Labelled sets of buckets: example k has cells[edge[k]:edge[k + 1]]."""

    def __init__(self, edge: np.ndarray, cells: np.ndarray, good: np.ndarray):
        self.edge, self.cells, self.good = edge, cells, good

    def ratios(self, use: np.ndarray) -> np.ndarray:
        """Logarithm of the ratio of the classes' shares of counts, over the examples in use."""
        held = np.repeat(use, np.diff(self.edge))
        good = np.repeat(self.good, np.diff(self.edge)) == 1
        p, q = (SMOOTH + np.bincount(self.cells[held & g], minlength=BUCKETS) for g in (good, ~good))
        return np.log(p / p.sum()) - np.log(q / q.sum())

    def margins(self, weights: np.ndarray, ratios: np.ndarray) -> np.ndarray:
        return margins(self.edge, self.cells, weights, ratios * ratios)

    def fit(self, use: np.ndarray, ratios: np.ndarray) -> np.ndarray:
        """weights[c], so that a text's margin is the sum over its buckets divided by the length of its scaled indicators.

        Dual coordinate descent for the hinge loss: each step solves for one example's multiplier and moves the weights along it.
        """
        chosen = np.flatnonzero(use)
        length = np.sqrt(np.maximum(_sums(self.edge, ratios[self.cells] ** 2), 1e-300))
        y = 2.0 * self.good - 1
        share = np.array([np.mean(self.good[chosen] == g) for g in (0, 1)])
        most = COST * 0.5 / np.maximum(share, 1e-9)[self.good]
        w, alpha = np.zeros(BUCKETS), np.zeros(len(y))
        parts = {i: (c := self.cells[self.edge[i]:self.edge[i + 1]], ratios[c] / length[i]) for i in chosen}
        rng = np.random.default_rng(7)
        for _ in range(ROUNDS):
            moved = 0.0
            for i in rng.permutation(chosen):
                c, x = parts[i]
                gradient = y[i] * (w[c] @ x) - 1
                new = min(max(alpha[i] - gradient, 0.0), most[i])  # the examples have unit length
                if new != alpha[i]:
                    w[c] += (new - alpha[i]) * y[i] * x
                    moved = max(moved, abs(new - alpha[i]))
                    alpha[i] = new
            if moved < 1e-3:
                break
        return w * ratios


def _sums(edge: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of a text's values, added up in order, so that they do not depend on the texts around it."""
    return np.bincount(np.repeat(np.arange(len(edge) - 1), np.diff(edge)), values, minlength=len(edge) - 1)


def margins(edge: np.ndarray, cells: np.ndarray, weights: np.ndarray, squares: np.ndarray) -> np.ndarray:
    return _sums(edge, weights[cells]) / np.sqrt(np.maximum(_sums(edge, squares[cells]), 1e-300))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0) and offset of the curve that fits outcomes best, with one example of each class as prior."""
    good = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    target = np.where(y == 1, *good)
    a, b = 0.0, float(np.log(target.mean() / (1 - target.mean())))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        d, v = p - target, p * (1 - p) + 1e-12
        g, h = np.array([d @ x, d.sum()]), np.array([[v @ (x * x) + 1e-9, v @ x], [v @ x, v.sum()]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (float(a), float(b)) if a > 0 else (0.0, float(np.log(target.mean() / (1 - target.mean()))))


class Model:
    def __init__(self, weights: np.ndarray, squares: np.ndarray, slope: float, offset: float):
        self.weights, self.squares, self.slope, self.offset = weights, squares, slope, offset

    def scores(self, texts: list[str | None]) -> np.ndarray:
        row, cell = features(texts)
        edge = np.searchsorted(row, np.arange(len(texts) + 1))
        return 1 / (1 + np.exp(-(self.slope * margins(edge, cell, self.weights, self.squares) + self.offset)))


class Constant:
    """What is known without two classes: one rate for all."""

    def __init__(self, rate: float):
        self.rate = rate

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.full(len(texts), self.rate)


def _example_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, cell = features(batch.column(1).to_pylist())
        at = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(at, pa.array(cell.astype(np.int32)))],
                                         names=["doc_id", "label", "cells"])


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> Model | Constant:
    """docs: doc_id, text; labels: doc_id, label. Rows whose crc32 of the doc_id is divisible by 5 are held out.

    The folds' models and the last one are tasks of their own, over the sample as a broadcast of bounded size.
    """
    spark = docs.sparkSession
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("label").isNotNull())
    chosen = usable.groupBy("doc_id").agg(F.min("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = spark.createDataFrame(chosen.toPandas().astype("int64"), "doc_id long, label long")  # at most sample_rows pairs
    whole = F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256)
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    texts = texts.groupBy(whole.alias("whole"), "label").agg(F.min("doc_id").alias("doc_id"), F.min_by("text", "doc_id").alias("text"))
    sample = texts.select("doc_id", "text", "label").mapInArrow(giving_back(_example_cells), "doc_id long, label long, cells array<int>").orderBy("doc_id", "label").toArrow()
    good = sample["label"].to_numpy().astype(np.int64)
    if len(set(good)) < 2:
        return Constant(float(good.mean()) if len(good) else 0.0)
    cells = sample["cells"].combine_chunks()
    edge = np.concatenate([[0], np.cumsum(cells.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    fold = np.arange(len(good)) % FOLDS
    shared = spark.sparkContext.broadcast((edge, cells.flatten().to_numpy(zero_copy_only=False).astype(np.int32), good, fold))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                edge, cells, good, fold = shared.value
                examples = Examples(edge, cells, good)
                use = fold != k
                both = len(set(good[use])) > 1
                ratios = examples.ratios(use)
                weights = examples.fit(use, ratios) if both else np.zeros(BUCKETS)
                if k < FOLDS:
                    rest = np.flatnonzero(~use)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rest), k)), pa.array(rest), pa.array(examples.margins(weights, ratios)[rest]),
                                                      pa.array(np.zeros(len(rest)))], names=["model", "at", "x", "square"])
                else:
                    some = np.flatnonzero((weights != 0) | (ratios != 0))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k)), pa.array(some), pa.array(weights[some]),
                                                      pa.array(ratios[some] ** 2)], names=["model", "at", "x", "square"])

    found = spark.range(FOLDS + 1).repartition(FOLDS + 1, "id").mapInArrow(giving_back(one), "model long, at long, x double, square double").toArrow()
    model, at, x, square = (found[c].to_numpy() for c in ("model", "at", "x", "square"))
    shared.destroy()
    out = np.zeros(len(good))
    out[at[model < FOLDS]] = x[model < FOLDS]
    weights, squares = np.zeros(BUCKETS), np.zeros(BUCKETS)
    last = model == FOLDS
    weights[at[last]], squares[at[last]] = x[last], square[last]
    return Model(weights, squares, *logistic(out, good.astype(float)))


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    docs = pick(docs, doc_id=id_col, text=text_col)
    model = fit(docs, pick(labels, doc_id=id_col, label=label_col), sample_rows=sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1).to_pylist()))], names=["doc_id", "score"])

    scored = docs.mapInArrow(giving_back(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
              threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that count as good, with all their columns."""
    small_batches(docs.sparkSession)
    model = fit(pick(docs, doc_id=id_col, text=text_col), pick(labels, doc_id=id_col, label=label_col), sample_rows=sample_rows)

    @F.arrow_udf("double")
    def of(text: pa.Array) -> pa.Array:
        return pa.array(model.scores(text.to_pylist()))

    return docs.where(of(F.col(text_col)) >= threshold)
