"""Toxicity from nearest labelled examples by exact TF-IDF cosine.

A bounded sample of labelled rows gives the examples. All their words are indexed; document frequencies are counted
over all documents, and a word's weight is also that of its association with the label. Examples are dealt to blocks
of an inverted index that keeps, per word and block, the largest weight: a block is opened only if its bound can
reach the k best, so the neighbours are exact. Votes are weighted by similarity and calibrated on the examples,
each of them left out of its own vote.

Defined cases: null and empty texts have no words and get the rate of examples without any word of weight. Ties between neighbours go to the example that comes first. Repeated labels of one document count once,
toxic if any says so; null labels are no labels. Labelled texts that are equal but for capitals and spaces are one
example. Without labelled rows every score is 0. Repeated rows give a row each. Only text is an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PLACES, _expand, _slices
from .common import give_back, giving_back, pick, small_batches
from .neardup import _mix

#: Labelled rows of the sample, neighbours, examples of a block, blocks that are opened first.
SAMPLE_ROWS, NEIGHBOURS, BLOCK, FIRST_BLOCKS = 4096, 15, 64, 4
#: A word that more than one of so many examples hold has a full row for a posting list; texts scored at once.
FULL_ROW, TEXTS = 16, 128
#: Weight of the examples' base rate beside the votes.
PRIOR_WEIGHT = 0.2
_POWER = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _in_words() -> np.ndarray:
    """Letters and digits, for every code point."""
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def word_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, word and how often it is there, in order; words are runs of letters and digits in small letters, named by 64-bit hashes."""
    # Some texts at a time, as what is built over characters takes many times their size.
    parts = [(s.start, *_word_counts(texts[s])) for s in _slices(np.array([len(t or "") for t in texts], np.int64), PLACES)]
    text, word, n = ([x[k] for x in parts] for k in (1, 2, 3))
    return (np.concatenate([*(first + t for (first, *_), t in zip(parts, text)), np.empty(0, np.int64)]),
            np.concatenate([*word, np.empty(0, np.uint64)]), np.concatenate([*n, np.empty(0, np.int64)]))


def _word_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    texts = [(t or "").lower() for t in texts]
    code = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), np.uint32)
    inside = np.concatenate([[False], _in_words()[code], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2]
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    power = np.cumprod(np.full(int(size.max()), _POWER))
    key = np.empty(len(start), np.uint64)
    for s in _slices(size, PLACES):
        flat = _expand(start[s], size[s])
        letters = (code[flat].astype(np.uint64) + np.uint64(1)) * power[flat - np.repeat(start[s], size[s])]
        key[s] = np.add.reduceat(letters, np.cumsum(size[s]) - size[s])
    word = _mix(key)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    o = np.lexsort((word, text))
    text, word = text[o], word[o]
    new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (word[1:] != word[:-1])))
    return text[new], word[new], np.diff(np.append(new, len(o)))


def _example_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, word, n = word_counts(batch.column(1).to_pylist())
        at = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(2), pa.ListArray.from_arrays(at, pa.array(word.view(np.int64))),
            pa.ListArray.from_arrays(at, pa.array(n.astype(np.int32)))], names=["doc_id", "toxic", "words", "tf"])


def label_weight(df: np.ndarray, hit: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """How much a word's presence says about the label: its phi coefficient over the examples, 0 to 1 at every size."""
    spread = df * (n - df) * float(n_toxic) * (n - n_toxic)
    return np.abs(hit * float(n) - df * float(n_toxic)) / np.sqrt(np.where(spread > 0, spread, np.inf))


class Neighbours:
    """The block-max inverted index over the examples, and the votes' calibration.

    A posting list has the examples with a word, block by block; of each word and block the largest weight is kept.
    """

    def __init__(self, row: np.ndarray, word: np.ndarray, tf: np.ndarray, toxic: np.ndarray, ids: np.ndarray,
                 vocabulary: np.ndarray, df: np.ndarray, total: int):
        """Example, word and count of each entry; labels and doc_ids of the examples; all words in order and the documents with them."""
        toxic, self.block = toxic.astype(float), BLOCK
        self.base = float(toxic.mean()) if len(toxic) else 0.0
        self.vocabulary, size = vocabulary, np.zeros(len(toxic), np.int64)
        term = np.searchsorted(vocabulary, word)
        held = np.bincount(term, minlength=len(vocabulary)), np.bincount(term, toxic[row], minlength=len(vocabulary))
        self.idf = (np.log((1 + total) / (1 + df)) + 1) * label_weight(*held, len(toxic), int(toxic.sum()))
        w = (1 + np.log(tf)) * self.idf[term]
        norm = np.sqrt(np.bincount(row, w * w, minlength=len(size)))
        w = w / np.where(norm > 0, norm, 1)[row]
        # Examples without any word of weight have no direction; their rate is the score of such texts.
        some = norm > 0
        self.rate_without = float((toxic[~some].sum() + self.base) / ((~some).sum() + 1))
        # Examples with the same heaviest word share blocks, which keeps the bounds tight.
        heaviest = np.zeros(len(size), np.int64)
        by = np.lexsort((-w, row))
        first = np.flatnonzero(np.append(True, row[by][1:] != row[by][:-1])) if len(by) else by
        heaviest[row[by][first]] = term[by][first]
        order = np.lexsort((ids, heaviest))
        order = order[some[order]]
        place = np.full(len(size), -1, np.int64)
        place[order] = np.arange(len(order))
        self.toxic, self.ids = toxic[order], ids[order]
        use = (place[row] >= 0) & (w > 0)
        term, row, w = term[use], place[row[use]], w[use]
        whole = np.lexsort((term, row))
        whole = row[whole], term[whole], w[whole]
        # Posting lists of words that many examples hold are full rows, so that one product scores a batch of texts.
        frequent = np.flatnonzero(np.bincount(term, minlength=len(vocabulary)) * FULL_ROW > len(order))
        self.full = np.full(len(vocabulary), -1)
        self.full[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((len(frequent), len(order)))
        at = self.full[term]
        self.rows[at[at >= 0], row[at >= 0]] = w[at >= 0]
        term, row, w = term[at < 0], row[at < 0], w[at < 0]
        by = np.lexsort((row, term))
        term, self.row, self.w = term[by], row[by], w[by]
        new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (self.row[1:] // self.block != self.row[:-1] // self.block))) if len(term) else term
        self.part_start, self.part_size = new, np.diff(np.append(new, len(term)))
        self.part_block = self.row[new] // self.block
        self.part_most = np.maximum.reduceat(self.w, new) if len(new) else self.w
        self.start = np.searchsorted(term[new], np.arange(len(vocabulary)))
        self.size = np.searchsorted(term[new], np.arange(len(vocabulary)), "right") - self.start
        self.knots = None
        if len(order):
            raw = np.array([self.vote(i, s) for i, s in self.nearest(*whole, len(order), leave_own=True)])
            self.knots = _isotonic(raw, self.toxic)

    def nearest(self, text: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, leave_own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Example positions and cosines of the k best of each of n texts, the best first; text is in order.

        leave_own: the texts are the examples themselves, and none is a neighbour of its own.
        """
        full = self.full[term]
        for low in range(0, n, TEXTS):
            here = slice(*np.searchsorted(text, [low, low + TEXTS]))
            t, column, words, weights = text[here] - low, full[here], term[here], w[here]
            q = np.zeros((min(TEXTS, n - low), len(self.rows)))
            q[t[column >= 0], column[column >= 0]] = weights[column >= 0]
            t, words, weights = t[column < 0], words[column < 0], weights[column < 0]
            edge = np.searchsorted(t, np.arange(len(q) + 1))
            for k, s in enumerate(q @ self.rows):
                yield self._best(s, words[edge[k]:edge[k + 1]], weights[edge[k]:edge[k + 1]], low + k if leave_own else None)

    def _best(self, s: np.ndarray, terms: np.ndarray, weights: np.ndarray, leave: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The k best, given what frequent words add to each example.

        A block is opened if that and what the other words could add at most reach the k-th best so far.
        """
        def least() -> float:
            if leave is not None:
                s[leave] = 0
            return float(np.partition(s, -NEIGHBOURS)[-NEIGHBOURS]) - 1e-12 if len(s) > NEIGHBOURS else 0.0

        reach = least()
        size = self.size[terms]
        part = _expand(self.start[terms], size)
        weight, block = np.repeat(weights, size), self.part_block[part]
        more = np.bincount(block, weight * self.part_most[part], minlength=-(-len(s) // self.block))
        bound = np.maximum.reduceat(s, np.arange(0, len(s), self.block)) + more
        open_ = (more > 0) & (bound >= reach)
        first = np.flatnonzero(open_)
        first = first[np.argsort(-bound[first], kind="stable")[:FIRST_BLOCKS]]
        for turn in (0, 1):
            chosen = np.zeros(len(bound), bool)
            if turn:
                chosen |= open_ & (bound >= reach)
                chosen[first] = False
            else:
                chosen[first] = True
            hit = np.flatnonzero(chosen[block])
            if len(hit):
                k = self.part_size[part[hit]]
                cell = _expand(self.part_start[part[hit]], k)
                s += np.bincount(self.row[cell], np.repeat(weight[hit], k) * self.w[cell], minlength=len(s))
            reach = least()
        i = np.flatnonzero((s > 0) & (s >= reach))
        i = i[np.lexsort((i, -np.round(s[i], 12)))[:NEIGHBOURS]]
        return i, s[i]

    def vote(self, i: np.ndarray, s: np.ndarray) -> float:
        return float((s @ self.toxic[i] + PRIOR_WEIGHT * self.base) / (s.sum() + PRIOR_WEIGHT))

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int], list[float]]]:
        """Calibrated scores, and the nearest examples with their cosines as evidence."""
        out: list[tuple[float, list[int], list[float]]] = [(self.rate_without, [], [])] * len(texts)
        if self.knots is None:
            return out
        text, word, n = word_counts(texts)
        term = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
        w = np.where(self.vocabulary[term] == word, (1 + np.log(n)) * self.idf[term], 0)
        text, term, w = text[w > 0], term[w > 0], w[w > 0]
        w = w / np.sqrt(np.bincount(text, w * w))[text] if len(w) else w
        for k, (i, s) in enumerate(self.nearest(text, term, w, len(texts))):
            if len(i):
                out[k] = float(np.interp(self.vote(i, s), *self.knots)), self.ids[i[:3]].tolist(), s[:3].tolist()
        return out


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent means of y in order of x, as knots; the ends stay off 0 and 1."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # lowest x, highest x, sum of y, rows
    for a, b in zip(x[order], y[order]):
        if pools and pools[-1][1] == a:
            pools[-1][2] += b
            pools[-1][3] += 1
        else:
            pools.append([a, a, b, 1])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    at = np.array([v for p in pools for v in (p[0], p[1])])
    value = np.array([v for p in pools for v in [(p[2] + 0.5) / (p[3] + 1)] * 2])
    return at, np.maximum.accumulate(value)


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> Neighbours:
    """docs: doc_id, text; labels: doc_id, toxic. Rows whose crc32 of the doc_id is divisible by 5 are held out."""
    spark = docs.sparkSession
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = spark.createDataFrame(chosen.toPandas().astype("int64"), "doc_id long, toxic long")  # at most sample_rows pairs
    # Copies of one text, but for capitals and spaces, are one example.
    whole = F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256)
    # Minima instead of any row, so that a repeated run learns the same.
    sample = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).groupBy(
        whole.alias("whole"), "toxic").agg(
        F.min("doc_id").alias("doc_id"), F.min_by("text", "doc_id").alias("text")).select("doc_id", "text", "toxic").mapInArrow(
        _example_words, "doc_id long, toxic long, words array<long>, tf array<int>").orderBy("doc_id").toArrow()
    words = [sample[c].combine_chunks() for c in ("words", "tf")]
    row = np.repeat(np.arange(len(sample)), words[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    word, tf = (x.flatten().to_numpy(zero_copy_only=False) for x in words)
    word = np.ascontiguousarray(word, np.int64).view(np.uint64)
    vocabulary = np.unique(word)
    df, total = document_frequencies(docs, vocabulary) if len(sample) else (np.zeros(0), 0)
    return Neighbours(row, word, tf, sample["toxic"].to_numpy(), sample["doc_id"].to_numpy(), vocabulary, df, total)


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents that hold each word, over all documents, and the number of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One cell more for the number of documents.
        df = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            word = word_counts(batch.column(0).to_pylist())[1]
            term = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1) if len(vocabulary) else np.empty(0, np.int64)
            df += np.bincount(term[vocabulary[term] == word] if len(vocabulary) else term, minlength=len(df))
            df[-1] += batch.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "n"])

    # As many rows as words of the bounded sample.
    rows = docs.select("text").mapInArrow(giving_back(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(vocabulary) + 1)
    df[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return df[:-1], int(df[-1])


def held_out(doc_id) -> object:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence_ids, evidence_cosines."""
    small_batches(docs.sparkSession)
    docs = pick(docs, doc_id=id_col, text=text_col)
    model = fit(docs, pick(labels, doc_id=id_col, toxic=label_col), sample_rows=sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([x[0] for x in found], pa.float64()),
                pa.array([x[1] for x in found], pa.list_(pa.int64())),
                pa.array([x[2] for x in found], pa.list_(pa.float64()))],
                names=["doc_id", "score", "evidence_ids", "evidence_cosines"])

    scored = docs.mapInArrow(giving_back(run), "doc_id long, score double, evidence_ids array<long>, evidence_cosines array<double>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence_ids", "evidence_cosines")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    small_batches(docs.sparkSession)
    model = fit(pick(docs, doc_id=how.get("id_col", "doc_id"), text=text_col),
                pick(labels, doc_id=how.get("id_col", "doc_id"), toxic=how.get("label_col", "toxic")))

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for text in batches:
                yield pd.Series([x[0] for x in model.scores(list(text))], dtype="float64")
        finally:
            give_back()

    return docs.where(of(F.col(text_col)) < 0.5)
