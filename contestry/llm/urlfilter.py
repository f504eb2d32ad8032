"""URL filter: rules by host suffix and path prefix, and naive Bayes on segmented names for the rest.

Words are learned from the distinct host labels and path tokens of all pages: frequent substrings start a
unigram model, one Viterbi pass over all names re-estimates it. Multinomial naive Bayes learns from the pages
that a rule decides: counts of hashed host words and path tokens. Models are bounded by their parameters
(words, buckets); the counts behind them cover every page.

Defined cases: a null url, or one without "://", has an empty host and path, no rule, and the method's verdict
on no tokens (the more frequent label). Equal odds allow. Repeated rows give a row each. Only the named columns
are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, pick, small_batches

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words of the unigram model, letters of its longest word, and buckets of the naive Bayes counts.
WORDS, LONGEST, BUCKETS = 20_000, 12, 1 << 15
_ALPHA = re.compile(r"[^\W\d_]+")


def parts(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return ascii_lower(host), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, like ``example.net/en/``, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def names_of(host: str, path: str) -> tuple[list[str], list[str]]:
    return _ALPHA.findall(host), [x.lower() for x in _ALPHA.findall(path)]


class Segmenter:
    """Best split of a name by a unigram model; unknown words cost more the longer they are."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.unknown = math.log(total) + 1
        self.known: dict[str, list[str]] = {}

    def split(self, name: str) -> list[str]:
        if name in self.known:
            return self.known[name]
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            options = []
            for start in range(max(0, end - LONGEST), end):
                c = self.cost.get(name[start:end])
                options.append((best[start] + (self.unknown + 2.3 * (end - start - 1) if c is None else c), start))
            cost, start = min(options)
            best.append(cost)
            back.append(start)
        out, end = [], len(name)
        while end:
            out.append(name[back[end]:end])
            end = back[end]
        if len(self.known) > 100_000:
            self.known.clear()
        self.known[name] = out[::-1]
        return out[::-1]


def _per_name(make) -> object:
    """Counts of what make(name) yields, summed per task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                counts.update(make(name))
            if len(counts) > 200_000:
                yield out()
                counts.clear()
        yield out()

    return run


def _top(names: DataFrame, make, weight: Column) -> dict[str, int]:
    rows = names.mapInArrow(_per_name(make), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in rows.where("n > 1").orderBy(weight.desc(), "word").limit(WORDS).collect()}


def _substrings(name: str) -> set[str]:
    return {name[i:j] for i in range(len(name)) for j in range(i + 2, min(i + LONGEST, len(name)) + 1)}


def fit_segmenter(names: DataFrame) -> Segmenter:
    """names: one column of distinct names."""
    first = _top(names, _substrings, F.col("n") * (F.length("word") - 1))
    return Segmenter(_top(names, Segmenter(first).split, F.col("n")) or first)


def _bucket(token: str) -> int:
    return xxhash.xxh32_intdigest(token.encode("utf-8", "replace")) % BUCKETS


def judge(pages: DataFrame, *, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, odds (log odds of block by the method; null where a rule decides)."""
    small_batches(pages.sparkSession, 4096)
    p = pick(pages, page_id=id_col, url=url_col)
    host, path = parts(F.col("url"))
    p = p.select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    p = p.select("*", rule.alias("rule"), ruled.alias("ruled"))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {x for h, q in zip(*(c.to_pylist() for c in batch.columns)) for y in names_of(h, q) for x in y}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["name"])

    model = fit_segmenter(p.select("host", "path").mapInArrow(names, "name string").distinct())

    def tokens(host: str, path: str) -> list[int]:
        labels, steps = names_of(host, path)
        return [_bucket("h:" + w) for x in labels for w in model.split(x)] + [_bucket("p:" + w) for x in steps for w in model.split(x)]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, pages = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for h, q, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                y = int(verdict == "block")
                pages[y] += 1
                np.add.at(counts[y], tokens(h, q), 1)
        y, k = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([y, [0, 1]]).astype(np.int32)), pa.array(np.concatenate([k, [-1, -1]]).astype(np.int32)),
            pa.array(np.concatenate([counts[y, k], pages]))], names=["label", "bucket", "n"])

    # At most two rows per bucket and two for the labels come to the driver.
    rows = p.where("ruled is not null").select("host", "path", "ruled").mapInArrow(
        learn, "label int, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).collect()
    counts, seen = np.ones((2, BUCKETS)), np.ones(2)
    for r in rows:
        if r["bucket"] < 0:
            seen[r["label"]] += r["n"]
        else:
            counts[r["label"], r["bucket"]] += r["n"]
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    prior = float(np.log(seen[1] / seen[0]))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = [None if v is not None else prior + float(ratio[tokens(h, q)].sum()) if h or q else prior
                    for h, q, v in zip(*(batch.column(k).to_pylist() for k in (1, 2, 4)))]
            verdict = [v or ("block" if o > 0 else "allow") for v, o in zip(batch.column(4).to_pylist(), odds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdict, pa.string()), pa.array(odds, pa.float64())],
                                             names=["page_id", "host", "path", "rule", "verdict", "odds"])

    return p.mapInArrow(decide, "page_id long, host string, path string, rule string, verdict string, odds double")
