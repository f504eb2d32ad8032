"""Benchmark decontamination with DataFrame functions only.

The word n-grams of the benchmark are a broadcast hash set (its size is counted first; a larger one is
joined by shuffle). Documents are scanned once: each position is looked up by a hash of the first words
of its window, and a hit counts only if the whole window equals the benchmark's words.

Defined cases: null or empty text has no words and is clean. An item of fewer words than the window, but
not none, is one window; an item without words is ignored. Repeated benchmark rows count once per item_id.
Rows that share doc_id and text give one result row; one doc_id with several texts gives one row each.
An empty benchmark leaves every document clean. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, maybe_broadcast, pick

#: What separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for text whose letters are not lower-cased yet.
_SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a window that the first lookup hashes.
LOOKUP_WORDS = 3
#: Most distinct benchmark windows that are broadcast.
BROADCAST_WINDOWS = 200_000


def words(text: Column) -> Column:
    found = F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def _lookup(first: Column, rest: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(rest)), first, *rest)


def benchmark_windows(bench: DataFrame, window: int) -> DataFrame:
    """One row per distinct window: its words, the lookup hash and the items that hold it."""
    w = bench.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    grams = w.select("item_id", "w", F.explode(starts).alias("i")).select(
        "item_id", F.slice("w", F.col("i"), F.lit(window)).alias("gram"))
    items = grams.groupBy("gram").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    g = [F.get("gram", F.lit(k)) for k in range(LOOKUP_WORDS)]
    key = reduce(lambda other, k: F.when(F.size("gram") == k, _lookup(g[0], g[1:k])).otherwise(other),
                 range(1, LOOKUP_WORDS), _lookup(g[0], g[1:]))
    return items.select(key.alias("key"), "gram", "items")


def contamination(docs: DataFrame, bench: DataFrame, *, window: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (merged, 0-based, end exclusive)."""
    docs, bench = pick(docs, doc_id=id_col, text=text_col), pick(bench, item_id=item_col, text=item_text_col)
    grams = benchmark_windows(bench, window)
    sizes = grams.agg(F.count("*"), F.sum(F.size("items")),
                      F.collect_set(F.least(F.size("gram"), F.lit(LOOKUP_WORDS)))).first()
    key_sizes = sorted(sizes[2]) or [LOOKUP_WORDS]
    document_row = docs.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("key"), F.lit(None).cast("array<string>").alias("gram"),
        F.lit(None).cast("array<string>").alias("items"))
    table = maybe_broadcast(grams.unionByName(document_row), sizes[0] + (sizes[1] or 0), BROADCAST_WINDOWS)

    # Position 0 stands for the document itself, so that one scan also gives the counts of clean documents.
    scanned = docs.select("doc_id", F.xxhash64("text").alias("of"),
                          F.concat(F.array(F.lit("")), words(F.col("text"))).alias("w"))
    at = scanned.select("doc_id", "of", "w", F.posexplode_outer("w").alias("p", "word"))
    p = F.col("p")
    keys = [_lookup(F.col("word"), [F.get("w", p + k) for k in range(1, n)]) for n in key_sizes]
    if len(keys) > 1:
        at = at.select("doc_id", "of", "w", "p", F.explode(
            F.when(p == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.array(*keys)))).alias("k"))
    else:
        at = at.select("doc_id", "of", "w", "p", F.when(p == 0, F.lit(0).cast("long")).otherwise(keys[0]).alias("k"))
    same = F.when(F.col("gram").isNull(), p == 0).otherwise(
        (p > 0) & (F.slice("w", p + 1, F.size("gram")) == F.col("gram")))
    hits = at.join(table, (F.col("k") == F.col("key")) & same).select(
        "doc_id", "of", F.when(p == 0, F.size("w") - 1).alias("n"),
        F.when(p > 0, F.struct((p - 1).alias("s"), (p - 1 + F.size("gram")).alias("e"))).alias("span"), "items")
    found = hits.groupBy("doc_id", "of").agg(
        F.max("n").cast("long").alias("n_words"), F.collect_set("span").alias("raw"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    empty = F.array().cast("array<struct<s:int,e:int>>")
    merged = F.aggregate(F.array_sort("raw"), empty, lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["s"] <= F.get(acc, F.size(acc) - 1)["e"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
            F.get(acc, F.size(acc) - 1)["s"].alias("s"),
            F.greatest(F.get(acc, F.size(acc) - 1)["e"], x["e"]).alias("e")))),
    ).otherwise(F.concat(acc, F.array(x))))
    found = found.select("doc_id", "of", "n_words", merged.alias("spans"), "items")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), "spans", "of")


def drop_contaminated(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                      **how) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    bad = contamination(docs, bench, id_col=id_col, text_col=text_col, **how).where("contaminated").select(
        F.col("doc_id").alias("__bad_id"), F.col("of").alias("__bad_of"))
    return docs.join(bad, docs[id_col].eqNullSafe(F.col("__bad_id"))
                     & (F.xxhash64(docs[text_col]) == F.col("__bad_of")), "left_anti")


def remove_spans(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 **how) -> DataFrame:
    """All documents, with the words of benchmark windows taken out; the text between words stays."""
    bad = contamination(docs, bench, id_col=id_col, text_col=text_col, **how).where("contaminated").select(
        F.col("doc_id").alias("__bad_id"), F.col("of").alias("__bad_of"), F.col("spans").alias("__spans"))
    both = docs.join(bad, docs[id_col].eqNullSafe(F.col("__bad_id"))
                     & (F.xxhash64(docs[text_col]) == F.col("__bad_of")), "left")
    own = F.array_remove(F.split(docs[text_col], _SEPARATORS_ANY_CASE), "")
    between = F.split(docs[text_col], _SEPARATORS_ANY_CASE.replace("[", "[^", 1))
    # A text that begins with a word has an empty piece before it, one that ends with a word one after it.
    kept = F.transform(own, lambda x, i: F.when(F.exists(
        "__spans", lambda s: (s["s"] <= i) & (i < s["e"])), F.lit("")).otherwise(x))
    text = F.concat(F.get(between, F.lit(0)), F.array_join(F.zip_with(
        kept, F.slice(between, F.lit(2), F.greatest(F.size(between) - 1, F.lit(0))),
        lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), ""))
    return both.select(*[(F.when(F.col("__spans").isNotNull(), text).otherwise(docs[c]) if c == text_col
                          else docs[c]).alias(c) for c in docs.columns])
