"""MinHash near-duplicate detection with HyperMinHash registers.

A document is the set of its word shingles. Equal sets are one class. Each class has a HyperMinHash sketch:
shingle hashes are dealt to buckets, and a bucket keeps the leading-zero count and some mantissa bits of its
smallest hash. Bands of registers are the keys of the candidate search. Each member of a band is paired with
the smallest member and with its neighbour in order, never with all others; a collision-corrected estimate of
the Jaccard similarity thins the pairs and the full texts confirm them. Where members of one band are in
different components after that, the pairs across components are tried as well, in blocks, so that no link
which could join two components is left out. All decisions carry over to every copy.

Defined cases: null or empty text has no shingles and links with nothing; fewer words than a shingle make
one shingle of the whole sequence. Repeated rows and doc_ids give one row each. An empty table gives an empty
result. Null doc_ids stay alone, with a null component. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, giving_back, maybe_broadcast, pick, settled, small_batches
from .components import components

#: Registers of a sketch, registers of a band, and mantissa bits of a register.
REGISTERS, BAND, MANTISSA = 160, 5, 10
#: Estimates lower than the threshold by more than so many standard errors are dropped.
ERRORS = 3.5
#: Smallest shingle hashes kept beside the registers; a set of no more is kept whole.
LOW = 512
#: Members of a band that are compared across components at once.
BLOCK = 1024


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(words: list[bytes], size: int, cache: _Hashes) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, in order."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = max(len(words) - size + 1, 1)
    out = np.full(n, min(size, len(words)), np.uint64)
    for k in range(min(size, len(words))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n])
    return np.unique(out)


def _orders(registers: int) -> np.ndarray:
    """For each register a fixed random order of all, from which an empty one borrows."""
    draw = np.random.default_rng(11)
    return np.stack([draw.permutation(registers) for _ in range(registers)])


def sketch(hashes: np.ndarray, registers: int, orders: np.ndarray) -> np.ndarray:
    """Registers of leading zeros and mantissa bits; an empty bucket borrows from the next filled one of its order."""
    bucket = (hashes % np.uint64(registers)).astype(np.int64)
    value = _mix(hashes + np.uint64(0x632BE59BD9B4E019))
    least = np.full(registers, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bucket, value)
    filled = np.zeros(registers, bool)
    filled[bucket] = True
    # The leading one of the value sets the exponent; the bits after it are the mantissa.
    top = least >> np.uint64(12)
    exponent = np.frexp(np.maximum(top, 1).astype(np.float64))[1]
    zeros = (52 - exponent).astype(np.int64)
    shift = np.maximum(exponent - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = ((top >> shift) & np.uint64((1 << MANTISSA) - 1)).astype(np.int64)
    out = ((zeros << MANTISSA) | mantissa).astype(np.uint16)
    if not filled.all():
        empty = np.flatnonzero(~filled)
        source = orders[empty]
        first = filled[source].argmax(axis=1)
        out[empty] = out[source[np.arange(len(empty)), first]]
    return out


def jaccard_estimate(equal: np.ndarray, registers: int) -> np.ndarray:
    """Share of equal registers, less what chance alone makes equal."""
    # Two unequal minima share an exponent with odds of 1/3 and then a mantissa with odds of 2^-MANTISSA.
    chance = 1 / 3 / 2**MANTISSA
    return np.clip((equal / registers - chance) / (1 - chance), 0, 1)


def least_estimate(n: np.ndarray, threshold: float, registers: int) -> np.ndarray:
    """The estimate that a pair needs; n: shingles of the smaller set, which fill so many buckets on average."""
    filled = registers * -np.expm1(-np.maximum(n, 1) / registers)
    return threshold - ERRORS * np.sqrt(threshold * (1 - threshold) / filled)


def _sketches(size: int, registers: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, orders = _Hashes(), _orders(registers)
        for batch in batches:
            n, sets, regs, low = [], [], [], []
            for text in batch.column(1).to_pylist():
                h = shingle_hashes(words_of(text), size, cache)
                n.append(len(h))
                sets.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                regs.append(sketch(h, registers, orders).tobytes() if len(h) else None)
                low.append((h[:LOW] >> np.uint64(32)).astype(np.uint32).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(regs, pa.binary()),
                pa.array(low, pa.binary())], names=["doc_id", "n_shingles", "set_hash", "registers", "low"])

    return run


def _band_keys(regs: np.ndarray, band: int) -> np.ndarray:
    n = regs.shape[1] // band
    key = np.broadcast_to(np.arange(n, dtype=np.uint64), (len(regs), n)).copy()
    for k in range(band):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, k::band][:, :n].astype(np.uint64))
    return key


def _bands(registers: int, band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            if not len(ids):
                continue
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(ids), registers)
            key = _band_keys(regs, band)
            yield pa.RecordBatch.from_arrays([
                pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(ids, key.shape[1]))], names=["band", "rep"])

    return run


def _estimate(registers: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, registers) for k in (2, 3))
            least = least_estimate(np.asarray(batch.column(4)), threshold, registers)
            keep = jaccard_estimate((x == y).sum(axis=1), registers) >= least
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shingles(text):
            w = words_of(text)
            return set(zip(*(w[k:] for k in range(size)))) if len(w) >= size else {tuple(w)} if w else set()

        last, kept = None, set()
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if ta != last:
                    last, kept = ta, shingles(ta)
                other = shingles(tb)
                both = len(kept & other)
                keep.append(both > 0 and 100 * both >= percent * (len(kept) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


class _LowHashes:
    """Jaccard similarity by the smallest hashes: exact where both sets are whole, else with its standard error."""

    def __init__(self, packed: list[bytes], n: np.ndarray):
        self.sets = [np.frombuffer(x, np.uint32) for x in packed]
        self.size = np.array([len(x) for x in self.sets])
        self.values = np.concatenate(self.sets)
        self.start = np.cumsum(self.size) - self.size
        _, self.number = np.unique(self.values, return_inverse=True)
        self.mark = np.zeros(len(self.values) and self.number.max() + 1, bool)
        # All hashes up to here are known; a whole set knows them all.
        self.known = np.where(n <= LOW, 2**32, [int(x[-1]) for x in self.sets])

    def possible(self, i: int, other: np.ndarray, threshold: float) -> np.ndarray:
        own = self.number[self.start[i]:self.start[i] + self.size[i]]
        self.mark[own] = True
        cells = np.concatenate([np.arange(self.start[k], self.start[k] + self.size[k]) for k in other])
        begin = np.cumsum(self.size[other]) - self.size[other]
        upto = np.minimum(self.known[i], self.known[other])
        limit = np.repeat(upto, self.size[other])
        both = np.add.reduceat((self.mark[self.number[cells]] & (self.values[cells] <= limit)).astype(np.int64), begin)
        theirs = np.add.reduceat((self.values[cells] <= limit).astype(np.int64), begin)
        self.mark[own] = False
        union = np.searchsorted(self.sets[i], upto, "right") + theirs - both
        error = np.where(upto == 2**32, 1e-9, ERRORS * np.sqrt(threshold * (1 - threshold) / union))
        return both / union >= threshold - error


def _across(registers: int, band: int, threshold: float):
    """Pairs of one block pair of a band that lie in different components and that can be similar enough.

    A pair that shares several bands comes out in the first of them only.
    """
    def run(key, table):
        ids, comp, n = (table.column(c).to_numpy() for c in ("rep", "component", "n"))
        regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, registers)
        low, bands = _LowHashes(table.column("low").to_pylist(), n), _band_keys(regs, band)
        this = int((bands[0].view(np.int64) == key[0].as_py()).argmax())
        half, a, b = table.column("half").to_numpy(), [], []
        left, right = (np.flatnonzero(half == k) for k in (0, 1))
        own = not len(right)
        for at, i in enumerate(left):
            other = left[at + 1:] if own else right
            other = other[comp[other] != comp[i]]
            other = other[(bands[other] == bands[i]).argmax(axis=1) == this]
            equal = (regs[other] == regs[i]).sum(axis=1)
            other = other[jaccard_estimate(equal, registers) >= least_estimate(np.minimum(n[i], n[other]), threshold, registers)]
            if len(other):
                other = other[low.possible(i, other, threshold)]
            a.append(np.minimum(ids[i], ids[other]))
            b.append(np.maximum(ids[i], ids[other]))
        none = np.empty(0, np.int64)
        return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    return run


def named(found: DataFrame, key: str, value: str) -> DataFrame:
    return found.select(F.col("id").alias(key), F.col("component").alias(value))


class _Confirmer:
    """Checks candidate pairs of class representatives against registers and then full texts."""

    def __init__(self, docs: DataFrame, reps: DataFrame, size: int, threshold: float, registers: int):
        self.docs, self.reps, self.size, self.registers = docs, reps, size, registers
        self.threshold = threshold

    def __call__(self, pairs: DataFrame, estimated: bool) -> DataFrame:
        return settled(lambda: self._confirmed(pairs, estimated))

    def _confirmed(self, pairs: DataFrame, estimated: bool) -> DataFrame:
        if not estimated:
            def side(x):
                return self.reps.select(F.col("rep").alias(x), F.col("registers").alias(f"r{x}"), F.col("n").alias(f"n{x}"))

            pairs = pairs.join(side("a"), "a").join(side("b"), "b").select(
                "a", "b", "ra", "rb", F.least("na", "nb").alias("n"))
            pairs = pairs.mapInArrow(giving_back(_estimate(self.registers, self.threshold)), "a long, b long")
        pairs = cut(pairs)
        ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
        # The texts of candidates only; where the identifiers are few enough they go to every task.
        texts = cut(self.docs.join(maybe_broadcast(ids, ids.count()), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
        both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(
            texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
        return both.mapInArrow(giving_back(_confirm(self.size, round(100 * self.threshold))), "a long, b long")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, threshold: float = 0.8, id_col: str = "doc_id",
                    text_col: str = "text", registers: int = REGISTERS, band: int = BAND) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    docs = pick(docs, doc_id=id_col, text=text_col)
    sketches = cut(docs.mapInArrow(giving_back(
        _sketches(shingle, registers)), "doc_id long, n_shingles long, set_hash binary, registers binary, low binary"))
    sets = sketches.where("set_hash is not null and doc_id is not null")
    reps = cut(sets.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("registers").alias("registers"),
                                            F.max("n_shingles").alias("n")))
    bands = reps.select("rep", "registers").mapInArrow(_bands(registers, band), "band long, rep long")

    # Bands with one member are gone after this; what stays has the first member beside each member.
    firsts = bands.groupBy("band").agg(F.min("rep").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = cut(bands.join(firsts, "band").select("band", "rep", "first"))
    before = F.lag("rep").over(Window.partitionBy("band", "part").orderBy("rep"))
    near = shared.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(32))).select(F.col("rep").alias("b"), before.alias("a"))
    pairs = shared.select(F.col("first").alias("a"), F.col("rep").alias("b")).unionByName(
        near.where("a is not null").select("a", "b")).where("a <> b").distinct()
    confirm = _Confirmer(docs, reps, shingle, threshold, registers)
    links = confirm(pairs, estimated=False)
    tried = pairs
    found = settled(lambda: components(links))

    # Bands whose members are still in different components.
    at = shared.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
        "band", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = at.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
    mixed = mixed.where("lo < hi and n > 2").select("band", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    sketched = sets.select(F.col("doc_id").alias("rep"), "registers", "low", F.col("n_shingles").alias("size")).dropDuplicates(["rep"])
    members = at.join(mixed, "band").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).join(
        sketched, "rep")
    dealt = members.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("half"), "rep", "component", "registers", "low", F.col("size").alias("n"))
    more = dealt.groupBy("band", "i", "j").applyInArrow(_across(registers, band, threshold), "a long, b long")
    more = cut(more.distinct().join(tried, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        # Components merge over the graph of components, which is far smaller than that of documents.
        over = confirm(more, estimated=True).join(named(found, "a", "ca"), "a", "left").join(named(found, "b", "cb"), "b", "left")
        merged = settled(lambda: components(over.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))))
        whole = reps.select(F.col("rep").alias("id")).join(found, "id", "left").select("id", F.coalesce("component", "id").alias("was"))
        found = cut(whole.join(named(merged, "was", "now"), "was", "left").select("id", F.coalesce("now", "was").alias("component")))
    classes = reps.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
        "set_hash", F.coalesce("component", "rep").alias("component"))
    out = sketches.join(classes, "set_hash", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """All columns of one document per class, that with the smallest identifier."""
    dropped = settled(lambda: near_duplicates(docs, id_col=id_col, **how).where("not kept").select(F.col("doc_id").alias("__drop")).distinct())
    return docs.join(dropped, docs[id_col] == F.col("__drop"), "left_anti")
