"""Embedding near-duplicates by sorted projection passes.

In each pass vectors are ordered by a string of random hyperplane signs, as a number, and each is compared
with a bounded window of neighbours in that order. Pairs of high enough cosine link; links of all passes are
united. Inside the components found so, links are then counted in blocks, so a dense group has its full count
although only windows were searched; pairs themselves are never written out there.

Passes come in rounds, each with hyperplanes of its own, as many as the data ask for: what a round finds and all
before it had missed is, as with marked and recaptured animals, about the share that they missed. Rounds go on until
that share is at most ``missed``, both over all links of the round and as a mean over components, so a large
group can't hide that pairs elsewhere are new. Uniform vectors need two or three rounds, dense topics many.

Defined cases: null, zero or non-finite vectors and null identifiers link with nothing, vectors only with others of
their length. Repeated vec_ids count as vectors of their own; their components are one, as one identifier reaches what
any of its vectors links with. An empty table gives an empty result. Labels and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, pick, small_batches
from .components import components

#: Passes of a round, sign bits of an order, neighbours on either side, rows of a comparison block, and the seed.
PASSES, BITS, WINDOW, ROWS, SEED = 12, 60, 80, 4000, 20
#: Rounds go on while the last one finds that more than this share of links were missed before it.
MISSED = 0.02
#: Members of a component that are counted against as many others at once.
BLOCK = 2048


def _units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows, of one length, in double precision; scaling by the largest part first keeps extreme lengths finite."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(passes: range):
    """For each pass the signs of a vector's random projections, as one integer."""
    weights = np.left_shift(np.int64(1), np.arange(BITS - 1, -1, -1, dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(1))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = _units(part.column(2))
                for k in passes:
                    planes = np.random.default_rng([SEED, k, dim]).standard_normal((BITS, dim))
                    yield pa.RecordBatch.from_arrays([
                        part.column(0), part.column(1), pa.array(np.full(len(x), k, np.int32)), pa.array((x @ planes.T > 0) @ weights)],
                        names=["row", "dim", "pass", "key"])

    return run


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches over the links."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _windows(window: int, cosine: float):
    """A spanning forest of the links found in one block: as many rows as vectors at most."""
    def run(key, table):
        table = table.sort_by([("pos", "ascending")])
        dims, parts = table.column("dim").to_numpy(), []
        cuts = np.flatnonzero(np.diff(dims, prepend=-1))
        for start, end in zip(cuts, [*cuts[1:], len(dims)]):
            part = table.slice(start, end - start)
            x, row, own = _units(part.column("vector")), part.column("row").to_numpy(), part.column("own").to_numpy()
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for k in range(1, min(window, len(x) - 1) + 1):
                # A pair belongs to the block that owns its earlier row.
                near = np.flatnonzero((np.einsum("ij,ij->i", x[:-k], x[k:]) >= cosine) & own[:-k])
                a.append(near)
                b.append(near + k)
            label = _forest(len(x), np.concatenate(a), np.concatenate(b))
            child = np.flatnonzero(label != np.arange(len(x)))
            parts.append(pa.table({"a": row[label[child]], "b": row[child]}))
        return pa.concat_tables(parts)

    return run


def _counts(cosine: float):
    """For each row of the first half, how many of the second half (or of its own) link with it."""
    def run(key, table):
        x, row, half = _units(table.column("vector")), table.column("row").to_numpy(), table.column("half").to_numpy()
        left, right = np.flatnonzero(half == 0), np.flatnonzero(half == 1)
        n = np.zeros(len(x), np.int64)
        if key[1].as_py() == key[2].as_py():
            n[left] = _linked(x[left], x[left], cosine).sum(axis=1) - 1
        else:
            hit = _linked(x[left], x[right], cosine)
            n[left], n[right] = hit.sum(axis=1), hit.sum(axis=0)
        return pa.table({"row": row, "n": n})

    return run


def _linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    return x @ y.T >= cosine


def _links(good: DataFrame, passes: range, window: int, cosine: float) -> DataFrame:
    """a, b: rows that some pass brought together and that link."""
    # Global positions: rows are dealt in ranges of (pass, length, key), then counted per range.
    order = ["pass", "dim", "key", "row"]
    keyed = good.mapInArrow(_keys(passes), "row long, dim int, pass int, key long")
    ranged = cut(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "row", "pass", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("i")))
    # One count per range, that is per task, comes to the driver.
    offsets, at = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()):
        offsets.append((part, at))
        at += n
    starts = good.sparkSession.createDataFrame(offsets, "part int, start long")
    placed = ranged.join(F.broadcast(starts), "part").select("row", "pass", (F.col("start") + F.col("i")).alias("pos"))
    first = F.floor(F.col("pos") / ROWS)
    # The last block also takes the next block's first rows, as neighbours only.
    dealt = placed.select("row", "pass", "pos", F.explode(F.array_distinct(F.array(
        first, F.floor((F.col("pos") - window) / ROWS)))).alias("block"), first.alias("home"))
    dealt = dealt.where("block >= 0").withColumn("own", F.col("block") == F.col("home"))
    return cut(dealt.join(good, "row").groupBy("pass", "block").applyInArrow(
        _windows(window, cosine), "a long, b long").distinct())


def _edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("component").alias("a"), F.col("id").alias("b"))


def _named(links: DataFrame, found: DataFrame) -> DataFrame:
    """Links with the components of their ends so far, an end without one being its own, and the group that a link counts for."""
    for x in ("a", "b"):
        links = links.join(found.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}")), x, "left")
    return links.select("a", "b", F.coalesce("of_a", "of_b", "a").alias("group"),
                        F.coalesce("of_a", "a").alias("ca"), F.coalesce("of_b", "b").alias("cb"))


def _missed(named: DataFrame) -> float:
    """The share of a round's links that join what was apart before it: over all of them, or as a mean over groups if that is more."""
    each = named.groupBy("group").agg(F.count_if(F.col("ca") != F.col("cb")).alias("new"), F.count("*").alias("all"))
    shares = each.agg(F.sum("new") / F.sum("all"), F.avg(F.col("new") / F.col("all"))).first()
    return max(x or 0.0 for x in shares)


def _found(good: DataFrame, passes: int, window: int, cosine: float, missed: float) -> DataFrame:
    """id, component of the rows with links, after as many rounds as it takes."""
    found = cut(components(_links(good, range(passes), window, cosine)))
    turn, share = 0, 1.0
    while share > missed:
        turn += 1
        named = cut(_named(_links(good, range(turn * passes, (turn + 1) * passes), window, cosine), found))
        share = _missed(named)
        if share:
            # Components merge over the graph of components, which gets small.
            merged = components(named.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
            ends = named.where("ca <> cb").select(F.explode(F.array("ca", "cb")).alias("id")).distinct().select("id", F.col("id").alias("component"))
            was = found.union(ends.join(found, "id", "left_anti")).withColumnRenamed("component", "was")
            found = cut(was.join(merged.select(F.col("id").alias("was"), F.col("component").alias("now")), "was", "left").select(
                "id", F.coalesce("now", "was").alias("component")))
    return found


def near_vectors(vectors: DataFrame, *, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding",
                 passes: int = PASSES, window: int = WINDOW, missed: float = MISSED) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    small_batches(vectors.sparkSession)
    v = pick(vectors, vec_id=id_col, vector=vector_col)
    fine = (F.coalesce(F.size("vector"), F.lit(0)) > 0) & F.forall("vector", lambda e: F.coalesce(
        (~F.isnan(e)) & (F.abs(e.cast("double")) < float("inf")), F.lit(False))) & F.exists("vector", lambda e: e != 0)
    fine = F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()
    v = cut(v.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector",
                     F.when(fine, F.size("vector")).otherwise(0).alias("dim")))
    good = v.where("dim > 0").select("row", "dim", "vector")
    if good.isEmpty():
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                        F.lit(True).alias("kept"))
    found = _found(good, passes, window, cosine, missed)

    # Full counts inside the components, in blocks of a bounded size.
    sizes = found.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = found.join(sizes, "component").withColumnRenamed("id", "row").join(good, "row").withColumn(
        "block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    pairs = members.select("component", "block", "row", "vector", F.explode(
        F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("half"), "row", "vector")
    counts = pairs.groupBy("component", "i", "j").applyInArrow(
        _counts(cosine), "row long, n long").groupBy("row").agg(F.sum("n").alias("n_links"))

    # Components are of rows; rows of one identifier are in one.
    repeated = cut(v.where("vec_id is not null").groupBy("vec_id").agg(F.min("row").alias("a"), F.count("*").alias("n")).where("n > 1").select("vec_id", "a"))
    n = repeated.count()
    if n:
        same = v.select("row", "vec_id").join(maybe_broadcast(repeated, n), "vec_id").select("a", F.col("row").alias("b"))
        found = cut(components(_edges(found).union(same)))
    named = v.select("row", "vec_id").join(found.withColumnRenamed("id", "row"), "row", "left").join(counts, "row", "left")
    named = cut(named.select("row", "vec_id", F.coalesce("component", "row").alias("component"),
                             F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return named.join(least, "component").select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
