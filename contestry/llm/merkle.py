"""Merkle manifest of a table: a digest per row, a root per group, one root of all, and a proof for every row.

Rows of a group stand in order of their identifier. Level by level, windows over blocks of positions give each node
its run of eight as lag and lead columns at the fixed offsets 1 to 7, masked by the node's slot and the length of the
run; the first node of a run hashes the parent. The roots of groups are the leaves of a last tree of the same kind.
Proofs come down again by joins of a node with its parent, so a parent's path is built once for all below it.

Positions are those of a range-partitioned sort with counted offsets, and a window holds at most ``BLOCK`` nodes, so
a group of any size is spread over all tasks. Text is read once; afterwards only digests move.

Defined cases: null fields are ``-``; a null identifier comes first, a null group is a group of its own and comes
first. Rows that share an identifier are ordered by their digest; equal rows each have a leaf. A group of one row has
its leaf as root. An empty table has no rows. Texts of any length are hashed whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, pick

#: Children of a node; positions in one window, a power of the fanout.
FANOUT, BLOCK = 8, 512
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, start, lambda node, at: F.sha2(F.concat(at["left"], node, at["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a proof in one string, level by level, left to right."""
    return F.array_join(F.transform(path, lambda at: F.concat(at["left"], at["right"])), "")


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows of g, h and others with pos and size: their place in the order of their group g, and its rows."""
    dealt = cut(rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn(
        "at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    runs = dealt.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    group = Window.partitionBy("g")  # a row for each partition of a group
    before = F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut(runs.select("g", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(group).alias("size")))
    return dealt.join(starts, ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _with_runs(nodes: DataFrame) -> DataFrame:
    """left and right: the digests of a node's run before and after it."""
    here = Window.partitionBy("g", "block").orderBy("pos")
    slot = F.col("pos") % FANOUT
    run = F.least(F.lit(FANOUT), F.col("size") - F.col("pos") + slot)
    left = [F.when(slot >= k, F.lag("h", k).over(here)).otherwise("") for k in range(FANOUT - 1, 0, -1)]
    right = [F.when(slot + k < run, F.lead("h", k).over(here)).otherwise("") for k in range(1, FANOUT)]
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).withColumns(
        {"left": F.concat(*left), "right": F.concat(*right)}).drop("block")


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every level with their runs, and g, level, top: the level and digest of each group's root."""
    levels, tops = [], []
    most = nodes.agg(F.max("size")).first()[0] or 0
    while True:
        tops.append(nodes.where("size = 1").select("g", F.lit(len(levels)).alias("level"), F.col("h").alias("top")))
        if most <= 1:
            break
        levels.append(_with_runs(nodes.where("size > 1")))
        nodes = cut(levels[-1].where(F.col("pos") % FANOUT == 0).select(
            "g", F.floor(F.col("pos") / FANOUT).alias("pos"), F.ceil(F.col("size") / FANOUT).alias("size"),
            F.sha2(F.concat("h", "right"), 256).alias("h")))
        most = -(-most // FANOUT)
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return levels, cut(out)


def _descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Leaves with the columns of their group's row of tops (level, path and others); the path starts at the leaf."""
    given = [c for c in tops.columns if c not in ("g", "level", "path")]
    root = lambda level: tops.where(F.col("level") == level).select("g", F.lit(0).cast("long").alias("pos"), "path", *given)
    above = root(len(levels))
    for level in reversed(range(len(levels))):
        up = above.select("g", F.col("pos").alias("up"), F.col("path").alias("above"), *given)
        step = F.array(F.struct("left", "right"))
        nodes = levels[level].withColumn("up", F.floor(F.col("pos") / FANOUT)).join(up, ["g", "up"]).withColumn(
            "path", F.concat(step, "above")).drop("up", "above", "left", "right", "size")
        if not level:
            return nodes
        above = nodes.drop("h").unionByName(root(level))
    raise ValueError("no level")


def _tree(rows: DataFrame, order: list[str]) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    nodes = _numbered(rows, order)
    return nodes, *_climb(nodes)


def _proofs(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Every leaf with its path; groups of one leaf have their root's."""
    alone = nodes.where("size = 1").drop("size").join(tops.where("level = 0").drop("level"), "g")
    return _descend(levels, tops).unionByName(alone) if levels else alone


def manifest(rows: DataFrame, *, id_col: str = "doc_id", group_col: str = "lang", leaf_col: str = "leaf", extra: tuple[str, ...] = ()) -> DataFrame:
    """Identifier, group, leaf, subroot, root and path (array of left and right siblings from the leaf up) of every row.

    rows have their leaf digests; the columns of ``extra`` are carried along.
    """
    held = {f"x{k}": c for k, c in enumerate(extra)}
    rows = pick(rows, id=id_col, grp=group_col, h=leaf_col, **held)
    # Null sorts before all, and a string by its bytes.
    rows = cut(rows.withColumn("g", F.coalesce(F.concat(F.lit("1"), F.col("grp").cast("string")), F.lit("0"))))
    nodes, levels, tops = _tree(rows, ["id", "h"])
    outer, above, root = _tree(tops.select(F.lit("").alias("g"), F.col("g").alias("key"), F.col("top").alias("h")), ["key"])
    root = root.select("g", "level", F.col("top").alias("root"), F.expr(f"CAST(array() AS {_PATH})").alias("path"))
    outer = cut(_proofs(outer, above, root).select(F.col("key").alias("g"), "root", "path"))
    tops = cut(tops.withColumnRenamed("top", "subroot").join(outer, "g"))
    out = _proofs(nodes, levels, tops)
    return out.select(F.col("id").alias(id_col), F.col("grp").alias(group_col), F.col("h").alias(leaf_col), "subroot", "root", "path",
                      *[F.col(c).alias(old) for c, old in held.items()])


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of documents, and whether proofs notice rows whose text was changed to small letters.

    doc_id, leaf, subroot, root, path, changed_leaf (null for rows left alone), folded_root, verified.
    """
    docs = pick(docs, **{c: c for c in FIELDS})
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(touched, leaf(*[ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]))
    rows = docs.select("doc_id", "lang", leaf(*[F.col(c) for c in FIELDS]).alias("leaf"), changed.alias("changed_leaf"))
    out = manifest(rows, extra=("changed_leaf",))
    out = out.withColumn("folded_root", fold(F.coalesce("changed_leaf", "leaf"), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).drop("lang")


def verify(docs: DataFrame, published: DataFrame) -> DataFrame:
    """doc_id, verified: rows of documents against the proofs of a published manifest; rows it lacks are not verified.

    Identifiers that the manifest has several times are verified if any of their proofs holds.
    """
    rows = pick(docs, **{c: c for c in FIELDS}).select("doc_id", leaf(*[F.col(c) for c in FIELDS]).alias("h"))
    proofs = published.select("doc_id", "root", "path")
    both = rows.join(proofs, "doc_id", "left").withColumn("ok", F.coalesce(fold(F.col("h"), F.col("path")) == F.col("root"), F.lit(False)))
    return both.groupBy("doc_id", "h").agg(F.max("ok").alias("verified")).drop("h")
