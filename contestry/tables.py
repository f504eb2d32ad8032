"""Tables written between steps, and places of rows in an order, without any group in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where the session names none."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        path = f"file://{tempfile.mkdtemp(prefix='contestry-')}"
        sc.setCheckpointDir(path)
    return path


def written(df: DataFrame, *by: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: computed once, and a lost executor costs no recomputation.

    by: columns whose values have a folder each, so that their rows are read alone; their names must be the last ones.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to as many tasks as shuffles have, for work that is much for each row.

    Spark sizes tasks by bytes, also when it joins small ones after a shuffle, unless the number is stated.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def dealt(df: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by their group and an order, written, with __g (group), __part and __at.

    A large group is spread over many parts. __at grows along the order; equal rows may stand either way round.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    df = df.withColumn("__g", group)
    ranged = df.repartitionByRange(*([parts] if parts else []), "__g", *order).sortWithinPartitions("__g", *order)
    return written(ranged.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33).cast("int")))


def numbered(df: DataFrame, by: list[str], order: list[str], place: str = "place", size: str | None = None) -> DataFrame:
    """Each row's place (0, 1, ...) in the order of its group, and if asked the group's rows.

    Places are counted inside the parts of a range-partitioned sort and moved by the rows of the parts before; only
    a row for each part of a group meets its like. Null groups are groups.
    """
    rows = dealt(df, by, order)
    parts = rows.groupBy("__g", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    group = Window.partitionBy("__g")
    before = F.sum("__n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    moves = parts.select("__g", "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__move"), F.sum("__n").over(group).alias("__size"))
    out = rows.join(moves, ["__g", "__part"]).withColumn(place, F.col("__at") + F.col("__move"))
    return (out.withColumn(size, F.col("__size")) if size else out).drop("__g", "__part", "__at", "__move", "__size")


def running_before(df: DataFrame, by: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """The sum of a column over the rows of the group that stand before a row; sums of parts are carried on as in ``numbered``."""
    rows = dealt(df, by, order)
    parts = rows.groupBy("__g", "__part").agg(F.sum(column).alias("__sum"))
    ahead = lambda w: F.coalesce(w, F.lit(0))
    earlier = F.sum("__sum").over(Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.sum(column).over(Window.partitionBy("__g", "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("__inside", ahead(inside)).join(parts.select("__g", "__part", ahead(earlier).alias("__earlier")), ["__g", "__part"])
    return out.withColumn(name, F.col("__inside") + F.col("__earlier")).drop("__g", "__part", "__at", "__inside", "__earlier")
