"""Symmetric isotonic calibration as pools that merge in any order, so that no step sorts all rows in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import numbered, written
from .temporal import asof

#: Pools that a task merges in one round.
POOLS = 1 << 18
_FIELDS = "lo double, hi double, total double, weight double, part int"


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjacent pools whose means do not rise become one, until all rise; rows come in order of lo."""
    from pyspark import TaskContext

    part, pools = TaskContext.get().partitionId(), []
    for batch in batches:
        for lo, hi, total, weight in zip(*(batch.column(k).to_pylist() for k in range(4))):
            while pools and pools[-1][2] * weight >= total * pools[-1][3]:
                last = pools.pop()
                lo, total, weight = last[0], last[2] + total, last[3] + weight
            pools.append((lo, hi, total, weight))
    columns = list(zip(*pools)) or [[]] * 4
    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in columns), pa.array([part] * len(pools), pa.int32())],
                                     names=["lo", "hi", "total", "weight", "part"])


def _falls(pools: DataFrame) -> int:
    """Borders of parts at which the mean does not rise; one row for each part."""
    mean = F.col("total") / F.col("weight")
    ends = pools.groupBy("part").agg(F.min("lo").alias("lo"), F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"))
    before = F.lag("last").over(Window.orderBy("lo"))
    return ends.select((before >= F.col("first")).cast("int").alias("falls")).agg(F.coalesce(F.sum("falls"), F.lit(0))).first()[0]


def fit(df: DataFrame, p: str, y: str = "actual_a_won", symmetric: bool = True, pools: int = POOLS) -> DataFrame:
    """The rising step function nearest to the outcomes: lo, hi, value and weight of each pool.

    Every row counts for both sides, so that f(p) + f(1 - p) = 1. Equal predictions are one pool from the start. Parts
    of a range-partitioned order pool their own neighbours; then the order is cut elsewhere, until the means rise over
    all borders. The result of pooling does not depend on the order of its steps. Rows with nulls do not count.
    """
    rows = df.select(F.col(p).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    if symmetric:
        rows = rows.union(rows.select(1 - F.col("x"), 1 - F.col("y")))
    at = rows.groupBy("x").agg(F.sum("y").alias("total"), F.count("*").cast("double").alias("weight"))
    found = at.select("x", F.col("x").alias("hi"), "total", "weight").toDF("lo", "hi", "total", "weight")
    parts, turn = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 0
    while True:
        found = written(found.repartitionByRange(parts, "lo").sortWithinPartitions("lo").mapInArrow(_pooled, _FIELDS))
        if parts == 1 or not _falls(found):
            return found.select("lo", "hi", (F.col("total") / F.col("weight")).alias("value"), "weight")
        turn += 1
        parts = -(-found.count() // pools)
        parts += turn % 2 if parts > 1 else 0  # other borders than in the round before
        found = found.drop("part")


def apply(model: DataFrame, df: DataFrame, p: str) -> DataFrame:
    """df with ``calibrated``: a pool's value inside it, a straight line between pools, the first or last value outside.

    A row finds its pool by a join in order, so neither side has to be small. Values stay in [0.001, 0.999]; null
    predictions and a model without rows give null.
    """
    pools = numbered(model, [], ["lo"], "k")
    following = pools.select((F.col("k") - 1).alias("k"), F.col("lo").alias("next_lo"), F.col("value").alias("next_value"))
    steps = pools.join(following, "k", "left").withColumn("from", F.when(F.col("k") == 0, F.lit(float("-inf"))).otherwise(F.col("lo")))
    steps = steps.select("from", F.struct("hi", "value", "next_lo", "next_value").alias("pool"))
    out = asof(df, steps, [], p, "from", ["pool"])
    x, hi, value = F.col(p), F.col("pool.hi"), F.col("pool.value")
    line = value + (F.col("pool.next_value") - value) * (x - hi) / (F.col("pool.next_lo") - hi)
    found = F.when((x <= hi) | F.col("pool.next_lo").isNull(), value).otherwise(line)
    return out.withColumn("calibrated", F.when(found.isNotNull(), F.greatest(F.least(found, F.lit(0.999)), F.lit(0.001)))).drop("pool", "from")


def curve(model: DataFrame, spark) -> DataFrame:
    """The calibrated value at 0.05, 0.10 and so on to 0.95."""
    return apply(model, spark.range(1, 20).select((F.col("id") * 0.05).alias("p")), "p")
