"""Joins in time: the latest earlier row of the same keys, and the nearest row within some days.

Neither sorts or collects a key in one task, and the rows that either examines grow with the input, also where one
key holds most of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import dealt


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, take: list[str], tie: str | None = None,
         within: int | None = None) -> DataFrame:
    """Every left row with ``right_on`` and the columns ``take`` of the latest right row of its keys, not after its time.

    Both sides are dealt by ranges of (keys, time), so a key with many rows is split by time. Inside a range the last
    right row is carried on; a range that starts inside a key gets the last right row of the ranges before, of which
    there is one for each range and key. Right rows of one time count once, that with the largest ``tie``. Right
    times may be irregular, unsorted or repeated; null keys and times match nothing, and left rows without a match
    have nulls. within: the largest age of a match in days. Names that both sides have must not be in ``take``.
    """
    rank = F.struct(*([tie] if tie else []), *take)
    once = right.dropna(subset=[*keys, right_on]).groupBy(*keys, F.col(right_on).alias("__t")).agg(F.max_by(F.struct(*take), rank).alias("__new"))
    known = F.lit(True)
    for c in [*keys, left_on]:
        known &= F.col(c).isNotNull()
    # Rows of one key and time are spread by their own hash; they all follow the right row of that time.
    l = left.select(*keys, F.col(left_on).alias("__t"), F.xxhash64(*left.columns).alias("__salt"), F.struct(*left.columns).alias("__row"), known.alias("__known"),
                    F.lit(1).alias("__side"))
    r = once.select(*keys, "__t", F.lit(0).cast("long").alias("__salt"), F.struct("__t", "__new").alias("__seen"), F.lit(True).alias("__known"), F.lit(0).alias("__side"))
    rows = dealt(l.unionByName(r, allowMissingColumns=True), ["__known", *keys], ["__t", "__side", "__salt"])
    here = Window.partitionBy("__g", "__part")
    so_far = F.last("__seen", ignorenulls=True).over(here.orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = rows.groupBy("__g", "__part").agg(F.max_by("__seen", F.when(F.col("__side") == 0, F.col("__at"))).alias("__end"))
    before = F.last("__end", ignorenulls=True).over(Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("__g", "__part", before.alias("__before"))
    out = rows.withColumn("__last", so_far).where("__side = 1").join(carried, ["__g", "__part"])
    seen = F.coalesce("__last", "__before")
    good = F.col("__known")
    if within is not None:
        good &= F.datediff(F.col("__t"), seen["__t"]) <= within
    out = out.withColumn("__seen", F.when(good, seen))
    return out.select("__row.*", F.col("__seen.__t").alias(right_on), *[F.col(f"__seen.__new.{c}").alias(c) for c in take])


def nearest_candidates(left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, take: list[str], tie: str, days: int) -> DataFrame:
    """Pairs of a left day and a right row of the same keys at most some days apart, one right row a day.

    Which right row is the nearest depends on nothing but keys and days, so both sides are first reduced to one row
    for each key and day: the right one to that with the smallest ``tie``. Days fall into cells as wide as the
    window; a right day reaches two of them at most. A left day so meets at most 2 days + 1 right rows, however often
    its keys come together.
    """
    wide = 2 * days + 1
    cell = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / wide)
    wanted = left.select(*keys, F.col(left_day).alias("__l")).dropna().distinct().withColumn("__cell", cell(F.col("__l")))
    offers = right.groupBy(*keys, F.col(right_day).alias("__r")).agg(F.min_by(F.struct(tie, *take), tie).alias("__offer"))
    reached = F.array_distinct(F.array(cell(F.date_sub("__r", days)), cell(F.date_add("__r", days))))
    pairs = wanted.join(offers.withColumn("__cell", F.explode(reached)), [*keys, "__cell"])
    return pairs.withColumn("__off", F.abs(F.datediff("__l", "__r"))).where(F.col("__off") <= days)


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, take: list[str], tie: str, days: int) -> DataFrame:
    """Left rows with ``tie`` and the columns ``take`` of the right row of the same keys whose day is nearest, at most some days away.

    Of equally near ones that with the smallest ``tie``; left rows without one, or with null keys or days, go.
    """
    found = nearest_candidates(left, right, keys, left_day, right_day, take, tie, days)
    best = found.groupBy(*keys, "__l").agg(F.min_by("__offer", F.struct("__off", f"__offer.{tie}")).alias("__best"))
    out = left.join(best.withColumnRenamed("__l", left_day), [*keys, left_day])
    return out.select(*left.columns, *[F.col(f"__best.{c}").alias(c) for c in [tie, *take]])
