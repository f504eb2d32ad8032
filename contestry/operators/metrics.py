"""Scores of predictions: losses, reliability, markets and comparisons with prices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.odds import log_loss, reliability_bin
from ..tables import numbered, running_before, written


def _hit(p: Column, y: Column) -> Column:
    return ((p > 0.5) == (y == 1)).cast("double")


def summary(df: DataFrame, p: str, y: str = "actual_a_won", by: list[str] | None = None) -> DataFrame:
    """n, log-loss, its gain on one half, and accuracy; one half counts as B. NaN if there are no rows."""
    out = df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(log_loss(F.col(p), F.col(y))).alias("ll"), F.avg(_hit(F.col(p), F.col(y))).alias("accuracy"))
    ll = F.coalesce("ll", F.lit(float("nan")))
    return out.select(*(by or []), "n", ll.alias("log_loss"), (F.lit(math.log(2)) - ll).alias("gain"), "accuracy")


def reliability(df: DataFrame, p: str, y: str = "actual_a_won", least: int = 20, by: list[str] | None = None) -> DataFrame:
    """Ten bins with mean prediction, mean outcome and gap; bins of fewer rows are left out."""
    return df.groupBy(*(by or []), reliability_bin(F.col(p)).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("actual")).where(F.col("n") >= least).withColumn(
        "gap", F.col("actual") - F.col("predicted"))


def reliability_by_market(df: DataFrame, p: str, market: str = "fair_prob_a", y: str = "actual_a_won", least: int = 20) -> DataFrame:
    return df.groupBy(reliability_bin(F.col(market)).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("model"), F.avg(market).alias("market"), F.avg(y).alias("actual")).where(F.col("n") >= least)


def markets(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """All markets in one aggregation: log-loss against that of the base rate, with a verdict and a rank."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(name).alias("market"), F.col(p).alias("p"), F.col(y).cast("double").alias("y"))
                                         for name, (p, y) in pairs.items()])).alias("m")).select("m.*")
    out = rows.groupBy("market").agg(F.count("*").alias("n"), F.avg(log_loss(F.col("p"), F.col("y"))).alias("log_loss"),
                                     F.avg("y").alias("base_rate"), F.avg(_hit(F.col("p"), F.col("y"))).alias("accuracy"))
    safe = lambda c: F.log(F.greatest(c, F.lit(1e-6)))
    r = F.col("base_rate")
    out = out.withColumn("base_log_loss", -(r * safe(r) + (1 - r) * safe(1 - r))).withColumn("gain", F.col("base_log_loss") - F.col("log_loss"))
    verdict = F.when(F.col("gain") > 0.005, "useful").when(F.col("gain") > 0, "marginal").otherwise("worse")
    # Few rows, one per market, so one task ranks them.
    return out.withColumn("verdict", verdict).withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("gain", 9)), "market")))


def against_market(df: DataFrame, p: str, market: str = "fair_prob_a", y: str = "actual_a_won") -> DataFrame:
    """Both log-losses on the rows that have a price, and the correlation."""
    d = df.where(F.col(market).isNotNull())
    return d.agg(F.count("*").alias("n"), F.avg(log_loss(F.col(p), F.col(y))).alias("model_ll"),
                 F.avg(log_loss(F.col(market), F.col(y))).alias("market_ll"), F.corr(p, market).alias("correlation"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def average_ranks(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """by, column and the average rank of each value (from 1); rows are counted per value before values are put in order."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    return running_before(counts, by, [column], "n", "before").select(*by, column, (F.col("before") + (F.col("n") + 1) / 2).alias(name))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Rank correlation with average ranks of ties, of all rows or per group; rows with a null in either do not count."""
    keys = by or []
    # Written, as the ranks of both columns and their join each read the rows.
    df = written(df.select(*keys, F.col(x).alias("__x"), F.col(y).alias("__y")).dropna(subset=["__x", "__y"]))
    both = df
    for c in ("__x", "__y"):
        ranks = average_ranks(df, keys, c, f"{c}_rank")
        ranks = ranks.toDF(*[f"r_{k}" for k in keys], f"r{c}", f"{c}_rank")
        same = F.col(c) == F.col(f"r{c}")
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"r_{k}"))
        both = both.join(ranks, same).drop(*[f"r_{k}" for k in keys], f"r{c}")
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("__x_rank", "__y_rank").alias("rho"))


def time_split(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Mark the first int(n * share) rows by date and match as training rows."""
    return numbered(df, [], ["date", "match_id"], "__at_place", "__rows").withColumn(
        "is_train", F.col("__at_place") < F.floor(F.col("__rows") * share)).drop("__at_place", "__rows")


def recency_weight(age_days: Column, half_life: float = 365.0) -> Column:
    return F.exp(-math.log(2) * age_days / half_life)
