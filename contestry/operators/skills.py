"""Serve and return skills by weighted ridge, from Gram sums that Spark adds up.

Rows are summed per (surface, as_of, player, opponent) before anything meets, so a fit sees pairs, not rows.
Each fit solves its normal equations by conjugate gradients on those pairs and never builds a dense matrix.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import refit_dates
from ..functions.odds import logit, sigmoid
from .metrics import recency_weight

#: Defaults of the fit; rows that a fit needs; observations from which a player's own skill is used.
HALF_LIFE, RIDGE, LOOKBACK, LEAST_ROWS, LEAST_OBS = 365.0, 1.0, 730, 100, 5
#: Days over which fits of a surface follow each other in one task.
RUN = 56
_TABLE = "surface string, as_of date, player_id long, serve_skill double, return_skill double, n_obs long, intercept double, avg_serve double, avg_return double"


def grid(start: str, end: str, every: int = 7) -> list[str]:
    """Refit dates: every so many days from one step before the test window."""
    return refit_dates(start, end, every)


def gram(long: DataFrame, dates: list[str], half_life: float = HALF_LIFE, lookback: int = LOOKBACK) -> DataFrame:
    """Sums of weights, weighted targets and rows per surface, fit date, player and opponent.

    A row counts for the fit dates after it that it precedes by at most the look-back. Instead of a copy for each of
    them it enters the sums of its pair at the first one and leaves them after the last: at most two changes, added up
    per pair and date. Weights are taken as of the first date, where they only grow, so running sums of the changes,
    scaled to each date, are the decayed sums. They start from zero whenever a pair has no row left. What the last
    step multiplies is the result itself, one row for each date on which a pair has rows.
    """
    days = sorted({d[:10] for d in dates})
    grid_ = F.array(*[F.lit(d).cast("date") for d in days])
    base = F.lit(days[0]).cast("date")
    first = F.array_size(F.filter(grid_, lambda t: t <= F.col("date")))
    past = F.array_size(F.filter(grid_, lambda t: t <= F.date_add("date", lookback)))
    v = recency_weight(F.datediff(base, "date"), half_life) * F.col("svpt")
    rows = long.where((F.col("date") < F.lit(days[-1]).cast("date")) & (F.col("date") >= F.date_sub(base, lookback))).select(
        "surface", "player_id", "opp_id", first.alias("first"), past.alias("past"), v.alias("v"), (v * logit(F.col("spw"))).alias("vy")).where("first < past")
    pair = ["surface", "player_id", "opp_id"]
    change = lambda at, sign: F.struct(F.col(at).alias("at"), (sign * F.col("v")).alias("v"), (sign * F.col("vy")).alias("vy"), F.lit(sign).alias("n"))
    # The last date has no way out: nothing follows it.
    changes = rows.select(*pair, F.explode(F.array(change("first", 1), change("past", -1))).alias("c")).select(*pair, "c.*").where(F.col("at") < len(days))
    changes = changes.groupBy(*pair, "at").agg(*[F.sum(c).alias(c) for c in ("v", "vy", "n")])
    order = Window.partitionBy(*pair).orderBy("at")
    running = changes.withColumn("n", F.sum("n").over(order)).withColumns({
        "run": F.count(F.when(F.col("n") == 0, 1)).over(order.rowsBetween(Window.unboundedPreceding, -1)), "until": F.lead("at", 1, len(days)).over(order)})
    inside = Window.partitionBy(*pair, "run").orderBy("at")
    running = running.withColumns({"v": F.sum("v").over(inside), "vy": F.sum("vy").over(inside)}).where("n > 0")
    every = running.select(*pair, "v", "vy", "n", F.explode(F.sequence(F.col("at"), F.col("until") - 1)).alias("at"))
    as_of = F.get(grid_, F.col("at"))
    scale = recency_weight(F.datediff(as_of, base), half_life)
    return every.select("surface", as_of.alias("as_of"), "player_id", "opp_id", (scale * F.col("v")).alias("w"), (scale * F.col("vy")).alias("wy"), "n")


def solve(w: np.ndarray, wy: np.ndarray, i: np.ndarray, j: np.ndarray, n: int, ridge: float, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Serve and return skills: the minimum of sum w (y - s_i + r_j)^2 + ridge (s.s + r.r), by conjugate gradients from a start."""
    right = np.concatenate([np.bincount(i, wy, n), -np.bincount(j, wy, n)])
    diagonal = np.concatenate([np.bincount(i, w, n), np.bincount(j, w, n)]) + ridge

    def times(v):
        e = w * (v[:n][i] - v[n:][j])
        return np.concatenate([np.bincount(i, e, n), -np.bincount(j, e, n)]) + ridge * v

    x = np.zeros(2 * n) if start is None else start.copy()
    r = right - times(x)
    z = r / diagonal
    p, rz = z.copy(), float(r @ z)
    for _ in range(20 * n + 200):
        if np.linalg.norm(r) <= 1e-12 * max(np.linalg.norm(right), 1e-300):
            break
        ap = times(p)
        by = rz / float(p @ ap)
        x, r = x + by * p, r - by * ap
        z = r / diagonal
        rz, old = float(r @ z), rz
        p = z + rz / old * p
    return x[:n], x[n:]


def fit(sums: DataFrame, ridge: float = RIDGE) -> DataFrame:
    """A skill table per surface and fit date; fits with too few rows are left out.

    Fit dates of a surface are dealt in runs of ``RUN`` days; inside a run each fit starts from the one before. A task
    holds the pairs of one fit.
    """
    names = ["surface", "as_of", "player_id", "opp_id", "w", "wy", "n"]

    def one(key, columns, before):
        player, opponent, w, wy, rows = columns
        if rows.sum() < LEAST_ROWS:
            return None, before
        players, code = np.unique(np.concatenate([player, opponent]), return_inverse=True)
        i, j, n = code[:len(player)], code[len(player):], len(players)
        start = None
        if before is not None:
            at = np.minimum(np.searchsorted(before[0], players), len(before[0]) - 1)
            known = before[0][at] == players
            start = np.concatenate([np.where(known, side[at], 0.0) for side in before[1:]])
        serve, back = solve(w, wy, i, j, n, ridge, start)
        n_obs = np.bincount(i, rows, n) + np.bincount(j, rows, n)
        many = lambda v: np.full(n, v)
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.date32()), pa.array(players), pa.array(serve), pa.array(back),
             pa.array(n_obs.astype(np.int64)), pa.array(many(wy.sum() / w.sum())), pa.array(many(serve.mean())), pa.array(many(back.mean()))],
            names=[c.split()[0] for c in _TABLE.split(", ")]), (players, serve, back)

    def part(day: datetime.date) -> int:
        return (day - datetime.date(1970, 1, 1)).days // RUN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, before = [], None, None
        for batch in _then_none(batches):
            cells = [None] if batch is None else _runs(batch)
            for cell in cells:
                if cell is None or cell[0] != key:
                    if held:
                        out, before = one(key, [np.concatenate(c) for c in zip(*held)], before)
                        if out is not None:
                            yield out
                    if cell is not None and (key is None or (cell[0][0], part(cell[0][1])) != (key[0], part(key[1]))):
                        before = None
                    held, key = [], cell and cell[0]
                if cell is not None:
                    held.append(cell[1])

    block = F.floor(F.datediff("as_of", F.lit("1970-01-01").cast("date")) / RUN)
    ordered = sums.repartition("surface", block).sortWithinPartitions("surface", "as_of", "player_id", "opp_id")
    return ordered.select(*names).mapInArrow(run, _TABLE)


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """The stretches of one surface and date of a sorted batch: their key and columns."""
    surface, day = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 7)]
    columns = [columns[0], columns[1], *[c.astype(float) for c in columns[2:]]]
    edges = [0, *[k for k in range(1, len(day)) if day[k] != day[k - 1] or surface[k] != surface[k - 1]], len(day)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield (surface[a], day[a]), [c[a:b] for c in columns]


def predict_points(pairs: DataFrame, skills: DataFrame, center: bool = False) -> DataFrame:
    """spw_a and spw_b for rows with surface, as_of, player_a_id and player_b_id.

    Players with few observations, or none at all (``n_obs`` 0), count as average. The default adds the intercept to skills that were fitted
    on uncentred targets, as the established model does; ``center`` leaves it out.
    """
    at = ["surface", "as_of"]
    means = skills.groupBy(*at).agg(*[F.first(c).alias(c) for c in ("intercept", "avg_serve", "avg_return")])
    known = F.col("n_obs") >= LEAST_OBS
    s = skills.select(*at, "player_id", "n_obs", F.when(known, F.col("serve_skill")).alias("serve"), F.when(known, F.col("return_skill")).alias("back"))
    both = pairs.join(means, at)
    for x in ("a", "b"):
        side = s.select(*at, F.col("player_id").alias(f"player_{x}_id"), F.col("serve").alias(f"serve_{x}"), F.col("back").alias(f"back_{x}"),
                        F.col("n_obs").alias(f"n_obs_{x}"))
        both = both.join(side, [*at, f"player_{x}_id"], "left").withColumns({
            f"serve_{x}": F.coalesce(f"serve_{x}", "avg_serve"), f"back_{x}": F.coalesce(f"back_{x}", "avg_return"),
            f"n_obs_{x}": F.coalesce(f"n_obs_{x}", F.lit(0).cast(s.schema["n_obs"].dataType))})
    both = both.withColumnRenamed("intercept", "intercept_a")
    base = F.lit(0.0) if center else F.col("intercept_a")
    return both.withColumns({"spw_a": sigmoid(base + F.col("serve_a") - F.col("back_b")), "spw_b": sigmoid(base + F.col("serve_b") - F.col("back_a"))}).drop(
        "serve_a", "serve_b", "back_a", "back_b", "intercept_a", "avg_serve", "avg_return")


def best(skills: DataFrame, by: str = "serve_skill", n: int = 5) -> DataFrame:
    """The n players with the largest skill of each surface and fit date; ties go to the smaller id.

    A filter on row_number lets Spark keep n rows of a fit before it deals them.
    """
    place = F.row_number().over(Window.partitionBy("surface", "as_of").orderBy(F.desc(by), "player_id"))
    return skills.withColumn("place", place).where(F.col("place") <= n).select("surface", "as_of", "place", "player_id", by, "n_obs")
