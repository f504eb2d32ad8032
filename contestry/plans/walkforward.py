"""Walk-forward plans: refit on a grid, predict each match with the latest fit before it."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import probability
from ..functions.dates import refit_date
from ..functions.odds import shrink
from ..operators import metrics, ratings, reshape, skills
from ..tables import written


def backtest(matches: DataFrame, start: str, end: str, *, every: int = 7, ridge: float = 1.0, least_obs: int = 10) -> DataFrame:
    """Point and match probabilities for canonical matches of the window, with skills fitted before each."""
    long = reshape.long_format(matches)
    table = written(skills.fit(skills.gram(long, skills.grid(start, end, every)), ridge))  # read for both players and the means
    window = reshape.in_window(reshape.canonical_long(long), datetime.date.fromisoformat(start), datetime.date.fromisoformat(end))
    pairs = window.where(F.col("surface").isin("Hard", "Clay", "Grass")).select(
        "match_id", "date", "surface", "best_of", "score", F.col("player_id").alias("player_a_id"), F.col("opp_id").alias("player_b_id"),
        F.col("won").cast("int").alias("actual_a_won"), refit_date(F.col("date"), start, every).alias("as_of"))
    points = skills.predict_points(pairs, table).where((F.col("n_obs_a") >= least_obs) & (F.col("n_obs_b") >= least_obs))
    out = probability.with_probabilities(points)
    return out.withColumn("model_prob_a", F.when(F.col("best_of") == 5, F.col("p_match_bo5")).otherwise(F.col("p_match_bo3")))


def score_backtest(matches: DataFrame, start: str, end: str, *, every: int = 14, ridge: float = 12.0, least_obs: int = 10) -> DataFrame:
    """The same for matches whose score can be read, with what the score says."""
    facts = reshape.score_facts(backtest(matches, start, end, every=every, ridge=ridge, least_obs=least_obs))
    return facts.select("match_id", "date", "surface", "best_of", "player_a_id", "player_b_id", "spw_a", "spw_b", "actual_a_won",
                        F.col("a_sets").alias("actual_a_sets"), F.col("b_sets").alias("actual_b_sets"),
                        F.col("total_games").alias("actual_total_games"), (F.col("a_sets") > 0).cast("int").alias("actual_a_set"),
                        (F.col("b_sets") > 0).cast("int").alias("actual_b_set"))


def market_predictions(scored: DataFrame, alpha: float = 0.10) -> DataFrame:
    """Best-of-three market probabilities from shrunk point probabilities, beside the outcomes."""
    three = scored.where("best_of = 3").withColumns({"spw_a": shrink(F.col("spw_a"), alpha), "spw_b": shrink(F.col("spw_b"), alpha)})
    p = probability.with_markets(probability.with_probabilities(three), 3)
    return probability.over_lines(p, p.columns)


def ten_markets(predicted: DataFrame) -> DataFrame:
    """All best-of-three markets of ``market_predictions`` against what the scores say, in one aggregation."""
    is_ = lambda a, b: ((F.col("actual_a_sets") == a) & (F.col("actual_b_sets") == b)).cast("int")
    over = lambda line: (F.col("actual_total_games") > line).cast("int")
    rows = predicted.withColumns({"y20": is_(2, 0), "y21": is_(2, 1), "y02": is_(0, 2), "y12": is_(1, 2), "o21": over(21.5), "o22": over(22.5),
                                  "y3": (F.col("actual_a_sets") + F.col("actual_b_sets") == 3).cast("int")})
    return metrics.markets(rows, {
        "match": ("p_match_bo3", "actual_a_won"), "a set for A": ("p_a_wins_at_least_one_set", "actual_a_set"), "a set for B": ("p_b_wins_at_least_one_set", "actual_b_set"),
        "2-0": ("p_a_2_0", "y20"), "2-1": ("p_a_2_1", "y21"), "0-2": ("p_b_2_0", "y02"), "1-2": ("p_b_2_1", "y12"), "three sets": ("p_match_total_sets_3", "y3"),
        "over 21.5": ("p_over_21_5", "o21"), "over 22.5": ("p_over_22_5", "o22")})


def warm_predictions(matches: DataFrame, start: str, end: str, *, every: int | None = None, levels: dict[str, int] | None = None,
                     least_pairs: int = 0) -> DataFrame:
    """Blended predictions of the window with ranks mapped to ratings: by one line from before the window, or, with
    ``every``, by a line refitted every so many days, each from the matches before it only."""
    rows = ratings.tracks(matches, levels=levels)
    first, last = datetime.date.fromisoformat(start), datetime.date.fromisoformat(end)
    if every:
        base = ratings.rate(ratings.tracks(matches, surfaces=False, levels=levels))
        maps = written(ratings.rank_maps(ratings.rank_pairs(matches, base), start, end, every, least_pairs))
        rated = ratings.rate(ratings.with_rank_maps(rows, maps, start, every))
    else:
        before = matches.where(F.col("date") < F.lit(first))
        fit = ratings.rank_fit(ratings.rank_pairs(before, ratings.rate(ratings.tracks(before, surfaces=False, levels=levels))), least_pairs).first()
        rated = ratings.rate(rows, (fit["a"], fit["b"]) if fit["a"] is not None else None)
    return reshape.in_window(ratings.blended(matches, rated), first, last)
