"""Prices: cleaning, and the join of predictions with the nearest price of the same pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, odds
from . import temporal


def clean_odds(raw: DataFrame) -> DataFrame:
    """Closing prices: the sharp book's, else the average, each side on its own; rows without both go.

    Columns are found whatever their capitals; the day may be called ``date``.
    """
    names_here = {c.lower(): c for c in raw.columns}
    there = lambda *names: [F.col(f"`{names_here[n]}`") for n in names if n in names_here]
    df = raw.select(*there("odds_id"), F.to_date(there("day", "date")[0]).alias("day"), *there("winner", "loser"),
                    F.coalesce(*there("psw", "avgw")).alias("odds_w"), F.coalesce(*there("psl", "avgl")).alias("odds_l"))
    df = df.toDF("odds_id", "day", "winner", "loser", "odds_w", "odds_l").dropna(subset=["day", "winner", "loser", "odds_w", "odds_l"])
    return df.withColumn("margin", odds.margin(F.col("odds_w"), F.col("odds_l")))


def name_index(players: DataFrame) -> DataFrame:
    """player_id, name -> player_id, key: the normal form of the price list's spelling."""
    return players.select("player_id", names.normal_form(names.surname_first(F.col("name"))).alias("key"))


def keyed_prices(prices: DataFrame) -> DataFrame:
    """Prices with kw, the normal form of the winner, and lo and hi, the pair of normal forms in order.

    Every spelling is normalised once, however many prices have it.
    """
    spelled = prices.select(F.explode(F.array("winner", "loser")).alias("name")).distinct().withColumn("key", names.normal_form(F.col("name")))
    side = lambda name, key: spelled.select(F.col("name").alias(name), F.col("key").alias(key))
    out = prices.join(side("winner", "kw"), "winner").join(side("loser", "kl"), "loser")
    return out.withColumns({"lo": F.least("kw", "kl"), "hi": F.greatest("kw", "kl")}).drop("kl")


def with_pair(predictions: DataFrame, index: DataFrame) -> DataFrame:
    """Predictions with key_a and the pair of normal forms in order; players without a name go."""
    key = lambda side: index.select(F.col("player_id").alias(f"player_{side}_id"), F.col("key").alias(f"key_{side}"))
    p = predictions.join(key("a"), "player_a_id").join(key("b"), "player_b_id")
    return p.withColumns({"lo": F.least("key_a", "key_b"), "hi": F.greatest("key_a", "key_b")}).drop("key_b")


def join_odds(predictions: DataFrame, prices: DataFrame, index: DataFrame, days: int = 3) -> DataFrame:
    """Each prediction with the nearest price of the same two players within some days, if its winner agrees.

    The pair of names, in order, and a cell of days are the equality key. Ties go to the smaller odds_id.
    The outcome is checked after the nearest price is chosen: a price that contradicts it drops the prediction.
    """
    near = temporal.nearest(with_pair(predictions, index), keyed_prices(prices), ["lo", "hi"], "date", "day", ["odds_w", "odds_l", "kw"], "odds_id", days)
    a_won = F.col("kw") == F.col("key_a")
    kept = near.where(a_won == (F.col("actual_a_won") == 1))
    oa, ob = F.when(a_won, F.col("odds_w")).otherwise(F.col("odds_l")), F.when(a_won, F.col("odds_l")).otherwise(F.col("odds_w"))
    return kept.select(*predictions.columns, "odds_id", oa.alias("odds_a"), ob.alias("odds_b")).withColumns({
        "implied_prob_a": odds.implied(F.col("odds_a")), "implied_prob_b": odds.implied(F.col("odds_b")),
        "fair_prob_a": odds.fair(F.col("odds_a"), F.col("odds_b")), "fair_prob_b": odds.fair(F.col("odds_b"), F.col("odds_a")),
        "vig": odds.margin(F.col("odds_a"), F.col("odds_b"))})


def latest_price(predictions: DataFrame, prices: DataFrame, index: DataFrame, days: int | None = None) -> DataFrame:
    """Each prediction with the last price of the pair up to its own day (null if there was none), whatever its age, or at most some days.

    What was known on the day: later prices are not looked at, and neither is the outcome.
    """
    p, o = with_pair(predictions, index), keyed_prices(prices)
    return temporal.asof(p, o, ["lo", "hi"], "date", "day", ["odds_id", "odds_w", "odds_l", "kw"], tie="odds_id", within=days)


def value_bets(priced: DataFrame, p: str = "p_model", threshold: float = 0.05, fraction: float = 0.25) -> DataFrame:
    """Edge, expected value, whether to bet, and the stake, for side A."""
    chance, price = F.col(p), F.col("odds_a")
    ev = odds.expected_value(chance, price)
    return priced.withColumns({"edge": chance - F.col("implied_prob_a"), "ev": ev, "is_value": ev > threshold,
                               "stake": odds.kelly(chance, price, fraction)})
