"""Matches in tidy form: cleaning, two rows per match, and A/B orientation."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores

#: Update sizes by tournament level; fixed values. Other levels get 24.
K_BY_LEVEL = {"G": 32, "M": 28, "A": 24, "F": 28, "D": 20, "C": 18, "S": 14, "O": 20}
K_BY_LEVEL_WTA = K_BY_LEVEL | {"PM": 28, "P": 24, "I": 20}
DEFAULT_K = 24


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_day(c: Column) -> Column:
    """A YYYYMMDD number as a date, bad values as null."""
    return F.to_date(F.try_to_timestamp(c.cast("string"), F.lit("yyyyMMdd")))


def existing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select([c for c in columns if c in df.columns])


def clean_matches(raw: DataFrame) -> DataFrame:
    """Rows with serve counts, surface and date; surface trimmed; ranks only if 1 to 1500."""
    rank = lambda c: F.when(F.col(c).between(1, 1500), F.col(c).cast("int"))
    df = raw.dropna(subset=["w_svpt", "l_svpt", "surface"]).withColumns({
        "date": parse_day(F.col("tourney_date")), "surface": trimmed(F.col("surface")),
        "winner_rank": rank("winner_rank"), "loser_rank": rank("loser_rank")})
    return df.dropna(subset=["date"])


def level_k(level: Column, table: dict[str, int] | None = None) -> Column:
    table = table or K_BY_LEVEL
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, level), F.lit(DEFAULT_K))


def unknown_levels(matches: DataFrame, table: dict[str, int] | None = None) -> DataFrame:
    known = matches.sparkSession.createDataFrame([(x,) for x in table or K_BY_LEVEL], "tourney_level string")
    return matches.select("tourney_level").distinct().join(F.broadcast(known), "tourney_level", "left_anti")


def in_window(df: DataFrame, start: datetime.date, end: datetime.date, column: str = "date") -> DataFrame:
    """Half-open window of dates."""
    return df.where((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end)))


def long_format(matches: DataFrame) -> DataFrame:
    """Two rows per match, one for each player serving, in one scan; both need serve points."""
    def side(me: str, you: str, m: str, y: str, won: bool):
        mine, yours = (F.col(f"{s}_1stWon") + F.col(f"{s}_2ndWon") for s in (m, y))
        return F.struct(
            F.col(f"{me}_id").alias("player_id"), F.col(f"{me}_name").alias("player_name"),
            F.col(f"{you}_id").alias("opp_id"), F.col(f"{you}_name").alias("opp_name"), F.lit(won).alias("won"),
            F.col(f"{m}_svpt").alias("svpt"), mine.alias("sv_won"), F.col(f"{y}_svpt").alias("rpt"),
            (F.col(f"{y}_svpt") - yours).alias("rpt_won"))

    rows = matches.where("w_svpt > 0 AND l_svpt > 0").select(
        "match_id", "date", "surface", "tourney_level", "best_of", "score",
        F.explode(F.array(side("winner", "loser", "w", "l", True), side("loser", "winner", "l", "w", False))).alias("s"))
    return rows.select("match_id", "date", "surface", "tourney_level", "best_of", "score", "s.*").withColumns({
        "spw": F.try_divide("sv_won", "svpt"), "rpw": F.try_divide("rpt_won", "rpt")})


def canonical_long(long: DataFrame) -> DataFrame:
    """One row per match: the player with the smaller id."""
    return long.where("player_id < opp_id")


def canonical(matches: DataFrame) -> DataFrame:
    """A is the player with the smaller id; ranks follow, and actual_a_won is 1 if A won."""
    a_won = F.col("winner_id") < F.col("loser_id")
    pick = lambda x: (F.when(a_won, F.col(f"winner_{x}")).otherwise(F.col(f"loser_{x}")),
                      F.when(a_won, F.col(f"loser_{x}")).otherwise(F.col(f"winner_{x}")))
    ids, names, ranks = pick("id"), pick("name"), pick("rank")
    return matches.select(
        "match_id", "date", "surface", "tourney_name", "tourney_level", "best_of", ids[0].alias("player_a_id"),
        ids[1].alias("player_b_id"), names[0].alias("name_a"), names[1].alias("name_b"), ranks[0].alias("a_rank"),
        ranks[1].alias("b_rank"), a_won.cast("int").alias("actual_a_won"), "score")


def score_facts(canon: DataFrame) -> DataFrame:
    """Parsed scores and what they tell; rows without a score go."""
    sets = scores.parse(F.col("score"))
    df = canon.withColumn("sets", sets).where(F.col("sets").isNotNull())
    won = F.col("actual_a_won") == 1
    return df.withColumn("from_a", scores.from_a(F.col("sets"), won)).withColumns({
        "n_sets": F.size("sets"), "winner_sets": scores.sets_of_winner(F.col("sets")),
        "loser_took_set": scores.loser_took_set(F.col("sets")), "total_games": scores.games(F.col("sets")),
        "a_sets": F.size(F.filter("from_a", lambda s: s["a"] > s["b"])), "b_sets": F.size(F.filter("from_a", lambda s: s["b"] > s["a"]))})


def latest_names(matches: DataFrame) -> DataFrame:
    """The name that a player had last, by date and match."""
    both = matches.select("date", "match_id", F.explode(F.array(
        F.struct(F.col("winner_id").alias("player_id"), F.col("winner_name").alias("name"), F.lit(0).alias("side")),
        F.struct(F.col("loser_id").alias("player_id"), F.col("loser_name").alias("name"), F.lit(1).alias("side")))).alias("s"))
    return both.groupBy("s.player_id").agg(F.max_by("s.name", F.struct("date", "match_id", "s.side")).alias("name"))


def prior_matches(matches: DataFrame) -> DataFrame:
    """match_id, player_id, n_prior: the matches of a player before this one."""
    both = matches.select("date", "match_id", F.explode(F.array("winner_id", "loser_id")).alias("player_id"))
    order = Window.partitionBy("player_id").orderBy("date", "match_id")
    return both.select("match_id", "player_id", (F.row_number().over(order) - 1).alias("n_prior"))


def player_rows(long: DataFrame) -> DataFrame:
    """Rows per surface and player, counting a player's own rows and those of opponents: two per match."""
    return long.select("surface", F.explode(F.array("player_id", "opp_id")).alias("player_id")).groupBy(
        "surface", "player_id").agg(F.count("*").alias("n_obs"))
