"""File sources and sinks: yearly match and price files in, tidy tables out; a seeded synthetic source."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workbooks import load_sheets, typed_day

_INTEGERS = ("match_id", "match_num", "tourney_date", "best_of", "winner_id", "loser_id", "winner_rank", "loser_rank")
_DOUBLES = ("w_svpt", "w_1stWon", "w_2ndWon", "l_svpt", "l_1stWon", "l_2ndWon", "w_SvGms", "l_SvGms")
_STRINGS = ("tourney_id", "tourney_name", "tourney_level", "surface", "winner_name", "loser_name", "score")
MATCH_COLUMNS = {**dict.fromkeys(_INTEGERS, "bigint"), **dict.fromkeys(_STRINGS, "string"), **dict.fromkeys(_DOUBLES, "double")}
ODDS_COLUMNS = {"Date": "date", "Tournament": "string", "Surface": "string", "Round": "string", "Best of": "int", "Winner": "string",
                "Loser": "string", **dict.fromkeys(("WRank", "LRank"), "int"),
                **dict.fromkeys(("PSW", "PSL", "B365W", "B365L", "AvgW", "AvgL", "MaxW", "MaxL"), "double")}


def _typed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Known columns that the file has, trimmed headers, bad values as null, absent ones as null."""
    names = {c.strip(): c for c in df.columns}
    return df.select(*[(F.expr(f"try_cast(`{names[c]}` AS {t})") if c in names else F.lit(None).cast(t)).alias(c)
                       for c, t in columns.items()])


def _scan(spark: SparkSession, paths: list[str], columns: dict[str, str]) -> DataFrame:
    frames = [_typed(spark.read.csv(p, header=True) if p.endswith(".csv") else spark.read.parquet(p), columns) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def load_matches(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """Yearly match files (CSV or Parquet) by year, with the year as a column.

    A file without ``match_id`` names its matches by tournament and number: the id is the tournament's hash with the
    number in its low bits, so that matches of one tournament and day stay in their order. A row that has neither is
    refused when it is read; ``repeated_ids`` shows ids that are there twice.
    """
    frames = [_scan(spark, [p], MATCH_COLUMNS).withColumn("year", F.lit(y)) for y, p in sorted(paths.items())]
    number = F.when(F.col("match_num").between(0, (1 << 20) - 1), F.col("match_num"))
    made = F.shiftleft(F.shiftrightunsigned(F.when(F.col("tourney_id").isNotNull(), F.xxhash64("tourney_id")), 21), 20) + number
    return reduce(lambda a, b: a.unionByName(b), frames).withColumn("match_id", F.coalesce(
        F.col("match_id"), made, F.raise_error(F.lit("a match needs match_id, or tourney_id and match_num")).cast("bigint")))


def repeated_ids(matches: DataFrame) -> DataFrame:
    """match_id, n: identifiers of more than one match."""
    return matches.groupBy("match_id").agg(F.count("*").alias("n")).where("n > 1")


def load_odds(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Yearly price files as CSV, Parquet or spreadsheets (their first sheet), ready for ``clean_odds``.

    Days may be written as 2024-01-31 or 31/01/2024 or, in sheets, be serial numbers; a day that cannot be read is null,
    and ``unread_days`` shows such rows before cleaning drops them. A price is named by a hash of what it is about, so it
    has the same odds_id however the files are read.
    """
    text = {**ODDS_COLUMNS, "Date": "string"}
    sheets, others = [p for p in paths if p.lower().endswith(".xlsx")], [p for p in paths if not p.lower().endswith(".xlsx")]
    frames = [_scan(spark, others, text).withColumn("Date", typed_day(F.col("Date")))] if others else []
    if sheets:
        raw = load_sheets(spark, sheets, list(text))
        frames.append(raw.select(typed_day(F.col("Date"), F.col("base")).alias("Date"), *[F.expr(f"try_cast(`{c}` AS {t})").alias(c) for c, t in text.items() if c != "Date"]))
    raw = reduce(lambda a, b: a.unionByName(b), frames)
    return raw.withColumn("odds_id", F.xxhash64("Date", "Tournament", "Round", "Winner", "Loser"))


def unread_days(odds: DataFrame) -> DataFrame:
    """Price rows whose day could not be read."""
    return odds.where(F.col("Date").isNull())


def load_predictions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def save(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Overwrite a folder of Parquet or headed CSV."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def synthetic(spark: SparkSession, n_players: int = 100, n_matches: int = 5000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Long-form matches drawn from known serve and return skills, and those skills.

    Skills are hashes of (player, surface); matches are drawn in parallel from hashed match numbers, so the
    same seed gives the same rows whatever the partitioning.
    """
    surfaces = np.array([["Hard", 0.55], ["Clay", 0.35], ["Grass", 0.10]])

    def uniform(*parts):
        return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1_000_003)).cast("double") / 1_000_003

    def normal(label, *parts):
        a, b = uniform(F.lit(label + "a"), *parts), uniform(F.lit(label + "b"), *parts)
        return F.sqrt(-2 * F.log(F.greatest(a, F.lit(1e-9)))) * F.cos(2 * np.pi * b)

    skill = lambda label, who, where: 0.25 * normal(label, who) + 0.08 * normal(label + "s", who, where)
    players = spark.range(n_players).select(F.col("id").alias("player_id"))
    truth = players.withColumn("surface", F.explode(F.array(*[F.lit(s) for s in surfaces[:, 0]]))).select(
        "player_id", F.concat(F.lit("Player "), "player_id").alias("player_name"), "surface",
        skill("serve", F.col("player_id"), F.col("surface")).alias("true_serve_skill"),
        skill("return", F.col("player_id"), F.col("surface")).alias("true_return_skill"))
    u = uniform(F.lit("surface"), F.col("match_id"))
    m = spark.range(n_matches).select(F.col("id").alias("match_id")).select(
        "match_id", F.floor(uniform(F.lit("a"), F.col("match_id")) * n_players).alias("a"),
        F.floor(uniform(F.lit("b"), F.col("match_id")) * (n_players - 1)).alias("b0"),
        F.when(u < 0.55, "Hard").when(u < 0.90, "Clay").otherwise("Grass").alias("surface"),
        F.date_add(F.lit("2022-01-01").cast("date"), (F.col("match_id") * 1095 / n_matches).cast("int")).alias("date"))
    m = m.withColumn("b", F.col("b0") + (F.col("b0") >= F.col("a")).cast("int")).drop("b0")
    side = F.explode(F.array(F.struct(F.col("a").alias("player_id"), F.col("b").alias("opp_id")),
                             F.struct(F.col("b").alias("player_id"), F.col("a").alias("opp_id"))))
    rows = m.select("match_id", "date", "surface", side.alias("s")).select("match_id", "date", "surface", "s.*")
    eta = 0.55 + skill("serve", F.col("player_id"), F.col("surface")) - skill("return", F.col("opp_id"), F.col("surface"))
    svpt = F.floor(60 + 40 * uniform(F.lit("n"), F.col("match_id"), F.col("player_id")))
    p = 1 / (1 + F.exp(-eta))
    noise = normal("w", F.col("match_id"), F.col("player_id")) * F.sqrt(p * (1 - p) / svpt)
    rows = rows.withColumn("svpt", svpt.cast("double")).withColumn("spw", F.greatest(F.least(p + noise, F.lit(0.99)), F.lit(0.01)))
    won = F.col("spw") >= F.max("spw").over(Window.partitionBy("match_id"))
    return rows.withColumn("won", won).withColumn("best_of", F.lit(3)), truth
