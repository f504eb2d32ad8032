"""Contest tables derived from the supplied ``orders`` table: one match per order, and a price list.

The expressions are plain SQL that Spark and DuckDB both read, so that oracles start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NAME = "concat(CASE {0} % 3 WHEN 0 THEN 'Élodie' WHEN 1 THEN 'João' ELSE 'Max' END, ' Núñez-', CAST({0} AS STRING))"
_PRICED = "concat('Nunez ', CAST({0} AS STRING), ' ', CASE {0} % 3 WHEN 0 THEN 'E' WHEN 1 THEN 'J' ELSE 'M' END, '.')"

KEYS = """SELECT o_orderkey AS k, o_custkey % 97 AS w, (o_custkey % 97 + 1 + o_orderkey % 96) % 97 AS l,
CAST(o_orderdate AS DATE) AS d, o_orderpriority AS priority FROM orders"""

MATCHES = f"""SELECT k AS match_id, year(d) * 10000 + month(d) * 100 + day(d) AS tourney_date, priority AS tourney_name,
CASE WHEN k % 101 = 0 THEN NULL WHEN k % 4 = 0 THEN 'Hard' WHEN k % 4 = 1 THEN 'Clay' WHEN k % 4 = 2 THEN 'Grass' ELSE ' Hard ' END AS surface,
CASE k % 5 WHEN 0 THEN 'G' WHEN 1 THEN 'M' WHEN 2 THEN 'A' WHEN 3 THEN 'F' ELSE 'X' END AS tourney_level,
CASE WHEN k % 5 = 0 THEN 5 ELSE 3 END AS best_of, w AS winner_id, l AS loser_id,
{_NAME.format('w')} AS winner_name, {_NAME.format('l')} AS loser_name,
CASE WHEN w % 11 = 0 THEN NULL ELSE w * 17 + 1 END AS winner_rank, CASE WHEN l % 11 = 0 THEN NULL ELSE l * 17 + 1 END AS loser_rank,
CASE k % 8 WHEN 0 THEN '6-4 6-3' WHEN 1 THEN '6-4 3-6 7-5' WHEN 2 THEN '6-3 6-7(4) 7-6(2)' WHEN 3 THEN 'W/O'
  WHEN 4 THEN '3-6 RET' WHEN 5 THEN '' WHEN 6 THEN NULL ELSE '14-12 6-3' END AS score,
CAST(CASE WHEN k % 53 = 0 THEN NULL WHEN k % 59 = 0 THEN 0 ELSE 70 + k % 41 END AS DOUBLE) AS w_svpt,
CAST(30 + k % 17 AS DOUBLE) AS w_1stWon, CAST(8 + k % 9 AS DOUBLE) AS w_2ndWon,
CAST(70 + k % 37 AS DOUBLE) AS l_svpt, CAST(25 + k % 16 AS DOUBLE) AS l_1stWon, CAST(6 + k % 8 AS DOUBLE) AS l_2ndWon
FROM ({KEYS}) AS keys"""

_PSW = "CAST(k % 240 AS DOUBLE) / 100 + CAST(1.1 AS DOUBLE)"
_PRICES = f"""k, odds_id, day,
CASE WHEN k % 71 = 0 THEN {_PRICED.format('l')} ELSE {_PRICED.format('w')} END AS winner,
CASE WHEN k % 71 = 0 THEN {_PRICED.format('w')} ELSE {_PRICED.format('l')} END AS loser,
CASE WHEN k % 29 = 0 THEN NULL ELSE {_PSW} END AS psw,
CASE WHEN k % 29 = 0 THEN NULL ELSE 1 / (CAST(1.03 AS DOUBLE) - 1 / ({_PSW})) END AS psl,
{_PSW} - CAST(0.02 AS DOUBLE) AS avgw, 1 / (CAST(1.03 AS DOUBLE) - 1 / ({_PSW})) - CAST(0.02 AS DOUBLE) AS avgl"""


def odds_sql(plus_days: str) -> str:
    """plus_days: how the engine adds {1} days to the date {0}."""
    first = plus_days.format("d", "CAST(k % 9 - 4 AS INT)")
    second = plus_days.format("d", "CAST(k % 9 - 3 AS INT)")
    return f"""SELECT odds_id, day, winner, loser, psw, psl, avgw, avgl FROM (
SELECT {_PRICES} FROM (SELECT k, w, l, k AS odds_id, {first} AS day FROM ({KEYS}) AS k1 WHERE k % 6 <> 0) AS one
UNION ALL SELECT {_PRICES} FROM (SELECT k, w, l, k + 10000000 AS odds_id, {second} AS day FROM ({KEYS}) AS k2
WHERE k % 6 <> 0 AND k % 13 = 0) AS two) AS prices"""


SPARK_ODDS, DUCK_ODDS = odds_sql("date_add({0}, {1})"), odds_sql("({0} + {1})")


def _from_orders(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def raw_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_orders(spark, sf_dir, MATCHES)


def raw_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_orders(spark, sf_dir, SPARK_ODDS)
