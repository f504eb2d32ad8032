import math
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contestry.functions import names, odds, probability, scores


def dp_game(p):
    @lru_cache(None)
    def go(a, b):
        if a == 4:
            return 1.0
        if b == 4:
            return 0.0
        if a == b == 3:
            return p * p / (p * p + (1 - p) ** 2)
        return p * go(a + 1, b) + (1 - p) * go(a, b + 1)

    return go(0, 0)


def dp_tiebreak(pa, pb):
    @lru_cache(None)
    def go(a, b):
        if a == 7:
            return 1.0
        if b == 7:
            return 0.0
        if a == b == 6:
            u, v = pa * (1 - pb), (1 - pa) * pb
            return u / (u + v)
        p = pa if (a + b) % 4 in (0, 3) else 1 - pb
        return p * go(a + 1, b) + (1 - p) * go(a, b + 1)

    return go(0, 0)


def dp_set(pa, pb):
    ha, hb = dp_game(pa), dp_game(pb)
    out = {}

    @lru_cache(None)
    def chance(a, b):
        if a == b == 0:
            return 1.0
        total = 0.0
        for x, y, won in ((a - 1, b, True), (a, b - 1, False)):
            if x < 0 or y < 0 or max(x, y) >= 6 and abs(x - y) > 1 or max(x, y) == 7 or (x, y) == (6, 6):
                continue
            p = ha if (x + y) % 2 == 0 else 1 - hb
            total += chance(x, y) * (p if won else 1 - p)
        return total

    for x, y in probability.SET_SCORES:
        if {x, y} == {7, 6}:
            t = dp_tiebreak(pa, pb)
            out[x, y] = chance(6, 6) * (t if x > y else 1 - t)
        else:
            out[x, y] = chance(x, y)
    return out


PAIRS = [(0.65, 0.65), (0.68, 0.62), (0.5, 0.8), (0.35, 0.4), (0.85, 0.36)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(PAIRS, "spw_a double, spw_b double")


def test_probabilities_equal_recursion(table):
    for r in probability.with_probabilities(table).collect():
        assert r.hold_a == pytest.approx(dp_game(r.spw_a), abs=1e-12)
        assert r.tiebreak == pytest.approx(dp_tiebreak(r.spw_a, r.spw_b), abs=1e-12)
        assert r.p_set == pytest.approx(sum(p for (x, y), p in dp_set(r.spw_a, r.spw_b).items() if x > y), abs=1e-12)
    first = probability.with_probabilities(table).first()
    assert first.hold_a == pytest.approx(0.830, abs=0.01)
    assert first.tiebreak == pytest.approx(0.5) and first.p_set == pytest.approx(0.5) and first.p_match_bo5 == pytest.approx(0.5)


def test_set_scores_and_totals(table):
    rows = probability.set_score_rows(probability.with_probabilities(table), ["spw_a", "spw_b"]).collect()
    assert len(rows) == 14 * len(PAIRS)
    for r in rows:
        assert r.p == pytest.approx(dp_set(r.spw_a, r.spw_b)[r.a_games, r.b_games], abs=1e-12)
    p = probability.with_probabilities(table)
    totals = probability.total_games(p, ["spw_a", "spw_b", "hold_a", "hold_b", "tiebreak"])
    for r in totals.groupBy("spw_a").agg(F.sum("p").alias("s"), F.min("total").alias("lo"), F.max("total").alias("hi")).collect():
        assert r.s == pytest.approx(1) and r.lo == 12 and r.hi == 39


def test_certain_sets_have_a_distribution(spark):
    one = probability.with_probabilities(spark.createDataFrame([(1.0, 0.0)], "spw_a double, spw_b double"))
    out = probability.total_games(one, ["spw_a", "hold_a", "hold_b", "tiebreak"]).where("p > 0").collect()
    assert [(r.total, r.p) for r in out] == [(12, 1.0)]


@settings(max_examples=20, deadline=None)
@given(st.floats(0.05, 0.95), st.floats(0.05, 0.95))
def test_tiebreak_is_symmetric(a, b):
    assert dp_tiebreak(a, b) + dp_tiebreak(b, a) == pytest.approx(1)


SCORES = [("6-4 6-3", [(6, 4), (6, 3)]), ("6-3 6-7(4) 7-6(2)", [(6, 3), (6, 7), (7, 6)]), ("W/O", None), ("3-6 RET", None), ("", None), (None, None),
          ("14-12 6-3", None), ("13-11 6-4", [(13, 11), (6, 4)]), ("[10-8]", None), ("6-4 foo", None), ("6-4\t6-3", [(6, 4), (6, 3)]), ("  6-1 6-0", [(6, 1), (6, 0)])]


def test_scores(spark):
    df = spark.createDataFrame([(s,) for s, _ in SCORES], "s string").select(scores.parse(F.col("s")).alias("x"))
    assert [None if r.x is None else [(s.w, s.l) for s in r.x] for r in df.collect()] == [x for _, x in SCORES]


def test_names(spark):
    given_ = ["Novak Djokovic", "Juan Martin del Potro", "Cher", "", None, "  Ana  -Maria Đo "]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(given_)], "i int, n string").select(
        "i", names.surname_first(F.col("n")).alias("short"), names.normal_form(F.col("n")).alias("norm"), names.initial_pattern(names.surname_first(F.col("n"))).alias("pat"))
    out = df.orderBy("i").collect()
    assert [r.short for r in out][:5] == ["Djokovic N.", "Martin del Potro J.", "Cher", "", ""]
    assert out[5].norm == "ana  maria đo"
    assert out[0].pat == r"^N\w+\s+Djokovic$"
    assert spark.range(1).select(F.lit("Novak Djokovic").rlike(out[0].pat)).first()[0]


def test_bins_at_exact_edges(spark):
    p = [0.0, 0.1, 0.2, 0.3, 0.6, 0.7, 0.8, 0.9, 1.0]
    df = spark.createDataFrame([(x,) for x in p], "p double").select(odds.reliability_bin(F.col("p")).alias("b"))
    assert [r.b for r in df.collect()] == [0, 1, 2, 2, 5, 6, 8, 9, 9]


def test_kelly_and_expectation(spark):
    df = spark.createDataFrame([(0.6, 2.0), (0.4, 2.0), (0.9, 1.0)], "p double, o double")
    assert [r.k for r in df.select(odds.kelly(F.col("p"), F.col("o")).alias("k")).collect()] == [pytest.approx(0.05), 0.0, 0.0]
    assert df.select(odds.expected(F.lit(1500.0), F.lit(1500.0))).first()[0] == 0.5
    assert df.select(odds.log_loss(F.lit(1.0), F.lit(0))).first()[0] == pytest.approx(-math.log(1e-6), rel=1e-6)
