"""Operators that spread one large group over tasks, against plain loops: time joins, places, sums of refit dates, resampling, pooling."""

import datetime
import itertools
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contestry import oracles, queries, tables
from contestry.functions import probability
from contestry.operators import audit, calibrate, metrics, ratings, reshape, skills, temporal
from contestry.plans import walkforward

DAY = datetime.date(2000, 1, 1)


def day(n):
    return None if n is None else DAY + datetime.timedelta(days=n)


def test_places_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot", rng.randrange(50), i) for i in range(900)] + [(None, 3, 1), (None, 2, 2), ("one", 1, 1)]
    df = spark.createDataFrame(rows, "g string, t int, i int").repartition(5)
    got = {(r.g, r.i): (r.place, r.rows) for r in tables.numbered(df, ["g"], ["t", "i"], "place", "rows").collect()}
    for g in ("hot", None, "one"):
        members = sorted((t, i) for h, t, i in rows if h == g)
        assert [got[g, i] for _, i in members] == [(k, len(members)) for k in range(len(members))]
    assert sorted(r.place for r in tables.numbered(df, [], ["t", "i"]).collect()) == list(range(len(rows)))
    assert tables.numbered(df.where("false"), ["g"], ["t"]).count() == 0


def test_sums_before_a_row(spark):
    rows = [(k % 3, k, k % 7) for k in range(200)]
    got = {(r.g, r.t): r.s for r in tables.running_before(spark.createDataFrame(rows, "g int, t int, v int"), ["g"], ["t"], "v", "s").collect()}
    assert got == {(g, t): sum(v for h, u, v in rows if h == g and u < t) for g, t, _ in rows}


@pytest.mark.parametrize("within", [None, 4])
def test_latest_row_before(spark, within):
    rng = random.Random(2)
    left = [(i, rng.choice(["hot", "hot", "hot", "b", "c", None]), rng.choice([None, *range(40)]), "x") for i in range(400)] + [(7, "hot", 9, "x")] * 3
    right = [(k, rng.choice(["hot", "hot", "b", None]), rng.choice([None, *range(0, 40, 3)]), float(k)) for k in range(150)]
    l = spark.createDataFrame([(i, k, day(t), n) for i, k, t, n in left], "id int, k string, t date, note string").repartition(6)
    r = spark.createDataFrame([(o, k, day(t), v) for o, k, t, v in right], "o int, k string, u date, v double").repartition(3)
    got = temporal.asof(l, r, ["k"], "t", "u", ["o", "v"], tie="o", within=within)
    assert got.columns == ["id", "k", "t", "note", "u", "o", "v"]
    want = []
    for i, k, t, n in left:
        best = max(((u, o, v) for o, h, u, v in right if k is not None and h == k and None not in (t, u) and u <= t and (within is None or t - u <= within)), default=None)
        want.append((i, k, day(t), n, *((day(best[0]), *best[1:]) if best else (None, None, None))))
    assert sorted(map(repr, (tuple(x) for x in got.collect()))) == sorted(map(repr, want))
    assert [x.o for x in temporal.asof(l, r.where("false"), ["k"], "t", "u", ["o"]).select("o").distinct().collect()] == [None]
    assert temporal.asof(l.where("false"), r, ["k"], "t", "u", ["o"]).count() == 0


def test_nearest_row_equals_a_loop(spark):
    rng = random.Random(3)
    left = [(i, rng.choice("aab"), rng.randrange(60)) for i in range(200)]
    right = [(o, rng.choice("aab"), rng.randrange(60)) for o in range(120)]
    l = spark.createDataFrame([(i, k, day(t)) for i, k, t in left] + [(900, None, day(3)), (901, "a", None)], "id int, k string, t date")
    r = spark.createDataFrame([(o, k, day(u), o * 2.0) for o, k, u in right], "o int, k string, u date, v double")
    for days in (0, 1, 3):
        got = {x.id: (x.o, x.v) for x in temporal.nearest(l, r, ["k"], "t", "u", ["v"], "o", days).collect()}
        want = {i: min(((abs(t - u), o) for o, h, u in right if h == k and abs(t - u) <= days), default=None) for i, k, t in left}
        assert got == {i: (w[1], w[1] * 2.0) for i, w in want.items() if w}


@pytest.mark.parametrize("spread", [5, 4000])
def test_a_pair_that_meets_often_costs_no_more_for_each_row(spark, spread):
    """10 000 and 20 000 matches and prices of one pair, on few days or many: a day meets at most seven others."""
    counts = []
    for n in (10_000, 20_000):
        rows = spark.range(n).select(F.lit("x").alias("k"), F.date_add(F.lit(DAY), (F.col("id") % spread).cast("int")).alias("t"), F.col("id").alias("o"))
        pairs = temporal.nearest_candidates(rows, rows.withColumnRenamed("t", "u"), ["k"], "t", "u", [], "o", 3)
        counts.append(pairs.count())
        assert counts[-1] <= 7 * min(n, spread)
        assert temporal.nearest(rows.select("k", "t"), rows.withColumnRenamed("t", "u"), ["k"], "t", "u", [], "o", 3).count() == n
    assert counts[1] <= 2 * counts[0]


def test_sums_of_refit_dates_equal_direct_ones(spark, sf):
    long = reshape.long_format(queries.matches(spark, sf)).persist()
    dates = skills.grid("1999-01-01", "2000-10-01", 20)
    got = {tuple(r[:4]): r for r in skills.gram(long, dates, half_life=100.0, lookback=300).collect()}
    rows = long.select("surface", "date", "player_id", "opp_id", "svpt", "spw").toPandas()
    y = np.clip(rows.spw.to_numpy(float), 1e-4, 1 - 1e-4)
    rows["y"], want = np.log(y / (1 - y)), {}
    for d in dates:
        t = datetime.date.fromisoformat(d)
        age = np.array([(t - x).days for x in rows.date])
        use = rows[(age > 0) & (age <= 300)].assign(w=lambda x, a=age: 2.0 ** (-a[x.index] / 100.0) * x.svpt)
        use = use.assign(wy=use.w * use.y)
        for key, g in use.groupby(["surface", "player_id", "opp_id"]):
            want[key[0], t, *key[1:]] = g.w.sum(), g.wy.sum(), len(g)
    assert got.keys() == want.keys() and len(want) > 3000
    for k, (w, wy, n) in want.items():
        assert got[k].n == n and got[k].w == pytest.approx(w, rel=1e-9) and got[k].wy == pytest.approx(wy, rel=1e-9, abs=1e-9)


def test_fits_that_follow_each_other_equal_single_ones(spark, sf):
    long = reshape.long_format(queries.matches(spark, sf)).persist()
    dates = skills.grid("2000-01-01", "2000-03-01", 14)
    many = {(r.surface, r.as_of, r.player_id): (r.serve_skill, r.return_skill, r.n_obs, r.intercept) for r in skills.fit(skills.gram(long, dates)).collect()}
    for d in (dates[0], dates[-1]):
        for r in skills.fit(skills.gram(long, [d])).collect():
            assert many[r.surface, r.as_of, r.player_id] == pytest.approx((r.serve_skill, r.return_skill, r.n_obs, r.intercept), abs=1e-8)
    assert skills.fit(skills.gram(long, dates).where("n < 0")).count() == 0
    top = skills.best(skills.fit(skills.gram(long, [dates[0]])), n=2).collect()
    assert len(top) == 6 and all(r.place in (1, 2) for r in top)


def convolved(sets, best_of):
    """Chances of the games of a match by going through all sequences of sets."""
    need, out = best_of // 2 + 1, {}
    state = {(0, 0, 0): 1.0}
    while state:
        following = {}
        for (a, b, g), p in state.items():
            for (x, y), q in sets.items():
                key, where = (a + (x > y), b + (x < y), g + x + y), following
                if need in key[:2]:
                    out[key[2]] = out.get(key[2], 0.0) + p * q
                else:
                    where[key] = where.get(key, 0.0) + p * q
        state = following
    return out


@pytest.mark.parametrize("best_of", [1, 3, 5])
def test_totals_from_polynomials(spark, best_of):
    pairs = [(0.62, 0.66), (0.5, 0.5), (0.8, 0.4), (1.0, 0.0), (0.35, 0.85)]
    df = probability.with_probabilities(spark.createDataFrame(pairs, "spw_a double, spw_b double"))
    sets = {}
    for r in probability.set_score_rows(df, ["spw_a", "spw_b"]).collect():
        sets.setdefault((r.spw_a, r.spw_b), {})[r.a_games, r.b_games] = r.p
    got = {}
    for r in probability.total_games(df, ["spw_a", "spw_b"], best_of).collect():
        got.setdefault((r.spw_a, r.spw_b), {})[r.total] = r.p
    over = {(r.spw_a, r.spw_b): (r["p_over_9_5"], r["p_over_21_5"]) for r in probability.over_lines(df, ["spw_a", "spw_b"], (9.5, 21.5), best_of).collect()}
    for pair in pairs:
        want = convolved(sets[pair], best_of)
        assert got[pair] == pytest.approx(want, abs=1e-12)
        assert over[pair] == pytest.approx([sum(p for g, p in want.items() if g > x) for x in (9.5, 21.5)], abs=1e-12)


def test_totals_of_unknown_chances(spark):
    df = probability.with_probabilities(spark.createDataFrame([(0.6, None), (0.5, 0.5), (None, None)], "spw_a double, spw_b double"))
    got = probability.over_lines(df, ["spw_a"], (21.5,)).collect()
    assert [r.p_over_21_5 is None for r in got] == [True, False, True]
    assert probability.total_games(df, ["spw_a"]).count() == 28 and probability.total_games(df.where("false"), ["spw_a"]).count() == 0


def test_totals_need_no_exchange(spark):
    df = probability.with_probabilities(spark.createDataFrame([(0.6, 0.6)], "spw_a double, spw_b double"))
    assert "Exchange" not in probability.total_games(df, ["spw_a"])._jdf.queryExecution().executedPlan().toString()


def test_draws_of_blocks_add_up():
    rows = 730
    counts = np.array([audit.block_counts([42, 5], rows, b, 4000, 100) for b in range(8)])
    assert (counts.sum(axis=0) == rows).all()
    assert np.allclose(counts.mean(axis=1), [100] * 7 + [30], rtol=0.02)
    assert np.allclose(counts.var(axis=1), [100 * (1 - 100 / rows)] * 7 + [30 * (1 - 30 / rows)], rtol=0.12)


@pytest.mark.parametrize("block", [1 << 14, 64])
def test_resampling_is_that_of_rows(spark, block):
    """Each row is drawn once on average with the variance of a multinomial; the result does not depend on partitions."""
    rng = np.random.default_rng(6)
    d = rng.normal(0.02, 0.3, 500)
    df = spark.createDataFrame([(i, "a" if i % 5 else None, float(x)) for i, x in enumerate(d)], "match_id long, s string, d double")
    out = {r.s: r for r in audit.resampled(df, ["s"], "d", ["match_id"], 1000, block_rows=block).collect()}
    for s, use in (("a", np.arange(500) % 5 > 0), (None, np.arange(500) % 5 == 0)):
        x, r = d[use], out[s]
        assert r.n == len(x) and r.mean == pytest.approx(x.mean(), abs=4 * x.std() / math.sqrt(len(x)) / 30)
        assert r.ci_high - r.ci_low == pytest.approx(3.92 * x.std() / math.sqrt(len(x)), rel=0.15)
    again = {r.s: r for r in audit.resampled(df.repartition(7), ["s"], "d", ["match_id"], 1000, block_rows=block).collect()}
    assert all(again[s].ci_low == pytest.approx(out[s].ci_low, abs=1e-12) for s in out)
    sums = audit.block_sums(9, 42, 40, 0, np.ones(40), 50)
    assert (sums == 40).all()
    assert audit.resampled(df.where("false"), ["s"], "d", ["match_id"]).count() == 0


def test_draws_of_several_blocks(monkeypatch):
    """As many draws as counted, each row as likely as another, with the variance of drawing with replacement."""
    d = np.random.default_rng(7).normal(size=100)
    sums = audit.block_sums(5, 42, 730, 3, d, 4000, 100)
    counts = audit.block_counts([42, 5], 730, 3, 4000, 100)
    assert (audit.block_sums(5, 42, 730, 3, np.ones(100), 4000, 100) == counts).all()
    assert sums.mean() == pytest.approx(100 * d.mean(), abs=4 * 10 * d.std() / math.sqrt(4000))
    assert (sums - counts * d.mean()).var() == pytest.approx(100 * d.var(), rel=0.12)
    monkeypatch.setattr(audit, "_mixed", None)  # the slow hash that SQL follows is for slices of one block
    assert (audit.block_sums(5, 42, 730, 3, d, 4000, 100) == sums).all()


@pytest.mark.parametrize("rows, block", [(40_000, 40_000), (40_000, 9_000), (30, 7), (1 << 15, 1 << 14)])
def test_draws_of_large_slices_are_those_of_sql(rows, block):
    """Each draw by the SQL's arithmetic, in plain numbers; blocks and shares of the resamples add up to the whole."""
    def mixed(x):
        for _ in range(2):
            x = (x >> 16 ^ x) * 73244475 & 0xFFFFFFFF
        return x >> 16 ^ x

    d, code = np.random.default_rng(11).normal(size=rows), 0xFFFFFFF0
    want = [sum(d[mixed(mixed(mixed(code + 42 & 0xFFFFFFFF) ^ r) ^ j) * rows >> 32] for j in range(rows)) for r in (1, 2)]
    got = sum(audit.hashed_sums(code, 42, rows, at, d[at:at + block], 1, 3) for at in range(0, rows, block))
    assert got == pytest.approx(want, abs=1e-9)
    ones = sum(audit.hashed_sums(code, 42, rows, at, np.ones(min(block, rows - at)), 0, 3) for at in range(0, rows, block))
    assert (ones == rows).all()


@pytest.fixture(scope="module")
def large(spark):
    return spark.range(60_000).selectExpr("id match_id", "if(id % 3 = 0, 'b', 'a') slice", "'x' value", "sin(id) + 0.02 d")


def test_intervals_of_large_slices_equal_sql(large):
    """Slices of more rows than are packed together, against DuckDB by the queries' own SQL of the draws."""
    con = duckdb.connect()
    con.register("members", large.toPandas())
    want = {r[0]: r[1:] for r in con.execute(f"WITH {oracles._drawn('slice, value', 'd', 'members')} SELECT slice, mean, ci_low, ci_high, p_better FROM ends").fetchall()}
    for how in ({}, {"block_rows": 5000}):
        got = {r.slice: (r.mean, r.ci_low, r.ci_high, r.p_better) for r in audit.resampled(large, ["slice", "value"], "d", ["match_id"], **how).collect()}
        assert set(got) == set(want) == {"a", "b"}
        assert all(got[s] == pytest.approx(want[s], abs=1e-9) for s in want)


def test_slices_can_be_drawn_by_block(large):
    """Without the hash the same distribution, in one block or several."""
    exact = {r.slice: r for r in audit.resampled(large, ["slice", "value"], "d", ["match_id"]).collect()}
    for r in audit.resampled(large, ["slice", "value"], "d", ["match_id"], block_rows=3000, hashed=False).collect():
        assert r.n == exact[r.slice].n and r["mean"] == pytest.approx(exact[r.slice]["mean"], abs=2e-3)
        assert r.ci_high - r.ci_low == pytest.approx(exact[r.slice].ci_high - exact[r.slice].ci_low, rel=0.15)


def test_prices_are_joined_once(spark, sf):
    """What the resampling and the rank correlation read again and again is a written table."""
    for name in ("bootstrap_ci", "rank_correlation"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "orderkey" not in plan


def pooled(rows):
    blocks = []
    for x, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        ys = [y for _, y in group]
        blocks.append([x, x, sum(ys), len(ys)])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    return [(a, b, t / n, n) for a, b, t, n in blocks]


@pytest.mark.parametrize("falling", [False, True])
def test_pools_that_cross_parts(spark, falling):
    """Parts of a few pools each: the pools that come out are those of one task."""
    rng = np.random.default_rng(8)
    x = rng.random(800).round(3)
    y = (rng.random(800) < (1 - x if falling else x)).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)] + [(None, 1)], "p double, actual_a_won int")
    got = sorted(tuple(r) for r in calibrate.fit(df, "p", symmetric=False, pools=4).collect())
    want = pooled(list(zip(x.tolist(), y.tolist())))
    assert got == [(a, b, pytest.approx(v), n) for a, b, v, n in want]
    model = calibrate.fit(df, "p", symmetric=False)
    asked = [-1.0, 0.0, 0.2345, 0.5, 0.77777, 2.0]
    frame = spark.createDataFrame([(v,) for v in asked] + [(None,)], "p double")
    knots = np.array([(e, v) for a, b, v, _ in want for e in (a, b)])
    for r in calibrate.apply(model, frame, "p").collect():
        assert r.calibrated == (None if r.p is None else pytest.approx(float(np.clip(np.interp(r.p, *knots.T), 0.001, 0.999))))


def test_ranks_of_all_rows(spark):
    rng = np.random.default_rng(9)
    t = pd.DataFrame({"x": rng.integers(0, 20, 300).astype(float), "y": rng.integers(0, 30, 300).astype(float), "g": rng.integers(0, 2, 300)})
    df = spark.createDataFrame(t).unionByName(spark.createDataFrame([(None, 1.0, 0)], "x double, y double, g long"))
    rho = lambda a: a.x.rank().corr(a.y.rank())
    one = metrics.spearman(df, "x", "y").first()
    assert one.n == 300 and one.rho == pytest.approx(rho(t))
    assert {r.g: r.rho for r in metrics.spearman(df, "x", "y", by=["g"]).collect()} == pytest.approx({g: rho(a) for g, a in t.groupby("g")})


def test_rank_maps_use_only_earlier_pairs(spark):
    rng = np.random.default_rng(10)
    rows = [(day(int(k)), int(r), float(1500 - 30 * math.log(r) + e)) for k, r, e in zip(rng.integers(-200, 120, 900), rng.integers(1, 900, 900), rng.normal(0, 9, 900))]
    pairs = spark.createDataFrame(rows, "date date, rank int, rating double")
    got = {r.as_of: r for r in ratings.rank_maps(pairs, "2000-01-01", "2000-03-01", 14, least=560).collect()}
    assert len(got) == 6 and sum(r.a is None for r in got.values()) >= 1
    for t, r in got.items():
        use = [(math.log(k), y) for d, k, y in rows if d < t]
        assert r.n == len(use)
        if len(use) >= 560:
            b, a = np.polyfit(*np.array(use).T, 1)
            assert (r.a, r.b) == pytest.approx((a, b)) and r.r2 == pytest.approx(np.corrcoef(np.array(use).T)[0, 1] ** 2)
        else:
            assert r.a is None and r.b is None and r.r2 is None
    assert ratings.rank_fit(pairs, 901).first().a is None and ratings.rank_fit(pairs, 900).first().a is not None


def test_refitted_predictions_do_not_see_the_future(spark, sf):
    m = queries.matches(spark, sf)
    how = {"every": 28, "least_pairs": 30}
    whole = {r.match_id: r.p_a for r in walkforward.warm_predictions(m, "2000-01-01", "2000-06-01", **how).collect()}
    part = walkforward.warm_predictions(m.where("date < '2000-03-01'"), "2000-01-01", "2000-06-01", **how).collect()
    assert len(part) > 10 and all(whole[r.match_id] == pytest.approx(r.p_a, abs=1e-12) for r in part)
    plain = {r.match_id: r.p_a for r in walkforward.warm_predictions(m, "2000-01-01", "2000-06-01", least_pairs=10 ** 9).collect()}
    assert plain == pytest.approx({r.match_id: r.p_a for r in reshape.in_window(ratings.blended(m, ratings.rate(ratings.tracks(m))), datetime.date(2000, 1, 1),
                                                                              datetime.date(2000, 6, 1)).collect()})


def test_second_tour_levels(spark):
    levels = spark.createDataFrame([("PM",), ("P",), ("I",), ("G",), ("Z",)], "l string")
    assert [r[0] for r in levels.select(reshape.level_k(F.col("l"), reshape.K_BY_LEVEL_WTA)).collect()] == [28, 24, 20, 32, 24]


def test_walk_forward_markets_equal_loops(spark, sf):
    predicted = walkforward.market_predictions(walkforward.score_backtest(queries.matches(spark, sf), "2000-01-01", "2000-10-01", least_obs=2)).persist()
    rows = predicted.collect()
    got = {r.market: r for r in walkforward.ten_markets(predicted).collect()}
    assert len(got) == 10 and len(rows) > 20 and sorted(r.place for r in got.values()) == list(range(1, 11))
    loss = lambda p, y: -math.log(min(max(p if y else 1 - p, 1e-6), 1 - 1e-6))
    for name, p, y in (("over 22.5", "p_over_22_5", lambda r: r.actual_total_games > 22.5), ("2-1", "p_a_2_1", lambda r: (r.actual_a_sets, r.actual_b_sets) == (2, 1)),
                       ("three sets", "p_match_total_sets_3", lambda r: r.actual_a_sets + r.actual_b_sets == 3)):
        assert got[name].n == len(rows) and got[name].log_loss == pytest.approx(np.mean([loss(r[p], y(r)) for r in rows]))
        assert got[name].base_rate == pytest.approx(np.mean([y(r) for r in rows]))
