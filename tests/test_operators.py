import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestry import queries
from contestry.operators import audit, calibrate, metrics, pricing, ratings, reshape, skills
from contestry.plans import walkforward
from contestry.sources import files
from contestry.streaming.ratings import rate_stream


@pytest.fixture(scope="module")
def small(spark, sf):
    return queries.matches(spark, sf).where("match_id < 4000").persist()


def walk(rows, rank_map=None):
    """Both tracks in one loop, coupled as usual."""
    tracks, n, out = {}, {}, {}

    def start(track, who, rank):
        r, k = tracks.get((track, who)), n.get((track, who), 0)
        mapped = rank_map[0] + rank_map[1] * math.log(rank) if rank_map and rank is not None else None
        if r is None:
            return 1500.0 if mapped is None else mapped
        share = max(0.0, 1 - k / 30)
        return r if mapped is None or share == 0 else share * mapped + (1 - share) * r

    for m in sorted(rows, key=lambda m: (m.date, m.match_id)):
        k, ps, counts = reshape.K_BY_LEVEL.get(m.tourney_level, 24), [], (n.get(("o", m.winner_id), 0), n.get(("o", m.loser_id), 0))
        for t in (m.surface + "!", "o"):
            rw, rl = start(t, m.winner_id, m.winner_rank), start(t, m.loser_id, m.loser_rank)
            p = 1 / (1 + 10 ** ((rl - rw) / 400))
            ps.append(p)
            tracks[t, m.winner_id], tracks[t, m.loser_id] = rw + k * (1 - p), rl - k * (1 - p)
            for who in (m.winner_id, m.loser_id):
                n[t, who] = n.get((t, who), 0) + 1
        p_w = 0.5 * ps[0] + 0.5 * ps[1]
        out[m.match_id] = (p_w if m.winner_id < m.loser_id else 1 - p_w, min(counts) < 30)
    return out


@pytest.mark.parametrize("rank_map", [None, (2000.0, -90.0)])
def test_fold_equals_walk(small, rank_map):
    got = {r.match_id: (r.p_a, r.is_cold_start) for r in ratings.blended(small, ratings.rate(ratings.tracks(small), rank_map)).collect()}
    want = walk(small.collect(), rank_map)
    assert got.keys() == want.keys()
    assert all(got[k] == (pytest.approx(want[k][0], abs=1e-12), want[k][1]) for k in want)


def test_past_predictions_do_not_see_the_future(small):
    day = datetime.date(1998, 1, 1)
    part = small.where(F.col("date") < F.lit(day))
    whole = {r.match_id: r.p_a for r in ratings.blended(small, ratings.rate(ratings.tracks(small))).collect()}
    assert all(whole[r.match_id] == r.p_a for r in ratings.blended(part, ratings.rate(ratings.tracks(part))).collect())


@pytest.mark.parametrize("rank_map", [None, (2000.0, -100.0)])
def test_fold_by_blocks_equals_one_block(small, rank_map):
    want = sorted(map(tuple, ratings.rate(ratings.tracks(small), rank_map).collect()))
    rows = ratings.rate(ratings.tracks(small), rank_map, block_rows=2 * small.count() // 7 + 1)
    assert sorted(map(tuple, rows.collect())) == want and len(rows.columns) == 8
    one_day = small.withColumn("date", F.lit("2000-01-03").cast("date"))
    want = sorted(map(tuple, ratings.rate(ratings.tracks(one_day), rank_map).collect()))
    assert sorted(map(tuple, ratings.rate(ratings.tracks(one_day), rank_map, block_rows=small.count() // 2).collect())) == want


def test_empty_fold(small):
    none = small.where("false")
    assert ratings.blended(none, ratings.rate(ratings.tracks(none))).count() == 0
    assert math.isnan(metrics.summary(none.withColumn("p", F.lit(0.5)).withColumn("actual_a_won", F.lit(1)), "p").first().log_loss)


def test_ridge_equals_dense_solution():
    rng = np.random.default_rng(1)
    n, rows = 6, 80
    i, j = rng.integers(0, n, rows), rng.integers(0, n, rows)
    w, y = rng.random(rows) + 0.1, rng.normal(size=rows)
    x = np.zeros((rows, 2 * n))
    x[np.arange(rows), i] = 1
    x[np.arange(rows), n + j] -= 1
    beta = np.linalg.solve(x.T @ (w[:, None] * x) + 2.0 * np.eye(2 * n), x.T @ (w * y))
    serve, back = skills.solve(w, w * y, i, j, n, 2.0)
    assert np.allclose(np.concatenate([serve, back]), beta, atol=1e-9)


def test_refit_dates(spark):
    days = ["1999-12-24", "1999-12-25", "2000-01-01", "2000-01-07", "2000-01-08"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(walkforward.refit_date(F.col("d").cast("date"), "2000-01-01", 7).alias("r"))
    assert [str(r.r) for r in df.collect()] == ["None", "1999-12-25", "2000-01-01", "2000-01-01", "2000-01-08"]
    assert skills.grid("2000-01-01", "2000-01-10", 7) == ["1999-12-25", "2000-01-01", "2000-01-08"]


def test_skills_are_recovered(spark):
    long, truth = files.synthetic(spark, 60, 4000)
    table = skills.fit(skills.gram(long, ["2025-01-15"], lookback=1500)).where("n_obs >= 10")
    rho = metrics.spearman(table.join(truth, ["player_id", "surface"]), "serve_skill", "true_serve_skill", by=["surface"])
    assert {r.surface: r.rho > 0.5 for r in rho.collect()}["Hard"]


def test_backtest_uses_only_the_past(spark, sf):
    m = queries.matches(spark, sf)
    whole = walkforward.backtest(m, "2000-01-01", "2000-03-01", least_obs=2)
    past = walkforward.backtest(m.where("date < '2000-03-01'"), "2000-01-01", "2000-03-01", least_obs=2)
    key = lambda df: sorted((r.match_id, round(r.model_prob_a, 9)) for r in df.collect())
    assert key(whole) == key(past)


def test_isotonic_is_symmetric_and_rising(spark):
    rng = np.random.default_rng(2)
    p = rng.random(600).round(2)
    y = (rng.random(600) < p ** 2 / (p ** 2 + (1 - p) ** 2)).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, actual_a_won int")
    model = calibrate.fit(df, "p")
    c = [r.calibrated for r in calibrate.curve(model, spark).orderBy("p").collect()]
    assert c == sorted(c) and c[9] == pytest.approx(0.5)
    assert all(a + b == pytest.approx(1, abs=0.05) for a, b in zip(c, c[::-1]))


def test_bootstrap(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "a" if i < 400 else "b", float(rng.random() * 0.8 + 0.1), 0.5, int(rng.random() < 0.5)) for i in range(420)]
    df = spark.createDataFrame(rows, "match_id long, s string, p_model double, fair_prob_a double, actual_a_won int")
    out = {r.s: r for r in audit.bootstrap(df, ["s"]).collect()}
    assert math.isnan(out["b"].mean) and out["b"].n == 20
    p, y = np.array([r[2] for r in rows[:400]]), np.array([r[4] for r in rows[:400]])
    d = -(y * np.log(p) + (1 - y) * np.log(1 - p)) + math.log(0.5)
    assert out["a"].mean == pytest.approx(d.mean(), abs=0.01)
    assert out["a"].ci_low < d.mean() < out["a"].ci_high
    assert out["a"].ci_high - out["a"].ci_low == pytest.approx(3.92 * d.std() / 20, rel=0.2)


def test_time_split_is_exact(spark):
    df = spark.createDataFrame([(i, datetime.date(2000, 1, 1 + i % 5)) for i in range(21)], "match_id long, date date")
    assert metrics.time_split(df, 0.3).where("is_train").count() == 6


def test_files(spark, tmp_path):
    (tmp_path / "2000.csv").write_text(" match_id ,tourney_date,winner_rank,extra\n1,20000101,abc,x\n2,20001399,7,y\n")
    (tmp_path / "2001.csv").write_text("match_id,surface\n3,Clay\n")
    df = files.load_matches(spark, {2000: f"{tmp_path}/2000.csv", 2001: f"{tmp_path}/2001.csv"})
    rows = {r.match_id: r for r in df.withColumn("date", reshape.parse_day(F.col("tourney_date"))).collect()}
    assert rows[1].winner_rank is None and rows[2].date is None and rows[3].year == 2001 and str(rows[1].date) == "2000-01-01"
    files.save(df, f"{tmp_path}/out", "csv")
    files.save(df, f"{tmp_path}/out", "csv")
    assert spark.read.csv(f"{tmp_path}/out", header=True).count() == 3


def test_stream_equals_fold(spark, small, tmp_path):
    rows = small.where("match_id < 800").select(F.lit("overall").alias("track"), F.col("date").cast("string").alias("date"), "match_id", "winner_id",
                                                "loser_id", reshape.level_k(F.col("tourney_level")).cast("double").alias("k"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = rate_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("rated").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    part = small.where("match_id < 800")
    want = {r.match_id: r.p_w for r in ratings.rate(ratings.tracks(part, surfaces=False)).collect()}
    got = {r.match_id: r.p_w for r in spark.table("rated").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_files_to_priced_predictions(spark, tmp_path):
    """Yearly files with the headers they come with, through ratings, names and prices to a loss."""
    names = {1: "Ada Byron", 2: "Bo van Dyk", 3: "Cy Ek"}
    rows = [(2000, "2000-1", k, f"2000{1 + k // 20:02d}{1 + k % 20:02d}", *pair) for k, pair in enumerate([(1, 2), (1, 3), (3, 2), (1, 2)] * 8)]
    lines = ["tourney_id,tourney_name,surface,tourney_level,tourney_date,match_num,winner_id,winner_name,loser_id,loser_name,score,best_of,"
             "w_svpt,w_1stWon,w_2ndWon,l_svpt,l_1stWon,l_2ndWon"]
    lines += [f"{t},Cup,Hard,A,{d},{k},{w},{names[w]},{l},{names[l]},6-4 6-4,3,60,30,12,62,28,10" for _, t, k, d, w, l in rows]
    (tmp_path / "m.csv").write_text("\n".join(lines))
    short = {1: "Byron A.", 2: "Van Dyk B.", 3: "Ek C."}
    prices = ["Date ,Tournament,Winner,Loser,PSW,PSL,AvgW,AvgL"]
    prices += [f"{d[:4]}-{d[4:6]}-{d[6:]},Cup,{short[w]},{short[l]},{'' if k % 8 == 0 else 1.5},{'' if k % 8 == 0 else 2.7},1.4,2.6" for _, _, k, d, w, l in rows]
    (tmp_path / "o.csv").write_text("\n".join(prices))
    raw = files.load_matches(spark, {2000: f"{tmp_path}/m.csv"})
    assert files.repeated_ids(raw).count() == 0 and [r.match_num for r in raw.orderBy("match_id").collect()] == list(range(32))
    matches = reshape.clean_matches(raw)
    rated = {r.match_id: r.p_w for r in ratings.rate(ratings.tracks(matches, surfaces=False)).collect()}
    assert len(rated) == 32 and rated[min(rated)] == pytest.approx(0.5)
    clean = pricing.clean_odds(files.load_odds(spark, [f"{tmp_path}/o.csv"]))
    assert sorted({(r.odds_w, r.odds_l) for r in clean.collect()}) == [(1.4, 2.6), (1.5, 2.7)] and clean.count() == 32
    p = spark.createDataFrame(list(rated.items()), "match_id long, p_model double")
    won = matches.join(p, "match_id").select("match_id", "date", F.col("winner_id").alias("player_a_id"), F.col("loser_id").alias("player_b_id"),
                                           F.lit(1).alias("actual_a_won"), "p_model")
    index = pricing.name_index(spark.createDataFrame(list(names.items()), "player_id long, name string"))
    priced = pricing.join_odds(won, clean, index, days=0)
    assert priced.count() == 32 and {r.odds_a for r in priced.collect()} == {1.4, 1.5}
    loss = metrics.summary(priced, "p_model").first()
    want = -sum(math.log(x) for x in rated.values()) / 32
    assert any(isinstance(v, float) and v == pytest.approx(want) for v in loss.asDict().values())


def test_unseen_players_count_as_average(spark):
    table = spark.createDataFrame([("Hard", "2000-01-03", 1, 9, 0.3, 0.1, 0.5, 0.02, 0.01)],
                                  "surface string, as_of string, player_id long, n_obs int, serve_skill double, return_skill double, intercept double, avg_serve double, avg_return double")
    pairs = spark.createDataFrame([("Hard", "2000-01-03", 1, 77), ("Hard", "2000-01-03", 78, 77)], "surface string, as_of string, player_a_id long, player_b_id long")
    got = {r.player_a_id: r for r in skills.predict_points(pairs, table).collect()}
    logit = lambda x: 1 / (1 + math.exp(-x))
    assert got[1].spw_a == pytest.approx(logit(0.5 + 0.3 - 0.01)) and got[1].spw_b == pytest.approx(logit(0.5 + 0.02 - 0.1))
    assert got[78].spw_a == pytest.approx(logit(0.5 + 0.02 - 0.01)) and got[78].n_obs_b == 0
