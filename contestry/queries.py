"""Registered queries of the contest operators, each over the whole derived tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import odds, probability
from .functions.names import normal_form, surname_first
from .operators import audit, calibrate, metrics, pricing, ratings, reshape, skills
from .plans import walkforward
from .sources import files, fixtures
from .tables import spread

#: Test window of the derived tables.
START, END = "2000-01-01", "2000-10-01"
_FROM, _TO = datetime.date.fromisoformat(START), datetime.date.fromisoformat(END)


def matches(spark: SparkSession, d: str) -> DataFrame:
    return reshape.clean_matches(fixtures.raw_matches(spark, d))


def canon(spark: SparkSession, d: str) -> DataFrame:
    return ratings.rank_probability(reshape.canonical(matches(spark, d)))


def priced(spark: SparkSession, d: str) -> DataFrame:
    index = pricing.name_index(reshape.latest_names(matches(spark, d)))
    return pricing.join_odds(canon(spark, d), pricing.clean_odds(fixtures.raw_odds(spark, d)), index)


def points(spark: SparkSession, d: str) -> DataFrame:
    """Serve chances of both players of a match from its own counts, inside [0.35, 0.85]."""
    m = matches(spark, d).where("w_svpt > 0 AND l_svpt > 0")
    share = lambda x: F.greatest(F.least(F.try_divide(F.col(f"{x}_1stWon") + F.col(f"{x}_2ndWon"), F.col(f"{x}_svpt")), F.lit(0.85)), F.lit(0.35))
    return spread(m.select("match_id", share("w").alias("spw_a"), share("l").alias("spw_b")), "match_id")


def rounded(df: DataFrame, places: int = 8) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def long_format(spark, d):
    return rounded(reshape.long_format(matches(spark, d)).select("match_id", "player_id", "opp_id", "surface", "won", "svpt", "sv_won", "rpt_won", "spw", "rpw"))


def clean(spark, d):
    return matches(spark, d).select("match_id", "date", "surface", "tourney_level", "winner_rank", "loser_rank")


def canonical_pairs(spark, d):
    return rounded(canon(spark, d).select("match_id", "player_a_id", "player_b_id", "a_rank", "b_rank", "actual_a_won", "p_model"))


def date_window(spark, d):
    return reshape.in_window(matches(spark, d), _FROM, _TO).select("match_id", "date")


def level_k(spark, d):
    return matches(spark, d).select("match_id", reshape.level_k(F.col("tourney_level")).alias("k"))


def unknown_levels(spark, d):
    return reshape.unknown_levels(matches(spark, d))


def score_parse(spark, d):
    facts = reshape.score_facts(reshape.canonical(matches(spark, d)))
    text = F.array_join(F.transform("from_a", lambda s: F.concat(s["a"].cast("string"), F.lit("-"), s["b"].cast("string"))), " ")
    return facts.select("match_id", text.alias("from_a"), "n_sets", "winner_sets", "loser_took_set", "total_games", "a_sets", "b_sets")


def score_outcomes(spark, d):
    facts = reshape.score_facts(reshape.canonical(matches(spark, d)))
    return facts.groupBy("best_of", "a_sets", "b_sets").agg(F.count("*").alias("n"))


def odds_clean(spark, d):
    return rounded(pricing.clean_odds(fixtures.raw_odds(spark, d)).select("odds_id", "day", "odds_w", "odds_l", "margin"))


def odds_coverage(spark, d):
    return rounded(pricing.clean_odds(fixtures.raw_odds(spark, d)).agg(F.count("*").alias("n"), F.avg("margin").alias("mean_margin")))


def name_norm(spark, d):
    names = reshape.latest_names(matches(spark, d))
    return names.select("player_id", "name", surname_first(F.col("name")).alias("short"), normal_form(surname_first(F.col("name"))).alias("key"))


def odds_match(spark, d):
    return rounded(priced(spark, d).select("match_id", "odds_id", "odds_a", "odds_b", "implied_prob_a", "fair_prob_a", "vig"))


def odds_match_rate(spark, d):
    one = priced(spark, d).select("match_id", F.lit(1.0).alias("hit"))
    return rounded(matches(spark, d).join(one, "match_id", "left").agg(F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("rate")))


def value_kelly(spark, d):
    return rounded(pricing.value_bets(priced(spark, d)).select("match_id", "edge", "ev", "is_value", "stake"))


def prior_obs(spark, d):
    return reshape.prior_matches(matches(spark, d))


def player_obs(spark, d):
    return reshape.player_rows(reshape.long_format(matches(spark, d)))


def distinct_players(spark, d):
    long = reshape.long_format(matches(spark, d))
    return long.select("player_id").union(long.select("opp_id")).distinct()


def surface_counts(spark, d):
    return metrics.value_counts(matches(spark, d), "surface")


def spw_means(spark, d):
    return rounded(reshape.long_format(matches(spark, d)).groupBy("surface").agg(F.avg("spw").alias("mean_spw"), F.avg("rpw").alias("mean_rpw")))


def elo_vanilla(spark, d):
    m = matches(spark, d)
    out = ratings.rate(ratings.tracks(m, surfaces=False)).select("match_id", F.lit(None).cast("double").alias("p_surface"), F.col("p_w"))
    return rounded(out.select("match_id", "p_w"))


def elo_surface(spark, d):
    m = matches(spark, d)
    return rounded(ratings.blended(m, ratings.rate(ratings.tracks(m))).select("match_id", "actual_a_won", "p_a", "a_n_obs", "b_n_obs", "is_cold_start"))


def elo_blend_sweep(spark, d):
    m = matches(spark, d)
    sweep = reshape.in_window(ratings.blend_sweep(m, ratings.rate(ratings.tracks(m))), _FROM, _TO)
    return rounded(metrics.summary(sweep, "p_a", by=["weight"]))


def _rank_fit(spark, d):
    before = matches(spark, d).where(F.col("date") < F.lit(_FROM))
    return ratings.rank_fit(ratings.rank_pairs(before, ratings.rate(ratings.tracks(before, surfaces=False))))


def rank_fit(spark, d):
    return rounded(_rank_fit(spark, d), 6)


def rank_ratings(spark, d):
    return rounded(ratings.rank_ratings(_rank_fit(spark, d)), 6)


def _warmstart(spark, d):
    return walkforward.warm_predictions(matches(spark, d), START, END)


def warmstart(spark, d):
    return rounded(_warmstart(spark, d).select("match_id", "player_a_id", "player_b_id", "p_a", "a_n_obs", "b_n_obs", "is_cold_start"))


def _with_prices(spark, d, predictions):
    index = pricing.name_index(reshape.latest_names(matches(spark, d)))
    return pricing.join_odds(predictions, pricing.clean_odds(fixtures.raw_odds(spark, d)), index)


def cold_warm(spark, d):
    return rounded(audit.cold_warm(_with_prices(spark, d, _warmstart(spark, d))))


def rank_maps(spark, d):
    """The line from ranks to ratings as of every fourth week, from the matches before it."""
    m = matches(spark, d)
    pairs = ratings.rank_pairs(m, ratings.rate(ratings.tracks(m, surfaces=False)))
    return rounded(ratings.rank_maps(pairs, START, END, 28), 6)


def warmstart_asof(spark, d):
    """Predictions with the rank line of the last refit before each match."""
    out = walkforward.warm_predictions(matches(spark, d), START, END, every=28, least_pairs=ratings.LEAST_PAIRS)
    return rounded(out.select("match_id", "player_a_id", "player_b_id", "p_a", "a_n_obs", "b_n_obs", "is_cold_start"))


def _both_models(spark, d):
    """Warmstart and plain blended predictions of the same priced matches, by day and players."""
    m, keys = matches(spark, d), ["date", "player_a_id", "player_b_id"]
    plain = reshape.in_window(ratings.blended(m, ratings.rate(ratings.tracks(m))), _FROM, _TO)
    warm = _with_prices(spark, d, _warmstart(spark, d)).withColumnRenamed("p_a", "p_warm")
    return warm.join(plain.select(*keys, F.col("p_a").alias("p_base")), keys)


def compare_models(spark, d):
    return rounded(audit.compare_models(_both_models(spark, d)))


def disagreement_change(spark, d):
    return rounded(audit.disagreement_change(_both_models(spark, d)))


def tour_report(spark, d):
    """The second tour's report: its own update sizes, guard and bucket edges, and every level that is there."""
    warm = walkforward.warm_predictions(matches(spark, d), START, END, levels=reshape.K_BY_LEVEL_WTA, least_pairs=ratings.LEAST_PAIRS)
    rows = audit.slice_rows(_with_prices(spark, d, warm), "p_a", levels=[], difference=audit.DIFFERENCE_WTA, favourite=audit.FAVOURITE_WTA, start="is_cold_start")
    return rounded(audit.slice_means(rows, {"all": 1}))


def after_warmup(spark, d):
    """Plain and blended ratings over the test window, and without its first 90 days."""
    m = matches(spark, d)
    rated = reshape.in_window(ratings.blend_sweep(m, ratings.rate(ratings.tracks(m)), (0.0, 0.5)), _FROM, _TO)
    spans = F.array(F.lit("window"), F.lit("after warm-up"))
    model = F.when(F.col("weight") == 0, "overall").otherwise("blended").alias("model")
    late = F.col("date") >= F.lit(_FROM + datetime.timedelta(days=90))
    rows = rated.select(model, "p_a", "actual_a_won", F.explode(F.when(late, spans).otherwise(F.slice(spans, 1, 1))).alias("span"))
    return rounded(metrics.summary(rows, "p_a", by=["model", "span"]))


def match_prob(spark, d):
    return rounded(probability.with_probabilities(points(spark, d)))


def set_score_dist(spark, d):
    p = probability.with_probabilities(points(spark, d))
    return rounded(probability.set_score_rows(p, ["match_id"]))


def markets_bo3(spark, d):
    return rounded(probability.with_markets(probability.with_probabilities(points(spark, d)), 3).drop("spw_a", "spw_b", "hold_a", "hold_b", "tiebreak"))


def markets_bo5(spark, d):
    return rounded(probability.with_markets(probability.with_probabilities(points(spark, d)), 5).drop("spw_a", "spw_b", "hold_a", "hold_b", "tiebreak"))


def total_games(spark, d):
    """By distinct serve chances: matches that share them share the distribution."""
    p = probability.with_probabilities(spread(points(spark, d).select("spw_a", "spw_b").distinct(), "spw_a", "spw_b"))
    keys = ["spw_a", "spw_b"]
    return rounded(probability.total_games(p, keys))


def over_line(spark, d):
    p = probability.with_probabilities(spread(points(spark, d).select("spw_a", "spw_b").distinct(), "spw_a", "spw_b"))
    keys = ["spw_a", "spw_b"]
    return rounded(probability.over_lines(p, keys))


def logloss(spark, d):
    return rounded(metrics.summary(canon(spark, d), "p_model", by=["surface"]))


def reliability(spark, d):
    return rounded(metrics.reliability(canon(spark, d), "p_model"))


def market_reliability(spark, d):
    return rounded(metrics.reliability_by_market(priced(spark, d), "p_model"))


def book_compare(spark, d):
    return rounded(metrics.against_market(priced(spark, d), "p_model"))


def shrinkage(spark, d):
    return rounded(canon(spark, d).select("match_id", odds.shrink(F.col("p_model"), 0.20).alias("match_level"), odds.shrink(F.col("p_model"), 0.10).alias("point_level")))


def market_eval(spark, d):
    """Set markets from a match's own serve chances against its score."""
    m = matches(spark, d).where("best_of = 3")
    facts = reshape.score_facts(reshape.canonical(m)).select("match_id", "actual_a_won", "a_sets", "b_sets", "total_games")
    a_won = F.col("winner_id") < F.col("loser_id")
    p = points(spark, d).join(m.select("match_id", a_won.alias("a_won")), "match_id")
    p = p.select("match_id", F.when(F.col("a_won"), F.col("spw_a")).otherwise(F.col("spw_b")).alias("spw_a"),
                 F.when(F.col("a_won"), F.col("spw_b")).otherwise(F.col("spw_a")).alias("spw_b"))
    rows = probability.with_markets(probability.with_probabilities(p), 3).join(facts, "match_id")
    is_ = lambda a, b: ((F.col("a_sets") == a) & (F.col("b_sets") == b)).cast("int")
    rows = rows.withColumns({"y20": is_(2, 0), "y21": is_(2, 1), "y02": is_(0, 2), "y12": is_(1, 2), "ya": (F.col("a_sets") > 0).cast("int"),
                             "yb": (F.col("b_sets") > 0).cast("int"), "y3": (F.col("a_sets") + F.col("b_sets") == 3).cast("int")})
    return rounded(metrics.markets(rows, {
        "match": ("p_match_bo3", "actual_a_won"), "2-0": ("p_a_2_0", "y20"), "2-1": ("p_a_2_1", "y21"), "0-2": ("p_b_2_0", "y02"),
        "1-2": ("p_b_2_1", "y12"), "a set for A": ("p_a_wins_at_least_one_set", "ya"), "a set for B": ("p_b_wins_at_least_one_set", "yb"),
        "three sets": ("p_match_total_sets_3", "y3")}), 6)


def slices_grouping_sets(spark, d):
    return rounded(audit.slices(priced(spark, d)))


def smallest_gaps(spark, d):
    return rounded(audit.slices(priced(spark, d)).orderBy("gap", "slice", "value").limit(10))


def difference_buckets(spark, d):
    return rounded(audit.buckets(priced(spark, d), "abs_difference", audit.DIFFERENCE))


def favourite_buckets(spark, d):
    return rounded(audit.buckets(priced(spark, d), "favourite", audit.FAVOURITE))


def directional(spark, d):
    return rounded(audit.directional(priced(spark, d)))


def disagreement_tails(spark, d):
    return rounded(audit.tails(priced(spark, d)))


def top_disagreements(spark, d):
    return rounded(audit.top_disagreements(priced(spark, d)))


def bootstrap_ci(spark, d):
    return rounded(audit.bootstrap(priced(spark, d), ["surface"]))


def slice_report(spark, d):
    """All slices with the interval of the loss difference, from rows drawn anew inside each slice."""
    return rounded(audit.slice_report(priced(spark, d)))


def model_wins(spark, d):
    """The slices in which the model is more often better than the market."""
    return rounded(audit.model_wins(audit.slice_report(priced(spark, d))))


def latest_price(spark, d):
    """The price of the same pair that was known on a match's day, however old, beside the match."""
    index = pricing.name_index(reshape.latest_names(matches(spark, d)))
    out = pricing.latest_price(canon(spark, d), pricing.clean_odds(fixtures.raw_odds(spark, d)), index)
    return rounded(out.select("match_id", "date", "odds_id", "day", "odds_w", "odds_l"))


def asof_refit(spark, d):
    rows = reshape.in_window(matches(spark, d), _FROM, _TO)
    return rows.select("match_id", "date", walkforward.refit_date(F.col("date"), START, 7).alias("as_of"))


def recency_weights(spark, d):
    long = reshape.long_format(matches(spark, d)).where((F.col("date") < F.lit(_FROM)) & (F.datediff(F.lit(_FROM), "date") <= skills.LOOKBACK))
    w = metrics.recency_weight(F.datediff(F.lit(_FROM), "date")) * F.col("svpt")
    return rounded(long.withColumn("w", w).groupBy("surface").agg(
        F.sum("w").alias("w"), (F.sum(F.col("w") * odds.logit(F.col("spw"))) / F.sum("w")).alias("intercept")), 6)


def skill_gram(spark, d):
    return rounded(skills.gram(reshape.long_format(matches(spark, d)), [START]).drop("as_of"), 6)


def skill_grid(spark, d):
    """The same sums for every weekly fit date of the test window."""
    return rounded(skills.gram(reshape.long_format(matches(spark, d)), skills.grid(START, END)), 6)


def skill_fit(spark, d):
    return rounded(skills.fit(skills.gram(reshape.long_format(matches(spark, d)), [START])), 6)


def skill_recovery(spark, d):
    """Rank correlation of fitted and true skills on the synthetic source."""
    long, truth = files.synthetic(spark)
    table = skills.fit(skills.gram(long, ["2024-06-01"], lookback=1200)).where("n_obs >= 10")
    return rounded(metrics.spearman(table.join(truth, ["player_id", "surface"]), "serve_skill", "true_serve_skill", by=["surface"]))


def backtest(spark, d):
    return rounded(walkforward.backtest(matches(spark, d), START, END).select("match_id", "as_of", "spw_a", "spw_b", "model_prob_a", "actual_a_won"), 6)


def score_markets(spark, d):
    scored = walkforward.score_backtest(matches(spark, d), START, END)
    return rounded(walkforward.market_predictions(scored).select("match_id", "p_match_bo3", "p_a_2_0", "p_match_total_sets_3", "p_over_21_5", "p_over_22_5"), 6)


def rank_correlation(spark, d):
    """Model and market over all priced matches by their ranks."""
    return rounded(metrics.spearman(priced(spark, d), "p_model", "fair_prob_a"))


def ten_markets(spark, d):
    """All ten markets with point chances shrunk, from a match's own serve chances."""
    m = matches(spark, d)
    canon_ = reshape.canonical(m)
    facts = reshape.score_facts(canon_).select("match_id", "best_of", "actual_a_won", F.col("a_sets").alias("actual_a_sets"), F.col("b_sets").alias("actual_b_sets"),
                                               F.col("total_games").alias("actual_total_games"), (F.col("a_sets") > 0).cast("int").alias("actual_a_set"),
                                               (F.col("b_sets") > 0).cast("int").alias("actual_b_set"))
    a_won = F.col("actual_a_won") == 1
    p = points(spark, d).withColumnsRenamed({"spw_a": "w", "spw_b": "l"}).join(facts, "match_id").withColumns({
        "spw_a": F.when(a_won, F.col("w")).otherwise(F.col("l")), "spw_b": F.when(a_won, F.col("l")).otherwise(F.col("w"))}).drop("w", "l")
    return rounded(walkforward.ten_markets(walkforward.market_predictions(p)), 6)


def score_market_eval(spark, d):
    """The same for walk-forward predictions, which know nothing of the match."""
    scored = walkforward.score_backtest(matches(spark, d), START, END)
    return rounded(walkforward.ten_markets(walkforward.market_predictions(scored)), 6)


def top_skills(spark, d):
    """The five best servers of each surface before the window."""
    table = skills.fit(skills.gram(reshape.long_format(matches(spark, d)), [START]))
    return rounded(skills.best(table), 6)


def time_split(spark, d):
    return metrics.time_split(canon(spark, d).select("match_id", "date"), 0.5).select("match_id", "is_train")


def split_ranges(spark, d):
    split = metrics.time_split(canon(spark, d).select("match_id", "date"), 0.5)
    return split.groupBy("is_train").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"))


def _rank_chances(spark, d):
    """Chances from ranks at nine decimals, so that equal ones are equal on every engine."""
    return canon(spark, d).withColumn("p_model", F.round("p_model", 9))


def isotonic(spark, d):
    split = metrics.time_split(_rank_chances(spark, d), 0.5)
    model = calibrate.fit(split.where("is_train"), "p_model")
    out = calibrate.apply(model, split.where("NOT is_train").select("match_id", "actual_a_won", "p_model"), "p_model")
    return out.withColumn("calibrated", F.round("calibrated", 8))


def isotonic_curve(spark, d):
    return rounded(calibrate.curve(calibrate.fit(_rank_chances(spark, d), "p_model"), spark))


_ALL = [
    clean, long_format, canonical_pairs, date_window, level_k, unknown_levels, score_parse, score_outcomes, odds_clean, odds_coverage,
    name_norm, odds_match, odds_match_rate, value_kelly, prior_obs, player_obs, distinct_players, surface_counts, spw_means, elo_vanilla,
    elo_surface, elo_blend_sweep, rank_fit, rank_ratings, warmstart, cold_warm,
    rank_maps, warmstart_asof, compare_models, disagreement_change, tour_report, after_warmup, ten_markets, score_market_eval, top_skills, match_prob, set_score_dist, markets_bo3, markets_bo5,
    total_games, over_line, logloss, reliability, market_reliability, book_compare, shrinkage, market_eval, slices_grouping_sets,
    smallest_gaps, difference_buckets, favourite_buckets, directional, disagreement_tails, top_disagreements, bootstrap_ci, slice_report, model_wins,
    latest_price, rank_correlation, asof_refit,
    recency_weights, skill_gram, skill_grid, skill_fit, skill_recovery, backtest, score_markets, time_split, split_ranges, isotonic, isotonic_curve,
]
QUERIES = {f.__name__: f for f in _ALL}
