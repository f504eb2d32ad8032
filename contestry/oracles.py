"""DuckDB SQL for the contest queries, from the same derived tables."""

from __future__ import annotations

from .functions import odds, probability
from .sources import fixtures

_RANK = "CASE WHEN {0} BETWEEN 1 AND 1500 THEN CAST({0} AS INT) END"
_CLIP = "greatest(least({0}, 1 - 1e-6), 1e-6)"
_LOSS = f"-(actual_a_won * ln({_CLIP}) + (1 - actual_a_won) * ln(1 - {_CLIP}))"
_BIN = "(" + " + ".join(f"CAST({{0}} >= CAST({e!r} AS DOUBLE) AS INT)" for e in odds.BIN_EDGES[1:]) + ")"

_TABLES = {
    "raw": fixtures.MATCHES,
    "raw_odds": fixtures.DUCK_ODDS,
    "m": rf"""SELECT * REPLACE (regexp_replace(surface, '^\s+|\s+$', '', 'g') AS surface, {_RANK.format('winner_rank')} AS winner_rank,
      {_RANK.format('loser_rank')} AS loser_rank), CAST(try_strptime(CAST(tourney_date AS VARCHAR), '%Y%m%d') AS DATE) AS date
      FROM raw WHERE w_svpt IS NOT NULL AND l_svpt IS NOT NULL AND surface IS NOT NULL""",
    "long": """SELECT *, sv_won / svpt AS spw, rpt_won / rpt AS rpw FROM (
      SELECT match_id, date, surface, winner_id AS player_id, loser_id AS opp_id, true AS won, w_svpt AS svpt, w_1stWon + w_2ndWon AS sv_won,
        l_svpt AS rpt, l_svpt - (l_1stWon + l_2ndWon) AS rpt_won FROM m WHERE w_svpt > 0 AND l_svpt > 0
      UNION ALL SELECT match_id, date, surface, loser_id, winner_id, false, l_svpt, l_1stWon + l_2ndWon, w_svpt, w_svpt - (w_1stWon + w_2ndWon)
      FROM m WHERE w_svpt > 0 AND l_svpt > 0)""",
    "canon": """SELECT *, 1 / (1 + pow(10.0, (rating_b - rating_a) / 400)) AS p_model FROM (SELECT *,
      coalesce(2000.0 - 100.0 * ln(CAST(a_rank AS DOUBLE)), 1500.0) AS rating_a, coalesce(2000.0 - 100.0 * ln(CAST(b_rank AS DOUBLE)), 1500.0) AS rating_b
      FROM (SELECT match_id, date, surface, tourney_level, best_of, score, least(winner_id, loser_id) AS player_a_id, greatest(winner_id, loser_id) AS player_b_id,
        CAST(winner_id < loser_id AS INT) AS actual_a_won, CASE WHEN winner_id < loser_id THEN winner_rank ELSE loser_rank END AS a_rank,
        CASE WHEN winner_id < loser_id THEN loser_rank ELSE winner_rank END AS b_rank FROM m))""",
    "names": """SELECT player_id, arg_max(name, (date, match_id, side)) AS name FROM (SELECT date, match_id, winner_id AS player_id, winner_name AS name, 0 AS side FROM m
      UNION ALL SELECT date, match_id, loser_id, loser_name, 1 FROM m) GROUP BY player_id""",
    "short": r"""SELECT player_id, name, CASE WHEN len(w) < 2 THEN name ELSE array_to_string(w[2:], ' ') || ' ' || w[1][1] || '.' END AS short
      FROM (SELECT *, regexp_split_to_array(trim(name), '\s+') AS w FROM names)""",
    "keyed": r"SELECT *, replace(regexp_replace(trim(lower(strip_accents(short))), '\s+', ' ', 'g'), '-', ' ') AS key FROM short",
    "prices": """SELECT odds_id, day, winner, loser, coalesce(psw, avgw) AS odds_w, coalesce(psl, avgl) AS odds_l FROM raw_odds""",
    "oz": r"""SELECT *, replace(regexp_replace(trim(lower(strip_accents(winner))), '\s+', ' ', 'g'), '-', ' ') AS kw,
      replace(regexp_replace(trim(lower(strip_accents(loser))), '\s+', ' ', 'g'), '-', ' ') AS kl FROM prices""",
    "near": """SELECT c.*, a.key AS key_a, odds_id, odds_w, odds_l, kw, row_number() OVER (PARTITION BY match_id ORDER BY abs(day - date), odds_id) AS rn
      FROM canon c JOIN keyed a ON a.player_id = player_a_id JOIN keyed b ON b.player_id = player_b_id
      JOIN oz ON least(kw, kl) = least(a.key, b.key) AND greatest(kw, kl) = greatest(a.key, b.key) AND abs(day - date) <= 3""",
    "priced": """SELECT *, 1 / odds_a AS implied_prob_a, (1 / odds_a) / (1 / odds_a + 1 / odds_b) AS fair_prob_a, 1 / odds_a + 1 / odds_b - 1 AS vig
      FROM (SELECT *, CASE WHEN kw = key_a THEN odds_w ELSE odds_l END AS odds_a, CASE WHEN kw = key_a THEN odds_l ELSE odds_w END AS odds_b
      FROM near WHERE rn = 1 AND (kw = key_a) = (actual_a_won = 1))""",
    "diffs": f"""SELECT *, p_model - fair_prob_a AS difference, abs(p_model - fair_prob_a) AS abs_difference, greatest(fair_prob_a, 1 - fair_prob_a) AS favourite,
      {_LOSS.format('p_model')} AS l_model, {_LOSS.format('fair_prob_a')} AS l_market FROM priced""",
    "points": """SELECT match_id, greatest(least((w_1stWon + w_2ndWon) / w_svpt, CAST(0.85 AS DOUBLE)), CAST(0.35 AS DOUBLE)) AS spw_a,
      greatest(least((l_1stWon + l_2ndWon) / l_svpt, CAST(0.85 AS DOUBLE)), CAST(0.35 AS DOUBLE)) AS spw_b FROM m WHERE w_svpt > 0 AND l_svpt > 0""",
    "parsed": r"""SELECT *, list_transform(regexp_split_to_array(trim(score), '\s+'), lambda t: {'w': TRY_CAST(regexp_extract(t, '^(\d+)-(\d+)(\(\d+\))?$', 1) AS INT),
      'l': TRY_CAST(regexp_extract(t, '^(\d+)-(\d+)(\(\d+\))?$', 2) AS INT)}) AS sets FROM canon
      WHERE score IS NOT NULL AND trim(score) <> '' AND NOT regexp_matches(upper(score), 'W/O|WO|RET|DEF|ABN')""",
    "facts": """SELECT match_id, best_of, actual_a_won, len(sets) AS n_sets, len(list_filter(sets, lambda s: s.w > s.l)) AS winner_sets,
      len(list_filter(sets, lambda s: s.l > s.w)) > 0 AS loser_took_set, list_sum(list_transform(sets, lambda s: s.w + s.l)) AS total_games,
      list_transform(sets, lambda s: CASE WHEN actual_a_won = 1 THEN {'a': s.w, 'b': s.l} ELSE {'a': s.l, 'b': s.w} END) AS from_a
      FROM parsed WHERE len(list_filter(sets, lambda s: coalesce(s.w <= 13 AND s.l <= 13, false))) = len(sets)""",
    "scored": """SELECT *, len(list_filter(from_a, lambda s: s.a > s.b)) AS a_sets, len(list_filter(from_a, lambda s: s.b > s.a)) AS b_sets FROM facts""",
}


def _fold(lists: str, start: str) -> str:
    """Ratings of tracks match by match: step, track, ratings and earlier matches by player, and what held before the match.

    start: the rating of a player with {r} (null if new), {n} earlier matches and rank {rank}; more columns come from lists.
    """
    side = lambda x: start.format(r=f"r[{x} + 1]", n=f"seen[{x} + 1]", rank=f"rank_{x}")
    return f"""SELECT 0 AS step, track, list_transform(range(97), lambda x: CAST(NULL AS DOUBLE)) AS r, list_transform(range(97), lambda x: 0) AS seen,
        CAST(NULL AS BIGINT) AS match_id, CAST(NULL AS DOUBLE) AS r_w, CAST(NULL AS DOUBLE) AS r_l, 0 AS n_w, 0 AS n_l, CAST(NULL AS DOUBLE) AS p_w FROM {lists}
      UNION ALL
      SELECT step, track, list_transform(r, lambda v, i: CASE WHEN i = w + 1 THEN r_w + k * (1 - p) WHEN i = l + 1 THEN r_l - k * (1 - p) ELSE v END),
        list_transform(seen, lambda v, i: CASE WHEN i = w + 1 OR i = l + 1 THEN v + 1 ELSE v END), match_id, r_w, r_l, n_w, n_l, p FROM (
        SELECT *, 1 / (1 + pow(10.0, (r_l - r_w) / 400)) AS p FROM (
          SELECT *, {side('w')} AS r_w, {side('l')} AS r_l, seen[w + 1] AS n_w, seen[l + 1] AS n_l FROM (
            SELECT step + 1 AS step, f.track, r, seen, ws[step + 1] AS w, ls[step + 1] AS l, ks[step + 1] AS k, rws[step + 1] AS rank_w, rls[step + 1] AS rank_l, ids[step + 1] AS match_id,
              t.* EXCLUDE (track, ws, ls, ks, rws, rls, ids) FROM {{self}} f JOIN {lists} t ON t.track = f.track WHERE step < t.n)))"""


_LISTS = """SELECT track, count(*) AS n, list(winner_id ORDER BY date, match_id) AS ws, list(loser_id ORDER BY date, match_id) AS ls, list(k ORDER BY date, match_id) AS ks,
  list(winner_rank ORDER BY date, match_id) AS rws, list(loser_rank ORDER BY date, match_id) AS rls, list(match_id ORDER BY date, match_id) AS ids FROM {0} GROUP BY track"""
_PLAIN = "coalesce({r}, 1500.0)"
_MAPPED = "a + b * ln(CAST({rank} AS DOUBLE))"
_WARM = (f"CASE WHEN {{rank}} IS NULL THEN {_PLAIN} WHEN {{r}} IS NULL THEN {_MAPPED} WHEN {{n}} >= 30 THEN {{r}} "
         f"ELSE (1 - {{n}} / 30) * ({_MAPPED}) + (1 - (1 - {{n}} / 30)) * {{r}} END")
_WARM_LINE = _WARM.replace("WHEN {rank} IS NULL", "WHEN {rank} IS NULL OR a IS NULL", 1)
_BEFORE = "(SELECT * FROM track_rows WHERE track = '' AND date < DATE '2000-01-01')"
_LEVELS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in {"G": 32, "M": 28, "A": 24, "F": 28, "D": 20, "C": 18, "S": 14, "O": 20}.items())
_TABLES |= {
    "mk": f"SELECT *, CASE tourney_level {_LEVELS} ELSE 24 END AS k FROM m",
    "track_rows": "SELECT '' AS track, * FROM mk UNION ALL SELECT surface, * FROM mk",
    "lists": _LISTS.format("track_rows"),
    "lists_before": _LISTS.format(_BEFORE),
    "folded": _fold("lists", _PLAIN).format(self="folded"),
    "folded_before": _fold("lists_before", _PLAIN).format(self="folded_before"),
    "rank_pairs": """SELECT ln(CAST(rank AS DOUBLE)) AS x, rating AS y FROM (
      SELECT winner_rank AS rank, r_w AS rating, n_w AS n FROM folded_before JOIN m USING (match_id) UNION ALL SELECT loser_rank, r_l, n_l FROM folded_before JOIN m USING (match_id))
      WHERE rank BETWEEN 1 AND 1500 AND n >= 30""",
    "rank_line": "SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b, count(*) AS n, regr_r2(y, x) AS r2 FROM rank_pairs",
    "lists_warm": "SELECT lists.*, a, b FROM lists CROSS JOIN rank_line",
    "folded_warm": _fold("lists_warm", _WARM_LINE).format(self="folded_warm"),
    "lists_tour": "SELECT lists.*, CASE WHEN rank_line.n >= 100 THEN a END AS a, CASE WHEN rank_line.n >= 100 THEN b END AS b FROM lists CROSS JOIN rank_line",
    "folded_tour": _fold("lists_tour", _WARM_LINE).format(self="folded_tour"),
}


def _blended(folded: str, columns: str = "") -> str:
    """A/B predictions from folded tracks, half from each."""
    either = lambda x, y: f"CASE WHEN winner_id < loser_id THEN {x} ELSE {y} END"
    return f"""SELECT match_id, date, surface, tourney_level, least(winner_id, loser_id) AS player_a_id, greatest(winner_id, loser_id) AS player_b_id,
      CAST(winner_id < loser_id AS INT) AS actual_a_won, {either('p_blend', '1 - p_blend')} AS p_a, p_surface, p_overall, {either('n_w', 'n_l')} AS a_n_obs, {either('n_l', 'n_w')} AS b_n_obs,
      n_w < 30 OR n_l < 30 AS is_cold_start {columns} FROM (
      SELECT m.*, o.n_w, o.n_l, s.p_w AS p_surface, o.p_w AS p_overall, 0.5 * s.p_w + (1 - 0.5) * o.p_w AS p_blend
      FROM m JOIN {folded} o ON o.match_id = m.match_id AND o.track = '' JOIN {folded} s ON s.match_id = m.match_id AND s.track = m.surface)"""


#: The 32-bit hash of resampling, of a SQL expression.
_step = lambda x: f"(xor(({x}) >> 16, ({x})) * 73244475 & 4294967295)"


def _drawn(by: str, value: str, source: str) -> str:
    """Tables s (rows of slices with their place), b (r, m: mean of a resample) for groups of 30 rows and more, up to one block each."""
    mixed = lambda name, x, source: (f"{name} AS (SELECT * EXCLUDE (x2), xor(x2 >> 16, x2) AS {name[1:]} FROM (SELECT * EXCLUDE (x1), {_step('x1')} AS x2 "  # noqa: E731
                                     f"FROM (SELECT * EXCLUDE (x0), {_step('x0')} AS x1 FROM (SELECT *, {x} AS x0 FROM {source}))))")
    name = " || '|' || ".join(f"coalesce({c}, '')" for c in by.split(", "))
    return f"""s AS (SELECT {by}, match_id, {value} AS d, row_number() OVER (PARTITION BY {by} ORDER BY match_id) - 1 AS place, count(*) OVER (PARTITION BY {by}) AS n FROM {source}),
      g AS (SELECT DISTINCT {by}, n, CAST('0x' || substr(md5({name}), 1, 8) AS BIGINT) AS code FROM s WHERE n >= 30),
      {mixed('_base', '(code + 42) & 4294967295', 'g')},
      {mixed('_own', 'xor(base, r)', '(SELECT * FROM _base, range(1000) AS t(r))')},
      draws AS (SELECT * EXCLUDE (hit), (hit * n) >> 32 AS place FROM ({{hit}})),
      b AS (SELECT {by}, r, sum(d) / any_value(s.n) AS m FROM draws JOIN s USING ({by}, place) GROUP BY {by}, r),
      ends AS (SELECT {by}, avg(m) AS mean, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high, avg(CAST(m < 0 AS DOUBLE)) AS p_better FROM b GROUP BY {by})""".replace(
        "({hit})", "(WITH " + mixed("_hit", "xor(own, j)", f"(SELECT {by}, n, r, own, unnest(range(n)) AS j FROM _own)") + f" SELECT {by}, n, r, hit FROM _hit)")


def _pools(source: str) -> str:
    """Pools of a symmetric isotonic fit: rounds in which all runs of means that do not rise become one, until all rise."""
    return f"""sym AS (SELECT p_model AS x, actual_a_won AS y FROM ({source}) UNION ALL SELECT 1 - p_model, 1 - actual_a_won FROM ({source})),
      rounds AS (
        SELECT 0 AS turn, x AS lo, x AS hi, CAST(sum(y) AS DOUBLE) AS t, CAST(count(*) AS DOUBLE) AS w, true AS more FROM sym GROUP BY x
        UNION ALL
        SELECT turn + 1, min(lo), max(hi), sum(t), sum(w), bool_or(falls) FROM (
          SELECT *, sum(CASE WHEN falls_here THEN 0 ELSE 1 END) OVER (ORDER BY lo) AS pool, max(falls_here) OVER () AS falls FROM (
            SELECT *, coalesce(lag(t) OVER (ORDER BY lo) * w >= t * lag(w) OVER (ORDER BY lo), false) AS falls_here FROM rounds WHERE more))
        GROUP BY turn, pool),
      pools AS (SELECT lo, hi, t / w AS value, lead(lo) OVER (ORDER BY lo) AS next_lo, lead(t / w) OVER (ORDER BY lo) AS next_value, row_number() OVER (ORDER BY lo) AS k
        FROM rounds WHERE turn = (SELECT max(turn) FROM rounds)),
      steps AS (SELECT * REPLACE (CASE WHEN k = 1 THEN CAST('-infinity' AS DOUBLE) ELSE lo END AS lo) FROM pools)"""


_CALIBRATED = """round(greatest(least(CASE WHEN x <= hi OR next_lo IS NULL THEN value ELSE value + (next_value - value) * (x - hi) / (next_lo - hi) END, 0.999), 0.001), 8)"""


def _staged(source: str) -> str:
    for stage in probability.stages():
        source = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in stage)} FROM ({source})"
    return source


_TABLES["probs"] = _staged("SELECT * FROM points")


def _with(text: str) -> str:
    """The query with the tables it needs, in order of definition."""
    import re

    needed: set[str] = set()

    def add(sql: str) -> None:
        for name in _TABLES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
                needed.add(name)
                add(_TABLES[name])

    add(text)
    tables = "WITH RECURSIVE " + ", ".join(f"{n} AS ({q})" for n, q in _TABLES.items() if n in needed)
    return tables + (", " + text[5:] if text.startswith("MORE ") else " " + text)


def _round(columns: str, places: int = 8) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns.split())


_GAPS = "count(*) AS n, round(avg(l_model), 8) AS model_ll, round(avg(l_market), 8) AS market_ll, round(avg(l_model) - avg(l_market), 8) AS gap"


def _buckets(column: str, edges) -> str:
    values = ", ".join(f"('{b}', CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for b, lo, hi in edges)
    return f"SELECT bucket, {_GAPS} FROM diffs JOIN (VALUES {values}) AS e(bucket, lo, hi) ON {column} >= lo AND {column} < hi GROUP BY bucket HAVING count(*) >= 30"


def _reliability(p: str, extra: str, source: str) -> str:
    q = f"greatest(least({p}, 1 - 1e-9), 0.0)"
    return f"SELECT {_BIN.format(q)} AS bin, count(*) AS n, {extra} FROM {source} GROUP BY 1 HAVING count(*) >= 20"


def _queries() -> dict[str, str]:
    from .operators import audit

    cells = ", ".join(f"({x}, {y})" for x, y in probability.SET_SCORES)
    choose = " ".join(f"WHEN a_games = {x} AND b_games = {y} THEN {probability.set_score(x, y)}" for x, y in probability.SET_SCORES)
    dist = f"SELECT match_id, spw_a, spw_b, a_games, b_games, CASE {choose} END AS p FROM probs CROSS JOIN (VALUES {cells}) AS s(a_games, b_games)"
    market = lambda n: ", ".join(f"round({e}, 8) AS {c}" for c, e in probability.set_markets(n))
    per_set = f"""WITH one AS (SELECT DISTINCT * EXCLUDE (match_id) FROM ({dist})),
      s AS (SELECT spw_a, spw_b, a_games > b_games AS a, a_games + b_games AS g, sum(p) AS p FROM one GROUP BY ALL),
      two AS (SELECT x.spw_a, x.spw_b, x.a AS a1, y.a AS a2, x.g + y.g AS g, sum(x.p * y.p) AS p FROM s x JOIN s y USING (spw_a, spw_b) GROUP BY ALL),
      ends AS (SELECT spw_a, spw_b, g, p FROM two WHERE a1 = a2
        UNION ALL SELECT spw_a, spw_b, t.g + s.g, t.p * s.p FROM two t JOIN s USING (spw_a, spw_b) WHERE a1 <> a2)"""
    ranges = "date >= DATE '2000-01-01' AND date < DATE '2000-10-01'"
    logit = "ln(greatest(least(spw, 1 - 1e-4), 1e-4) / (1 - greatest(least(spw, 1 - 1e-4), 1e-4)))"
    weight = "exp(-ln(2) * (DATE '2000-01-01' - date) / 365.0) * svpt"
    recent = "FROM long WHERE date < DATE '2000-01-01' AND DATE '2000-01-01' - date <= 730"
    oriented = """(SELECT p.match_id, CASE WHEN winner_id < loser_id THEN spw_a ELSE spw_b END AS spw_a,
      CASE WHEN winner_id < loser_id THEN spw_b ELSE spw_a END AS spw_b FROM points p JOIN m ON m.match_id = p.match_id WHERE best_of = 3)"""
    market_rows = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in probability.set_markets(3))} FROM ({_staged('SELECT * FROM ' + oriented)}) AS q JOIN scored USING (match_id)"
    pairs = {"match": ("p_match_bo3", "actual_a_won = 1"), "2-0": ("p_a_2_0", "a_sets = 2 AND b_sets = 0"), "2-1": ("p_a_2_1", "a_sets = 2 AND b_sets = 1"),
             "0-2": ("p_b_2_0", "a_sets = 0 AND b_sets = 2"), "1-2": ("p_b_2_1", "a_sets = 1 AND b_sets = 2"),
             "a set for A": ("p_a_wins_at_least_one_set", "a_sets > 0"), "a set for B": ("p_b_wins_at_least_one_set", "b_sets > 0"),
             "three sets": ("p_match_total_sets_3", "a_sets + b_sets = 3")}
    stacked = " UNION ALL ".join(f"SELECT '{k}' AS market, {p} AS p, CAST({y} AS INT) AS actual_a_won FROM rows_" for k, (p, y) in pairs.items())
    slices = f"""SELECT CASE GROUPING(tourney_level, surface) WHEN 1 THEN 'level' WHEN 2 THEN 'surface' ELSE 'level x surface' END AS slice,
      concat_ws(' ', tourney_level, surface) AS value, {_GAPS} FROM diffs WHERE tourney_level IN ('G', 'M', 'A') AND surface IN ('Hard', 'Clay', 'Grass')
      GROUP BY GROUPING SETS ((tourney_level), (surface), (tourney_level, surface)) HAVING count(*) >= 20"""
    marked = "SELECT *, row_number() OVER (ORDER BY date, match_id) <= floor((SELECT count(*) FROM canon) * 0.5) AS is_train FROM (SELECT * REPLACE (round(p_model, 9) AS p_model) FROM canon)"
    bucket = lambda c, edges: "CASE " + " ".join(f"WHEN {c} >= CAST({lo} AS DOUBLE) AND {c} < CAST({hi} AS DOUBLE) THEN '{b}'" for b, lo, hi in edges) + " END"
    known = ("tourney_level IN ('G', 'M', 'A')", "surface IN ('Hard', 'Clay', 'Grass')")
    members = f"""members AS (SELECT *, l_model - l_market AS d FROM (
        SELECT match_id, l_model, l_market, unnest([{{'slice': 'all', 'value': 'all'}}, {{'slice': 'level', 'value': CASE WHEN {known[0]} THEN tourney_level END}},
          {{'slice': 'surface', 'value': CASE WHEN {known[1]} THEN surface END}}, {{'slice': 'level x surface', 'value': CASE WHEN {known[0]} AND {known[1]} THEN tourney_level || ' ' || surface END}},
          {{'slice': 'difference', 'value': {bucket('abs_difference', audit.DIFFERENCE)}}}, {{'slice': 'favourite', 'value': {bucket('favourite', audit.FAVOURITE)}}}], recursive := true) FROM diffs) WHERE value IS NOT NULL)"""
    report = f"""MORE {members}, {_drawn('slice, value', 'd', 'members')}
      SELECT slice, value, {_GAPS}, round(coalesce(any_value(ci_low), 'nan'), 8) AS ci_low, round(coalesce(any_value(ci_high), 'nan'), 8) AS ci_high,
        round(coalesce(any_value(p_better), 'nan'), 8) AS p_better FROM members LEFT JOIN ends USING (slice, value) GROUP BY slice, value
      HAVING count(*) >= CASE WHEN slice IN ('all', 'level', 'surface') THEN 20 ELSE 30 END"""
    refits = "(SELECT CAST(unnest(range(DATE '1999-12-25', DATE '2000-10-02', INTERVAL 7 DAY)) AS DATE) AS as_of)"
    loss = lambda p: _LOSS.format(p)
    in_window = "date >= DATE '2000-01-01' AND date < DATE '2000-10-01'"
    warm = f"MORE warm AS ({_blended('folded_warm')} WHERE {in_window})"
    priced_warm = f"""{warm}, near_warm AS (SELECT c.*, a.key AS key_a, odds_id, odds_w, odds_l, kw, row_number() OVER (PARTITION BY match_id ORDER BY abs(day - date), odds_id) AS rn
      FROM warm c JOIN keyed a ON a.player_id = player_a_id JOIN keyed b ON b.player_id = player_b_id
      JOIN oz ON least(kw, kl) = least(a.key, b.key) AND greatest(kw, kl) = greatest(a.key, b.key) AND abs(day - date) <= 3),
      priced_warm AS (SELECT *, (1 / odds_a) / (1 / odds_a + 1 / odds_b) AS fair_prob_a FROM (SELECT *, CASE WHEN kw = key_a THEN odds_w ELSE odds_l END AS odds_a,
        CASE WHEN kw = key_a THEN odds_l ELSE odds_w END AS odds_b FROM near_warm WHERE rn = 1 AND (kw = key_a) = (actual_a_won = 1))),
      diffs_warm AS (SELECT *, abs(p_a - fair_prob_a) AS abs_difference, greatest(fair_prob_a, 1 - fair_prob_a) AS favourite, {loss('p_a')} AS l_model, {loss('fair_prob_a')} AS l_market
        FROM priced_warm)"""
    both = f"""{priced_warm}, both_ AS (SELECT w.*, b.p_a AS p_base, {loss('b.p_a').replace('actual_a_won', 'w.actual_a_won')} AS l_base FROM diffs_warm w
      JOIN ({_blended('folded')}) b ON b.date = w.date AND b.player_a_id = w.player_a_id AND b.player_b_id = w.player_b_id)"""
    tour = f"""SELECT match_id, l_model, l_market, unnest([{{'slice': 'all', 'value': 'all'}}, {{'slice': 'level', 'value': tourney_level}},
      {{'slice': 'surface', 'value': CASE WHEN {known[1]} THEN surface END}}, {{'slice': 'level x surface', 'value': CASE WHEN {known[1]} THEN tourney_level || ' ' || surface END}},
      {{'slice': 'difference', 'value': {bucket('abs_difference', audit.DIFFERENCE_WTA)}}}, {{'slice': 'favourite', 'value': {bucket('favourite', audit.FAVOURITE_WTA)}}},
      {{'slice': 'start', 'value': CASE WHEN is_cold_start THEN 'cold' ELSE 'warm' END}}], recursive := true) FROM diffs_warm"""
    dates = "(SELECT CAST(unnest(range(DATE '1999-12-04', DATE '2000-10-02', INTERVAL 28 DAY)) AS DATE) AS as_of)"
    maps = f"""all_pairs AS (SELECT date, ln(CAST(rank AS DOUBLE)) AS x, rating AS y FROM (
      SELECT date, winner_rank AS rank, r_w AS rating, n_w AS n FROM folded JOIN m USING (match_id) WHERE track = '' UNION ALL
      SELECT date, loser_rank, r_l, n_l FROM folded JOIN m USING (match_id) WHERE track = '') WHERE rank BETWEEN 1 AND 1500 AND n >= 30),
      maps AS (SELECT as_of, count(x) AS n, CASE WHEN count(x) >= 100 THEN regr_intercept(y, x) END AS a, CASE WHEN count(x) >= 100 THEN regr_slope(y, x) END AS b,
        CASE WHEN count(x) >= 100 THEN regr_r2(y, x) END AS r2 FROM {dates} LEFT JOIN all_pairs ON date < as_of GROUP BY as_of)"""
    mapped = lambda x: f"a + b * ln(CAST({x}_rank AS DOUBLE))"
    asof = f"""MORE {maps}, mapped_rows AS (SELECT t.* REPLACE ({mapped('winner')} AS winner_rank, {mapped('loser')} AS loser_rank) FROM track_rows t ASOF LEFT JOIN maps ON t.date >= maps.as_of),
      lists_mapped AS ({_LISTS.format('mapped_rows')}), folded_mapped AS ({_fold('lists_mapped', _WARM.replace(_MAPPED, '{rank}')).format(self='folded_mapped')})"""
    totals = per_set.replace("WITH one AS (SELECT DISTINCT * EXCLUDE (match_id) FROM (" + dist + "))", "one AS (SELECT DISTINCT spw_a, spw_b, a_games, b_games, p FROM dist_)")
    shrunk = f"(SELECT match_id, spw_a * 0.9 + 0.05 AS spw_a, spw_b * 0.9 + 0.05 AS spw_b FROM {oriented})"
    ten = {**{k: (p, y) for k, (p, y) in pairs.items()}, "over 21.5": ("p_over_21_5", "total_games > 21.5"), "over 22.5": ("p_over_22_5", "total_games > 22.5")}
    stacked_ten = " UNION ALL ".join(f"SELECT '{k}' AS market, {p} AS p, CAST({y} AS INT) AS actual_a_won FROM rows_" for k, (p, y) in ten.items())
    ten_text = f"""MORE points_ AS ({_staged('SELECT * FROM ' + shrunk)}), dist_ AS (SELECT spw_a, spw_b, a_games, b_games, CASE {choose} END AS p FROM points_ CROSS JOIN (VALUES {cells}) AS s(a_games, b_games)),
      {totals}, overs AS (SELECT spw_a, spw_b, sum(CASE WHEN g > 21.5 THEN p ELSE 0 END) AS p_over_21_5, sum(CASE WHEN g > 22.5 THEN p ELSE 0 END) AS p_over_22_5 FROM ends GROUP BY ALL),
      rows_ AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in probability.set_markets(3))} FROM points_ JOIN overs USING (spw_a, spw_b) JOIN scored USING (match_id))"""
    kelly = "(p_model * odds_a - 1) / (odds_a - 1)"
    return {
        "clean": "SELECT match_id, date, surface, tourney_level, winner_rank, loser_rank FROM m",
        "long_format": f"SELECT match_id, player_id, opp_id, surface, won, {_round('svpt sv_won rpt_won spw rpw')} FROM long",
        "canonical_pairs": f"SELECT match_id, player_a_id, player_b_id, a_rank, b_rank, actual_a_won, {_round('p_model')} FROM canon",
        "date_window": f"SELECT match_id, date FROM m WHERE {ranges}",
        "level_k": f"SELECT match_id, CASE tourney_level {_LEVELS} ELSE 24 END AS k FROM m",
        "unknown_levels": "SELECT DISTINCT tourney_level FROM m WHERE tourney_level NOT IN ('G', 'M', 'A', 'F', 'D', 'C', 'S', 'O')",
        "score_parse": """SELECT match_id, array_to_string(list_transform(from_a, lambda s: concat(s.a, '-', s.b)), ' ') AS from_a, CAST(n_sets AS INT) AS n_sets,
          CAST(winner_sets AS INT) AS winner_sets, loser_took_set, CAST(total_games AS INT) AS total_games, CAST(a_sets AS INT) AS a_sets, CAST(b_sets AS INT) AS b_sets FROM scored""",
        "score_outcomes": "SELECT best_of, CAST(a_sets AS INT) AS a_sets, CAST(b_sets AS INT) AS b_sets, count(*) AS n FROM scored GROUP BY ALL",
        "odds_clean": "SELECT odds_id, day, round(odds_w, 8) AS odds_w, round(odds_l, 8) AS odds_l, round(1 / odds_w + 1 / odds_l - 1, 8) AS margin FROM prices",
        "odds_coverage": "SELECT count(*) AS n, round(avg(1 / odds_w + 1 / odds_l - 1), 8) AS mean_margin FROM prices",
        "name_norm": "SELECT player_id, name, short, key FROM keyed",
        "odds_match": f"SELECT match_id, odds_id, {_round('odds_a odds_b implied_prob_a fair_prob_a vig')} FROM priced",
        "odds_match_rate": "SELECT count(*) AS n, round(avg(CASE WHEN p.match_id IS NULL THEN 0.0 ELSE 1.0 END), 8) AS rate FROM m LEFT JOIN priced p ON p.match_id = m.match_id",
        "value_kelly": f"""SELECT match_id, round(p_model - implied_prob_a, 8) AS edge, round(p_model * odds_a - 1, 8) AS ev, p_model * odds_a - 1 > 0.05 AS is_value,
          round(CASE WHEN odds_a <= 1 OR {kelly} <= 0 THEN 0.0 ELSE {kelly} * 0.25 END, 8) AS stake FROM priced""",
        "prior_obs": """SELECT match_id, player_id, CAST(row_number() OVER (PARTITION BY player_id ORDER BY date, match_id) - 1 AS INT) AS n_prior
          FROM (SELECT match_id, date, winner_id AS player_id FROM m UNION ALL SELECT match_id, date, loser_id FROM m)""",
        "player_obs": "SELECT surface, player_id, count(*) AS n_obs FROM (SELECT surface, player_id FROM long UNION ALL SELECT surface, opp_id FROM long) GROUP BY ALL",
        "distinct_players": "SELECT player_id FROM long UNION SELECT opp_id FROM long",
        "surface_counts": "SELECT surface, count(*) AS n FROM m GROUP BY surface",
        "spw_means": "SELECT surface, round(avg(spw), 8) AS mean_spw, round(avg(rpw), 8) AS mean_rpw FROM long GROUP BY surface",
        "match_prob": f"SELECT match_id, {_round('spw_a spw_b hold_a hold_b tiebreak p_set p_match_bo1 p_match_bo3 p_match_bo5')} FROM probs",
        "set_score_dist": f"SELECT match_id, a_games, b_games, round(p, 8) AS p FROM ({dist})",
        "markets_bo3": f"SELECT match_id, {_round('p_set p_match_bo1 p_match_bo3 p_match_bo5')}, {market(3)} FROM probs",
        "markets_bo5": f"SELECT match_id, {_round('p_set p_match_bo1 p_match_bo3 p_match_bo5')}, {market(5)} FROM probs",
        "total_games": f"SELECT round(spw_a, 8) AS spw_a, round(spw_b, 8) AS spw_b, total, round(p, 8) AS p FROM ({per_set} SELECT spw_a, spw_b, g AS total, sum(p) AS p FROM ends GROUP BY ALL)",
        "over_line": f"""SELECT round(spw_a, 8) AS spw_a, round(spw_b, 8) AS spw_b, round(p_over_21_5, 8) AS p_over_21_5, round(p_over_22_5, 8) AS p_over_22_5 FROM ({per_set}
          SELECT spw_a, spw_b, sum(CASE WHEN g > 21.5 THEN p ELSE 0 END) AS p_over_21_5, sum(CASE WHEN g > 22.5 THEN p ELSE 0 END) AS p_over_22_5 FROM ends GROUP BY ALL)""",
        "logloss": f"""SELECT surface, count(*) AS n, round(avg({_LOSS.format('p_model')}), 8) AS log_loss, round(ln(2) - avg({_LOSS.format('p_model')}), 8) AS gain,
          round(avg(CAST((p_model > 0.5) = (actual_a_won = 1) AS DOUBLE)), 8) AS accuracy FROM canon GROUP BY surface""",
        "reliability": _reliability("p_model", "round(avg(p_model), 8) AS predicted, round(avg(actual_a_won), 8) AS actual, round(avg(actual_a_won) - avg(p_model), 8) AS gap", "canon"),
        "market_reliability": _reliability("fair_prob_a", "round(avg(p_model), 8) AS model, round(avg(fair_prob_a), 8) AS market, round(avg(actual_a_won), 8) AS actual", "priced"),
        "book_compare": "SELECT count(*) AS n, round(avg(l_model), 8) AS model_ll, round(avg(l_market), 8) AS market_ll, round(corr(p_model, fair_prob_a), 8) AS correlation FROM diffs",
        "shrinkage": "SELECT match_id, round(p_model * 0.8 + 0.1, 8) AS match_level, round(p_model * 0.9 + 0.05, 8) AS point_level FROM canon",
        "market_eval": f"""SELECT market, n, round(log_loss, 6) AS log_loss, round(base_rate, 6) AS base_rate, round(accuracy, 6) AS accuracy, round(base_log_loss, 6) AS base_log_loss,
          round(base_log_loss - log_loss, 6) AS gain, CASE WHEN base_log_loss - log_loss > 0.005 THEN 'useful' WHEN base_log_loss - log_loss > 0 THEN 'marginal' ELSE 'worse' END AS verdict,
          CAST(row_number() OVER (ORDER BY round(base_log_loss - log_loss, 9) DESC, market) AS INT) AS place FROM (SELECT *, -(base_rate * ln(greatest(base_rate, 1e-6)) +
          (1 - base_rate) * ln(greatest(1 - base_rate, 1e-6))) AS base_log_loss FROM (WITH rows_ AS ({market_rows}) SELECT market, count(*) AS n, avg({_LOSS.format('p')}) AS log_loss,
          avg(actual_a_won) AS base_rate, avg(CAST((p > 0.5) = (actual_a_won = 1) AS DOUBLE)) AS accuracy FROM ({stacked}) GROUP BY market))""",
        "slices_grouping_sets": slices,
        "smallest_gaps": f"SELECT * FROM ({slices}) ORDER BY gap, slice, value LIMIT 10",
        "difference_buckets": _buckets("abs_difference", audit.DIFFERENCE),
        "favourite_buckets": _buckets("favourite", audit.FAVOURITE),
        "directional": """SELECT CASE WHEN difference > 0.1 THEN 'above' ELSE 'below' END AS side, count(*) AS n, round(avg(p_model), 8) AS model, round(avg(fair_prob_a), 8) AS market,
          round(avg(actual_a_won), 8) AS actual FROM diffs WHERE abs(difference) > 0.1 GROUP BY 1""",
        "disagreement_tails": """SELECT count(*) AS n, round(avg(abs_difference), 8) AS mean_abs, round(avg(CAST(abs_difference > 0.05 AS INT)), 8) AS over_05,
          round(avg(CAST(abs_difference > 0.1 AS INT)), 8) AS over_10, round(avg(CAST(abs_difference > 0.2 AS INT)), 8) AS over_20 FROM diffs""",
        "top_disagreements": """SELECT match_id, date, round(p_model, 8) AS p_model, round(fair_prob_a, 8) AS fair_prob_a, actual_a_won, round(abs_difference, 8) AS abs_difference,
          (p_model > 0.5) = (actual_a_won = 1) AS model_right, (fair_prob_a > 0.5) = (actual_a_won = 1) AS market_right FROM diffs ORDER BY diffs.abs_difference DESC, match_id LIMIT 20""",
        "asof_refit": f"""SELECT match_id, m.date, g.as_of FROM (SELECT * FROM m WHERE {ranges}) m ASOF JOIN
          (SELECT CAST(unnest(range(DATE '1999-12-25', DATE '2000-10-02', INTERVAL 7 DAY)) AS DATE) AS as_of) g ON m.date >= g.as_of""",
        "recency_weights": f"SELECT surface, round(sum({weight}), 6) AS w, round(sum({weight} * {logit}) / sum({weight}), 6) AS intercept {recent} GROUP BY surface",
        "skill_gram": f"SELECT surface, player_id, opp_id, round(sum({weight}), 6) AS w, round(sum({weight} * {logit}), 6) AS wy, count(*) AS n {recent} GROUP BY ALL",
        "elo_vanilla": "SELECT match_id, round(p_w, 8) AS p_w FROM folded WHERE track = '' AND step > 0",
        "elo_surface": f"SELECT match_id, actual_a_won, round(p_a, 8) AS p_a, a_n_obs, b_n_obs, is_cold_start FROM ({_blended('folded')})",
        "elo_blend_sweep": f"""SELECT weight, count(*) AS n, round(avg({loss('p')}), 8) AS log_loss, round(ln(2) - avg({loss('p')}), 8) AS gain,
          round(avg(CAST((p > 0.5) = (actual_a_won = 1) AS DOUBLE)), 8) AS accuracy FROM (SELECT weight, actual_a_won, CASE WHEN actual_a_won = 1 THEN q ELSE 1 - q END AS p
          FROM (SELECT weight, actual_a_won, weight * p_surface + (1 - weight) * p_overall AS q FROM ({_blended('folded')}), (VALUES (CAST(0.3 AS DOUBLE)), (0.5), (0.7), (1.0)) AS v(weight)
          WHERE {in_window})) GROUP BY weight""",
        "rank_fit": f"SELECT {_round('a b', 6)}, n, round(r2, 6) AS r2 FROM rank_line",
        "rank_ratings": "SELECT CAST(rank AS INT) AS rank, round(a + b * ln(CAST(rank AS DOUBLE)), 6) AS rating FROM rank_line, (VALUES (1), (5), (10), (25), (50), (100), (200), (500)) AS v(rank)",
        "warmstart": f"{warm} SELECT match_id, player_a_id, player_b_id, round(p_a, 8) AS p_a, a_n_obs, b_n_obs, is_cold_start FROM warm",
        "cold_warm": f"{priced_warm} SELECT is_cold_start, {_GAPS} FROM diffs_warm GROUP BY is_cold_start HAVING count(*) >= 30",
        "rank_maps": f"MORE {maps} SELECT as_of, {_round('a b', 6)}, n, round(r2, 6) AS r2 FROM maps",
        "warmstart_asof": f"""{asof} SELECT match_id, player_a_id, player_b_id, round(p_a, 8) AS p_a, a_n_obs, b_n_obs, is_cold_start FROM ({_blended('folded_mapped')}) WHERE {in_window}""",
        "compare_models": f"""{both} SELECT slice, value, count(*) AS n, round(avg(l_base), 8) AS base_ll, round(avg(l_model), 8) AS warm_ll, round(avg(l_market), 8) AS market_ll,
          round(avg(cold), 8) AS cold_share, round(avg(l_base) - avg(l_model), 8) AS gain, round(avg(l_base) - avg(l_market), 8) AS base_gap, round(avg(l_model) - avg(l_market), 8) AS warm_gap
          FROM (SELECT l_base, l_model, l_market, CAST(is_cold_start AS INT) AS cold, unnest([{{'slice': 'all', 'value': 'all'}}, {{'slice': 'start', 'value': CASE WHEN is_cold_start THEN 'cold' ELSE 'warm' END}},
          {{'slice': 'level', 'value': CASE WHEN {known[0]} THEN tourney_level END}}], recursive := true) FROM both_) WHERE value IS NOT NULL GROUP BY slice, value HAVING count(*) >= 30 OR slice = 'all'""",
        "disagreement_change": f"""{both} SELECT count(*) AS n, round(avg(b), 8) AS base_mean, round(avg(w), 8) AS warm_mean, round(avg(CAST(b > 0.25 AS INT)), 8) AS base_far,
          round(avg(CAST(w > 0.25 AS INT)), 8) AS warm_far, count(*) FILTER (b > 0.2) AS n_big, round(avg(b) FILTER (b > 0.2), 8) AS big_base, round(avg(w) FILTER (b > 0.2), 8) AS big_warm,
          round(100 * (avg(b) FILTER (b > 0.2) - avg(w) FILTER (b > 0.2)) / avg(b) FILTER (b > 0.2), 8) AS reduction_percent
          FROM (SELECT abs(p_base - fair_prob_a) AS b, abs(p_a - fair_prob_a) AS w FROM both_)""",
        "tour_report": f"{priced_warm.replace('folded_warm', 'folded_tour')} SELECT slice, value, {_GAPS} FROM ({tour}) WHERE value IS NOT NULL GROUP BY slice, value HAVING count(*) >= 30 OR slice = 'all'",
        "after_warmup": f"""SELECT model, span, count(*) AS n, round(avg({loss('p')}), 8) AS log_loss, round(ln(2) - avg({loss('p')}), 8) AS gain,
          round(avg(CAST((p > 0.5) = (actual_a_won = 1) AS DOUBLE)), 8) AS accuracy FROM (SELECT model, span, actual_a_won, CASE WHEN actual_a_won = 1 THEN q ELSE 1 - q END AS p FROM (
          SELECT model, actual_a_won, date, CASE model WHEN 'overall' THEN p_overall ELSE 0.5 * p_surface + 0.5 * p_overall END AS q FROM ({_blended('folded')}), (VALUES ('overall'), ('blended')) AS v(model)
          WHERE {in_window}), (VALUES ('window', DATE '2000-01-01'), ('after warm-up', DATE '2000-03-31')) AS s(span, first) WHERE date >= first) GROUP BY model, span""",
        "ten_markets": f"""{ten_text} SELECT market, n, round(log_loss, 6) AS log_loss, round(base_rate, 6) AS base_rate, round(accuracy, 6) AS accuracy, round(base_log_loss, 6) AS base_log_loss,
          round(base_log_loss - log_loss, 6) AS gain, CASE WHEN base_log_loss - log_loss > 0.005 THEN 'useful' WHEN base_log_loss - log_loss > 0 THEN 'marginal' ELSE 'worse' END AS verdict,
          CAST(row_number() OVER (ORDER BY round(base_log_loss - log_loss, 9) DESC, market) AS INT) AS place FROM (SELECT *, -(base_rate * ln(greatest(base_rate, 1e-6)) +
          (1 - base_rate) * ln(greatest(1 - base_rate, 1e-6))) AS base_log_loss FROM (SELECT market, count(*) AS n, avg({_LOSS.format('p')}) AS log_loss,
          avg(actual_a_won) AS base_rate, avg(CAST((p > 0.5) = (actual_a_won = 1) AS DOUBLE)) AS accuracy FROM ({stacked_ten}) GROUP BY market))""",
        "slice_report": report,
        "model_wins": report + " AND any_value(p_better) > 0.5",
        "bootstrap_ci": f"""MORE {_drawn('surface', 'l_model - l_market', 'diffs')}
          SELECT surface, count(*) AS n, {', '.join(f"round(coalesce(any_value({c}), 'nan'), 8) AS {c}" for c in ('mean', 'ci_low', 'ci_high', 'p_better'))}
          FROM diffs LEFT JOIN ends USING (surface) GROUP BY surface""",
        "latest_price": f"""SELECT c.match_id, c.date, odds_id, day, {_round('odds_w odds_l')} FROM
          (SELECT c.match_id, c.date, least(a.key, b.key) AS lo, greatest(a.key, b.key) AS hi FROM canon c JOIN keyed a ON a.player_id = player_a_id JOIN keyed b ON b.player_id = player_b_id) c
          ASOF LEFT JOIN (SELECT least(kw, kl) AS lo, greatest(kw, kl) AS hi, day, max(odds_id) AS odds_id, arg_max(odds_w, odds_id) AS odds_w, arg_max(odds_l, odds_id) AS odds_l
            FROM oz GROUP BY ALL) o ON c.lo = o.lo AND c.hi = o.hi AND c.date >= o.day""",
        "skill_grid": f"""SELECT surface, as_of, player_id, opp_id, round(sum(w), 6) AS w, round(sum(w * {logit}), 6) AS wy, count(*) AS n
          FROM (SELECT *, exp(-ln(2) * (as_of - date) / 365.0) * svpt AS w FROM long JOIN {refits} ON date < as_of AND as_of - date <= 730) GROUP BY ALL""",
        "rank_correlation": """SELECT count(*) AS n, round(corr(x, y), 8) AS rho FROM (SELECT rank() OVER (ORDER BY p_model) + (count(*) OVER (PARTITION BY p_model) - 1) / 2 AS x,
          rank() OVER (ORDER BY fair_prob_a) + (count(*) OVER (PARTITION BY fair_prob_a) - 1) / 2 AS y FROM priced)""",
        "isotonic": f"""MORE marked AS ({marked}), {_pools('SELECT * FROM marked WHERE is_train')}
          SELECT match_id, actual_a_won, x AS p_model, {_CALIBRATED} AS calibrated FROM (SELECT *, p_model AS x FROM marked WHERE NOT is_train) q ASOF JOIN steps ON q.x >= steps.lo""",
        "isotonic_curve": f"""MORE marked AS ({marked}), {_pools('SELECT * FROM marked')}
          SELECT round(x, 8) AS p, {_CALIBRATED} AS calibrated FROM (SELECT CAST(i AS DOUBLE) * CAST(0.05 AS DOUBLE) AS x FROM range(1, 20) AS t(i)) q ASOF JOIN steps ON q.x >= steps.lo""",
        "time_split": "SELECT match_id, row_number() OVER (ORDER BY date, match_id) <= floor((SELECT count(*) FROM canon) * 0.5) AS is_train FROM canon",
        "split_ranges": """SELECT is_train, min(date) AS first, max(date) AS last, count(*) AS n FROM (SELECT date, row_number() OVER (ORDER BY date, match_id)
          <= floor((SELECT count(*) FROM canon) * 0.5) AS is_train FROM canon) GROUP BY is_train""",
    }


ORACLE_SQL = {name: _with(text) for name, text in _queries().items()}
