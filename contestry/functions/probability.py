"""From point to match: closed forms as SQL text in stages, for Spark and any engine with pow and CASE.

Each stage is a list of (column, expression) over the columns of the stages before, so a deep formula stays
a chain of small projections. Inputs: spw_a and spw_b, the chances to win a point on own serve.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SET_SCORES = [(6, k) for k in range(5)] + [(7, 5), (7, 6)] + [(6, 7), (5, 7)] + [(k, 6) for k in range(4, -1, -1)]


def _power(x: str, n: int) -> str:
    return "1.0" if n == 0 else x if n == 1 else f"pow({x}, {n})"


def hold(p: str) -> str:
    """Chance to win a game on serve: four points with at most two lost, or 3-3 and then two ahead."""
    q = f"(1 - {p})"
    direct = f"{_power(p, 4)} * (1 + 4 * {q} + 10 * {_power(q, 2)})"
    deuce = f"20 * {_power(p, 5)} * {_power(q, 3)} / ({_power(p, 2)} + {_power(q, 2)})"
    return f"CASE WHEN {p} <= 0 THEN 0.0 WHEN {p} >= 1 THEN 1.0 ELSE {direct} + {deuce} END"


def _won(j: int, own: int, other: int, a: str, b: str) -> str:
    """Chance that A wins j of own + other rounds, at a in its own and b in the other's."""
    terms = [f"{comb(own, i) * comb(other, j - i)} * {_power(a, i)} * {_power(f'(1 - {a})', own - i)}"
             f" * {_power(b, j - i)} * {_power(f'(1 - {b})', other - j + i)}"
             for i in range(max(0, j - other), min(own, j) + 1)]
    return "(" + " + ".join(terms) + ")"


def extension(u: str, v: str) -> str:
    return f"CASE WHEN {u} + {v} <= 0 THEN 0.5 ELSE {u} / ({u} + {v}) END"


def tiebreak(target: int = 7) -> str:
    """First to the target by two; A serves the points 0, 3, 4, 7, 8 and so on."""
    serves = [n % 4 in (0, 3) for n in range(2 * target)]
    a, b, terms = "spw_a", "(1 - spw_b)", []
    for k in range(target - 1):
        n = target - 1 + k
        own = sum(serves[:n])
        terms.append(f"{_won(target - 1, own, n - own, a, b)} * {a if serves[n] else b}")
    n = 2 * target - 2
    own = sum(serves[:n])
    tied = extension("(spw_a * (1 - spw_b))", "((1 - spw_a) * spw_b)")
    return " + ".join(terms) + f" + {_won(target - 1, own, n - own, a, b)} * ({tied})"


def _games(j: int, n: int) -> str:
    return _won(j, (n + 1) // 2, n // 2, "hold_a", "(1 - hold_b)")


def set_score(x: int, y: int, games=_games) -> str:
    """Chance that a set in which A serves first ends x:y; games(j, n): chance that A wins j of the first n."""
    if {x, y} == {7, 6}:
        return f"({games(5, 10)} * (hold_a * hold_b + (1 - hold_a) * (1 - hold_b)) * " + ("tiebreak" if x > y else "(1 - tiebreak)") + ")"
    if {x, y} == {7, 5}:
        return f"({games(5, 10)} * " + ("hold_a * (1 - hold_b)" if x > y else "(1 - hold_a) * hold_b") + ")"
    n, a_wins = x + y - 1, x > y
    last = "hold_a" if n % 2 == 0 else "(1 - hold_b)"
    return f"({games(5 if a_wins else x, n)} * {last if a_wins else f'(1 - {last})'})"


def match(ps: str, best_of: int) -> str:
    need = best_of // 2 + 1
    return " + ".join(f"{comb(k - 1, need - 1)} * {_power(ps, need)} * {_power(f'(1 - {ps})', k - need)}"
                      for k in range(need, best_of + 1))


def stages() -> list[list[tuple[str, str]]]:
    return [
        [("hold_a", hold("spw_a")), ("hold_b", hold("spw_b")), ("tiebreak", tiebreak())],
        [("p_set", " + ".join(set_score(x, y) for x, y in SET_SCORES if x > y))],
        [("p_match_bo1", match("p_set", 1)), ("p_match_bo3", match("p_set", 3)), ("p_match_bo5", match("p_set", 5))],
    ]


def set_markets(best_of: int) -> list[tuple[str, str]]:
    """Exact set scores, a set for each side, and totals, as polynomials in p_set."""
    need, q, out = best_of // 2 + 1, "(1 - p_set)", []
    for lost in range(need):
        ways = comb(need - 1 + lost, lost)
        out.append((f"p_a_{need}_{lost}", f"{ways} * {_power('p_set', need)} * {_power(q, lost)}"))
        out.append((f"p_b_{need}_{lost}", f"{ways} * {_power(q, need)} * {_power('p_set', lost)}"))
    out += [("p_a_wins_at_least_one_set", f"1 - {_power(q, need)}"), ("p_b_wins_at_least_one_set", f"1 - {_power('p_set', need)}")]
    if best_of == 3:
        out += [("p_match_total_sets_2", f"{_power('p_set', 2)} + {_power(q, 2)}"), ("p_match_total_sets_3", f"2 * p_set * {q}")]
    return out


def with_probabilities(df: DataFrame) -> DataFrame:
    """Add hold_a, hold_b, tiebreak, p_set and the match chances to a table with spw_a and spw_b."""
    for stage in stages():
        df = df.select("*", *[F.expr(e).alias(c) for c, e in stage])
    return df


def with_markets(df: DataFrame, best_of: int) -> DataFrame:
    return df.select("*", *[F.expr(e).alias(c) for c, e in set_markets(best_of)])


def set_score_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and set score: a_games, b_games, p."""
    needed = sorted({(5, 10)} | {(5 if x > y else x, x + y - 1) for x, y in SET_SCORES if abs(x - y) > 1 and max(x, y) == 6})
    df = df.select("*", *[F.expr(_games(j, n)).alias(f"__{j}_{n}") for j, n in needed])
    cells = [F.struct(F.lit(x).alias("a_games"), F.lit(y).alias("b_games"),
                      F.expr(set_score(x, y, lambda j, n: f"__{j}_{n}")).alias("p")) for x, y in SET_SCORES]
    return df.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


#: Games of the shortest set and coefficients of a set's polynomial: 6 to 13 games.
_LEAST, _SPAN = 6, 8


def product(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products of polynomials, row by row: coefficients from the lowest power, a polynomial a row."""
    out = np.zeros((len(p), p.shape[1] + q.shape[1] - 1))
    for k in range(q.shape[1]):
        out[:, k:k + p.shape[1]] += p * q[:, k:k + 1]
    return out


def match_polynomials(a: np.ndarray, b: np.ndarray, best_of: int) -> np.ndarray:
    """Chances of 0, 1, 2, ... games of a match, from those of sets of 6 to 13 games that A and B win.

    Each sequence of sets is a product of A(x) and B(x); those that end a match are, with n sets to win and k lost,
    (n - 1 + k over k) A^n B^k and the same for B.
    """
    need, out = best_of // 2 + 1, np.zeros((len(a), (_LEAST + _SPAN - 1) * best_of + 1))
    for won, lost in ((a, b), (b, a)):
        power = won
        for _ in range(need - 1):
            power = product(power, won)
        for k in range(need):
            low = _LEAST * (need + k)
            out[:, low:low + power.shape[1]] += comb(need - 1 + k, k) * power
            power = product(power, lost)
    return out


def set_polynomials(df: DataFrame) -> DataFrame:
    """Add set_a and set_b: chances of sets that A and B win, as arrays by games from 6 to 13."""
    needed = sorted({(5, 10)} | {(5 if x > y else x, x + y - 1) for x, y in SET_SCORES if abs(x - y) > 1 and max(x, y) == 6})
    names = list(df.columns)
    df = df.select("*", *[F.expr(_games(j, n)).alias(f"__{j}_{n}") for j, n in needed])

    def side(a_won: bool) -> Column:
        by_games = {x + y: F.expr(set_score(x, y, lambda j, n: f"__{j}_{n}")) for x, y in SET_SCORES if (x > y) == a_won}
        return F.array(*[by_games.get(_LEAST + k, F.lit(0.0)) for k in range(_SPAN)])

    return df.select(*names, side(True).alias("set_a"), side(False).alias("set_b"))


def games_distribution(df: DataFrame, best_of: int = 3) -> DataFrame:
    """Add dist: the chances of 0, 1, 2, ... games of a match in all, by index.

    A row's work stays in the row and nothing is joined or regrouped; rows are multiplied out a batch at a time. A side
    that never wins a set has a zero polynomial, and a null chance gives a null.
    """
    @F.arrow_udf("array<double>")
    def dist(a: pa.Array, b: pa.Array) -> pa.Array:
        # Null chances arrive as NaN.
        found = match_polynomials(*(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, _SPAN) for x in (a, b)), best_of)
        known = ~np.isnan(found).any(axis=1)
        ends = np.concatenate([[0], np.cumsum(known * found.shape[1])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~known, False)), pa.array(found[known].ravel()))

    return set_polynomials(df).withColumn("dist", dist("set_a", "set_b")).select(*df.columns, "dist")


def total_games(df: DataFrame, keys: list[str], best_of: int = 3) -> DataFrame:
    """Distribution of the games of a match, one row for each total that sequences of sets can reach."""
    sizes, reach = {x + y for x, y in SET_SCORES}, {0}
    ends = set()
    for n in range(1, best_of + 1):
        reach = {g + s for g in reach for s in sizes}
        ends |= reach if n > best_of // 2 else set()
    # The outer form: for the other one Spark filters by the array's size first, and so makes every distribution twice.
    return games_distribution(df, best_of).select(*keys, F.posexplode_outer("dist").alias("total", "p")).where(F.col("total").isin(sorted(ends)))


def over_lines(df: DataFrame, keys: list[str], lines: tuple[float, ...] = (21.5, 22.5), best_of: int = 3) -> DataFrame:
    """The keys with the chance of more games than each line."""
    above = lambda line: F.aggregate(F.slice("dist", int(line) + 2, 200), F.lit(0.0), lambda total, p: total + p)
    return games_distribution(df, best_of).select(*keys, *[above(line).alias("p_over_" + str(line).replace(".", "_")) for line in lines])
