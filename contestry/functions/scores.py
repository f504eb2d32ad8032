"""Score strings as arrays of set scores, with higher-order functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of unfinished matches, anywhere in the text; fixed values.
UNFINISHED = r"W/O|WO|RET|DEF|ABN"
#: A set, with the tie-break points in brackets; most games of a side that still count.
_SET, MOST_GAMES = r"^(\d+)-(\d+)(\(\d+\))?$", 13


def parse(score: Column) -> Column:
    """array<struct<w:int,l:int>>, or null for walkovers, retirements and anything that is not a score."""
    text = F.regexp_replace(score, r"^\s+|\s+$", "")
    tokens = F.split(text, r"\s+")
    sets = F.transform(tokens, lambda t: F.struct(
        F.regexp_extract(t, _SET, 1).try_cast("int").alias("w"), F.regexp_extract(t, _SET, 2).try_cast("int").alias("l")))
    good = F.forall(sets, lambda s: F.coalesce((s["w"] <= MOST_GAMES) & (s["l"] <= MOST_GAMES), F.lit(False)))
    return F.when((text != "") & ~F.upper(text).rlike(UNFINISHED) & good, sets)


def sets_of_winner(sets: Column) -> Column:
    return F.size(F.filter(sets, lambda s: s["w"] > s["l"]))


def loser_took_set(sets: Column) -> Column:
    return F.exists(sets, lambda s: s["l"] > s["w"])


def games(sets: Column) -> Column:
    return F.aggregate(sets, F.lit(0), lambda n, s: n + s["w"] + s["l"])


def from_a(sets: Column, a_won: Column) -> Column:
    """Set scores from A's side."""
    return F.transform(sets, lambda s: F.struct(
        F.when(a_won, s["w"]).otherwise(s["l"]).alias("a"), F.when(a_won, s["l"]).otherwise(s["w"]).alias("b")))
