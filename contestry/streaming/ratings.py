"""Ratings over a stream of matches: the fold of a track as keyed state, one entry a player.

A track's players are a map in the state store, so a micro-batch reads and writes the players that it touches and no
others. Rows are applied in order of date and match. Rows that may still be overtaken by earlier ones wait in the
state until the track's clock, the latest day it has seen, is past them by the delay, or until nothing has come for a
while. Rows older than the last one applied are given out as not applied, because the fold does not commute.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators import ratings as batch
from ..operators.ratings import INITIAL, SCALE, WARMUP

#: The only state store that keeps maps; it is set where the session has the default one.
PROVIDER, STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "track string, match_id long, p_w double, applied boolean"
_ROW = ["date", "match_id", "winner_id", "loser_id", "k", "mapped_w", "mapped_l"]


def _none(x):
    return None if x is None or x != x else float(x)


class Track(StatefulProcessor):
    """One track: its players, the rows that wait, and where it stands."""

    def __init__(self, delay: int, patience: int | None):
        self.delay, self.patience = delay, patience

    def init(self, handle) -> None:
        self.handle = handle
        self.players = handle.getMapState("players", "player long", "rating double, seen int")
        self.waiting = handle.getMapState("waiting", "date string, match_id long", "winner long, loser long, k double, mapped_w double, mapped_l double")
        self.place = handle.getValueState("place", "date string, match_id long, clock string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, clock = self._place()
        ready, late = [], []
        for frame in rows:
            for r in frame[_ROW].itertuples(index=False):
                row = (str(r.date), int(r.match_id), int(r.winner_id), int(r.loser_id), float(r.k), _none(r.mapped_w), _none(r.mapped_l))
                clock = max(clock, row[0])
                (ready if row[:2] > last else late).append(row)
        if self.delay:
            border = (datetime.date.fromisoformat(clock) - datetime.timedelta(days=self.delay)).isoformat()
            for row in [r for r in ready if r[0] > border]:
                self.waiting.updateValue(row[:2], row[2:])
            ready = [r for r in ready if r[0] <= border] + self._taken(border)
            if self.patience is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield self._applied(key[0], sorted(set(ready), key=lambda r: r[:2]), late, last, clock)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, clock = self._place()
        yield self._applied(key[0], sorted(self._taken("9999"), key=lambda r: r[:2]), [], last, clock)

    def _place(self) -> tuple[tuple[str, int], str]:
        found = self.place.get()
        return ((found[0], found[1]), found[2]) if found is not None else (("", -1), "")

    def _taken(self, border: str) -> list[tuple]:
        """The waiting rows up to a day; they wait no more."""
        rows = [(*k, *v) for k, v in self.waiting.iterator() if k[0] <= border]
        for row in rows:
            self.waiting.removeKey(row[:2])
        return rows

    def _applied(self, track: str, rows: list[tuple], late: list[tuple], last: tuple[str, int], clock: str) -> pd.DataFrame:
        known: dict[int, tuple[float | None, int]] = {}
        touched, out = set(), []

        def player(who: int) -> tuple[float | None, int]:
            if who not in known:
                found = self.players.getValue((who,))
                known[who] = (found[0], found[1]) if found is not None else (None, 0)
            return known[who]

        def start(who: int, mapped: float | None) -> float:
            rating, seen = player(who)
            if rating is None:
                return INITIAL if mapped is None else mapped
            share = max(0.0, 1.0 - seen / WARMUP)
            return rating if mapped is None or share == 0 else share * mapped + (1 - share) * rating

        for row in [*late, *rows]:
            date, match_id, w, l, k, map_w, map_l = row
            r_w, r_l = start(w, map_w), start(l, map_l)
            p = 1.0 / (1.0 + 10 ** ((r_l - r_w) / SCALE))
            ok = (date, match_id) > last
            if ok:
                known[w], known[l] = (r_w + k * (1 - p), known[w][1] + 1), (r_l - k * (1 - p), known[l][1] + 1)
                touched |= {w, l}
                last = (date, match_id)
            out.append((track, match_id, p, ok))
        for who in touched:
            self.players.updateValue((who,), known[who])
        self.place.update((last[0], last[1], clock))
        return pd.DataFrame(out, columns=["track", "match_id", "p_w", "applied"])


def rate_stream(rows: DataFrame, delay: int = 0, patience: int | None = None) -> DataFrame:
    """rows: track, date, match_id, winner_id, loser_id, k, perhaps mapped_w and mapped_l (ratings that ranks say)
    -> track, match_id, p_w (expectation of the winner before the match), applied.

    delay: days for which rows wait for earlier ones; patience: milliseconds without rows after which a track waits no
    longer. A match that comes twice is applied once.
    """
    spark = rows.sparkSession
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, STORE)
    for c in ("mapped_w", "mapped_l"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("double"))
    rows = rows.select("track", F.col("date").cast("string").alias("date"), "match_id", "winner_id", "loser_id", F.col("k").cast("double").alias("k"), "mapped_w", "mapped_l")
    return rows.groupBy("track").transformWithStateInPandas(Track(delay, patience), _OUT, "append", "ProcessingTime" if patience is not None else "None")


def rate_matches(matches: DataFrame, rank_map: tuple[float, float] | None = None, surfaces: bool = True, delay: int = 0, patience: int | None = None) -> DataFrame:
    """A stream of clean matches through the overall and the surface tracks, with ranks as in ``ratings.rate``."""
    rows = batch.tracks(matches, surfaces)
    if rank_map:
        rows = batch.with_rank_map(rows, *(F.lit(float(x)) for x in rank_map))
    return rate_stream(rows.withColumn("track", F.concat_ws(":", "kind", "value")), delay, patience)
