"""Ratings over micro-batches equal the fold over the whole table."""

import datetime

import pytest
from pyspark.sql import functions as F

from contestry import queries
from contestry.operators import ratings
from contestry.streaming.ratings import rate_matches, rate_stream


def run(spark, stream, name, path):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/ck-{name}").trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None
    return q, spark.table(name).collect()


def files(spark, df, path, order, n):
    """The rows in n files that are read one in each batch."""
    rows = df.orderBy(*order).collect()
    for k in range(n):
        part = spark.createDataFrame(rows[k * len(rows) // n:(k + 1) * len(rows) // n], df.schema)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("rank_map", [None, (2000.0, -90.0)])
def test_batches_equal_the_fold(spark, sf, tmp_path, rank_map):
    m = queries.matches(spark, sf).where("match_id < 500")
    q, got = run(spark, rate_matches(files(spark, m, f"{tmp_path}/in", ["date", "match_id"], 4), rank_map), f"rated{bool(rank_map)}", tmp_path)
    want = {(f"{r.kind}:{r.value}", r.match_id): r.p_w for r in ratings.rate(ratings.tracks(m), rank_map).collect()}
    assert len(q.recentProgress) >= 4 and all(r.applied for r in got)
    assert {(r.track, r.match_id): r.p_w for r in got} == pytest.approx(want) and len(got) == len(want)
    # What a batch writes is its players, its place and no more.
    for p in q.recentProgress:
        state = p["stateOperators"][0] if isinstance(p, dict) else p.stateOperators[0]
        n = p["numInputRows"] if isinstance(p, dict) else p.numInputRows
        updated = state["numRowsUpdated"] if isinstance(state, dict) else state.numRowsUpdated
        assert updated <= 4 * n + 4


def test_rows_that_come_too_late_or_wait(spark, tmp_path):
    day = lambda n: (datetime.date(2000, 1, 1) + datetime.timedelta(days=n)).isoformat()
    rows = [("t", day(d), d, d % 3, 3 + d % 2, 24.0, i) for i, d in enumerate([0, 2, 1, 3, 5, 4, 9, 1, 20, 40, 3])]
    schema = "track string, date string, match_id long, winner_id long, loser_id long, k double, seq int"
    df = spark.createDataFrame(rows, schema)
    _, got = run(spark, rate_stream(files(spark, df, f"{tmp_path}/in", ["seq"], 11).drop("seq"), delay=3), "waited", tmp_path)
    applied, late = [r.match_id for r in got if r.applied], [r.match_id for r in got if not r.applied]
    assert applied == [0, 1, 2, 3, 4, 5, 9, 20] and late == [1, 3]  # 40 still waits
    part = df.where("match_id < 40").dropDuplicates(["match_id"])
    fold = ratings.rate(part.select(F.lit("a").alias("kind"), F.lit("").alias("value"), F.col("date").cast("date").alias("date"), "match_id", "winner_id", "loser_id",
                                    "k", F.lit(None).cast("int").alias("winner_rank"), F.lit(None).cast("int").alias("loser_rank")))
    assert {r.match_id: r.p_w for r in got if r.applied} == pytest.approx({r.match_id: r.p_w for r in fold.collect()})
