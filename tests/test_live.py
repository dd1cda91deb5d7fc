"""Keyed operators on Structured Streaming: values, nulls, several micro-batches and the size of their state."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from evidentia.streaming import live, replay

START = datetime(2024, 1, 1)
DDL = "event_id bigint, user_id bigint, ts timestamp"


def limited(spark, folder, batches):
    """(rows as admitted, progress of the micro-batches) of the rate limit over one file a micro-batch."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(part := f"{folder}/{n}")
        for name in os.listdir(part):
            if name.endswith(".parquet"):
                os.utime(f"{part}/{name}", (1_700_000_000 + n, 1_700_000_000 + n))
    s = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    out = live.rate_limited(s, "user_id", "ts", "event_id", 2, 3600)
    assert out.columns == ["event_id", "user_id", "ts", "admitted"] and [t for _, t in out.dtypes] == ["bigint", "bigint", "timestamp", "boolean"]
    q = out.writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("limited").withColumn("us", F.unix_micros("ts")).collect(), q.recentProgress


def test_state_of_a_stream_grows_with_buckets_not_keys(spark, tmp_path):
    rows = [(i, i // 2, START + timedelta(minutes=i % 50)) for i in range(1000)]
    got, progress = limited(spark, str(tmp_path / "in"), [rows])
    assert len(got) == 1000 and all(r.admitted for r in got)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= 256


def test_streamed_rate_limit_as_replayed_with_nulls_and_large_numbers(spark, tmp_path):
    big = 2**60
    rows = [(big + i, [None, big, big + 1][i % 3], None if i % 5 == 0 else START + timedelta(microseconds=i)) for i in range(40)]
    rows += [(None, 7, START), (3, 7, START), (4, 7, START)]
    got, _ = limited(spark, str(tmp_path / "in"), [rows])
    want = replay.rate_limit(spark.createDataFrame([r for r in rows if r[1] != 7], DDL), "user_id", "ts", "event_id", 2, 3600).withColumn("us", F.unix_micros("ts"))
    plain = lambda x: sorted((r.event_id, r.user_id or 0, r.us or 0, r.admitted) for r in x if r.user_id != 7)
    assert plain(got) == plain(want.collect())
    assert {r.event_id: r.admitted for r in got if r.user_id == 7} == {3: True, 4: True, None: False}  # SQL has nulls last


def test_counts_last_over_micro_batches_until_the_watermark_has_passed(spark, tmp_path):
    at = lambda minutes: START + timedelta(minutes=minutes)
    batches = [
        [(1, 1, at(10)), (2, 2, at(11)), (3, 1, None)],
        [(4, 1, at(20)), (5, 1, at(15)), (6, 1, at(70)), (7, 1, None), (8, 1, None)],
        [(9, 1, at(21)), (10, 1, at(71)), (11, 1, at(72)), (12, 2, at(12))],
        [(13, 3, at(600))],
        [(14, 3, at(601)), (15, 3, at(602)), (16, 1, None)],
    ]
    got, progress = limited(spark, str(tmp_path / "in"), batches)
    out = {r.event_id: r.admitted for r in got}
    assert sorted(out) == list(range(1, 17))
    # user 1 in hour 0: 1 | 5, 4 | 9; in hour 1: 6 | 10, 11; without a time: 3 | 7, 8 | 16; user 3: 13 | 14, 15
    assert [k for k, v in sorted(out.items()) if not v] == [4, 8, 9, 11, 15, 16]
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 2  # user 3's hour and user 1 without a time


def test_streamed_rate_limit_holds_before_1970_and_beyond_2262(spark, tmp_path):
    old, far = datetime(1969, 12, 31, 10), datetime(2300, 1, 1)
    minute = timedelta(minutes=1)
    batches = [[(1, 1, old), (2, 1, old + 60 * minute)], [(4, 1, old + 2 * minute), (3, 1, old + minute), (5, 1, far)], [(6, 1, far + minute), (7, 1, far + 2 * minute)]]
    got, _ = limited(spark, str(tmp_path / "in"), batches)
    assert sorted((r.event_id, r.admitted) for r in got) == [(1, True), (2, True), (3, True), (4, False), (5, True), (6, True), (7, False)]
