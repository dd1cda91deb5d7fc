"""The same operators on Structured Streaming."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_path


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table file or folder as a stream."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.withColumns({c: F.col(c).cast("timestamp") for c, t in stream.dtypes if t == "timestamp_ntz"})


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into a table of the shared folder; complete results replace each other."""
    spark = stream.sparkSession
    out, check = shared_path(spark, "stream"), shared_path(spark, "stream-state")
    writer = stream.writeStream.option("checkpointLocation", check).trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", out).outputMode("append").start()
    else:
        q = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def window_counts(stream: DataFrame, ts: str, by: str, value: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event-time window and key, with a watermark."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = stream.withWatermark(ts, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), by, "n", "total")


def session_counts(stream: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    g = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


_WHOLE = {"tinyint", "smallint", "int", "bigint", "timestamp"}
_NEVER = 2**63 - 1


def keyed_places(stream: DataFrame, key: str, event: str, until: str, order: list[str], name: str, buckets: int = 256) -> DataFrame:
    """A stream with one more column, and without `event`, which has the watermark: the place of a row among those of its key and `until` so far, rows of a micro-batch in order.

    Keys are dealt to `buckets` by hash and a bucket's counts are one state, so a micro-batch takes as many calls
    of Python as there are buckets, not keys. `until` is the end of a count's use in milliseconds of event time: it
    goes once the watermark has passed it (rows without `until` count together and stay). Whole numbers and times
    pass through Python as longs beside a mark for null, as pandas would turn them into floats or local times.
    """
    whole = {c: t for c, t in stream.dtypes if t in _WHOLE and c != event}
    long = {c: F.coalesce(F.unix_micros(c) if t == "timestamp" else F.col(c).cast("bigint"), F.lit(0).cast("bigint")) for c, t in whole.items()}
    back = {c: F.when(~F.col(f"_no_{c}"), F.timestamp_micros(c) if t == "timestamp" else F.col(c).cast(t)) for c, t in whole.items()}
    own = {"_key": F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")), "_until": F.coalesce(F.col(until), F.lit(_NEVER))}
    d = stream.withColumns(own | {f"_no_{c}": F.col(c).isNull() for c in whole} | long)
    d = d.withColumn("_bucket", F.pmod(F.xxhash64("_key", "_until"), F.lit(buckets)))
    kept = [(c, t) for c, t in d.dtypes if c not in (event, "_key", "_until", "_bucket")]
    by, cols = ["_key", "_until"], [c for c, _ in kept]
    order = [x for c in order for x in ([f"_no_{c}", c] if c in whole else [c])]

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        seen, rows = pd.DataFrame(dict(zip([*by, name], held.get, strict=True))) if held.exists else None, None
        if not held.hasTimedOut:
            rows = pd.concat(list(batches), ignore_index=True).sort_values(order, ignore_index=True)
            rows[name] = rows.groupby(by, sort=False).cumcount() + 1
            if seen is not None:
                rows[name] += rows[by].merge(seen, "left", by)[name].fillna(0).astype("int64")
            seen = pd.concat([seen, rows[[*by, name]]]).drop_duplicates(by, keep="last")
        seen = seen[seen["_until"].clip(lower=1) > held.getCurrentWatermarkMs()]  # a watermark starts at 0, in 1970
        if seen.empty:
            held.remove()
        else:
            held.update(tuple(seen[c].tolist() for c in (*by, name)))
            if (end := int(seen["_until"].min())) < _NEVER:
                held.setTimeoutTimestamp(max(end, 1))
        if rows is not None:
            yield rows[[*cols, name]]

    schema = ", ".join(f"`{c}` {t}" for c, t in kept) + f", `{name}` bigint"
    state = "keys array<string>, untils array<bigint>, places array<bigint>"
    out = d.groupBy("_bucket").applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumns(back).select(*(c for c in stream.columns if c != event), name)


def rate_limited(stream: DataFrame, key: str, ts: str, tie: str, limit: int = 6, window: int = 60, late: str = "1 hour", buckets: int = 256) -> DataFrame:
    """admitted per request, in tumbling windows; the state is the count of one window, and goes when the watermark has passed it by `late`."""
    # to a watermark of 0 what came before 1970 would be late, and pandas has no time after 2262
    first, last = F.timestamp_micros(F.lit(1)), F.timestamp_seconds(F.lit(9_000_000_000))
    event = F.when(F.col(ts) < first, first).when(F.col(ts) > last, last).otherwise(F.col(ts))
    end = (F.floor(F.unix_micros(F.col(ts)) / (window * 1_000_000)) + 1) * (window * 1000)
    timed = stream.withColumns({"_event": event, "_end": end}).withWatermark("_event", late)
    return keyed_places(timed, key, "_event", "_end", [ts, tie], "_place", buckets).select(*stream.columns, (F.col("_place") <= limit).alias("admitted"))
