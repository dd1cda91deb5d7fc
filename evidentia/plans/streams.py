"""Queries on the event stream: replays and Structured Streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..streaming import live, replay
from .registry import query


def events(spark, d):
    e = table(spark, d, "events")
    return e.withColumns({c: F.col(c).cast("timestamp") for c, t in e.dtypes if t == "timestamp_ntz"})


_T = "epoch_us(ts) / 1e6"


@query(f"SELECT event_id, user_id, CAST(place AS INTEGER) AS place, place <= 2 AS admitted FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, floor({_T} / 3600) ORDER BY ts, event_id) AS place FROM events)")
def rate_limited_events(spark, d):
    """Two requests an hour for each user."""
    return replay.rate_limit(events(spark, d), "user_id", "ts", "event_id", 2, 3600).select("event_id", "user_id", "place", "admitted")


_S = f"SELECT *, 0.01 * {_T} - coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM events"


@query(f"SELECT event_id, round(level, 3) AS level, round(greatest(0, (value - level) / 0.01), 2) AS wait FROM (SELECT *, 100 + s - max(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS level FROM ({_S}))")
def token_bucket_levels(spark, d):
    """A bucket of 100 refilled at 0.01 a second, drained by the events' values."""
    b = replay.token_bucket(events(spark, d), "user_id", "ts", "event_id", F.col("value"), 0.01, 100.0)
    return b.select("event_id", F.round("level", 3).alias("level"), F.round("wait", 2).alias("wait"))


@query(f"SELECT event_id, round(max({_T} - k * 600) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + k * 600, 3) AS sent FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)")
def throttled_events(spark, d):
    """At least ten minutes between two requests of a user."""
    return replay.min_interval(events(spark, d), "user_id", "ts", "event_id", 600.0).select("event_id", F.round("sent", 3).alias("sent"))


def _chain(keys: str, life: float, where: str = "true") -> str:
    """CTEs ending in s(keys, n, mark): for each key its first event, then the first one `life` seconds or more after that, and so on; mark is (t, event_id)."""
    on = " AND ".join(f"e.{k} = s.{k}" for k in keys.split(", "))
    of = ", ".join(f"s.{k}" for k in keys.split(", "))
    return (
        f"e AS MATERIALIZED (SELECT event_id, user_id, event_type, {_T} AS t, struct_pack(t := {_T}, i := event_id) AS mark FROM events), "
        f"s AS (SELECT {keys}, 1 AS n, min(mark) AS mark FROM e WHERE {where} GROUP BY {keys} UNION ALL SELECT {of}, s.n + 1, min(e.mark) FROM s JOIN e ON {on} WHERE {where} AND e.t >= s.mark.t + {life} GROUP BY {of}, s.n)"
    )


@query(f"WITH RECURSIVE {_chain('user_id, event_type', 21600.0)} SELECT e.event_id, CASE WHEN s.n IS NULL THEN 'hit' ELSE 'miss' END AS cache FROM e LEFT JOIN s ON s.user_id = e.user_id AND s.event_type = e.event_type AND s.mark.i = e.event_id")
def cached_events(spark, d):
    """A cache per user and event type with six hours to live from the write."""
    return replay.ttl_cache(events(spark, d).select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "event_id", 6 * 3600.0).select("event_id", "cache")


@query(f"WITH RECURSIVE {_chain('user_id', 1800.0)} SELECT e.event_id, e.user_id, CAST(max(s.n) AS INTEGER) AS session FROM e JOIN s ON s.user_id = e.user_id AND s.mark.t <= e.t GROUP BY e.event_id, e.user_id")
def session_events(spark, d):
    """Sessions of 30 minutes from their issue."""
    return replay.fixed_sessions(events(spark, d).select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").select("event_id", "user_id", "session")


_FAILED = _chain("user_id", 60.0, "e.event_type = 'error'").replace("FROM e WHERE e.event_type", "FROM e WHERE event_type")


@query(
    f"WITH RECURSIVE {_FAILED}, l AS (SELECT e.event_id, max(s.mark) AS last FROM e JOIN s ON s.user_id = e.user_id AND s.mark <= e.mark GROUP BY e.event_id) "
    "SELECT e.event_id, e.user_id, CASE WHEN l.last IS NULL THEN 'ok' WHEN l.last.i = e.event_id THEN 'failed' WHEN e.t < l.last.t + 60.0 THEN 'skipped' ELSE 'ok' END AS outcome FROM e LEFT JOIN l USING (event_id)"
)
def provider_outcomes(spark, d):
    """Users as providers: an error makes a provider cold for a minute."""
    e = events(spark, d).select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("failed"))
    return replay.provider_states(e, "user_id", "ts", "event_id", "failed", 60.0).select("event_id", "user_id", "outcome")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def latest_event_per_user(spark, d):
    return replay.latest_state(events(spark, d), "user_id", "ts", "event_id", "event_type", "value")


@query("SELECT user_id, sum(value) / sum(greatest(value, 50)) AS done FROM (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL) GROUP BY user_id")
def progress_per_user(spark, d):
    """Progress over the last value of each of a user's event types."""
    last = events(spark, d).groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    return last.groupBy("user_id").agg((F.sum("v") / F.sum(F.greatest("v", F.lit(50.0)))).alias("done"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streamed_hourly_counts(spark, d):
    """Structured Streaming: counts per hour and type under a watermark."""
    out = live.drain(live.window_counts(live.event_stream(spark, d), "ts", "event_type", "value"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"SELECT event_id, row_number() OVER (PARTITION BY user_id, floor({_T} / 3600) ORDER BY ts, event_id) <= 2 AS admitted FROM events")
def streamed_rate_limit(spark, d):
    """Structured Streaming: the rate limit with keyed state."""
    s = live.event_stream(spark, d).select("event_id", "user_id", "ts")
    buckets = max(256, table(spark, d, "events").count() // 32_768)  # all that is there comes in one micro-batch
    return live.drain(live.rate_limited(s, "user_id", "ts", "event_id", 2, 3600, buckets=buckets)).select("event_id", "admitted")


_GAP = "CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END"


@query(f"SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(g) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, {_GAP} AS g FROM events)) GROUP BY ALL) GROUP BY user_id")
def gap_sessions(spark, d):
    """Sessions that end after half an hour without an event."""
    s = live.session_counts(events(spark, d), "ts", "user_id")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))
