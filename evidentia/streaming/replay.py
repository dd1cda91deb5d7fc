"""Keyed stream operators as batch replays: closed forms as windows where there are any, else ordered folds.

An ordered fold hash-partitions by key and sorts inside the partition, so the rows of a key pass one
after another through a small state; no group is ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def rate_limit(events: DataFrame, key: str, ts: str, tie: str, limit: int = 6, window: int = 60) -> DataFrame:
    """Adds place and admitted: the first `limit` requests of a key in each tumbling window pass."""
    slot = F.floor(seconds(ts) / window)
    w = Window.partitionBy(key, "_slot").orderBy(ts, tie)
    return events.withColumn("_slot", slot).withColumn("place", F.row_number().over(w)).withColumn("admitted", F.col("place") <= limit).drop("_slot")


def token_bucket(events: DataFrame, key: str, ts: str, tie: str, need: Column, rate: float, capacity: float) -> DataFrame:
    """Adds level (before the request) and wait: a bucket of `capacity` refilled at `rate` a second; requests reserve and the level may go below zero.

    Closed form: with S = rate * t - earlier needs, the level is capacity + S - running max(S).
    """
    w = Window.partitionBy(key).orderBy(ts, tie)
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    d = events.withColumn("_n", need.cast("double")).withColumn("_s", rate * seconds(ts) - before)
    level = capacity + F.col("_s") - F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("level", level)
    return d.withColumn("wait", F.greatest(F.lit(0.0), (F.col("_n") - F.col("level")) / rate)).drop("_n", "_s")


def min_interval(events: DataFrame, key: str, ts: str, tie: str, gap: float) -> DataFrame:
    """Adds sent: when each request leaves if a key waits at least `gap` seconds between two; sent_n = n gap + max(t_k - k gap)."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    d = events.withColumn("_k", F.row_number().over(w)).withColumn("_d", seconds(ts) - F.col("_k") * gap)
    return d.withColumn("sent", F.max("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_k") * gap).drop("_k", "_d")


def ordered_fold(events: DataFrame, keys: list[str], order: list[str], start: Callable[[], dict], step: Callable[[dict, tuple], object], name: str, kind: str) -> DataFrame:
    """Adds a column: step(state, row) for the rows of each key in order; start() makes the state of a new key."""
    cols = events.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for p in batches:
            out = []
            for row, key in zip(p.itertuples(index=False), zip(*(p[k] for k in keys), strict=True), strict=True):
                if key != at:
                    at, state = key, start()
                out.append(step(state, row))
            yield p.assign(**{name: out})

    ordered = events.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = ", ".join(f"`{c}` {t}" for c, t in events.dtypes) + f", {name} {kind}"
    return ordered.select(cols).mapInPandas(run, schema)


def ttl_cache(events: DataFrame, keys: list[str], ts: str, tie: str, ttl: float) -> DataFrame:
    """Adds cache 'hit' or 'miss': a miss writes, and what is written lives `ttl` seconds from the write; a hit does not extend it."""

    def step(state: dict, row) -> str:
        if "until" in state and row[at] < state["until"]:
            return "hit"
        state["until"] = row[at] + ttl
        return "miss"

    d = events.withColumn("_t", seconds(ts))
    at = d.columns.index("_t")
    return ordered_fold(d, keys, ["_t", tie], dict, step, "cache", "string").drop("_t")


def fixed_sessions(events: DataFrame, key: str, ts: str, tie: str, life: float = 1800.0) -> DataFrame:
    """Adds session 1, 2, ...: a session lives `life` seconds from its issue, whatever happens in it."""

    def step(state: dict, row) -> int:
        if "until" not in state or row[at] >= state["until"]:
            state["until"], state["n"] = row[at] + life, state.get("n", 0) + 1
        return state["n"]

    d = events.withColumn("_t", seconds(ts))
    at = d.columns.index("_t")
    return ordered_fold(d, [key], ["_t", tie], dict, step, "session", "int").drop("_t")


def provider_states(attempts: DataFrame, provider: str, ts: str, tie: str, failed: str, cold: float = 60.0) -> DataFrame:
    """Adds outcome 'skipped', 'failed' or 'ok': after a failure a provider is cold, and skipped, for `cold` seconds."""

    def step(state: dict, row) -> str:
        if row[at] < state.get("until", float("-inf")):
            return "skipped"
        if row[bad]:
            state["until"] = row[at] + cold
            return "failed"
        return "ok"

    d = attempts.withColumn("_t", seconds(ts))
    at, bad = d.columns.index("_t"), d.columns.index(failed)
    return ordered_fold(d, [provider], ["_t", tie], dict, step, "outcome", "string").drop("_t")


def run_chain(requests: list[dict], providers: list[str], timeout: float = 8.0, cold: float = 60.0, until: dict[str, float] | None = None) -> list[dict]:
    """Replay of whole requests over an ordered provider chain.

    Each request: t, replies {provider: (status, first_token_seconds, tokens)}, forced failures. A provider
    turns cold after 429, 5xx, an empty stream (as 502) or a late first token; other errors and forced
    failures do not make it cold. Unconfigured providers are those without a reply.
    """
    until = {} if until is None else until
    out = []
    for r in requests:
        log, winner = [], None
        for p in providers:
            if p not in r["replies"]:
                continue
            if r["t"] < until.get(p, float("-inf")):
                log.append((p, "cold"))
                continue
            if p in r.get("forced", ()):
                log.append((p, "forced"))
                continue
            status, first, tokens = r["replies"][p]
            if status == 200 and not tokens:
                status = 502
            late = first > timeout
            if status == 200 and not late:
                winner = p
                log.append((p, "ok"))
                break
            log.append((p, "timeout" if late else str(status)))
            if late or status == 429 or status >= 500:
                until[p] = r["t"] + cold
        out.append({"t": r["t"], "provider": winner, "attempts": log})
    return out


def chained_requests(requests: DataFrame, chain: str, ts: str, tie: str, replies: str, providers: list[str], timeout: float = 8.0, cold: float = 60.0) -> DataFrame:
    """Adds provider and attempts: run_chain() over the requests of each chain (a service or client) in order of their time.

    replies is array<struct<provider, status, first, tokens>>, one entry for each configured provider; the
    requests of a chain pass one after another through its state, as a chain's cold providers depend on all before.
    """

    def step(state: dict, row) -> dict:
        until = state.setdefault("until", {})
        got = {r["provider"]: (r["status"], r["first"], ["x"] * int(r["tokens"])) for r in (row[body] if row[body] is not None else [])}
        one = run_chain([{"t": row[at], "replies": got}], providers, timeout, cold, until)[0]
        return {"provider": one["provider"], "attempts": [{"provider": p, "outcome": o} for p, o in one["attempts"]]}

    d = requests.withColumn("_t", seconds(ts))
    at, body = d.columns.index("_t"), d.columns.index(replies)
    return ordered_fold(d, [chain], ["_t", tie], dict, step, "_x", "struct<provider: string, attempts: array<struct<provider: string, outcome: string>>>").drop("_t").select("*", "_x.provider", "_x.attempts").drop("_x")


def latest_state(events: DataFrame, key: str, ts: str, tie: str, *cols: str) -> DataFrame:
    """The last state of each key."""
    g = events.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(ts, tie)).alias("_s"))
    return g.select(key, *(F.col(f"_s.{c}").alias(c) for c in cols))


def accumulate(tokens: DataFrame, request: str, seq: str, text: str, kind: str) -> DataFrame:
    """(request, answer, tokens, finished): a request's text tokens in order, up to its one 'done' or 'error' event.

    A request's events are few; what comes after the first final event is ignored.
    """
    end = F.min(F.when(F.col(kind).isin("done", "error"), F.col(seq)))
    ends = tokens.groupBy(request).agg(end.alias("_end"), F.min_by(kind, F.when(F.col(kind).isin("done", "error"), F.col(seq))).alias("finished"))
    j = tokens.join(ends, request).where((F.col(kind) == "token") & (F.col("_end").isNull() | (F.col(seq) < F.col("_end"))))
    a = j.groupBy(request).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, text))), lambda s: s[text]), "").alias("answer"), F.count("*").alias("tokens"))
    return ends.select(request, "finished").join(a, request, "left").select(request, F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "finished")


class SseParser:
    """Server-sent events out of pieces cut anywhere: feed() gives the events that are complete, close() the rest."""

    def __init__(self) -> None:
        self.rest = b""
        self.name, self.data = "message", []

    def feed(self, piece: bytes) -> list[tuple[str, str]]:
        self.rest += piece
        *lines, self.rest = self.rest.split(b"\n")
        return [e for line in lines if (e := self._line(line.decode("utf-8", "replace").rstrip("\r")))]

    def close(self) -> list[tuple[str, str]]:
        tail, self.rest = self.rest.decode("utf-8", "replace").rstrip("\r"), b""
        first = self._line(tail) if tail else None
        last = self._line("")
        return [e for e in (first, last) if e]

    def _line(self, line: str) -> tuple[str, str] | None:
        if not line:
            name, data = self.name, self.data
            self.name, self.data = "message", []
            return (name, "\n".join(data)) if data else None
        field, _, value = line.partition(":")
        value = value[1:] if value.startswith(" ") else value
        if field == "event":
            self.name = value
        elif field == "data":
            self.data.append(value)
        return None


def parse_sse(pieces: DataFrame, request: str, seq: str, body: str) -> DataFrame:
    """(request, no, event, data) of byte pieces that arrive in order per request; pieces may break anywhere."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parser, n, out = None, None, 0, []

        def emit(events) -> None:
            nonlocal n
            for name, data in events:
                out.append((at, n, name, data))
                n += 1

        for p in batches:
            for r, piece in zip(p[request], p[body], strict=True):
                if r != at:
                    if parser:
                        emit(parser.close())
                    at, parser, n = r, SseParser(), 0
                emit(parser.feed(bytes(piece)))
            yield pd.DataFrame(out, columns=[request, "no", "event", "data"])
            out = []
        if parser:
            emit(parser.close())
            yield pd.DataFrame(out, columns=[request, "no", "event", "data"])

    ordered = pieces.where(F.col(request).isNotNull() & F.col(body).isNotNull()).repartition(request).sortWithinPartitions(request, seq)
    return ordered.select(request, body).mapInPandas(run, f"{request} {dict(pieces.dtypes)[request]}, no int, event string, data string")
