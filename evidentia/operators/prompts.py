"""Prompts from retrieved sources, cached calls, request validation, signed sessions."""

from __future__ import annotations

import base64
import hashlib
import hmac
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _numbered(label: Column, body: Column, n: Column) -> Column:
    return F.concat(F.lit("["), n.cast("string"), F.lit("] "), label, F.lit("\n"), F.trim(body))


def source_prompts(sources: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, prompt): numbered source blocks in order, then the question.

    sources(qid, n, label, text), questions(qid, text). A question without sources has an empty source part.
    A question's sources are the few that were retrieved for it.
    """
    b = sources.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", _numbered(F.col("label"), F.col("text"), F.col("n")).alias("b")))).alias("s"))
    j = questions.join(b, "qid", "left")
    blocks = F.array_join(F.transform(F.coalesce("s", F.array()), lambda x: x["b"]), "\n\n")
    return j.select("qid", F.concat(F.lit("SOURCES:\n\n"), blocks, F.lit("\n\nQUESTION: "), F.trim(j["text"])).alias("prompt"))


def support_prompts(claims: DataFrame, sources: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, prompt) for a support judge: only the cited sources, then the numbered claims with their citations.

    claims(qid, k, plain, cites ARRAY<INT>), k from 1.
    """
    cited = claims.select("qid", F.explode("cites").alias("n")).distinct()
    base = source_prompts(sources.join(cited, ["qid", "n"], "left_semi"), questions)
    line = F.concat(F.lit("CLAIM "), F.col("k").cast("string"), F.lit(" (cites "), F.array_join(F.transform("cites", lambda c: F.concat(F.lit("["), c.cast("string"), F.lit("]"))), ""), F.lit("): "), F.col("plain"))
    listed = claims.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("l")))), lambda x: x["l"]), "\n").alias("l"))
    return base.join(listed, "qid").select("qid", F.concat("prompt", F.lit("\n\nCLAIMS:\n"), "l").alias("prompt"))


def correctness_prompt(question: Column, gold: Column, answer: Column) -> Column:
    return F.concat(F.lit("QUESTION: "), question, F.lit("\n\nREFERENCE ANSWER: "), gold, F.lit("\n\nANSWER: "), answer)


def cached_calls(requests: DataFrame, cache: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """(key, prompt, reply, cached): replies from the cache first; only the rest, each distinct prompt once, goes through `call`.

    requests(prompt), cache(key, reply); the key is the hash of the prompt. A run that breaks off loses
    nothing that was written to the cache: the next run only calls for what is missing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.assign(reply=[call(x) for x in p["prompt"]], cached=False)

    asked = requests.select("prompt").where("prompt IS NOT NULL").distinct().select(F.sha2("prompt", 256).alias("key"), "prompt")
    known = asked.join(cache.dropDuplicates(["key"]), "key").select("key", "prompt", "reply", F.lit(True).alias("cached"))
    fresh = asked.join(cache, "key", "left_anti").mapInPandas(run, "key string, prompt string, reply string, cached boolean")
    return known.unionAll(fresh)


def reject_reason(method: Column, origin: Column, host: Column, body: Column, question: Column, chunk_ids: Column) -> Column:
    """Why a request is turned away; null for a good one."""
    return (
        F.when(method != "POST", "method_not_allowed")
        .when(origin.isNotNull() & (F.regexp_extract(origin, r"^https?://([^/]+)", 1) != host), "forbidden_origin")
        .when(F.octet_length(body) > 16_384, "body_too_large")
        .when(F.try_parse_json(body).isNull(), "invalid_json")
        .when(F.coalesce(F.length(F.trim(question)), F.lit(0)).between(3, 500) == F.lit(False), "invalid_question")
        .when((F.coalesce(F.size(chunk_ids), F.lit(0)) < 1) | (F.size(chunk_ids) > 10), "invalid_chunks")
        .when(F.size(F.array_distinct(chunk_ids)) != F.size(chunk_ids), "repeated_chunks")
        .when(F.exists(chunk_ids, lambda x: ~x.rlike(r"^[A-Za-z0-9.-]{1,64}$")), "invalid_chunk_id")
    )


def sign(expiry: int, secret: str) -> str:
    """expiry.signature, the signature being a keyed hash of "v1.expiry" (fixed format) in URL-safe base 64."""
    mac = hmac.new(secret.encode(), f"v1.{expiry}".encode(), hashlib.sha256).digest()
    return f"{expiry}.{base64.urlsafe_b64encode(mac).rstrip(b'=').decode()}"


def session_alive(token: str | None, secret: str, now: int) -> bool:
    """Whether a token is ours and has not run out."""
    expiry, _, given = (token or "").partition(".")
    return expiry.isdigit() and hmac.compare_digest(sign(int(expiry), secret).encode(), f"{int(expiry)}.{given}".encode()) and now < int(expiry)


def alive_sessions(tokens: DataFrame, token: str, at: str, secret: str) -> DataFrame:
    """Adds alive for each token at its time in epoch seconds."""

    @F.pandas_udf("boolean")
    def alive(t: pd.Series, now: pd.Series) -> pd.Series:
        return pd.Series([session_alive(x, secret, int(n)) for x, n in zip(t, now, strict=True)])

    return tokens.withColumn("alive", alive(token, at))
