"""Evaluation items from passages: interleaved order, partners, quotas, evidence checks, values found in text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.passages import locate_udf, split_sentences


def interleave(rows: DataFrame, id_col: str, lane: str, seed: str) -> DataFrame:
    """Adds turn and lane_order: lanes take turns; both lanes and the rows of a lane go by a seeded hash."""
    h = lambda c: F.sha2(F.concat(F.lit(seed + "|"), F.col(c).cast("string")), 256)
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(lane).orderBy(h(id_col)))).withColumn("lane_order", h(lane))


def allocate(rows: DataFrame, quotas: dict[str, int], eligible: dict[str, str], order: list[str]) -> list[tuple]:
    """(row, category) plan of a bounded list: each category in turn takes the next rows that are eligible for it and unused.

    Skips consume nothing. `eligible` holds a condition per category. Only as many rows as the quotas
    could use per category come to the driver.
    """
    total = sum(quotas.values())
    used, plan = set(), []
    for cat, n in quotas.items():
        got = rows.where(eligible.get(cat, "true")).orderBy(*order).limit(total).collect()  # at most the quotas' sum
        for r in got:
            if n and r not in used:
                used.add(r)
                plan.append((r, cat))
                n -= 1
    return plan


def checked_evidence(evidence: DataFrame, texts: DataFrame, least: int = 30) -> DataFrame:
    """(item, needed, covered, valid): an item's quotes must be verbatim, at least `least` characters long, and cover all its passages.

    evidence(item, passage, needed, quote), texts(passage, text).
    """
    j = evidence.join(texts, "passage").withColumn("hits", locate_udf("text", "quote"))
    ok = (F.length("quote") >= least) & (F.size("hits") > 0)
    g = j.groupBy("item").agg(F.max("needed").alias("needed"), F.countDistinct(F.when(ok, F.col("passage"))).alias("covered"), F.min(ok.cast("int")).alias("all_ok"))
    return g.select("item", "needed", "covered", ((F.col("all_ok") == 1) & (F.col("covered") >= F.col("needed"))).alias("valid"))


def value_spans(text: str, formats: list[str], keywords: str, least: int = 30) -> list[tuple[int, int]]:
    """Where a text prints a value and says of what: table rows with a label, and sentences, that match the keywords; widened to `least` characters.

    A format counts where no digit, point or comma goes on beside it; blanks in it stand for any run of blanks.
    """
    printed = re.compile(r"(?<![\d.,])(?:" + "|".join(r"\s+".join(map(re.escape, f.split())) for f in formats) + r")(?!\d|[.,]\d)")
    topic, spans, begin = re.compile(keywords, re.I), set(), 0
    for line in text.splitlines(keepends=True):
        body = line.rstrip("\r\n")
        row = body.startswith("|")
        for a, b in [(0, len(body))] if row else split_sentences(body):
            if printed.search(body, a, b) and topic.search(body.split("|")[1] if row else body[a:b]):
                spans.add((begin + a, begin + b))
        begin += len(line)
    wider = [max(0, least - (b - a) + 1) // 2 for a, b in sorted(spans)]
    return [(max(0, a - w), min(len(text), b + w)) for (a, b), w in zip(sorted(spans), wider, strict=True)]


def located_values(values: DataFrame, texts: DataFrame, most: int = 8) -> DataFrame:
    """(doc_id, concept, spans, too_many): where each filing's text prints a value; values(doc_id, concept, formats, keywords), texts(doc_id, text).

    A value printed in more than `most` places says too little of where it is stated: it keeps all its
    spans, and is flagged.
    """

    @F.pandas_udf("array<struct<start: int, end: int>>")
    def spans(text: pd.Series, formats: pd.Series, keywords: pd.Series) -> pd.Series:
        rows = zip(text, formats, keywords, strict=True)
        return pd.Series([None if t is None or f is None else [{"start": a, "end": b} for a, b in value_spans(t, list(f), k or "")] for t, f, k in rows])

    found = values.join(texts.select("doc_id", "text"), "doc_id").select("doc_id", "concept", spans("text", "formats", "keywords").alias("spans"))
    return found.select("doc_id", "concept", "spans", (F.size("spans") > most).alias("too_many"))


def partners(chunks: DataFrame, scores: DataFrame, same: str, other: str) -> DataFrame:
    """(qid, row, score): the most similar row under a condition, ties to the smaller row.

    scores(qid, row, score) are candidate similarities; chunks(row, ...) says what both must share
    (`same`) and in what they must differ (`other`).
    """
    a = chunks.select(F.col("row").alias("qid"), F.col(same).alias("_sa"), F.col(other).alias("_oa"))
    b = chunks.select("row", F.col(same).alias("_sb"), F.col(other).alias("_ob"))
    j = scores.join(a, "qid").join(b, "row").where("_sa = _sb AND _oa <> _ob AND qid <> row")
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 6)), "row")
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("qid", "row", "score")


def grouped_labels(labels: DataFrame) -> DataFrame:
    """One judge call per question, answer and sources: (question, answer, chunk_ids, sentences)."""
    return labels.groupBy("question", "answer", "chunk_ids").agg(F.array_sort(F.collect_set("sentence")).alias("sentences"))
