"""Relevance judgements from gold spans, and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import overlap_pairs

METRICS = ("recall_at_5", "recall_at_10", "mrr_at_10", "ndcg_at_10")


def gold_spans(items: DataFrame) -> DataFrame:
    """(qid, grp, doc_id, gs, ge): the evidence spans; a span without a group is its own."""
    e = items.select(F.col("id").alias("qid"), F.posexplode("gold_spans").alias("i", "s"))
    return e.select("qid", F.coalesce("s.grp", F.concat(F.lit("#"), F.col("i").cast("string"))).alias("grp"), "s.doc_id", F.col("s.char_start").alias("gs"), F.col("s.char_end").alias("ge"))


def gold_overlaps(spans: DataFrame, chunks: DataFrame, least: int = 30) -> DataFrame:
    """(qid, grp, chunk_id): chunks that share at least `least` characters with a span, or the whole of a shorter one.

    The join runs over bins of a document, so that one with very many chunks and spans spreads out.
    """
    c = chunks.select("chunk_id", "doc_id", "char_start", "char_end")
    shared = F.least("char_end", "ge") - F.greatest("char_start", "gs")
    enough = shared >= F.least(F.lit(least), F.col("ge") - F.col("gs"))
    return overlap_pairs(spans, c, "doc_id", ("gs", "ge"), ("char_start", "char_end"), residual=enough).select("qid", "grp", "chunk_id").distinct()


def score_rankings(hits: DataFrame, relevant: DataFrame, spans: DataFrame) -> DataFrame:
    """(qid, recall@5, recall@10, mrr@10, ndcg@10) of every query that has spans.

    hits(qid, chunk_id, rank <= 10). Recall counts evidence groups; nDCG is binary per chunk, and its
    ideal has as many relevant chunks as the whole index, at most ten.
    """
    groups = spans.groupBy("qid").agg(F.countDistinct("grp").alias("groups"))
    rel = relevant.groupBy("qid").agg(F.countDistinct("chunk_id").alias("rel"))
    met = hits.join(relevant, ["qid", "chunk_id"])
    first = met.groupBy("qid", "grp").agg(F.min("rank").alias("r")).groupBy("qid").agg(F.count_if(F.col("r") <= 5).alias("g5"), F.count("*").alias("g10"), F.min("r").alias("first"))
    dcg = met.select("qid", "chunk_id", "rank").distinct().groupBy("qid").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("rel", F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    j = groups.join(rel, "qid", "left").join(first, "qid", "left").join(dcg, "qid", "left")
    zero = F.lit(0.0)
    return j.select(
        "qid", (F.coalesce("g5", F.lit(0)) / F.col("groups")).alias(METRICS[0]), (F.coalesce("g10", F.lit(0)) / F.col("groups")).alias(METRICS[1]),
        F.coalesce(1 / F.col("first"), zero).alias(METRICS[2]), F.when(F.col("dcg").isNull(), zero).otherwise(F.col("dcg") / ideal).alias(METRICS[3]),
    )


def mean_scores(scores: DataFrame, by: str) -> DataFrame:
    """Means overall ('all') and per group, to four decimals, half up, with the number of scored queries."""
    four = [(F.floor(F.avg(m) * 10000 + 0.5) / 10000).alias(m) for m in METRICS]
    return scores.groupingSets([[], [by]], by).agg(F.count("*").alias("n"), *four).withColumn(by, F.coalesce(by, F.lit("all"))).select(by, "n", *METRICS)


def gate(means: DataFrame, baseline: dict[str, float], drop: float) -> DataFrame:
    """(metric, value, baseline, regressed) from one row of means."""
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(float(b)).alias("baseline")) for m, b in baseline.items()))
    return means.select(F.explode(rows).alias("r")).select("r.*").withColumn("regressed", F.col("baseline") - F.col("value") > drop)
