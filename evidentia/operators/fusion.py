"""Rank fusion and reranking of candidate lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fuse(lexical: DataFrame, dense: DataFrame, k: int = 60) -> DataFrame:
    """(qid, row, lexical_rank, lexical_score, dense_rank, dense_score, fused, fused_rank).

    Reciprocal rank fusion of two ranked lists (qid, row, rank, score): a full outer join, a missing
    list adds nothing. Ties go to the smaller row.
    """
    lex = lexical.select("qid", "row", F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"))
    den = dense.select("qid", "row", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    both = lex.join(den, ["qid", "row"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    both = both.withColumn("fused", part("lexical_rank") + part("dense_rank"))
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("fused", 9)), "row")
    return both.withColumn("fused_rank", F.row_number().over(w))


def rerank(fused: DataFrame, scores: DataFrame, top_n: int) -> DataFrame:
    """Adds rerank_score, rerank_rank and final_rank: the head of top_n rows is ordered anew by scores(qid, row, rerank_score).

    A row without a score comes last of the head; the tail keeps its order behind the head and has no
    rerank rank. rank_move is how far a row rose.
    """
    j = fused.join(scores, ["qid", "row"], "left").withColumn("head", F.col("fused_rank") <= top_n)
    w = Window.partitionBy("qid").orderBy(F.desc("head"), F.when(F.col("head"), -F.coalesce("rerank_score", F.lit(float("-inf")))).otherwise(F.lit(0.0)), "fused_rank")
    j = j.withColumn("final_rank", F.row_number().over(w))
    j = j.withColumn("rerank_rank", F.when(F.col("head"), F.col("final_rank"))).withColumn("rerank_score", F.when(F.col("head"), F.col("rerank_score")))
    return j.withColumn("rank_move", F.col("fused_rank") - F.col("rerank_rank")).drop("head")


def overlap_scores(pairs: DataFrame, query_terms: DataFrame, posts: DataFrame) -> DataFrame:
    """The deterministic stand-in scorer: how many different query terms a row holds, per query term."""
    q = query_terms.select("qid", "term").distinct()
    n = q.groupBy("qid").agg(F.count("*").alias("n"))
    hit = pairs.select("qid", "row").join(q, "qid").join(posts.select("row", "term"), ["row", "term"]).groupBy("qid", "row").agg(F.count("*").alias("c"))
    return pairs.select("qid", "row").join(hit, ["qid", "row"], "left").join(n, "qid", "left").select("qid", "row", (F.coalesce("c", F.lit(0)) / F.coalesce("n", F.lit(1))).alias("rerank_score"))


def overlap_in_texts(pairs: DataFrame, query_terms: DataFrame, texts: DataFrame) -> DataFrame:
    """As overlap_scores(), from query_terms(qid, terms) and texts(row, terms): each pair meets its text once, and no posting is moved."""
    q = query_terms.select("qid", F.array_distinct("terms").alias("_asked"))
    j = pairs.select("qid", "row").join(q, "qid", "left").join(texts.select("row", F.col("terms").alias("_held")), "row", "left")
    met = F.coalesce(F.size(F.array_intersect("_asked", "_held")), F.lit(0))
    return j.select("qid", "row", (F.greatest(met, F.lit(0)) / F.greatest(F.coalesce(F.size("_asked"), F.lit(1)), F.lit(1))).alias("rerank_score"))
