"""Joins of intervals and positions within a key: overlap, containment, floor lookup, and overlap of regular windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_pairs(left: DataFrame, right: DataFrame, key: str, l_span: tuple[str, str], r_span: tuple[str, str], width: int = 4096, residual: Column | None = None) -> DataFrame:
    """Pairs of rows with equal key whose half-open intervals share at least one position.

    Both sides are cut into bins of `width`, so that a key with very many rows spreads over many join
    keys; a pair is kept only in the first bin that both touch, which needs no de-duplication. Rows with
    a null key or bound, and empty intervals, are in no pair. Column names must differ but for the key.
    """
    ls, le, rs, re_ = *l_span, *r_span
    bins = lambda df, s, e, name: df.where(F.col(key).isNotNull() & (F.col(e) > F.col(s))).withColumn(name, F.floor(F.col(s) / width)).withColumn("_bin", F.explode(F.sequence(F.col(name), F.floor((F.col(e) - 1) / width))))
    j = bins(left, ls, le, "_lb").join(bins(right, rs, re_, "_rb"), [key, "_bin"]).where((F.col("_bin") == F.greatest("_lb", "_rb")) & (F.least(le, re_) > F.greatest(ls, rs)))
    if residual is not None:
        j = j.where(residual)
    return j.drop("_bin", "_lb", "_rb")


def plan_overlaps(lengths: DataFrame, key: str, n: str, one: tuple[int, int], other: tuple[int, int], block: int = 8192) -> DataFrame:
    """(key, w, others, shared): for each window of `one` plan, the windows of the `other` that share positions with it, and how many positions.

    A plan (size, step) has windows [w * step, w * step + size), cut at the length n of the key, from 0 to the
    last that begins before n; windows that meet none are left out. Which windows of the other plan meet
    a window follows from its bounds, so no window is joined, sorted or sent: a join would be planned by the
    few rows that the lengths are, and the windows made in one task and broadcast, however many there are.
    Each key is cut into blocks of windows, and the blocks are dealt to all tasks.
    """
    (size, step), (size2, step2) = one, other
    last = F.ceil(F.col(n) / step) - 1
    tasks = int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, so that the blocks are not put together again for being small
    blocks = lengths.where(F.col(n) > 0).select(key, F.col(n).cast("long").alias("_n"), last.alias("_last"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / block))).alias("_block")).repartition(tasks, key, "_block")
    w = blocks.select(key, "_n", F.explode(F.sequence(F.col("_block") * block, F.least(F.col("_block") * block + (block - 1), "_last"))).alias("w"))
    w = w.withColumn("_a", F.col("w") * step).withColumn("_b", F.least(F.col("_a") + size, "_n"))
    met = w.withColumn("_from", F.greatest(F.floor((F.col("_a") - size2) / step2) + 1, F.lit(0).cast("long"))).withColumn("_to", F.floor((F.col("_b") - 1) / step2)).where("_from <= _to")
    each = lambda v: F.least(F.col("_b"), v * step2 + size2) - F.greatest(F.col("_a"), v * step2)
    shared = F.aggregate(F.sequence("_from", "_to"), F.lit(0).cast("long"), lambda s, v: s + each(v))
    return met.select(key, "w", (F.col("_to") - F.col("_from") + 1).alias("others"), shared.alias("shared"))


def floor_lookup(points: DataFrame, marks: DataFrame, key: str, at: str, start: str, value: str, width: int = 4096) -> DataFrame:
    """Adds `value` of the last mark at or before each point of the same key, null where there is none.

    Keys are cut into bins of `width` positions, each with a running window of its own; what a bin begins
    with is the last mark of the bins before it, from one row for each bin. Equal starts give the greatest value.
    """
    cols = points.columns
    kind = dict(marks.dtypes)[value]
    p = points.withColumn("_bin", F.floor(F.col(at) / width)).withColumn("_pos", F.col(at)).withColumn("_kind", F.lit(1)).withColumn("_v", F.lit(None).cast(kind))
    m = marks.groupBy(key, start).agg(F.max(value).alias("_v")).withColumn("_bin", F.floor(F.col(start) / width))
    bins = m.groupBy(key, "_bin").agg(F.max_by("_v", start).alias("_last")).unionByName(p.select(key, "_bin", F.lit(None).cast(kind).alias("_last")).distinct())
    bins = bins.groupBy(key, "_bin").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_from", F.last("_last", ignorenulls=True).over(before)).select(key, "_bin", "_from")
    blank = [F.lit(None).cast(t).alias(c) for c, t in points.dtypes if c != key]
    u = p.unionByName(m.select(key, *blank, "_bin", F.col(start).alias("_pos"), F.lit(0).alias("_kind"), "_v"))
    w = Window.partitionBy(key, "_bin").orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_found", F.last("_v", ignorenulls=True).over(w)).where("_kind = 1")
    return u.join(bins, [key, "_bin"], "left").select(*cols, F.coalesce("_found", "_from").alias(value))


def share_inside(chunks: DataFrame, blocks: DataFrame, key: str, id_col: str, c_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """(id, inside, mostly): characters of each chunk inside the given blocks, and whether they are more than half."""
    cs, ce = c_span
    pairs = overlap_pairs(chunks.select(key, id_col, cs, ce), blocks.select(key, *b_span), key, c_span, b_span)
    got = pairs.groupBy(id_col).agg(F.sum(F.least(ce, b_span[1]) - F.greatest(cs, b_span[0])).alias("inside"))
    return chunks.select(id_col, cs, ce).join(got, id_col, "left").select(id_col, F.coalesce("inside", F.lit(0)).alias("inside"), (F.coalesce("inside", F.lit(0)) * 2 > F.col(ce) - F.col(cs)).alias("mostly"))


def first_containing(spans: DataFrame, passages: DataFrame, key: str, span_id: str, s_span: tuple[str, str], p_span: tuple[str, str], index: str) -> DataFrame:
    """(span_id, index): the first passage that contains each span whole; -1 where none does."""
    inside = (F.col(s_span[0]) >= F.col(p_span[0])) & (F.col(s_span[1]) <= F.col(p_span[1]))
    hit = overlap_pairs(spans, passages, key, s_span, p_span, residual=inside).groupBy(span_id).agg(F.min(index).alias(index))
    return spans.select(span_id).distinct().join(hit, span_id, "left").select(span_id, F.coalesce(index, F.lit(-1)).alias(index))
