"""Row numbers over a whole table without gathering it: range partitions, their counts, and a number inside each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

_INSIDE = (1 << 33) - 1


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Adds 0, 1, 2, ... in the order given; rows that tie in it are numbered in any order.

    Only one count for each partition is collected.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_placed", F.monotonically_increasing_id())
    placed = cut_lineage(placed.withColumn("_stretch", F.shiftright("_placed", 33)).withColumn("_inside", F.col("_placed").bitwiseAND(F.lit(_INSIDE))).drop("_placed"))
    sizes = {r["_stretch"]: r["n"] for r in placed.groupBy("_stretch").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    offsets = df.sparkSession.createDataFrame(before, "_stretch long, _offset long")
    return placed.join(F.broadcast(offsets), "_stretch").withColumn(name, F.col("_offset") + F.col("_inside")).drop("_stretch", "_inside", "_offset")
