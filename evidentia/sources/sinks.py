"""Sinks: JSON lines, CSV for reviewers, partitioned tables, size reports, Markdown, upserts with a time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import shard_of
from .readers import exists


def write_json_lines(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines, range-sorted by the given columns."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)


def write_review_csv(df: DataFrame, path: str, most: int = 1_000_000) -> None:
    """One CSV for reviewers' spreadsheets: byte order mark in the head, everything as text, quotes doubled, lines ended by CR LF, those
    inside a cell too.

    More than `most` rows are no spreadsheet any more and raise an error.
    """
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows for a review file")
    first, *rest = df.columns
    named = df.select(*(F.col(c).cast("string").alias(c) for c in df.columns)).withColumnRenamed(first, "﻿" + first)
    named.coalesce(1).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", lineSep="\r\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_text_store(chunks: DataFrame, path: str) -> None:
    """Chunk texts by hash shard; a point lookup reads one shard."""
    chunks.withColumn("shard", shard_of(F.col("chunk_id"))).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def lookup(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Rows of the store for ids(chunk_id), missing ids with found = false; only the shards asked for are read."""
    want = ids.select("chunk_id").where("chunk_id IS NOT NULL").distinct().withColumn("shard", shard_of(F.col("chunk_id")))
    have = spark.read.schema("doc_id string, chunk_id string, text string, shard string").parquet(path)
    return want.join(have.withColumn("found", F.lit(True)), ["shard", "chunk_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def size_report(spark: SparkSession, path: str, budget: int) -> DataFrame:
    """(group, files, bytes, over) of the files below a path, by their first folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    root = path.rstrip("/").split("/")[-1]
    group = F.regexp_extract("path", rf"{root}/([^/]+)", 1)
    return f.groupBy(group.alias("group")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), (F.sum("length") > budget).alias("over"))


def upsert_ttl(spark: SparkSession, path: str, fresh: DataFrame, key: str, at: str, ttl_seconds: int, now: str) -> DataFrame:
    """The live rows of a keyed store after a batch of writes: the newest row of a key, dropped once it is older than its time to live."""
    rows = fresh if not exists(spark, path) else spark.read.schema(fresh.schema).parquet(path).unionByName(fresh)
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), at).alias("r")).select("r.*")
    return newest.where(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col(at).cast("timestamp")) < ttl_seconds)


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """History with the rows of `new` whose key it does not have yet."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def markdown(df: DataFrame, digits: int = 4, most: int = 1000) -> str:
    """A small report table as Markdown; raises beyond `most` rows, which is not a report any more."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "–" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = [df.columns, ["---"] * len(df.columns), *([cell(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(r) + " |" for r in lines)
