"""What evaluation reports are made of: configurations, best values, baselines, history, sections, log lines, citation precision."""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.readers import exists


def configurations(spark: SparkSession, path: str, schema: str, default: str = "default") -> DataFrame:
    """The configurations below a path (JSON files, one each), the default first, then by name; an error where there is none."""
    found = spark.read.schema(schema).option("multiLine", True).json(path) if exists(spark, path) else spark.createDataFrame([], schema)
    if found.isEmpty():
        raise ValueError(f"no configuration below {path}")
    return found.orderBy(F.col("name") != default, "name")


def with_configuration(rows: DataFrame, configs: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with `column` of the configuration that they name; naming an unknown one is an error when the rows are read."""
    j = rows.join(configs.select(F.col("name").alias(key), F.col(column).alias("_c")), key, "left")
    return j.withColumn(column, F.coalesce("_c", F.raise_error(F.concat(F.lit("unknown configuration: "), F.coalesce(F.col(key), F.lit("none")))))).drop("_c")


def best_values(report: DataFrame, metrics: list[str], lower: tuple[str, ...] = ()) -> DataFrame:
    """Adds best_<metric> to each row: whether its value, to four places, is the best of the column; null values never are."""
    for m in metrics:
        v = F.round(m, 4)
        top = (F.min if m in lower else F.max)(v).over(Window.partitionBy(F.lit(0)))  # one row a configuration
        report = report.withColumn(f"best_{m}", F.coalesce(v == top, F.lit(False)))
    return report


def write_baseline(means: DataFrame, metrics: list[str], path: str) -> None:
    """One row of means as the baseline that later runs are held against: JSON with sorted keys."""
    row = means.select(*metrics).first()
    if row is None:
        raise ValueError("there are no means to keep")
    means.sparkSession.createDataFrame([(json.dumps({m: row[m] for m in metrics}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_baseline(spark: SparkSession, path: str) -> dict[str, float]:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def trend(reports: DataFrame, day: str, name: str, metrics: list[str]) -> DataFrame:
    """(name, day, metrics, change_<metric>): the reports of each configuration in order of their day, the last of a day, with the change to the one before."""
    last = reports.groupBy(name, day).agg(*(F.max_by(m, F.struct(*metrics)).alias(m) for m in metrics))
    w = Window.partitionBy(name).orderBy(day)
    return last.select(name, day, *metrics, *((F.col(m) - F.lag(m).over(w)).alias(f"change_{m}") for m in metrics))


def merged_sections(old: DataFrame, new: DataFrame, name: str = "section") -> DataFrame:
    """The sections of a report after new ones came: a new section takes the place of the old one of its name."""
    return old.join(new.select(name), name, "left_anti").unionByName(new)


def log_line(route: Column, provider: Column, status: Column, latency_ms: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """One structured log line of a request; it holds no question, answer or passage."""
    return F.to_json(F.struct(route.alias("route"), provider.alias("provider"), status.alias("status"), F.round(latency_ms, 1).alias("latency_ms"), tokens_in.alias("tokens_in"), tokens_out.alias("tokens_out")), {"ignoreNullFields": "true"})


def eligible_providers(providers: DataFrame, at: Column) -> DataFrame:
    """The providers that may be asked at a time, in their order: configured, not forced to fail, and not cold."""
    cold = F.coalesce(F.col("cold_until") > at, F.lit(False))
    return providers.where(F.col("configured") & ~F.coalesce("forced", F.lit(False)) & ~cold).orderBy("place")


def client_key(forwarded: Column, direct: Column) -> Column:
    """The client's address: the first forwarded one, else the direct one, else 'unknown'."""
    first = F.trim(F.split_part(F.coalesce(forwarded, F.lit("")), F.lit(","), F.lit(1)))
    return F.coalesce(F.nullif(first, F.lit("")), direct, F.lit("unknown"))


def commit_stamp(folder: str) -> str:
    """The short commit of a folder, 'unknown' outside of version control."""
    try:
        return subprocess.run(["git", "-C", folder, "rev-parse", "--short", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return "unknown"


def citation_precision(citations: DataFrame, relevant: DataFrame, supported: DataFrame, *by: str) -> DataFrame:
    """(by, citations, precise, precision): of the different (sentence, chunk) citations of each group, those whose chunk holds gold evidence or whose sentence a judge found supported.

    citations(by, qid, no, chunk_id), relevant(qid, chunk_id), supported(qid, no, chunk_id). To four places; null without citations.
    """
    c = citations.distinct()
    c = c.join(relevant.select("qid", "chunk_id").distinct().withColumn("_g", F.lit(1)), ["qid", "chunk_id"], "left").join(supported.distinct().withColumn("_s", F.lit(1)), ["qid", "no", "chunk_id"], "left")
    ok = F.col("_g").isNotNull() | F.col("_s").isNotNull()
    g = c.groupBy(*by).agg(F.count("*").alias("citations"), F.count_if(ok).alias("precise"))
    return g.withColumn("precision", F.floor(F.col("precise") / F.col("citations") * 10000 + 0.5) / 10000)
