"""Reported facts of fiscal periods: current and prior values, trends, ratios, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import format_usd

PCT_TOLERANCE, EPS_TOLERANCE, USD_TOLERANCE = 0.5, 0.005, 0.005


def period_values(facts: DataFrame, concepts: DataFrame, filings: DataFrame) -> DataFrame:
    """(doc_id, concept, current, prior): a filing's own fiscal-year value and its prior-year comparative.

    facts(entity, tag, unit, accn, form, fp, start, end, val), concepts(concept, tags, unit, duration),
    filings(doc_id, entity, accession, report_date). Only full-year rows of the filing itself count; the
    current period ends on the report date, the prior 350 to 380 days before. The first tag with exactly
    one current value decides; several current values are a conflict and give no row. A prior value that
    is not unique is null.
    """
    days = lambda a, b: F.datediff(b, a)
    c = concepts.select("concept", "unit", "duration", F.posexplode("tags").alias("pref", "tag"))
    f = facts.where("form = '10-K' AND fp = 'FY'").join(c, ["tag", "unit"])
    f = f.where(~F.col("duration") | (F.col("start").isNotNull() & days(F.col("start"), F.col("end")).between(350, 380)))
    j = f.join(filings.select("doc_id", "entity", "accession", "report_date"), (f["entity"] == filings["entity"]) & (f["accn"] == filings["accession"]))
    now = F.when(F.col("end") == F.col("report_date"), F.col("val"))
    old = F.when((F.col("end") != F.col("report_date")) & days(F.col("end"), F.col("report_date")).between(350, 380), F.col("val"))
    g = j.groupBy("doc_id", "concept", "pref").agg(F.collect_set(now).alias("c"), F.collect_set(old).alias("p")).where("size(c) > 0")
    first = g.groupBy("doc_id", "concept").agg(F.min_by(F.struct("c", "p"), "pref").alias("x")).where("size(x.c) = 1")
    return first.select("doc_id", "concept", F.element_at("x.c", 1).alias("current"), F.when(F.size("x.p") == 1, F.element_at("x.p", 1)).alias("prior"))


def with_prior(values: DataFrame) -> DataFrame:
    """Adds prior: the value of the same entity and concept one fiscal year before, null where there is none."""
    p = values.select("entity", "concept", (F.col("fy") + 1).alias("fy"), F.col("current").alias("prior"))
    return values.join(p, ["entity", "concept", "fy"], "left")


def trend_items(values: DataFrame) -> DataFrame:
    """Year-over-year change of positive values in percent, to one decimal, half to even."""
    v = values.where("prior > 0 AND current > 0")
    pct = F.bround((F.col("current") - F.col("prior")) / F.col("prior") * 100, 1)
    return v.select(_id("yoy", F.col("entity"), F.col("fy"), F.col("concept")).alias("id"), "entity", "fy", "concept", pct.alias("pct"), F.when(pct > 0, "rose").otherwise("fell").alias("verb"))


def ratio_items(values: DataFrame, numerator: str, denominator: str) -> DataFrame:
    n = values.where(F.col("concept") == numerator).select("entity", "fy", F.col("current").alias("n"))
    m = values.where(F.col("concept") == denominator).select("entity", "fy", F.col("current").alias("d"))
    pct = F.bround(F.col("n") / F.col("d") * 100, 1)
    return n.join(m, ["entity", "fy"]).where("d > 0").select(_id("ratio", F.col("entity"), F.col("fy"), F.lit(f"{numerator}-{denominator}")).alias("id"), "entity", "fy", pct.alias("pct"))


def comparison_items(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """Which of two entities reports more of a concept in a year, and by how much; the tolerance follows the larger one."""
    a = values.select(F.col("entity").alias("a"), "fy", "concept", F.col("current").alias("va"))
    b = values.select(F.col("entity").alias("b"), "fy", "concept", F.col("current").alias("vb"))
    j = pairs.select("a", "b").join(a, "a").join(b, ["b", "fy", "concept"]).where("va <> vb")
    more = F.when(F.col("va") > F.col("vb"), F.col("a")).otherwise(F.col("b"))
    diff = F.abs(F.col("va") - F.col("vb"))
    return j.select(
        F.lower(F.concat_ws("-", F.lit("compare"), "a", "b", F.concat(F.lit("fy"), F.col("fy").cast("string")), "concept")).alias("id"), "fy", "concept", more.alias("higher"), diff.alias("diff"),
        format_usd(diff).alias("diff_text"), F.bround(F.greatest(F.abs("va"), F.abs("vb")) * USD_TOLERANCE, 0).alias("tolerance"),
    )


def value_items(values: DataFrame) -> DataFrame:
    return values.select(
        _id("value", F.col("entity"), F.col("fy"), F.col("concept")).alias("id"), "entity", "fy", "concept", format_usd(F.col("current")).alias("answer"),
        F.bround(F.abs("current") * USD_TOLERANCE, 0).alias("tolerance"),
    )


def _id(kind: str, entity: Column, fy: Column, concept: Column) -> Column:
    return F.lower(F.concat_ws("-", F.lit(kind), entity, F.concat(F.lit("fy"), fy.cast("string")), concept))


def round_robin(items: DataFrame, id_col: str, bucket: str, n: int) -> DataFrame:
    """n items, buckets in turn by name, each in the order of the hash of its ids."""
    w = Window.partitionBy(bucket).orderBy(F.sha2(F.col(id_col), 256))
    d = items.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return d.orderBy("_r", bucket).limit(n).drop("_r")  # the sample's own size


def latest_filings(filings: DataFrame, n: int, form: str = "10-K") -> DataFrame:
    """The n latest filings of each company with exactly this form; amendments do not count."""
    w = Window.partitionBy("cik").orderBy(F.desc_nulls_last("filing_date"), "accession")
    return filings.where(F.col("form") == form).withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)
