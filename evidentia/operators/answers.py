"""Answer metrics, judge agreement, sampling and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered

#: The categories in the order in which they take turns (fixed value).
CATEGORIES = ("lookup", "table_number", "trend", "comparison", "multi_hop", "false_premise", "unanswerable")


def correct() -> Column:
    """An item's outcome: abstaining where it cannot be answered, the judge for false premises, else the number, else the judge."""
    return F.when(~F.col("answerable"), F.col("abstained")).when(F.col("category") == "false_premise", F.col("judge_correct")).otherwise(F.coalesce("numeric_em", "judge_correct"))


def needs_judge(category: Column, answerable: Column, has_number: Column) -> Column:
    return (category == "false_premise") | (answerable & ~has_number)


def _four(x: Column) -> Column:
    return F.floor(x * 10000 + 0.5) / 10000


def share(flag: Column) -> Column:
    """Share of true among the known values, to four places; null where none is known."""
    return _four(F.avg(flag.cast("double")))


def ratio(a: Column, b: Column) -> Column:
    return _four(a / F.when(b > 0, b))


def summary(results: DataFrame, *by: str) -> DataFrame:
    """One row per group with all answer metrics. Abstained answers are left out of sentence metrics; unknown abstention counts as answered."""
    said = ~F.coalesce("abstained", F.lit(False))
    s = lambda c: F.coalesce(F.sum(F.when(said, F.col(c))), F.lit(0))
    ok = correct()
    false = F.col("category") == "false_premise"
    out = results.groupBy(*by).agg(
        F.count("*").alias("items"), share(ok).alias("accuracy"), F.count(ok).alias("accuracy_n"), share(F.col("numeric_em")).alias("numeric_em"),
        share(F.when(~false, F.col("judge_correct"))).alias("judge_correct"), share(F.when(false, F.col("judge_correct"))).alias("false_premise_correction"),
        ratio(F.count_if(F.col("abstained") & ~F.col("answerable")), F.count_if("abstained")).alias("abstention_precision"),
        ratio(F.count_if(F.col("abstained") & ~F.col("answerable")), F.count_if(~F.col("answerable"))).alias("abstention_recall"),
        s("sentences").alias("sentences"), ratio(s("cited"), s("sentences")).alias("citation_coverage"), ratio(s("precise_citations"), s("citations")).alias("citation_precision"),
        ratio(s("verified"), s("sentences")).alias("verified_rate"), ratio(s("unsupported"), s("support_judged")).alias("unsupported_rate"),
        F.expr("cast(percentile_disc(0.5) WITHIN GROUP (ORDER BY retrieval_ms) as int)").alias("retrieval_p50"), F.expr("cast(percentile_disc(0.95) WITHIN GROUP (ORDER BY retrieval_ms) as int)").alias("retrieval_p95"),
        F.expr("cast(percentile_disc(0.5) WITHIN GROUP (ORDER BY generation_ms) as int)").alias("generation_p50"), F.expr("cast(percentile_disc(0.95) WITHIN GROUP (ORDER BY generation_ms) as int)").alias("generation_p95"),
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
    )
    p, r = F.col("abstention_precision"), F.col("abstention_recall")
    return out.withColumn("abstention_f1", _four(2 * p * r / F.when(p + r > 0, p + r)))


def agreement(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Agreement and Cohen's kappa of two yes/no columns; kappa is null where chance agreement is certain. Rows with a null are left out."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    g = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return g.select(*by, "n", _four(F.col("po")).alias("agreement"), F.when(pe < 1, _four((F.col("po") - pe) / (1 - pe))).alias("kappa"))


def category_order(category: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, CATEGORIES)), category), F.lit(0)).cast("int")


def take_turns(items: DataFrame, id_col: str, category: str, limit: int) -> DataFrame:
    """Adds turn 1..limit: categories take turns, each in the order of the hash of its ids; a smaller limit gives a prefix. Unknown categories are left out."""
    order = category_order(F.col(category))
    w = Window.partitionBy(category).orderBy(F.sha2(F.col(id_col), 256))
    d = items.withColumn("_o", order).where("_o > 0").withColumn("_round", F.row_number().over(w))
    top = d.where(F.col("_round") <= limit).orderBy("_round", "_o").limit(limit)  # the report's own limit
    return top.withColumn("turn", F.row_number().over(Window.orderBy("_round", "_o"))).drop("_o", "_round")


def assign_splits(items: DataFrame, id_col: str, category: str, previous: str, dev_share: float = 0.6) -> DataFrame:
    """(id, category, split): known splits stay; new items, in hash order per category, fill dev up to its share.

    Closed form of the one-by-one rule: with d0 and t0 items already in dev and test, after k new items
    dev holds greatest(d0, least(d0 + k, round(share * (d0 + t0 + k)))), and an item is in dev where that grows.
    """
    d = items.withColumn("_p", F.lower(F.trim(F.col(previous)))).withColumn("_p", F.when(F.col("_p").isin("dev", "test"), F.col("_p")))
    # one numbering of the whole table by category, known items first, instead of a window for each category
    new = F.when(F.col("_p").isNull(), 1).otherwise(0)
    d = numbered(d, "_no", F.col(category), new, F.sha2(F.col(id_col), 256))
    held = d.groupBy(category).agg(F.count_if(F.col("_p") == "dev").alias("_d"), F.count_if(F.col("_p") == "test").alias("_t"), F.min("_no").alias("_base"))
    d = d.join(held.withColumnRenamed(category, "_c"), F.col(category).eqNullSafe(F.col("_c")))
    d = d.withColumn("_k", F.when(F.col("_p").isNull(), F.col("_no") - F.col("_base") - F.col("_d") - F.col("_t") + 1).otherwise(0))
    dev = lambda k: F.greatest("_d", F.least(F.col("_d") + k, F.floor(dev_share * (F.col("_d") + F.col("_t") + k) + 0.5)))
    new = F.when(dev(F.col("_k")) > dev(F.col("_k") - 1), "dev").otherwise("test")
    return d.select(id_col, category, F.coalesce("_p", new).alias("split"))


def why_wrong(reason: Column) -> Column:
    return (
        F.when(~F.col("answerable"), "Answered a question the filings can't answer.")
        .when(F.coalesce("abstained", F.lit(False)), "Declined a question the filings answer.")
        .when((F.col("numeric_em") == False) & (F.col("category") != "false_premise"), "The number doesn't match the gold value within tolerance.")  # noqa: E712
        .otherwise(F.concat(F.lit("Judge: "), F.coalesce(reason, F.lit("incorrect"))))
    )


def failures(results: DataFrame, details: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """(run_id, id, kind, why, unverified, note): wrong answers, and right or ungraded ones with an unverified sentence."""
    d = details.select("run_id", "id", F.col("judge.reason").alias("reason"), F.size(F.coalesce("sentences", F.array())).alias("said"), F.size(F.filter(F.coalesce("sentences", F.array()), lambda s: s["status"].isNull() | (s["status"] != "verified"))).alias("unverified"))
    j = results.join(d, ["run_id", "id"]).withColumn("ok", correct())
    kind = F.when(F.col("ok") == False, "incorrect").when(F.col("unverified") > 0, "unverified")  # noqa: E712
    why = F.when(F.col("ok") == False, why_wrong(F.col("reason"))).otherwise(F.concat(F.col("unverified").cast("string"), F.lit(" of "), F.col("said").cast("string"), F.lit(" sentences unverified.")))  # noqa: E712
    out = j.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("why", why)
    if notes is None:
        return out.select("run_id", "id", "kind", "why", "unverified", F.lit(None).cast("string").alias("note"))
    return out.join(notes.select("id", "note"), "id", "left").select("run_id", "id", "kind", "why", "unverified", "note")


def nearest_rank(values: Column, q: float) -> Column:
    """Percentile at index ceil(q n) - 1 of the sorted values; null for none."""
    v = F.array_sort(values)
    return F.try_element_at(v, F.greatest(F.lit(1), F.ceil(F.lit(q) * F.size(v)).cast("int")))


def index_percentile(values: Column, q: float) -> Column:
    """Percentile at index round-half-even(q (n - 1)) of the sorted values."""
    v = F.array_sort(values)
    return F.try_element_at(v, (F.bround(F.lit(q) * (F.size(v) - 1), 0) + 1).cast("int"))
