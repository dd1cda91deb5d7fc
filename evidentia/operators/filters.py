"""Document filters that a question names: companies, fiscal years, the latest filing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_pattern

#: Ways to name the latest year and a fiscal year (fixed values).
LATEST = r"(?i)\b(last|latest|most recent|this|current) (fiscal )?year\b|\b(latest|most recent)\b"
YEAR = r"(?i)\b(?:FY\s?'?|fiscal\s+(?:year\s+)?)(\d{4}|\d{2})\b|\b(20\d{2})\b"


def filing_dimension(manifest: DataFrame) -> DataFrame:
    """(doc_id, ticker, fy, name): each filing once, with the spellings of its company and the company without its legal form."""
    d = manifest.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("ticker").alias("ticker"), F.min("fy").alias("fy"), F.min(F.trim("company")).alias("company"))
    short = F.regexp_replace("company", r"(?i)[\s,]+(inc|corp|co|ltd|plc)\.?$", "")
    return d.select("doc_id", "ticker", "fy", "company", short.alias("alias"))


def named_tickers(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, ticker): companies named in a query. The join is on the first word of the name; whole-word patterns verify.

    The ticker must be written as it is, names in any case.
    """
    word = lambda c: F.lower(F.regexp_extract(c, r"[A-Za-z0-9]+", 0))
    names = docs.select("ticker", F.explode(F.array("company", "alias")).alias("name")).where("trim(name) <> ''").distinct()
    names = names.select("ticker", name_pattern(F.col("name")).alias("p"), word(F.col("name")).alias("w"))
    ticks = docs.select("ticker").distinct().select("ticker", name_pattern(F.col("ticker"), False).alias("p"), word(F.col("ticker")).alias("w"))
    asked = queries.select("qid", "text", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower))).alias("w"))
    return asked.join(names.unionAll(ticks), "w").where(F.expr("text rlike p")).select("qid", "ticker").distinct()


def detect_filters(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, tickers, fiscal_years, latest, missing_years, scope, n_docs): what each query restricts itself to.

    scope says which filings of the named companies (of all, where none is named) are meant: 'years' those
    of fiscal_years, 'latest' the newest of each company, 'all' every one; null where the query names
    neither company nor year nor the latest. n_docs counts them. Years that no filing in scope has are
    listed as missing and then do not restrict. Arrays are sorted. Null texts name nothing. The filings
    themselves: see allowed_documents(), or in_scope() as a mask.
    """
    y = lambda g: F.filter(F.regexp_extract_all("text", F.lit(YEAR), F.lit(g)), lambda s: s != "")
    years = F.array_sort(F.array_distinct(F.transform(F.concat(y(1), y(2)), lambda s: F.when(F.length(s) == 2, 2000 + s.cast("int")).otherwise(s.cast("int")))))
    q = queries.select("qid", F.coalesce("text", F.lit("")).alias("text")).select("qid", "text", years.alias("years"), F.col("text").rlike(LATEST).alias("last"))
    tick = named_tickers(q.select("qid", "text"), docs).groupBy("qid").agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))
    q = q.join(tick, "qid", "left").withColumn("tickers", F.coalesce("tickers", F.array().cast("array<string>"))).select("qid", "years", "last", "tickers")
    # how many filings a company has in a year, and which is its newest: each an equi-join on a small dimension
    held = docs.groupBy("ticker", "fy").agg(F.countDistinct("doc_id").alias("n"))
    firm = held.groupBy("ticker").agg(F.sum("n").alias("n_all"), F.max_by("n", "fy").alias("n_new"))
    whole = firm.agg(F.coalesce(F.sum("n_all"), F.lit(0)).alias("every_all"), F.coalesce(F.sum("n_new"), F.lit(0)).alias("every_new"))
    asked = q.select("qid", F.explode("years").alias("fy"), "tickers")
    named = asked.where("size(tickers) > 0").select("qid", "fy", F.explode("tickers").alias("ticker")).join(held, ["ticker", "fy"]).select("qid", "fy", "n")
    any_ = asked.where("size(tickers) = 0").select("qid", "fy").join(held.groupBy("fy").agg(F.sum("n").alias("n")), "fy").select("qid", "fy", "n")
    met = named.unionAll(any_).groupBy("qid").agg(F.array_sort(F.collect_set("fy")).alias("fys"), F.sum("n").alias("n_years"))
    firms = q.select("qid", F.explode("tickers").alias("ticker")).join(firm, "ticker").groupBy("qid").agg(F.sum("n_all").alias("n_all"), F.sum("n_new").alias("n_new"))
    j = q.join(met, "qid", "left").join(firms, "qid", "left").crossJoin(F.broadcast(whole))  # a single row
    fys = F.coalesce("fys", F.array().cast("array<int>"))
    filtered = (F.size("tickers") > 0) | (F.size(fys) > 0) | F.col("last")
    scope = F.when(~filtered, None).when((F.size("years") > 0) & (F.size(fys) > 0), "years").when(F.col("last") & (F.size("years") == 0), "latest").otherwise("all")
    of = lambda own, all_: F.when(F.size("tickers") > 0, F.coalesce(own, F.lit(0))).otherwise(F.col(all_))
    j = j.withColumn("scope", scope)
    n = F.when(F.col("scope") == "years", F.col("n_years")).when(F.col("scope") == "latest", of("n_new", "every_new")).when(F.col("scope") == "all", of("n_all", "every_all"))
    return j.select("qid", "tickers", fys.alias("fiscal_years"), (F.col("last") & (F.size("years") == 0)).alias("latest"), F.array_except("years", fys).alias("missing_years"), "scope", n.cast("long").alias("n_docs"))


def dated_dimension(docs: DataFrame) -> DataFrame:
    """(doc_id, ticker, fy, newest): each filing, and whether it is of its company's newest year."""
    top = docs.groupBy("ticker").agg(F.max("fy").alias("_top"))
    return docs.join(top, "ticker").select("doc_id", "ticker", "fy", (F.col("fy") == F.col("_top")).alias("newest"))


def in_scope() -> Column:
    """Whether a filing (ticker, fy, newest) is one that a detected filter (tickers, fiscal_years, scope) allows; everything is where there is none."""
    company = (F.size("tickers") == 0) | F.array_contains("tickers", F.col("ticker"))
    time = F.when(F.col("scope") == "years", F.array_contains("fiscal_years", F.col("fy"))).when(F.col("scope") == "latest", F.col("newest")).otherwise(True)
    return F.col("scope").isNull() | F.coalesce(company & time, F.lit(False))


def scope_mask(queries: pa.Table, block: pa.Table):
    """in_scope() for lexical.search(): queries(tickers, fiscal_years, scope), block(ticker, fy, newest). A row without a filing is in no scope."""
    filing = block.select(["ticker", "fy", "newest"]).to_pandas()
    of = filing.groupby(["ticker", "fy", "newest"], dropna=False, sort=False).ngroup().to_numpy()
    each = filing.iloc[np.unique(of, return_index=True)[1]]
    ticker, fy, newest = each["ticker"].to_numpy(object), each["fy"].to_numpy(float), (each["newest"] == True).to_numpy(bool)  # noqa: E712
    known = each["ticker"].notna().to_numpy()
    wanted = list(zip(*(queries.column(c).to_pylist() for c in ("scope", "tickers", "fiscal_years")), strict=True))

    def may(q: int) -> np.ndarray | None:
        scope, tickers, years = wanted[q]
        if scope is None:
            return None
        ok = known & np.isin(ticker, tickers) if tickers else known
        return (ok & np.isin(fy, years) if scope == "years" else ok & newest if scope == "latest" else ok)[of]

    return may


def allowed_documents(detected: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, doc_id): the filings of each query that names a company or a year; the scope of one that names neither is a condition, not a list."""
    dim = dated_dimension(docs)
    firm = detected.where("size(tickers) > 0").select("*", F.explode("tickers").alias("_t")).join(dim, F.col("_t") == F.col("ticker"))
    year = detected.where("size(tickers) = 0 AND scope = 'years'").select("*", F.explode("fiscal_years").alias("_y")).join(dim, F.col("_y") == F.col("fy"))
    cols = ["qid", "tickers", "fiscal_years", "scope", "doc_id", "ticker", "fy", "newest"]
    return firm.select(cols).unionAll(year.select(cols)).where(in_scope()).select("qid", "doc_id").distinct()


def filter_notes(detected: DataFrame) -> DataFrame:
    """Adds notes: what the corpus does not cover."""
    note = F.concat(F.lit("No filing in the corpus for FY"), F.array_join("missing_years", ", FY"))
    return detected.withColumn("notes", F.when(F.size("missing_years") > 0, F.array(note)).otherwise(F.array().cast("array<string>")))
