"""Queries on filings, facts and chunk plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, facts, synthesis
from ..session import table
from . import sqlparts as P
from .registry import query
from .retrieval import chunks


def _date(c: str) -> str:
    t = f"trim({c})"
    return f"CASE WHEN regexp_full_match({t}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN CAST(try_strptime({t}, '%Y-%m-%d') AS DATE) WHEN regexp_full_match({t}, '\\d{{8}}') THEN CAST(try_strptime({t}, '%Y%m%d') AS DATE) WHEN regexp_full_match({t}, '\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN CAST(try_strptime({t}, '%m/%d/%Y') AS DATE) END"


_FILINGS = (
    f"(SELECT doc_id, min(ticker) AS ticker, min(trim(company)) AS company, min(cik) AS cik, min(fy) AS fy, min(form) AS form, min(accession) AS accession, min({_date('filing_date')}) AS filing_date, min({_date('report_date')}) AS report_date "
    "FROM manifest WHERE doc_id IS NOT NULL GROUP BY doc_id)"
)


def filings(spark, d):
    m = table(spark, d, "manifest").where("doc_id IS NOT NULL")
    low = lambda c: F.min(c).alias(c)
    return m.groupBy("doc_id").agg(
        low("ticker"), F.min(F.trim("company")).alias("company"), low("cik"), low("fy"), low("form"), low("accession"),
        F.min(T.plain_date(F.col("filing_date"))).alias("filing_date"), F.min(T.plain_date(F.col("report_date"))).alias("report_date"),
    )


def _iso(df, *cols):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in cols})


@query(f"SELECT * REPLACE (strftime(filing_date, '%Y-%m-%d') AS filing_date, strftime(report_date, '%Y-%m-%d') AS report_date) FROM {_FILINGS}")
def filing_manifest(spark, d):
    """Each filing once, its dates read from any of their spellings."""
    return _iso(filings(spark, d), "filing_date", "report_date")


@query(f"SELECT cik, doc_id, strftime(filing_date, '%Y-%m-%d') AS filing_date, CAST(recency AS INTEGER) AS recency FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC NULLS LAST, accession) AS recency FROM {_FILINGS} WHERE form = '10-K') WHERE recency <= 3")
def latest_three_filings(spark, d):
    return _iso(facts.latest_filings(filings(spark, d), 3).select("cik", "doc_id", "filing_date", "recency"), "filing_date")


@query(f"SELECT doc_id, fy, CAST(y AS INTEGER) AS by_rule, fy = y AS agrees FROM (SELECT doc_id, fy, year(report_date) - CASE WHEN month(report_date) = 1 AND day(report_date) <= 7 THEN 1 ELSE 0 END AS y FROM {_FILINGS})")
def fiscal_year_rule(spark, d):
    f = filings(spark, d).select("doc_id", "fy", T.fiscal_year(F.lit(None).cast("int"), F.col("report_date")).alias("by_rule"))
    return f.withColumn("agrees", F.col("fy") == F.col("by_rule"))


_SUMS = (("revenue", "l_extendedprice * (1 - l_discount)"), ("discounts", "l_extendedprice * l_discount"), ("list_sales", "l_extendedprice"))
_V = (
    "g AS MATERIALIZED (SELECT n_name AS entity, CAST(year(o_orderdate) AS INTEGER) AS fy, " + ", ".join(f"round(sum({x}) / 1000, 0) * 1000 AS {c}" for c, x in _SUMS)
    + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, CAST(year(o_orderdate) AS INTEGER)), "
    + "v AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT entity, fy, '{c}' AS concept, {c} AS current FROM g" for c, _ in _SUMS) + ")"
)


def values(spark, d):
    """(entity, fy, concept, current): yearly sums per nation in whole thousands, the stand-in for tagged facts."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    order = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("fy"))
    who = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    j = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(who, F.col("o_custkey") == F.col("c_custkey"))
    k = lambda x: F.round(F.sum(x) / 1000, 0) * 1000
    p, q = F.col("l_extendedprice"), F.col("l_discount")
    g = j.groupBy(F.col("n_name").alias("entity"), "fy").agg(k(p * (1 - q)).alias("revenue"), k(p * q).alias("discounts"), k(p).alias("list_sales"))
    return g.unpivot(["entity", "fy"], ["revenue", "discounts", "list_sales"], "concept", "current")


_PCT = "round_even((current - prior) / prior * 100, 1)"


@query(f"WITH {_V}, t AS (SELECT v.*, p.current AS prior FROM v JOIN v p ON p.entity = v.entity AND p.concept = v.concept AND p.fy = v.fy - 1) SELECT lower('yoy-' || entity || '-fy' || fy || '-' || concept) AS id, entity, fy, concept, {_PCT} AS pct, CASE WHEN {_PCT} > 0 THEN 'rose' ELSE 'fell' END AS verb FROM t WHERE prior > 0 AND current > 0")
def yearly_trends(spark, d):
    return facts.trend_items(facts.with_prior(values(spark, d)))


@query(f"WITH {_V} SELECT lower('ratio-' || n.entity || '-fy' || n.fy || '-discounts-list_sales') AS id, n.entity, n.fy, round_even(n.current / m.current * 100, 1) AS pct FROM v n JOIN v m ON n.entity = m.entity AND n.fy = m.fy WHERE n.concept = 'discounts' AND m.concept = 'list_sales' AND m.current > 0")
def yearly_ratios(spark, d):
    return facts.ratio_items(values(spark, d), "discounts", "list_sales")


_USD = lambda x: f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || '$' || format('{{:,}}', CAST(round_even(abs({x}) / 1e6, 0) AS BIGINT)) || ' million' || CASE WHEN abs({x}) >= 1e9 THEN ' ($' || printf('%.1f', abs({x}) / 1e9) || ' billion)' ELSE '' END"


@query(f"WITH {_V} SELECT lower('value-' || entity || '-fy' || fy || '-' || concept) AS id, entity, fy, concept, {_USD('current')} AS answer, round_even(abs(current) * 0.005, 0) AS tolerance FROM v")
def yearly_values(spark, d):
    return facts.value_items(values(spark, d))


@query(
    f"WITH {_V}, pr AS (SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey) "
    f"SELECT lower('compare-' || a || '-' || b || '-fy' || x.fy || '-' || x.concept) AS id, x.fy, x.concept, CASE WHEN x.current > y.current THEN a ELSE b END AS higher, abs(x.current - y.current) AS diff, {_USD('abs(x.current - y.current)')} AS diff_text, "
    "round_even(greatest(abs(x.current), abs(y.current)) * 0.005, 0) AS tolerance FROM pr JOIN v x ON x.entity = a JOIN v y ON y.entity = b AND x.fy = y.fy AND x.concept = y.concept WHERE x.current <> y.current"
)
def yearly_comparisons(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    m = n.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("b"), "n_regionkey")
    pairs = n.join(m, "n_regionkey").where("n_nationkey < k2").select(F.col("n_name").alias("a"), "b")
    return facts.comparison_items(values(spark, d), pairs)


@query(f"WITH {_V}, i AS (SELECT lower('value-' || entity || '-fy' || fy || '-' || concept) AS id, entity FROM v) SELECT id, entity FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY sha256(id)) AS r FROM i) ORDER BY r, entity LIMIT 60")
def sampled_values(spark, d):
    """60 items, entities in turn."""
    return facts.round_robin(facts.value_items(values(spark, d)).select("id", "entity"), "id", "entity", 60)


#: Facts that every filing reports: (tag, which filings, days from start to the report date, days from end to it, value).
_REPORTED = (
    ("Revenues", "true", 363, 0, "cik % 100000 * 10 + fy"), ("Revenues", "true", 728, 365, "cik % 100000 * 10 + fy - 1"), ("Revenues", "cik % 7 = 0", 363, 0, "cik % 100000 * 10 + fy + 1"),
    ("Sales", "cik % 3 = 0", 364, 0, "cik % 1000 * 7 + fy"), ("Sales", "cik % 5 = 0", 727, 364, "cik % 1000 * 7 + fy - 1"), ("Sales", "cik % 2 = 0", 90, 0, "cik % 1000"), ("Cash", "fy % 4 <> 0", None, 0, "cik % 900 + fy"),
)
_FACT_ROWS = " UNION ALL ".join(
    f"SELECT cik, '{tag}' AS tag, accession AS accn, {'CAST(NULL AS DATE)' if start is None else f'report_date - {start}'} AS start, report_date - {end} AS ending, CAST({val} AS DOUBLE) AS val FROM {_FILINGS} WHERE report_date IS NOT NULL AND {where}" for tag, where, start, end, val in _REPORTED
)


@query(
    f"WITH f AS (SELECT doc_id, cik, accession, report_date FROM {_FILINGS}), c AS (SELECT * FROM (VALUES ('revenue', 0, 'Sales', true), ('revenue', 1, 'Revenues', true), ('cash', 0, 'Cash', false)) t(concept, pref, tag, duration)), "
    f"r AS (SELECT * FROM ({_FACT_ROWS})), m AS (SELECT f.doc_id, c.concept, c.pref, list_distinct(list(CASE WHEN r.ending = f.report_date THEN r.val END)) AS cur, "
    "list_distinct(list(CASE WHEN r.ending <> f.report_date AND f.report_date - r.ending BETWEEN 350 AND 380 THEN r.val END)) AS old FROM r JOIN c USING (tag) JOIN f ON f.cik = r.cik AND f.accession = r.accn "
    "WHERE NOT c.duration OR (r.start IS NOT NULL AND r.ending - r.start BETWEEN 350 AND 380) GROUP BY f.doc_id, c.concept, c.pref), "
    "x AS (SELECT *, list_filter(cur, lambda v: v IS NOT NULL) AS c2, list_filter(old, lambda v: v IS NOT NULL) AS o2 FROM m), y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, concept ORDER BY pref) AS rn FROM x WHERE len(c2) > 0) "
    "SELECT doc_id, concept, c2[1] AS current, CASE WHEN len(o2) = 1 THEN o2[1] END AS prior FROM y WHERE rn = 1 AND len(c2) = 1"
)
def filing_period_values(spark, d):
    """A filing's own fiscal-year value of each concept and its prior-year comparative, out of facts with conflicts, other periods and instants."""
    f = filings(spark, d).where("report_date IS NOT NULL")
    rows = None
    for tag, where, start, end, val in _REPORTED:
        one = f.where(where).select(
            F.col("cik").alias("entity"), F.lit(tag).alias("tag"), F.lit("USD").alias("unit"), F.col("accession").alias("accn"), F.lit("10-K").alias("form"), F.lit("FY").alias("fp"),
            (F.lit(None).cast("date") if start is None else F.date_sub("report_date", start)).alias("start"), F.date_sub("report_date", end).alias("end"), F.expr(val).cast("double").alias("val"),
        )
        rows = one if rows is None else rows.unionAll(one)
    concepts = spark.createDataFrame([("revenue", ["Sales", "Revenues"], "USD", True), ("cash", ["Cash"], "USD", False)], "concept string, tags array<string>, unit string, duration boolean")
    return facts.period_values(rows, concepts, filings(spark, d).select("doc_id", F.col("cik").alias("entity"), "accession", "report_date"))


_NTOK = "len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]'))"


@query(f"WITH n AS (SELECT chunk_id AS id, {_NTOK} AS n FROM {P.CHUNKS} WHERE text IS NOT NULL) SELECT id, CAST(w AS INTEGER) AS \"window\", CAST(w * 300 AS INTEGER) AS first_token, CAST(least(w * 300 + 350, n) AS INTEGER) AS last_token FROM (SELECT id, n, unnest(range(0, CASE WHEN n <= 350 THEN 1 ELSE CAST(ceil((n - 350) / 300.0) AS BIGINT) + 1 END)) AS w FROM n WHERE n > 0)")
def fixed_window_plan(spark, d):
    return chunking.window_plan(chunks(spark, d), "chunk_id", "text")


@query(f"SELECT chunk_id, {_NTOK} AS counted, CAST(n_tokens AS BIGINT) AS stored, coalesce(abs({_NTOK} - n_tokens) > 20, true) AS stale FROM {P.CHUNKS} WHERE text IS NOT NULL")
def stale_token_counts(spark, d):
    """Chunks whose stored token count is missing or far from a fresh count."""
    c = chunks(spark, d).where("text IS NOT NULL").select("chunk_id", T.count_tokens(F.col("text")).cast("long").alias("counted"), F.col("n_tokens").cast("long").alias("stored"))
    return c.withColumn("stale", F.coalesce(F.abs(F.col("counted") - F.col("stored")) > 20, F.lit(True)))


@query(f"SELECT chunk_id, length(text) AS chars, n_tokens, coalesce(len(list_filter(l, lambda x: x LIKE '|%' OR x LIKE '% | %')) <= 0.3 * len(l), true) AS prose FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM {P.CHUNKS} WHERE text IS NOT NULL) WHERE n_tokens >= 120")
def prose_candidates(spark, d):
    """Chunks of at least 120 tokens, with whether at most three tenths of their lines are table rows."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = F.size(F.filter(lines, lambda x: x.startswith("|") | x.contains(" | ")))
    return chunks(spark, d).where("text IS NOT NULL AND n_tokens >= 120").select("chunk_id", F.length("text").cast("long").alias("chars"), "n_tokens", (rows <= 0.3 * F.size(lines)).alias("prose"))


@query(
    f"SELECT c.chunk_id, f.company || ' (' || f.ticker || ') | FY' || f.fy || ' ' || f.form || ' | Item ' || c.item || CASE WHEN array_to_string(c.heading_path, ' > ') <> '' THEN ' | ' || array_to_string(c.heading_path, ' > ') ELSE '' END AS label "
    f"FROM {P.CHUNKS} c JOIN {_FILINGS} f USING (doc_id) WHERE c.item IS NOT NULL AND c.heading_path IS NOT NULL"
)
def source_labels(spark, d):
    """Head lines of chunks as prompt sources."""
    j = chunks(spark, d).where("item IS NOT NULL AND heading_path IS NOT NULL").join(filings(spark, d), "doc_id")
    return j.select("chunk_id", T.source_label(F.col("company"), F.col("ticker"), F.col("fy"), F.col("form"), F.col("item"), F.col("heading_path")).alias("label"))


def _cache_keys(spark, d):
    from .retrieval import gold

    g = gold(spark, d).where("question IS NOT NULL AND companies IS NOT NULL")
    key = T.answer_key(F.col("question"), F.lit("default"), F.col("companies"), F.lit("v1")).alias("key")
    return g.select("id", key, (~F.col("question").rlike(r"[^\x00-\x7f]")).alias("ascii"))


@query(f"SELECT id, sha256('v1|default|' || trim(regexp_replace(trim(regexp_replace(lower(question), '\\s+', ' ', 'g')), '[?!.\\s]+$', '')) || '|' || array_to_string(list_sort(companies), ',')) AS key FROM {P.GOLD} WHERE question IS NOT NULL AND companies IS NOT NULL AND NOT regexp_matches(question, '[^\\x00-\\x7f]')")
def answer_cache_keys(spark, d):
    """Cache keys of the questions in ASCII only, as its SQL has it; `answer_cache_keys_all` has those of every question."""
    return _cache_keys(spark, d).where("ascii").select("id", "key")


@query(f"SELECT id, sha256('v1|default|' || regexp_replace(trim(regexp_replace(lower(question), '[{T.JS_BLANKS}]+', ' ', 'g')), '[?!. ]+$', '') || '|' || array_to_string(list_sort(companies), ',')) AS key FROM {P.GOLD} WHERE question IS NOT NULL AND companies IS NOT NULL")
def answer_cache_keys_all(spark, d):
    """Cache keys of every question, in any script; the company list stands for the chunk list."""
    return _cache_keys(spark, d).select("id", "key")


@query(f"SELECT chunk_id FROM {P.CHUNKS} c WHERE doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM manifest m WHERE m.doc_id = c.doc_id) UNION ALL SELECT chunk_id FROM {P.CHUNKS} WHERE doc_id IS NULL")
def orphan_chunks(spark, d):
    """Chunks whose document is unknown."""
    c = chunks(spark, d).select("chunk_id", "doc_id")
    m = table(spark, d, "manifest").select("doc_id").distinct()
    return c.join(m, "doc_id", "left_anti").select("chunk_id")


@query("SELECT id, count(*) AS copies, count(DISTINCT question) AS questions FROM gold_items GROUP BY id HAVING count(*) > 1")
def duplicate_items(spark, d):
    """Ids delivered more than once."""
    return table(spark, d, "gold_items").groupBy("id").agg(F.count("*").alias("copies"), F.countDistinct("question").alias("questions")).where("copies > 1")


@query(f"SELECT doc_id, count(*) AS n, sha256(count(*) || ':' || CAST(sum(CAST('0x' || left(sha256(chunk_id || ':' || sha256(text)), 15) AS BIGINT)) AS VARCHAR)) AS fingerprint FROM {P.CHUNKS} WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id")
def document_fingerprints(spark, d):
    """A fingerprint of each document's chunks that does not depend on their order and never gathers them: the hash of the sum of their hashes."""
    h = F.conv(F.left(F.sha2(F.concat("chunk_id", F.lit(":"), F.sha2("text", 256)), 256), F.lit(15)), 16, 10).cast("decimal(38,0)")
    c = chunks(spark, d).where("text IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(h).alias("s"))
    return c.select("doc_id", "n", F.sha2(F.concat(F.col("n").cast("string"), F.lit(":"), F.col("s").cast("string")), 256).alias("fingerprint"))


@query(f"SELECT chunk_id, doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sha256('s1|' || chunk_id)) AS INTEGER) AS turn, sha256('s1|' || doc_id) AS lane_order FROM {P.CHUNKS} WHERE doc_id IS NOT NULL AND n_tokens >= 120")
def interleaved_chunks(spark, d):
    """Candidate chunks in seeded order, documents in turn."""
    c = chunks(spark, d).where("doc_id IS NOT NULL AND n_tokens >= 120").select("chunk_id", "doc_id")
    return synthesis.interleave(c, "chunk_id", "doc_id", "s1").select("chunk_id", "doc_id", "turn", "lane_order")
