"""Evaluation queries: data set composition, answer metrics, agreement, sampling, splits, failures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import intervals
from ..session import table
from . import sqlparts as P
from .registry import query
from .retrieval import chunks, gold


def results(spark, d):
    w = Window.partitionBy("run_id", "id").orderBy("recorded_at")
    return table(spark, d, "item_results").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def details(spark, d):
    w = Window.partitionBy("run_id", "id").orderBy("provider")
    return table(spark, d, "item_details").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


_OK = "CASE WHEN NOT answerable THEN abstained WHEN category = 'false_premise' THEN judge_correct ELSE coalesce(numeric_em, judge_correct) END"


@query(f"SELECT coalesce(s, 'all') AS split, coalesce(c, 'all') AS category, coalesce(o, 'all') AS source, count(*) AS n FROM (SELECT coalesce(lower(trim(split)), 'none') AS s, coalesce(category, 'none') AS c, coalesce(source, 'none') AS o FROM {P.GOLD}) GROUP BY GROUPING SETS ((s), (c, s), (o, s))")
def dataset_composition(spark, d):
    g = gold(spark, d).select(F.coalesce(F.lower(F.trim("split")), F.lit("none")).alias("s"), F.coalesce("category", F.lit("none")).alias("c"), F.coalesce("source", F.lit("none")).alias("o"))
    r = g.groupingSets([["s"], ["c", "s"], ["o", "s"]], "s", "c", "o").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("s", F.lit("all")).alias("split"), F.coalesce("c", F.lit("all")).alias("category"), F.coalesce("o", F.lit("all")).alias("source"), "n")


_CATS = ", ".join(f"({i + 1}, '{c}')" for i, c in enumerate(A.CATEGORIES))


@query(f"SELECT s AS split, category, count(g.id) AS n FROM (SELECT * FROM (VALUES {_CATS}) v(ord, category)) CROSS JOIN (SELECT unnest(['train', 'dev', 'test']) AS s) LEFT JOIN {P.GOLD} g ON g.category = v.category AND lower(trim(g.split)) = s GROUP BY ALL".replace("v(ord, category)) CROSS", "v(ord, category)) v CROSS").replace("SELECT s AS split, category,", "SELECT s AS split, v.category AS category,"))
def composition_zero_filled(spark, d):
    """Counts per split and category, with zeros for categories that do not occur."""
    cats = spark.createDataFrame([(s, c) for s in ("train", "dev", "test") for c in A.CATEGORIES], "split string, category string")
    g = gold(spark, d).select(F.lower(F.trim("split")).alias("split"), "category").groupBy("split", "category").agg(F.count("*").alias("c"))
    return cats.join(g, ["split", "category"], "left").select("split", "category", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


@query(f"SELECT run_id, id, {_OK} AS ok FROM {P.RESULTS}")
def item_outcomes(spark, d):
    return results(spark, d).select("run_id", "id", A.correct().alias("ok"))


def _sql_summary(by: str) -> str:
    four = lambda x: f"floor(({x}) * 10000 + 0.5) / 10000"
    share = lambda x: four(f"avg(CAST({x} AS DOUBLE))")
    s = lambda c: f"coalesce(sum({c}) FILTER (WHERE NOT coalesce(abstained, false)), 0)"
    ratio = lambda a, b: four(f"CAST({a} AS DOUBLE) / CASE WHEN {b} > 0 THEN {b} END")
    good = "count(*) FILTER (WHERE abstained AND NOT answerable)"
    pd = lambda q, c: f"CAST(quantile_disc({c}, {q}) AS INTEGER)"
    inner = (
        f"SELECT {by}, count(*) AS items, {share(_OK)} AS accuracy, count({_OK}) AS accuracy_n, {share('numeric_em')} AS numeric_em, "
        f"{share(chr(67) + 'ASE WHEN category <> ' + chr(39) + 'false_premise' + chr(39) + ' THEN judge_correct END')} AS judge_correct, "
        f"{share(chr(67) + 'ASE WHEN category = ' + chr(39) + 'false_premise' + chr(39) + ' THEN judge_correct END')} AS false_premise_correction, "
        f"{ratio(good, 'count(*) FILTER (WHERE abstained)')} AS abstention_precision, {ratio(good, 'count(*) FILTER (WHERE NOT answerable)')} AS abstention_recall, CAST({s('sentences')} AS BIGINT) AS sentences, "
        f"{ratio(s('cited'), s('sentences'))} AS citation_coverage, {ratio(s('precise_citations'), s('citations'))} AS citation_precision, {ratio(s('verified'), s('sentences'))} AS verified_rate, "
        f"{ratio(s('unsupported'), s('support_judged'))} AS unsupported_rate, {pd(0.5, 'retrieval_ms')} AS retrieval_p50, {pd(0.95, 'retrieval_ms')} AS retrieval_p95, {pd(0.5, 'generation_ms')} AS generation_p50, "
        f"{pd(0.95, 'generation_ms')} AS generation_p95, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM {P.RESULTS} GROUP BY {by}"
    )
    return f"SELECT *, floor(2 * abstention_precision * abstention_recall / CASE WHEN abstention_precision + abstention_recall > 0 THEN abstention_precision + abstention_recall END * 10000 + 0.5) / 10000 AS abstention_f1 FROM ({inner})"


@query(_sql_summary("run_id"))
def answer_summary(spark, d):
    return A.summary(results(spark, d), "run_id")


@query(_sql_summary("run_id, category"))
def answer_summary_by_category(spark, d):
    return A.summary(results(spark, d), "run_id", "category")


@query(f"SELECT provider, count(*) AS n, count(*) FILTER (WHERE generation_ms IS NULL) AS no_latency FROM {P.RESULTS} GROUP BY provider")
def provider_counts(spark, d):
    return results(spark, d).groupBy("provider").agg(F.count("*").alias("n"), F.count_if(F.col("generation_ms").isNull()).alias("no_latency"))


@query(
    "SELECT run_id, n, floor(po * 10000 + 0.5) / 10000 AS agreement, CASE WHEN pa * pb + (1 - pa) * (1 - pb) < 1 THEN floor((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) * 10000 + 0.5) / 10000 END AS kappa FROM "
    f"(SELECT run_id, count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS po, avg(CAST(a AS DOUBLE)) AS pa, avg(CAST(b AS DOUBLE)) AS pb FROM (SELECT run_id, r.numeric_em AS a, x.judge.correct AS b FROM {P.RESULTS} r JOIN {P.DETAILS} x USING (run_id, id)) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY run_id)"
)
def judge_agreement(spark, d):
    """How far the judge and the numeric match agree, per run."""
    pairs = results(spark, d).select("run_id", "id", F.col("numeric_em").alias("a")).join(details(spark, d).select("run_id", "id", F.col("judge.correct").alias("b")), ["run_id", "id"])
    return A.agreement(pairs, "a", "b", "run_id")


@query(f"SELECT id, category, CAST(row_number() OVER (ORDER BY r, ord) AS INTEGER) AS turn FROM (SELECT id, g.category, ord, row_number() OVER (PARTITION BY g.category ORDER BY sha256(id)) AS r FROM {P.GOLD} g JOIN (VALUES {_CATS}) v(ord, category) USING (category)) ORDER BY r, ord LIMIT 120")
def selected_items(spark, d):
    """A prefix-stable stratified selection of 120 items."""
    return A.take_turns(gold(spark, d).select("id", "category"), "id", "category", 120)


@query(
    "SELECT id, category, CASE WHEN p IS NOT NULL THEN p WHEN greatest(d0, least(d0 + k, floor(0.6 * (d0 + t0 + k) + 0.5))) > greatest(d0, least(d0 + k - 1, floor(0.6 * (d0 + t0 + k - 1) + 0.5))) THEN 'dev' ELSE 'test' END AS split FROM "
    "(SELECT *, sum(CASE WHEN p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY category ORDER BY p IS NULL, sha256(id) ROWS UNBOUNDED PRECEDING) AS k, count(*) FILTER (WHERE p = 'dev') OVER (PARTITION BY category) AS d0, count(*) FILTER (WHERE p = 'test') OVER (PARTITION BY category) AS t0 "
    f"FROM (SELECT id, category, CASE WHEN lower(trim(split)) IN ('dev', 'test') THEN lower(trim(split)) END AS p FROM {P.GOLD}))"
)
def sticky_splits(spark, d):
    return A.assign_splits(gold(spark, d).select("id", "category", "split"), "id", "category", "split")


_SAID = "len(coalesce(x.sentences, []))"
_UNV = "len(list_filter(coalesce(x.sentences, []), lambda s: s.status IS NULL OR s.status <> 'verified'))"


@query(
    f"SELECT run_id, id, kind, CASE WHEN kind = 'unverified' THEN unverified || ' of ' || said || ' sentences unverified.' WHEN NOT answerable THEN 'Answered a question the filings can''t answer.' WHEN coalesce(abstained, false) THEN 'Declined a question the filings answer.' "
    "WHEN numeric_em = false AND category <> 'false_premise' THEN 'The number doesn''t match the gold value within tolerance.' ELSE 'Judge: ' || coalesce(reason, 'incorrect') END AS why, CAST(unverified AS INTEGER) AS unverified FROM "
    f"(SELECT r.*, x.judge.reason AS reason, {_SAID} AS said, {_UNV} AS unverified, CASE WHEN ({_OK.replace('answerable', 'r.answerable').replace('category', 'r.category')}) = false THEN 'incorrect' WHEN {_UNV} > 0 THEN 'unverified' END AS kind FROM {P.RESULTS} r JOIN {P.DETAILS} x USING (run_id, id)) WHERE kind IS NOT NULL"
)
def failure_examples(spark, d):
    return A.failures(results(spark, d), details(spark, d)).drop("note")


@query(f"SELECT run_id, s.status AS status, count(*) AS n, count(*) FILTER (WHERE len(s.missing) > 0) AS with_missing FROM (SELECT run_id, unnest(sentences) AS s FROM {P.DETAILS}) GROUP BY ALL")
def sentence_status_counts(spark, d):
    s = details(spark, d).select("run_id", F.explode("sentences").alias("s"))
    return s.groupBy("run_id", F.col("s.status").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.size("s.missing") > 0).alias("with_missing"))


@query(
    f"SELECT strategy, count(*) AS chunks, count(n_tokens) AS counted, CAST(list_sort(list(n_tokens) FILTER (WHERE n_tokens IS NOT NULL))[CAST(round_even(0.5 * (count(n_tokens) - 1), 0) AS BIGINT) + 1] AS INTEGER) AS tokens_p50, "
    f"CAST(list_sort(list(n_tokens) FILTER (WHERE n_tokens IS NOT NULL))[CAST(round_even(0.95 * (count(n_tokens) - 1), 0) AS BIGINT) + 1] AS INTEGER) AS tokens_p95, max(n_tokens) AS tokens_max, "
    f"count(*) FILTER (WHERE text LIKE '%|%') AS with_tables FROM {P.CHUNKS} GROUP BY strategy"
)
def chunk_statistics(spark, d):
    """Sizes per chunking strategy, with the percentile that rounds its index half to even, exact by rank windows."""
    c = chunks(spark, d)
    w = Window.partitionBy("strategy").orderBy("n_tokens")
    r = c.where("n_tokens IS NOT NULL").withColumn("r", F.row_number().over(w)).withColumn("m", F.count("*").over(Window.partitionBy("strategy")))
    at = lambda q: F.max(F.when(F.col("r") == F.bround(F.lit(q) * (F.col("m") - 1), 0) + 1, F.col("n_tokens")))
    p = r.groupBy("strategy").agg(at(0.5).alias("tokens_p50"), at(0.95).alias("tokens_p95"))
    s = c.groupBy("strategy").agg(F.count("*").alias("chunks"), F.count("n_tokens").alias("counted"), F.max("n_tokens").alias("tokens_max"), F.count_if(F.col("text").contains("|")).alias("with_tables"))
    return s.join(p, "strategy", "left").select("strategy", "chunks", "counted", "tokens_p50", "tokens_p95", "tokens_max", "with_tables")


_A = f"(SELECT * FROM {P.CHUNKS} WHERE strategy = 'fixed' AND doc_id IS NOT NULL AND char_end > char_start)"
_B = f"(SELECT * FROM {P.CHUNKS} WHERE strategy = 'structure' AND doc_id IS NOT NULL AND char_end > char_start)"


@query(f"SELECT a.chunk_id, count(*) AS others, CAST(sum(least(a.char_end, b.char_end) - greatest(a.char_start, b.char_start)) AS BIGINT) AS shared FROM {_A} a JOIN {_B} b ON a.doc_id = b.doc_id AND least(a.char_end, b.char_end) > greatest(a.char_start, b.char_start) GROUP BY a.chunk_id")
def cross_strategy_overlap(spark, d):
    """For each fixed chunk, the structure chunks of the same document that share characters with it."""
    c = chunks(spark, d)
    a = c.where("strategy = 'fixed'").select("doc_id", "chunk_id", "char_start", "char_end")
    b = c.where("strategy = 'structure'").select("doc_id", F.col("char_start").alias("s2"), F.col("char_end").alias("e2"))
    j = intervals.overlap_pairs(a, b, "doc_id", ("char_start", "char_end"), ("s2", "e2"))
    return j.groupBy("chunk_id").agg(F.count("*").alias("others"), F.sum(F.least("char_end", "e2") - F.greatest("char_start", "s2")).alias("shared"))


def _plan(size: int, step: int) -> str:
    return f"(SELECT doc_id, w * {step} AS a, least(w * {step} + {size}, n) AS b, w FROM (SELECT doc_id, max(char_end) AS n, unnest(range(0, CAST(ceil(max(char_end) / {step}.0) AS BIGINT))) AS w FROM {P.CHUNKS} WHERE doc_id IS NOT NULL AND char_end > 0 GROUP BY doc_id))"


@query(f"SELECT a.doc_id, a.w, count(*) AS others, CAST(sum(least(a.b, b.b) - greatest(a.a, b.a)) AS BIGINT) AS shared FROM {_plan(9000, 8000)} a JOIN {_plan(3000, 5000)} b ON a.doc_id = b.doc_id AND least(a.b, b.b) > greatest(a.a, b.a) GROUP BY ALL")
def window_plan_overlap(spark, d):
    """Two window plans over every filing's length: for each window of the one, the windows of the other that share characters with it."""
    n = chunks(spark, d).where("doc_id IS NOT NULL AND char_end > 0").groupBy("doc_id").agg(F.max("char_end").alias("n"))
    return intervals.plan_overlaps(n, "doc_id", "n", (9000, 8000), (3000, 5000))


_SP = f"(SELECT id, s.doc_id AS doc_id, s.char_start AS at, i FROM (SELECT id, unnest(gold_spans) AS s, generate_subscripts(gold_spans, 1) - 1 AS i FROM {P.GOLD}) WHERE s.doc_id IS NOT NULL AND s.char_start IS NOT NULL)"


@query(f"SELECT p.id, CAST(p.i AS INTEGER) AS i, p.at, m.chunk_id FROM {_SP} p ASOF LEFT JOIN (SELECT doc_id, char_start, max(chunk_id) AS chunk_id FROM {P.CHUNKS} WHERE doc_id IS NOT NULL AND char_start IS NOT NULL GROUP BY ALL) m ON p.doc_id = m.doc_id AND p.at >= m.char_start")
def span_floor_chunk(spark, d):
    """The last chunk of the document that begins at or before each gold span."""
    p = gold(spark, d).select("id", F.posexplode("gold_spans").alias("i", "s")).select("s.doc_id", "id", "i", F.col("s.char_start").alias("at")).where("doc_id IS NOT NULL AND at IS NOT NULL")
    m = chunks(spark, d).where("doc_id IS NOT NULL AND char_start IS NOT NULL").select("doc_id", "char_start", "chunk_id")
    return intervals.floor_lookup(p, m, "doc_id", "at", "char_start", "chunk_id").select("id", "i", "at", "chunk_id")


_MARK = r"[\[【](\d{1,2}(?:\s*,\s*\d{1,2})*)(?:†[^\]】]*)?[\]】]"


@query(
    f"WITH s AS (SELECT run_id, id, i, s.text AS text FROM (SELECT run_id, id, unnest(sentences) AS s, generate_subscripts(sentences, 1) - 1 AS i FROM {P.DETAILS}) WHERE s.text IS NOT NULL), "
    f"m AS (SELECT *, list_transform(flatten(list_transform(regexp_extract_all(text, '{_MARK}', 1), lambda x: string_split(x, ','))), lambda x: CAST(trim(x) AS INTEGER)) AS ns, "
    f"trim(regexp_replace(regexp_replace(regexp_replace(text, '{_MARK}', '', 'g'), '\\s+([.,;:!?])', '\\1', 'g'), '\\s{{2,}}', ' ', 'g')) AS plain FROM s) "
    "SELECT run_id, id, CAST(i AS INTEGER) AS i, plain, array_to_string(list_sort(list_distinct(list_filter(ns, lambda n: n BETWEEN 1 AND 2))), ',') AS cites, array_to_string(list_sort(list_distinct(list_filter(ns, lambda n: NOT n BETWEEN 1 AND 2))), ',') AS invalid FROM m"
)
def sentence_citations(spark, d):
    """Citation markers of every recorded sentence against two sources: the valid and invalid ones, and the text without markers."""
    s = details(spark, d).select("run_id", "id", F.posexplode("sentences").alias("i", "s")).select("run_id", "id", "i", F.col("s.text").alias("text")).where("text IS NOT NULL")
    found = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(_MARK), F.lit(1)), lambda x: F.split(x, ",")))
    ns = F.array_sort(F.array_distinct(F.transform(found, lambda x: F.trim(x).cast("int"))))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", _MARK, ""), r"\s+([.,;:!?])", "$1"), r"\s{2,}", " ")
    s = s.withColumn("ns", ns)
    part = lambda f: F.array_join(F.filter("ns", f).cast("array<string>"), ",")
    return s.select("run_id", "id", "i", F.trim(plain).alias("plain"), part(lambda n: n.between(1, 2)).alias("cites"), part(lambda n: ~n.between(1, 2)).alias("invalid"))
