"""Retrieval queries: index statistics, lexical and dense search, filters, fusion, reranking, ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dense, filters, fusion, judging, lexical, numbering, prompts, reports
from ..session import cut_lineage, stored, table
from . import sqlparts as P
from .registry import query


def chunks(spark, d):
    return table(spark, d, "chunks").where("chunk_id IS NOT NULL").dropDuplicates(["chunk_id"])


def gold(spark, d):
    return table(spark, d, "gold_items").where("id IS NOT NULL").dropDuplicates(["id"])


def asked(spark, d):
    """The stated query set: every gold item whose number is divisible by 20."""
    number = F.regexp_extract("id", "[0-9]+", 0).cast("long")
    return gold(spark, d).where(F.col("question").isNotNull() & (number % 20 == 0)).select(F.col("id").alias("qid"), F.col("question").alias("text"))


def posts(spark, d):
    return lexical.postings(chunks(spark, d), "chunk_id", "text")


def index(spark, d):
    """(chunks, index): the index is written once as tables and read by every search."""
    c = chunks(spark, d)
    path = stored(spark, "index", [table(spark, d, "chunks")], lambda to: lexical.write_index(c, "chunk_id", "text", to))
    return c, lexical.read_index(spark, path)


@query(f"WITH {P.tokens('dt', P.CHUNKS, 'chunk_id', 'text')} SELECT chunk_id, term, count(*) AS tf, CAST(any_value(dl) AS INTEGER) AS dl FROM (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS term FROM dt) GROUP BY chunk_id, term")
def index_postings(spark, d):
    return posts(spark, d).select(F.col("row").alias("chunk_id"), "term", "tf", "dl")


@query(f"WITH {P.tokens('dt', P.CHUNKS, 'chunk_id', 'text')} SELECT count(*) AS n, floor(sum(len(toks)) / greatest(count(*), 1) * 1000 + 0.5) / 1000 AS avgdl FROM dt")
def index_statistics(spark, d):
    return lexical.corpus_stats(chunks(spark, d), "text")


@query(f"WITH {P.tokens('dt', P.CHUNKS, 'chunk_id', 'text')} SELECT term, count(DISTINCT chunk_id) AS df FROM (SELECT chunk_id, unnest(toks) AS term FROM dt) GROUP BY term")
def index_document_frequency(spark, d):
    return lexical.document_frequency(posts(spark, d))


_DELTA = (
    f"WITH {P.tokens('dt', P.CHUNKS, 'chunk_id', 'text')}, r AS (SELECT chunk_id, toks, row_number() OVER (ORDER BY chunk_id) - 1 AS row FROM dt), "
    "p AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(toks) AS term FROM r) GROUP BY ALL) "
    "SELECT term, count(*) AS df, CAST(max(row) AS BIGINT) AS last_row, CAST(sum(tf) AS BIGINT) AS total FROM p GROUP BY term"
)


@query(_DELTA)
def index_delta_round_trip(spark, d):
    """Postings delta-encoded in blocks and decoded again: the last row of each term must come back."""
    order = numbering.numbered(chunks(spark, d).select("chunk_id"), "no", "chunk_id")  # one number a chunk: the index's row order
    p = posts(spark, d).join(order, F.col("row") == F.col("chunk_id")).select("term", F.col("no").alias("row"), "tf")
    back = lexical.decode_postings(lexical.delta_postings(p, 1000), 1000)
    return back.groupBy("term").agg(F.count("*").alias("df"), F.max("decoded").cast("long").alias("last_row"), F.sum("tf").alias("total"))


@query(f"WITH {P.bm25()} SELECT qid, row AS chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM {P.top('scores', 50)}")
def bm25_top50(spark, d):
    _, ix = index(spark, d)
    return lexical.top_hits(lexical.search(ix, asked(spark, d), 50), 50).select("qid", F.col("row").alias("chunk_id"), "rank", F.round("score", 6).alias("score"))


_DIM = (
    "dim AS (SELECT doc_id, min(ticker) AS ticker, min(fy) AS fy, min(trim(company)) AS company FROM manifest WHERE doc_id IS NOT NULL GROUP BY doc_id), "
    "names AS (SELECT DISTINCT ticker, unnest([company, regexp_replace(company, '(?i)[\\s,]+(inc|corp|co|ltd|plc)\\.?$', '')]) AS name FROM dim)"
)
_FILTERS = (
    f"q AS (SELECT id AS qid, coalesce(question, '') AS text FROM {P.GOLD}), {_DIM}, "
    "yr AS (SELECT qid, text, list_sort(list_distinct(list_transform(list_filter(list_concat(regexp_extract_all(text, R, 1), regexp_extract_all(text, R, 2)), lambda s: s <> ''), "
    "lambda s: CASE WHEN length(s) = 2 THEN 2000 + CAST(s AS INTEGER) ELSE CAST(s AS INTEGER) END))) AS years, regexp_matches(text, L) AS last FROM q), "
    "tk AS (SELECT qid, list_sort(list(DISTINCT ticker)) AS tickers FROM (SELECT qid, ticker FROM q, names WHERE trim(name) <> '' AND contains(lower(text), lower(name)) "
    "AND regexp_matches(text, '(?i)(^|[^A-Za-z0-9])' || regexp_escape(name) || '($|[^A-Za-z0-9])') "
    "UNION SELECT qid, ticker FROM q, (SELECT DISTINCT ticker FROM dim) WHERE contains(text, ticker) AND regexp_matches(text, '(^|[^A-Za-z0-9])' || regexp_escape(ticker) || '($|[^A-Za-z0-9])')) GROUP BY qid), "
    "b AS (SELECT yr.*, coalesce(tickers, []) AS tickers FROM yr LEFT JOIN tk USING (qid)), "
    "sc AS (SELECT qid, doc_id, fy, fy = max(fy) OVER (PARTITION BY qid, ticker) AS newest, list_contains(years, fy) AS iny FROM b, dim WHERE len(tickers) = 0 OR list_contains(tickers, dim.ticker)), "
    "ag AS (SELECT qid, coalesce(list_sort(list(DISTINCT fy) FILTER (WHERE iny)), []) AS fys, list_sort(list(DISTINCT doc_id) FILTER (WHERE iny)) AS yd, list_sort(list(DISTINCT doc_id)) AS ad, "
    "list_sort(list(DISTINCT doc_id) FILTER (WHERE newest)) AS nd FROM sc GROUP BY qid), "
    "flt AS (SELECT qid, tickers, coalesce(fys, []) AS fiscal_years, last AND len(years) = 0 AS latest, list_sort(list_filter(years, lambda y: NOT list_contains(coalesce(fys, []), y))) AS missing_years, "
    "CASE WHEN NOT (len(tickers) > 0 OR len(coalesce(fys, [])) > 0 OR last) THEN NULL WHEN len(years) > 0 AND len(fys) > 0 THEN yd WHEN len(years) > 0 THEN ad WHEN last THEN nd ELSE ad END AS doc_ids FROM b LEFT JOIN ag USING (qid))"
).replace("regexp_extract_all(text, R,", f"regexp_extract_all(text, '{filters.YEAR.replace(chr(39), chr(39) * 2)}',").replace("regexp_matches(text, L)", f"regexp_matches(text, '{filters.LATEST}')")


@query(f"WITH {_FILTERS} SELECT qid, array_to_string(tickers, ',') AS tickers, array_to_string(fiscal_years, ',') AS fiscal_years, latest, array_to_string(missing_years, ',') AS missing_years, CAST(len(doc_ids) AS BIGINT) AS n_docs FROM flt")
def question_filters(spark, d):
    """What every question restricts itself to, with the number of filings it means."""
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _detected(spark, d, gold(spark, d).select(F.col("id").alias("qid"), F.col("question").alias("text"))).select("qid", text("tickers"), text("fiscal_years"), "latest", text("missing_years"), "n_docs")


@query(f"WITH {_FILTERS} SELECT qid, unnest(doc_ids) AS doc_id FROM flt WHERE len(tickers) > 0 OR (len(fiscal_years) > 0)")
def question_documents(spark, d):
    """The filings that each question naming a company or a year means."""
    q = gold(spark, d).select(F.col("id").alias("qid"), F.col("question").alias("text"))
    return filters.allowed_documents(_detected(spark, d, q), filters.filing_dimension(table(spark, d, "manifest")))


def _detected(spark, d, q):
    return filters.detect_filters(q, filters.filing_dimension(table(spark, d, "manifest")))


_MASK = f"JOIN flt USING (qid) JOIN (SELECT chunk_id, doc_id FROM {P.CHUNKS}) c ON c.chunk_id = post.row WHERE flt.doc_ids IS NULL OR list_contains(flt.doc_ids, c.doc_id)"


@query(f"WITH {_FILTERS}, {P.bm25().replace(', stats  GROUP BY', ' CROSS JOIN stats ' + _MASK + ' GROUP BY')} SELECT qid, row AS chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM {P.top('scores', 10)}")
def bm25_filtered_top10(spark, d):
    """Search within the documents that a question names; the statistics stay those of the whole index."""
    c, ix = index(spark, d)
    q = asked(spark, d)
    found = _detected(spark, d, q).select("qid", "tickers", "fiscal_years", "scope")
    dim = filters.dated_dimension(filters.filing_dimension(table(spark, d, "manifest")))
    # the mask is a condition on the filing of each hit: no list of allowed rows is made
    of = c.select(F.col("chunk_id").alias("row"), "doc_id").join(F.broadcast(dim), "doc_id").select("row", "ticker", "fy", "newest")  # one row a filing
    texts = ix.texts.join(of, "row", "left")
    return lexical.top_hits(lexical.search(ix, q.join(found, "qid"), 10, (texts, filters.scope_mask)), 10).select("qid", F.col("row").alias("chunk_id"), "rank", F.round("score", 6).alias("score"))


def _dense(spark, d, k):
    """Stated query set: index rows whose number is divisible by 20, by their own dequantised and normalised vectors."""
    rows = dense.stored_vectors(table(spark, d, "index_vectors"))
    q = rows.where("row_no % 20 = 0").select(F.col("row").alias("qid"), dense.normalized(F.col("v")).alias("v"))
    return lexical.top_hits(dense.dense_scores(rows.select("row", "v", "scale"), q, k), k)


_DENSE = (
    f"vec AS (SELECT row, row_no, list_transform(v, lambda x: x::DOUBLE) AS v, scale FROM {P.VECTORS}), "
    "qv AS (SELECT row AS qid, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS qv FROM vec WHERE row_no % 20 = 0), "
    "dsc AS (SELECT qid, row, list_dot_product(qv, v) * scale AS score FROM qv, vec)"
)


@query(f"WITH {_DENSE} SELECT qid, row AS chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM {P.top('dsc', 50)}")
def dense_top50(spark, d):
    return _dense(spark, d, 50).select("qid", F.col("row").alias("chunk_id"), "rank", F.round("score", 6).alias("score"))


_HYBRID_ASKED = f"(SELECT v.row AS qid, array_to_string(c.heading_path, ' ') AS text FROM {P.VECTORS} v JOIN {P.CHUNKS} c ON c.chunk_id = v.row WHERE v.row_no % 20 = 0 AND c.heading_path IS NOT NULL)"
_HYBRID = (
    f"{P.bm25().replace(P.ASKED, _HYBRID_ASKED)}, {_DENSE}, lex AS (SELECT * FROM {P.top('scores', 50)}), den AS (SELECT * FROM {P.top('dsc', 50)}), "
    "fu AS (SELECT qid, row, lex.rank AS lexical_rank, den.rank AS dense_rank, coalesce(1.0::DOUBLE / (60 + lex.rank), 0) + coalesce(1.0::DOUBLE / (60 + den.rank), 0) AS fused FROM lex FULL OUTER JOIN den USING (qid, row)), "
    "fr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC, row) AS fused_rank FROM fu)"
)


def _hybrid(spark, d):
    c, ix = index(spark, d)
    ids = dense.stored_vectors(table(spark, d, "index_vectors")).where("row_no % 20 = 0").select(F.col("row").alias("chunk_id"))
    q = c.join(ids, "chunk_id").where("heading_path IS NOT NULL").select(F.col("chunk_id").alias("qid"), F.array_join("heading_path", " ").alias("text"))
    lex = lexical.top_hits(lexical.search(ix, q, 50), 50)
    return ix, q, fusion.fuse(lex, _dense(spark, d, 50))


@query(f"WITH {_HYBRID} SELECT qid, row AS chunk_id, CAST(lexical_rank AS INTEGER) AS lexical_rank, CAST(dense_rank AS INTEGER) AS dense_rank, round(fused, 9) AS fused, CAST(fused_rank AS INTEGER) AS fused_rank FROM fr WHERE fused_rank <= 8")
def hybrid_fused_top8(spark, d):
    _, _, fused = _hybrid(spark, d)
    return fused.where("fused_rank <= 8").select("qid", F.col("row").alias("chunk_id"), "lexical_rank", "dense_rank", F.round("fused", 9).alias("fused"), "fused_rank")


_RERANK = (
    "qn AS (SELECT qid, count(*) AS n FROM qterm GROUP BY qid), rr AS (SELECT fr.qid, fr.row, fr.fused_rank, (SELECT count(*) FROM qterm t JOIN post p ON p.term = t.term AND p.row = fr.row WHERE t.qid = fr.qid) / coalesce(n, 1)::DOUBLE AS s "
    "FROM fr LEFT JOIN qn USING (qid)), fin AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused_rank <= 30 DESC, CASE WHEN fused_rank <= 30 THEN -s ELSE 0 END, fused_rank) AS final_rank FROM rr)"
)


@query(
    f"WITH {_HYBRID}, {_RERANK} SELECT qid, row AS chunk_id, CAST(fused_rank AS INTEGER) AS fused_rank, CAST(final_rank AS INTEGER) AS final_rank, CASE WHEN fused_rank <= 30 THEN round(s, 6) END AS rerank_score, "
    "CASE WHEN fused_rank <= 30 THEN CAST(fused_rank - final_rank AS INTEGER) END AS rank_move FROM fin"
)
def hybrid_reranked(spark, d):
    ix, q, fused = _hybrid(spark, d)
    fused = cut_lineage(fused)
    terms = q.select("qid", T.tokens(F.col("text")).alias("terms"))
    out = fusion.rerank(fused, fusion.overlap_in_texts(fused.where("fused_rank <= 30"), terms, ix.texts), 30)
    return out.select("qid", F.col("row").alias("chunk_id"), "fused_rank", "final_rank", F.round("rerank_score", 6).alias("rerank_score"), "rank_move")


_SPANS = f"spans AS (SELECT id AS qid, coalesce(s.grp, '#' || (i - 1)) AS grp, s.doc_id AS doc_id, s.char_start AS gs, s.char_end AS ge FROM (SELECT id, unnest(gold_spans) AS s, generate_subscripts(gold_spans, 1) AS i FROM {P.GOLD}))"
_OVER = f"ov AS (SELECT DISTINCT qid, grp, chunk_id FROM spans JOIN {P.CHUNKS} c USING (doc_id) WHERE least(char_end, ge) - greatest(char_start, gs) >= least(30, ge - gs))"


@query(f"WITH {_SPANS}, {_OVER} SELECT qid, grp, chunk_id FROM ov")
def gold_chunk_overlaps(spark, d):
    return judging.gold_overlaps(judging.gold_spans(gold(spark, d)), chunks(spark, d))


@query(f"WITH {_SPANS}, {_OVER} SELECT qid, count(DISTINCT chunk_id) AS relevant FROM ov GROUP BY qid")
def relevant_chunks(spark, d):
    return judging.gold_overlaps(judging.gold_spans(gold(spark, d)), chunks(spark, d)).groupBy("qid").agg(F.countDistinct("chunk_id").alias("relevant"))


_METRICS = (
    f"{P.bm25()}, {_SPANS}, {_OVER}, hits AS (SELECT qid, row AS chunk_id, rank FROM {P.top('scores', 10)}), ng AS (SELECT qid, count(DISTINCT grp) AS groups FROM spans WHERE qid IN (SELECT qid FROM {P.ASKED}) GROUP BY qid), "
    "nr AS (SELECT qid, count(DISTINCT chunk_id) AS rel FROM ov GROUP BY qid), f AS (SELECT qid, grp, min(rank) AS r FROM hits JOIN ov USING (qid, chunk_id) GROUP BY qid, grp), "
    "fa AS (SELECT qid, count(*) FILTER (WHERE r <= 5) AS g5, count(*) AS g10, min(r) AS first FROM f GROUP BY qid), "
    "dc AS (SELECT qid, sum(1 / log2(rank + 1)) AS dcg FROM (SELECT DISTINCT qid, chunk_id, rank FROM hits JOIN ov USING (qid, chunk_id)) GROUP BY qid), "
    "sc AS (SELECT qid, coalesce(g5, 0) / groups::DOUBLE AS recall_at_5, coalesce(g10, 0) / groups::DOUBLE AS recall_at_10, coalesce(1 / first::DOUBLE, 0) AS mrr_at_10, "
    "coalesce(dcg / list_sum(list_transform(range(1, least(rel, 10) + 1), lambda i: 1 / log2(i + 1))), 0) AS ndcg_at_10 FROM ng LEFT JOIN nr USING (qid) LEFT JOIN fa USING (qid) LEFT JOIN dc USING (qid))"
)


def _scored(spark, d, questions=None, spans=None):
    c, ix = index(spark, d)
    questions = asked(spark, d) if questions is None else questions
    hits = lexical.top_hits(lexical.search(ix, questions, 10), 10).select("qid", F.col("row").alias("chunk_id"), "rank")
    spans = (judging.gold_spans(gold(spark, d)) if spans is None else spans).join(questions.select("qid"), "qid", "left_semi")
    return judging.score_rankings(hits, judging.gold_overlaps(spans, c), spans)


@query(f"WITH {_METRICS} SELECT qid, round(recall_at_5, 6) AS recall_at_5, round(recall_at_10, 6) AS recall_at_10, round(mrr_at_10, 6) AS mrr_at_10, round(ndcg_at_10, 6) AS ndcg_at_10 FROM sc")
def ranking_scores(spark, d):
    return _scored(spark, d).select("qid", *(F.round(m, 6).alias(m) for m in judging.METRICS))


_MEAN = ", ".join(f"floor(avg({m}) * 10000 + 0.5) / 10000 AS {m}" for m in ("recall_at_5", "recall_at_10", "mrr_at_10", "ndcg_at_10"))


@query(f"WITH {_METRICS} SELECT coalesce(category, 'all') AS category, count(*) AS n, {_MEAN} FROM sc JOIN (SELECT id AS qid, coalesce(category, 'none') AS category FROM {P.GOLD}) USING (qid) GROUP BY GROUPING SETS ((), (category))")
def ranking_report(spark, d):
    """Mean metrics overall and per category, to four places, half up."""
    cats = gold(spark, d).select(F.col("id").alias("qid"), F.coalesce("category", F.lit("none")).alias("category"))
    return judging.mean_scores(_scored(spark, d).join(cats, "qid"), "category")


_BASE = {"recall_at_5": 0.05, "recall_at_10": 0.05, "mrr_at_10": 0.05, "ndcg_at_10": 0.05}


@query("WITH r AS (" + f"WITH {_METRICS} SELECT {_MEAN} FROM sc" + ") " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS value, CAST({b} AS DOUBLE) AS baseline, {b} - {m} > 0.02 AS regressed FROM r" for m, b in _BASE.items()))
def ranking_gate(spark, d):
    """Whether a mean fell more than 0.02 below its baseline."""
    means = judging.mean_scores(_scored(spark, d).withColumn("category", F.lit("x")), "category").where("category = 'all'")
    return judging.gate(means, _BASE, 0.02)


# Ranking against evidence that does lie in the chunks: the words before a number ask for it, and the number's place in its filing is the evidence.
_MENTIONED = (
    "(SELECT 'm' || m.mention_id AS qid, substring(c.text, greatest(1, m.char_start - 79), least(80, m.char_start)) AS text, c.doc_id, c.char_start + m.char_start AS gs, c.char_start + m.char_end AS ge, "
    "CASE WHEN m.percent THEN 'percent' WHEN m.currency THEN 'currency' ELSE 'plain' END AS category FROM (SELECT mention_id, any_value(chunk_id) AS chunk_id, any_value(char_start) AS char_start, any_value(char_end) AS char_end, any_value(percent) AS percent, any_value(currency) AS currency "
    f"FROM number_mentions WHERE mention_id % 20 = 0 GROUP BY mention_id) m JOIN {P.CHUNKS} c USING (chunk_id) WHERE c.doc_id IS NOT NULL AND c.char_start IS NOT NULL AND m.char_start > 0 AND m.char_end > m.char_start)"
)


def mentioned(spark, d):
    """(qid, text, doc_id, gs, ge, category): every number whose id is divisible by 20."""
    m = table(spark, d, "number_mentions").where("mention_id % 20 = 0").dropDuplicates(["mention_id"]).select("mention_id", "chunk_id", F.col("char_start").alias("a"), F.col("char_end").alias("b"), "percent", "currency")
    j = m.join(chunks(spark, d), "chunk_id").where("doc_id IS NOT NULL AND char_start IS NOT NULL AND a > 0 AND b > a")
    return j.select(
        F.concat(F.lit("m"), F.col("mention_id").cast("string")).alias("qid"), F.substring("text", F.greatest(F.lit(1), F.col("a") - 79), F.least(F.lit(80), F.col("a"))).alias("text"), "doc_id",
        (F.col("char_start") + F.col("a")).alias("gs"), (F.col("char_start") + F.col("b")).alias("ge"), F.when(F.col("percent"), "percent").when(F.col("currency"), "currency").otherwise("plain").alias("category"),
    )


_MSPANS = f"spans AS (SELECT qid, qid AS grp, doc_id, gs, ge FROM {_MENTIONED})"
_MMETRICS = _METRICS.replace(P.ASKED, _MENTIONED).replace(_SPANS, _MSPANS)


def _mention_scores(spark, d):
    m = cut_lineage(mentioned(spark, d))
    return m, _scored(spark, d, m.select("qid", "text"), m.select("qid", F.col("qid").alias("grp"), "doc_id", "gs", "ge"))


@query(f"WITH {_MSPANS}, {_OVER} SELECT qid, grp, chunk_id FROM ov")
def mention_chunk_overlaps(spark, d):
    """The chunks that hold each number's place in its filing."""
    m = mentioned(spark, d)
    return judging.gold_overlaps(m.select("qid", F.col("qid").alias("grp"), "doc_id", "gs", "ge"), chunks(spark, d))


@query(f"WITH {_MMETRICS} SELECT qid, round(recall_at_5, 6) AS recall_at_5, round(recall_at_10, 6) AS recall_at_10, round(mrr_at_10, 6) AS mrr_at_10, round(ndcg_at_10, 6) AS ndcg_at_10 FROM sc")
def mention_ranking_scores(spark, d):
    return _mention_scores(spark, d)[1].select("qid", *(F.round(m, 6).alias(m) for m in judging.METRICS))


@query(f"WITH {_MMETRICS} SELECT coalesce(category, 'all') AS category, count(*) AS n, {_MEAN} FROM sc JOIN (SELECT qid, category FROM {_MENTIONED}) USING (qid) GROUP BY GROUPING SETS ((), (category))")
def mention_ranking_report(spark, d):
    m, scores = _mention_scores(spark, d)
    return judging.mean_scores(scores.join(m.select("qid", "category"), "qid"), "category")


@query("WITH r AS (" + f"WITH {_MMETRICS} SELECT {_MEAN} FROM sc" + ") " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS value, CAST({b} AS DOUBLE) AS baseline, {b} - {m} > 0.02 AS regressed FROM r" for m, b in {"recall_at_5": 0.2, "mrr_at_10": 0.9}.items()))
def mention_ranking_gate(spark, d):
    """The gate on rows that have relevant chunks."""
    _, scores = _mention_scores(spark, d)
    means = judging.mean_scores(scores.withColumn("category", F.lit("x")), "category").where("category = 'all'")
    return judging.gate(means, {"recall_at_5": 0.2, "mrr_at_10": 0.9}, 0.02)


@query(
    f"WITH {_MMETRICS}, r AS (SELECT category, count(*) AS n, {_MEAN} FROM sc JOIN (SELECT qid, category FROM {_MENTIONED}) USING (qid) GROUP BY category) "
    "SELECT category, " + ", ".join(f"{m}, coalesce(round({m}, 4) = max(round({m}, 4)) OVER (), false) AS best_{m}" for m in judging.METRICS) + " FROM r"
)
def best_categories(spark, d):
    """Which category has the best value of each metric."""
    m, scores = _mention_scores(spark, d)
    means = judging.mean_scores(scores.join(m.select("qid", "category"), "qid"), "category").where("category <> 'all'").drop("n")
    return reports.best_values(means, list(judging.METRICS))


@query("SELECT vec_id, array_to_string(list_transform(u, lambda x: CAST(floor(x / s + 0.5) AS INTEGER)), ',') AS q, round(s, 9) AS scale FROM (SELECT vec_id, u, CASE WHEN list_max(list_transform(u, lambda x: abs(x))) = 0 THEN 1.0::DOUBLE ELSE list_max(list_transform(u, lambda x: abs(x))) / 127 END AS s FROM (SELECT vec_id, list_transform(e, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS u FROM (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings))))")
def quantized_embeddings(spark, d):
    q = dense.quantize(table(spark, d, "embeddings"), "embedding")
    return q.select("vec_id", F.array_join(F.col("q").cast("array<string>"), ",").alias("q"), F.round("scale", 9).alias("scale"))


_FNV = "lpad(lower(to_hex(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(chunk_id, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: xor(h, c) * 16777619 % 4294967296) % 256)), 2, '0')"


@query(f"SELECT chunk_id, {_FNV} AS shard FROM {P.CHUNKS}")
def chunk_shards(spark, d):
    return chunks(spark, d).select("chunk_id", T.shard_of(F.col("chunk_id")).alias("shard"))


@query(f"SELECT shard, count(*) AS chunks, CAST(sum(bytes) AS BIGINT) AS bytes, sum(bytes) > 4000 AS over_budget FROM (SELECT {_FNV} AS shard, strlen(text) AS bytes FROM {P.CHUNKS} WHERE text IS NOT NULL) GROUP BY shard")
def shard_sizes(spark, d):
    """Size report per shard of the text store, with a flag beyond a budget."""
    s = chunks(spark, d).where("text IS NOT NULL").select(T.shard_of(F.col("chunk_id")).alias("shard"), F.octet_length("text").alias("b"))
    return s.groupBy("shard").agg(F.count("*").alias("chunks"), F.sum("b").alias("bytes"), (F.sum("b") > 4000).alias("over_budget"))


@query(
    f"WITH {P.bm25()}, h AS (SELECT qid, row, rank FROM {P.top('scores', 3)}) SELECT a.qid, 'SOURCES:' || chr(10) || chr(10) || coalesce(b.s, '') || chr(10) || chr(10) || 'QUESTION: ' || trim(a.text) AS prompt FROM {P.ASKED} a LEFT JOIN "
    f"(SELECT qid, string_agg('[' || rank || '] ' || coalesce(c.item, '?') || chr(10) || trim(c.text), chr(10) || chr(10) ORDER BY rank) AS s FROM h JOIN {P.CHUNKS} c ON c.chunk_id = h.row GROUP BY qid) b USING (qid)"
)
def retrieval_prompts(spark, d):
    """Prompts of the stated questions over their three best chunks."""
    c, ix = index(spark, d)
    q = asked(spark, d)
    hits = lexical.top_hits(lexical.search(ix, q, 3), 3)
    s = hits.join(c.select(F.col("chunk_id").alias("row"), F.coalesce("item", F.lit("?")).alias("label"), "text"), "row").select("qid", F.col("rank").alias("n"), "label", "text")
    return prompts.source_prompts(s, q)
