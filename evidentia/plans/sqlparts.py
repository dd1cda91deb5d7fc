"""Shared pieces of the comparison SQL."""

from __future__ import annotations

from ..functions.text import STOPWORDS

CHUNKS = (
    "(SELECT chunk_id, any_value(doc_id) AS doc_id, any_value(strategy) AS strategy, any_value(item) AS item, any_value(char_start) AS char_start, "
    "any_value(char_end) AS char_end, any_value(n_tokens) AS n_tokens, any_value(text) AS text, any_value(heading_path) AS heading_path FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id)"
)
GOLD = (
    "(SELECT id, any_value(question) AS question, any_value(category) AS category, any_value(answerable) AS answerable, any_value(gold_answer) AS gold_answer, "
    "any_value(gold_spans) AS gold_spans, any_value(companies) AS companies, any_value(source) AS source, any_value(split) AS split FROM gold_items WHERE id IS NOT NULL GROUP BY id)"
)
ASKED = f"(SELECT id AS qid, question AS text FROM {GOLD} WHERE question IS NOT NULL AND CAST(regexp_extract(id, '[0-9]+') AS BIGINT) % 20 = 0)"
RESULTS = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, id ORDER BY recorded_at) AS rn FROM item_results) WHERE rn = 1)"
DETAILS = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, id ORDER BY provider) AS rn FROM item_details) WHERE rn = 1)"
VECTORS = (
    "(SELECT chunk_id AS row, row_no, doc_id, vectors AS v, CASE WHEN scales > 0 AND CAST(scales AS VARCHAR) NOT LIKE '%nan%' THEN scales::DOUBLE ELSE 1 / sqrt(list_sum(list_transform(vectors, lambda x: x::DOUBLE * x::DOUBLE))) END AS scale FROM "
    "(SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY row_no) AS rn FROM index_vectors WHERE len(vectors) = 384 AND chunk_id IS NOT NULL "
    "AND len(list_filter(vectors, lambda x: x IS NULL)) = 0 AND len(list_filter(vectors, lambda x: x <> 0)) > 0) WHERE rn = 1)"
)


def tokens(name: str, source: str, cols: str, text: str) -> str:
    """Common table expressions ending in name(cols, toks): the search terms of source.text."""
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    stem = (
        "CASE WHEN length(t) <= 3 OR NOT regexp_full_match(t, '[a-z]+') THEN t WHEN t LIKE '%ies' THEN left(t, length(t) - 3) || 'y' WHEN t LIKE '%sses' THEN left(t, length(t) - 2) "
        "WHEN regexp_matches(t, '(x|ch|sh)es$') THEN left(t, length(t) - 2) WHEN regexp_matches(t, '[^sui]s$') THEN left(t, length(t) - 1) ELSE t END"
    )
    return (
        f"{name}_a AS (SELECT {cols}, string_split(lower({text}), ',') AS a FROM {source} AS src WHERE {text} IS NOT NULL), "
        f"{name}_n AS (SELECT {cols}, array_to_string(list_transform(a, lambda v, i: v || CASE WHEN i = len(a) THEN '' WHEN regexp_matches(v, '[0-9]$') "
        f"AND regexp_matches(a[i + 1], '^[0-9]{{3}}([^0-9]|$)') THEN '' ELSE ',' END), '') AS n FROM {name}_a), "
        f"{name} AS (SELECT {cols}, list_transform(list_filter(regexp_extract_all(n, '[a-z0-9]+(?:\\.[0-9]+)?'), lambda t: NOT (t IN ({stop}) OR regexp_full_match(t, '[a-z]'))), lambda t: {stem}) AS toks FROM {name}_n)"
    )


def bm25(where: str = "") -> str:
    """CTEs ending in scores(qid, row, score) for the stated query set over all chunks; `where` may mask (qid, row) after the statistics."""
    return (
        f"{tokens('dt', CHUNKS, 'chunk_id', 'text')}, {tokens('qt', ASKED, 'qid', 'text')}, "
        "post AS (SELECT chunk_id AS row, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS term FROM dt) GROUP BY ALL), "
        "stats AS (SELECT count(*) AS n, floor(sum(len(toks)) / greatest(count(*), 1) * 1000 + 0.5) / 1000 AS avgdl FROM dt), "
        "df AS (SELECT term, count(*) AS df FROM post GROUP BY term), "
        "qterm AS (SELECT DISTINCT qid, unnest(toks) AS term FROM qt), "
        "scores AS (SELECT qid, row, CAST(sum(CAST(round(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) * 1e9) AS BIGINT)) AS DOUBLE) / 1e9 AS score "
        f"FROM qterm JOIN df USING (term) JOIN post USING (term), stats {where} GROUP BY qid, row)"
    )


def top(source: str, k: int) -> str:
    return f"(SELECT * FROM (SELECT qid, row, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, row) AS rank FROM {source}) WHERE rank <= {k})"
