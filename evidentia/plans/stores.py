"""Round trips through sources and sinks, and page blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html
from ..operators import chunking, pages
from ..session import cut_lineage, shared_path, table
from ..sources import readers, sinks
from . import sqlparts as P
from .filings import filings
from .registry import query
from .retrieval import chunks, gold


@query(f"SELECT id, question, category, source FROM {P.GOLD} WHERE coalesce(trim(question), '') || coalesce(trim(category), '') <> ''")
def review_csv_round_trip(spark, d):
    """Gold items through the reviewers' CSV and back."""
    path = shared_path(spark, "review")
    sinks.write_review_csv(gold(spark, d).select("id", "question", "category", "source"), path)
    return readers.review_csv(spark, path, ["id", "question", "category", "source"])


@query("SELECT doc_id, min(ticker) AS ticker, min(fy) AS fy FROM manifest WHERE doc_id IS NOT NULL GROUP BY doc_id")
def json_lines_round_trip(spark, d):
    path = shared_path(spark, "manifest")
    sinks.write_json_lines(filings(spark, d).select("doc_id", "ticker", "fy"), path, "ticker", "fy")
    return readers.json_lines(spark, path, "doc_id string, ticker string, fy int")


@query(f"SELECT i.chunk_id, c.text IS NOT NULL AS found, CAST(length(c.text) AS INTEGER) AS chars FROM (SELECT DISTINCT chunk_id FROM number_mentions WHERE chunk_id IS NOT NULL UNION SELECT 'missing-1') i LEFT JOIN {P.CHUNKS} c USING (chunk_id)")
def text_store_lookup(spark, d):
    """The text store written by shard, and looked up for every chunk with a number."""
    path = shared_path(spark, "store")
    sinks.write_text_store(chunks(spark, d).where("text IS NOT NULL").select("chunk_id", "doc_id", "text"), path)
    ids = table(spark, d, "number_mentions").select("chunk_id").unionAll(spark.createDataFrame([("missing-1",)], "chunk_id string"))
    return sinks.lookup(spark, path, ids).select("chunk_id", "found", F.length("text").alias("chars"))


@query()
def document_blocks(spark, d):
    """Every document read as a page: paragraphs and tables without furniture."""
    raw = html.raw_blocks(table(spark, d, "documents"), "doc_id", "text")
    return pages.without_furniture(raw).select(F.col("id").alias("doc_id"), "no", "type", "text")


#: Characters of a filing on one rendered page.
PAGE_CHARS = 100_000


def rendered(spark, d):
    """(id, html): the chunks of each filing, by stretches of PAGE_CHARS characters, as a page with item headings and page breaks."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    c = chunks(spark, d).where("doc_id IS NOT NULL AND text IS NOT NULL AND char_start IS NOT NULL AND item IS NOT NULL")
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<p>"), esc(x), F.lit("</p>"))), "")
    head = F.concat(F.lit("<p style='font-weight:bold'>Item "), F.col("item"), F.lit(". "), F.element_at(F.concat(F.coalesce("heading_path", F.array().cast("array<string>")), F.array(F.lit("Part"))), 1), F.lit("</p>"))
    c = c.select("doc_id", F.floor(F.col("char_start") / PAGE_CHARS).alias("part"), "char_start", "chunk_id", F.concat(head, lines, F.lit("<hr>")).alias("h"))
    g = c.groupBy("doc_id", "part").agg(F.array_sort(F.collect_list(F.struct("char_start", "chunk_id", "h"))).alias("x"))
    return g.select(F.concat_ws("#", "doc_id", F.col("part").cast("string")).alias("id"), "doc_id", F.array_join(F.transform("x", lambda x: x["h"]), "").alias("html"))


def parsed(spark, d):
    return pages.filing_blocks(pages.without_furniture(cut_lineage(html.raw_blocks(rendered(spark, d), "id", "html"))), pages.ITEMS)


@query()
def filing_page_blocks(spark, d):
    """Filings rendered as pages and parsed again: items, heading paths, types and offsets."""
    return parsed(spark, d).select("id", "k", "item", F.array_join("heading_path", " > ").alias("heading_path"), "type", "char_start", "char_end")


@query()
def structure_page_chunks(spark, d):
    """Those pages in chunks under their headings, tables apart."""
    b = cut_lineage(parsed(spark, d))
    about = filings(spark, d).select("doc_id", "company", "fy", "form")
    named = rendered(spark, d).select("id", "doc_id").join(about, "doc_id")
    got = chunking.structure_chunks(b, pages.filing_texts(b), named)
    return got.select("chunk_id", "item", "char_start", "char_end", "n_tokens", F.length("text").alias("chars"))


@query()
def fixed_document_chunks(spark, d):
    """Fixed token windows over every document."""
    return chunking.fixed_chunks(table(spark, d, "documents"), "doc_id", "text")
