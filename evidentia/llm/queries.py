"""Queries of the language-model data operators: name -> callable (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from . import encoding, leaks, near_duplicates, neighbours, pair_quality, split_overlap, splitting, subjects


def p1_found(spark, d):
    chunks = table(spark, d, "chunks")
    pairs = near_duplicates.near_duplicate_pairs(chunks, "chunk_id", "text", words=3, similarity=0.6, least_shingles=20, weighted=False)
    return pairs.toDF("chunk_id_a", "chunk_id_b")


def p1_groups(spark, d):
    return near_duplicates.near_duplicate_groups(table(spark, d, "chunks"), "chunk_id", "text").withColumnRenamed("id", "chunk_id")


def _overlaps(spark, d):
    known = split_overlap.known_words(table(spark, d, "manifest"), "company")
    return split_overlap.split_overlaps(table(spark, d, "gold_items"), "id", "question", "split", known=known)


def p2_found(spark, d):
    pairs = _overlaps(spark, d)
    return pairs.select(F.least("train_id", "held_id").alias("id_a"), F.greatest("train_id", "held_id").alias("id_b"))


def p2_report(spark, d):
    return split_overlap.overlap_report(_overlaps(spark, d), table(spark, d, "gold_items"), "id", "split", "source")


def p4_found(spark, d):
    languages = pair_quality.learn_languages(table(spark, d, "documents"), "text", "lang")
    return pair_quality.defective_pairs(table(spark, d, "item_details"), "run_id", "id", "question", "answer", "answerable", languages)


def p5_pieces(spark, d):
    return splitting.split_texts(table(spark, d, "chunks"), "chunk_id", "text", ["doc_id", "heading_path"])


def p5_found(spark, d):
    pieces = splitting.split_texts(table(spark, d, "chunks"), "chunk_id", "text", oversized_only=True)
    return pieces.where("piece = 1").select("chunk_id")


def p6_neighbours(spark, d):
    top = neighbours.nearest_neighbours(table(spark, d, "index_vectors"), "chunk_id", "vectors", "row_no")
    return top.withColumnsRenamed({"id_a": "chunk_id", "id_b": "neighbour_id"})


def p6_found(spark, d):
    return neighbours.neighbour_pairs(table(spark, d, "index_vectors"), "chunk_id", "vectors", "row_no").toDF("chunk_id_a", "chunk_id_b")


def p7_ids(spark, d):
    return encoding.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p8_spans(spark, d):
    return leaks.leaked_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_passages"), "item_id", "text")


def p8_found(spark, d):
    return p8_spans(spark, d).select("doc_id", "item_id").distinct()


def p9_found(spark, d):
    docs, filings = table(spark, d, "documents"), table(spark, d, "manifest").select("doc_id", "url", "path").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    about = docs.select("doc_id", "filing_id", "source").join(filings.toDF("filing_id", "url", "path"), "filing_id", "left")
    paths = about.select("doc_id", F.concat_ws(" ", "source", "url", "path").alias("path"))
    return subjects.document_subjects(docs, "doc_id", "text", table(spark, d, "subjects"), table(spark, d, "subject_labels"), paths)


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_report": p2_report, "p4_found": p4_found, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_found": p6_found, "p6_neighbours": p6_neighbours, "p7_ids": p7_ids, "p8_found": p8_found, "p8_spans": p8_spans, "p9_found": p9_found}
_TEXTS = "(SELECT chunk_id, any_value(text) AS text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY chunk_id)"
_SPACE = r"\s\x0b\x1c-\x1f\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: Where SQL can say the same over whole tables.
SQL: dict[str, str] = {
    "p1_found": (
        f"WITH w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {_TEXTS}), "
        "s AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) > 2), "
        "n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY chunk_id HAVING count(*) >= 20), "
        "p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY ALL) "
        "SELECT a AS chunk_id_a, b AS chunk_id_b FROM p JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE 10 * c >= 6 * (x.n + y.n - c)"
    ),
    "p5_found": f"SELECT chunk_id FROM {_TEXTS} WHERE len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^{_SPACE}]')) > 350",
}
