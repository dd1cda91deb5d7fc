"""Passage functions for SQL: register(spark) makes them callable by name."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import html, passages


@udtf(returnType="no int, start int, end int, text string")
class SplitSentences:
    """One row a sentence."""

    def eval(self, text: str) -> Iterator[tuple]:
        for n, (a, b) in enumerate(passages.split_sentences(text or "")):
            yield n, a, b, text[a:b]


@udtf(returnType="no int, raw string, start int, end int, value double, tolerance double, percent boolean, currency boolean, scaled boolean, per_share boolean")
class ExtractNumbers:
    """One row a number."""

    def eval(self, text: str) -> Iterator[tuple]:
        for i, n in enumerate(passages.extract_numbers(text or "")):
            yield i, n.raw, n.start, n.end, n.value, n.tolerance, n.percent, n.currency, n.scaled, n.per_share


@udtf(returnType="start int, end int")
class LocateAll:
    """One row an occurrence of a quote."""

    def eval(self, text: str, quote: str) -> Iterator[tuple]:
        yield from passages.locate_all(text or "", quote or "")


@udtf(returnType="no int, type string, text string")
class ParseHtmlBlocks:
    """One row a block of a page, furniture included."""

    def eval(self, page: str) -> Iterator[tuple]:
        for n, b in enumerate(html.page_blocks(page or "")[0]):
            yield n, b.type, b.text


def register(spark: SparkSession) -> None:
    """split_sentences, extract_numbers, locate_all and parse_html_blocks as table functions, numbers_of and sentences_of as scalar ones."""
    for name, f in (("split_sentences", SplitSentences), ("extract_numbers", ExtractNumbers), ("locate_all", LocateAll), ("parse_html_blocks", ParseHtmlBlocks)):
        spark.udtf.register(name, f)
    spark.udf.register("numbers_of", passages.numbers_udf)
    spark.udf.register("sentences_of", passages.sentences_udf)
