"""From the raw blocks of pages to the blocks of filings: page furniture, item sections, headings and their paths, offsets.

All as aggregates and windows over the table of blocks (id, no, breaks, page, type, text, bold, emph, size); a
window holds the blocks of one page or one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import UNIT_LINE

#: Items of an annual report (fixed values).
ITEMS = "1 1A 1B 1C 2 3 4 5 6 7 7A 8 9 9A 9B 9C 10 11 12 13 14 15 16".split()
#: Blocks at either end of a page that may be furniture; longest furniture, item heading and heading; repeats that show it.
EDGE, SHORT, ITEM_CHARS, HEADING_CHARS, AT_EDGES, ANYWHERE = 3, 100, 200, 150, 3, 8
ITEM_LINE = r"(?i)^item\s*(\d{1,2}[a-c]?)\b(?:\s*(?:&|,|and)\s*\d{1,2}[a-c]?\b)*\s*[-.:–—]?\s*(.*)$"
_NUMBERED = r"(?i)^(?:page\s*)?[-–—]?\s*(?:\d{1,3}|[ivxlc]{1,6})\s*[-–—]?$"
_POINTER = r"(?i)^(?:(?:back|return)\s+to\s+)?(?:contents|index|table\s+of\s+contents)$"
_FOOT = r"^(?:\d{1,3}\s+[A-Za-z].*|[A-Za-z].*\s\d{1,3})$"
_BULLET = r"^[-•▪●]$"


def _up_to(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)


def without_furniture(blocks: DataFrame) -> DataFrame:
    """Without page numbers, links to the contents, running heads and feet; a bullet alone in its line joins the next line.

    Furniture are short lines among the first or last blocks of a page that come up at AT_EDGES such
    places or end or begin with a number, and lines with letters and figures that come up ANYWHERE times.
    Lines that name a unit are kept. The end of a last page that no break follows is no edge.
    """
    short = (F.col("type") == "paragraph") & (F.length("text") <= SHORT)
    page = Window.partitionBy("id", "page")
    b = blocks.where("no >= 0").where(~(short & (F.col("text").rlike(_NUMBERED) | F.col("text").rlike(_POINTER))))
    top, bottom = F.row_number().over(page.orderBy("no")), F.row_number().over(page.orderBy(F.desc("no")))
    lower = F.lower("text")
    b = b.withColumn("_edge", (top <= EDGE) | ((bottom <= EDGE) & (F.col("page") < F.col("breaks")))).withColumn("_item", F.col("text").rlike(ITEM_LINE))
    b = b.withColumn("_key", F.when(short, F.when(F.col("_item"), lower).otherwise(F.regexp_replace(lower, r"\d+", "#"))))
    counted = b.where("_key IS NOT NULL").groupBy("id", "_key").agg(F.count_if("_edge").alias("_near"), F.count("*").alias("_all"))
    b = b.join(counted, ["id", "_key"], "left")
    at_edge = F.col("_edge") & ((F.col("_near") >= AT_EDGES) | (F.col("text").rlike(_FOOT) & (F.length("text") <= 63) & ~F.col("_item")))
    often = (F.col("_all") >= ANYWHERE) & F.col("text").rlike(r"\d") & F.col("text").rlike("[A-Za-z]")
    b = b.where(~(short & ~F.col("text").rlike(UNIT_LINE) & (at_edge | often)))
    doc = Window.partitionBy("id").orderBy("no")
    alone = (F.col("type") == "paragraph") & F.col("text").rlike(_BULLET)
    b = b.withColumn("_alone", alone).withColumn("_mark", F.when(F.lag("_alone").over(doc) & (F.col("type") == "paragraph"), F.lag("text").over(doc)))
    b = b.withColumn("_joins", F.col("_alone") & (F.coalesce(F.lead("type").over(doc), F.lit("")) == "paragraph")).where("NOT _joins")
    marked = F.col("_mark").isNotNull()
    return b.select(
        "id", "no", "page", "type", F.concat_ws(" ", "_mark", "text").alias("text"), (F.col("bold") & ~marked).alias("bold"), (F.col("emph") & ~marked).alias("emph"), "size"
    )


def item_sections(blocks: DataFrame) -> DataFrame:
    """(id, item, start, end): of the headings of each item the one with most text up to the next heading, the later of equals; end is exclusive, null for the last."""
    doc = Window.partitionBy("id").orderBy("no")
    item = F.upper(F.regexp_extract("text", ITEM_LINE, 1))
    b = blocks.select("id", "no", "type", "text", F.sum(F.length("text")).over(_up_to("id")).alias("upto"), F.sum(F.length("text")).over(Window.partitionBy("id")).alias("whole"))
    h = b.where((F.col("type") == "paragraph") & (F.length("text") <= ITEM_CHARS)).withColumn("item", item).where(F.col("item").isin(*ITEMS))
    h = h.withColumn("size", F.coalesce(F.lead(F.col("upto") - F.length("text")).over(doc), F.col("whole")) - F.col("upto"))
    chosen = h.groupBy("id", "item").agg(F.max_by("no", F.struct("size", "no")).alias("start"))
    return chosen.withColumn("end", F.lead("start").over(Window.partitionBy("id").orderBy("start")))


def configured_sections(blocks: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """(id, item, start, end): sections between a line like rule[0] and the next line like rule[1], if no other such start comes before; the longest of each item."""
    out = None
    whole = lambda p: F.col("text").rlike(f"(?i)^(?:{p})$") & (F.col("type") == "paragraph") & (F.length("text") <= ITEM_CHARS)
    after = Window.partitionBy("id").orderBy("no").rowsBetween(1, Window.unboundedFollowing)
    for item, (start, end) in rules.items():
        b = blocks.select("id", "no", whole(start).alias("s"), whole(end).alias("e"), F.sum(F.length("text")).over(_up_to("id")).alias("upto"))
        b = b.withColumn("next_s", F.min(F.when(F.col("s"), F.col("no"))).over(after)).withColumn("stop", F.min(F.when(F.col("e"), F.struct("no", "upto"))).over(after))
        b = b.where("s AND stop IS NOT NULL AND (next_s IS NULL OR stop.no < next_s)").withColumn("size", F.col("stop.upto") - F.col("upto"))
        one = b.groupBy("id").agg(F.max_by(F.struct(F.col("no").alias("start"), F.col("stop.no").alias("end")), F.struct("size", "no")).alias("x"))
        one = one.select("id", F.lit(item).alias("item"), "x.start", "x.end")
        out = one if out is None else out.unionAll(one)
    return out


def _tier(body: Column) -> Column:
    """1 to 4 for headings: by size above the text's, by weight or capitals, by emphasis; null for text."""
    t = F.col("text")
    out = (F.col("type") != "paragraph") | (F.length(t) > HEADING_CHARS) | ~t.rlike("[A-Za-z]{2}") | t.rlike("[,;]$") | (t.rlike(r"\.$") & (F.length(t) > 80))
    larger = F.when(body > 0, F.col("size") - body)
    capitals = (t == F.upper(t)) & (t != F.lower(t)) & (F.length(t) <= 100)
    return F.when(out, None).when(larger >= 6, 1).when(larger >= 2, 2).when(F.col("bold") | capitals, 3).when(F.col("emph"), 4)


def filing_blocks(blocks: DataFrame, keep: list[str], titles: dict[str, str] | None = None, configured: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(id, k, item, heading_path, type, char_start, char_end, text) of the items to keep, from blocks without furniture.

    Blocks are joined by an empty line, which gives the offsets. The path begins with the item and goes
    on with the headings in force: one of each tier since the last of a higher tier.
    """
    doc = Window.partitionBy("id").orderBy("no")
    starts = item_sections(blocks)
    b = blocks.join(starts.select("id", F.col("start").alias("no"), F.col("item").alias("_starts")), ["id", "no"], "left")
    b = b.withColumn("item", F.last("_starts", ignorenulls=True).over(_up_to("id"))).withColumn("_head", F.col("_starts").isNotNull())
    if configured:
        inner = configured_sections(blocks, configured).select("id", F.col("item").alias("_item"), F.col("start").alias("_a"), F.col("end").alias("_b"))
        spans = inner.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_a", "_b", "_item")), asc=False).alias("_spans"))  # one for each rule at most
        b = b.join(spans, "id", "left").withColumn("_in", F.try_element_at(F.filter("_spans", lambda s: (F.col("no") >= s["_a"]) & (F.col("no") < s["_b"])), F.lit(1)))
        b = b.withColumn("item", F.coalesce("_in._item", "item")).withColumn("_head", F.col("_head") | (F.col("_in._a") == F.col("no")) & F.col("_in").isNotNull())
    # a title on the line after a bare "Item 7." belongs to it
    bare = F.col("_head") & (F.regexp_extract("text", ITEM_LINE, 2) == "") & F.col("text").rlike(ITEM_LINE)
    b = b.withColumn("_head", F.col("_head") | (F.coalesce(F.lag(bare).over(doc), F.lit(False)) & (F.length("text") <= HEADING_CHARS) & (F.lag("item").over(doc) == F.col("item"))))
    sizes = blocks.where("type = 'paragraph' AND size > 0").groupBy("id", "size").agg(F.sum(F.length("text")).alias("n"), F.min("no").alias("first"))
    body = sizes.groupBy("id").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("_body"))
    b = b.join(body, "id", "left").where(F.col("item").isin(*keep)).withColumn("_tier", F.when(~F.col("_head"), _tier(F.coalesce("_body", F.lit(0.0)))))
    b = b.withColumn("_run", F.sum(F.when(F.col("item") == F.lag("item").over(doc), 0).otherwise(1)).over(_up_to("id")))
    for t in (1, 2, 3, 4):
        b = b.withColumn(f"_h{t}", F.last(F.when(F.col("_tier") == t, F.struct("no", "text")), ignorenulls=True).over(_up_to("id", "_run")))
    path = [F.concat_ws(" ", F.lit("Item"), F.col("item"), _titles(titles)[F.col("item")] if titles else F.lit(None))]
    for t in (1, 2, 3, 4):
        higher = reduce(F.greatest, [F.coalesce(F.col(f"_h{u}.no"), F.lit(-1)) for u in range(1, t)]) if t > 2 else F.coalesce(F.col("_h1.no"), F.lit(-1)) if t == 2 else F.lit(-1)
        path.append(F.when(~F.col("_head") & (F.col(f"_h{t}.no") > higher), F.col(f"_h{t}.text")))
    end = F.sum(F.length("text") + 2).over(_up_to("id")) - 2
    return b.select(
        "id", (F.row_number().over(doc) - 1).alias("k"), "item", F.array_compact(F.array(*path)).alias("heading_path"),
        F.when(F.col("_head") | F.col("_tier").isNotNull(), "heading").otherwise(F.col("type")).alias("type"),
        (end - F.length("text")).cast("int").alias("char_start"), end.cast("int").alias("char_end"), "text",
    )


def _titles(titles: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in titles.items() for x in pair))


def filing_texts(blocks: DataFrame) -> DataFrame:
    """(id, text): the kept blocks of each filing as one text."""
    b = blocks.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("b"))
    return b.select("id", F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("text"))


def item_warnings(blocks: DataFrame, keep: list[str], least: int = 300) -> DataFrame:
    """(id, warning): items to keep that a filing lacks, or that hold fewer than `least` characters."""
    held = blocks.groupBy("id", "item").agg(F.sum(F.col("char_end") - F.col("char_start")).alias("chars"))
    want = blocks.select("id").distinct().select("id", F.explode(F.array(*map(F.lit, keep))).alias("item")).join(held, ["id", "item"], "left")
    none = F.concat(F.lit("Item "), F.col("item"), F.lit(" not found"))
    few = F.concat(F.lit("Item "), F.col("item"), F.lit(" is only "), F.col("chars").cast("string"), F.lit(" chars"))
    return want.select("id", F.when(F.col("chars").isNull(), none).when(F.col("chars") < least, few).alias("warning")).where("warning IS NOT NULL")
