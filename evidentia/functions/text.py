"""Scalar text functions as Column expressions, inside the JVM; terms_of() says the same as tokens() in Python, for whole tables."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words the search tokenizer drops (fixed value).
STOPWORDS = (
    "a an and are as at be been but by for from had has have in into is it its not of on or our such that the their there these they this to was we were which will with"
).split()
#: Words that carry no content when spans are compared (fixed value).
SPAN_STOPWORDS = "a an and are as at be by for from has have in is it its of on or that the this to was were which with".split()
#: The marker of an answer that declines (fixed value).
INSUFFICIENT = "INSUFFICIENT_EVIDENCE"


def stem(t: Column) -> Column:
    """Strip plural endings of alphabetic words of more than three letters."""
    return (
        F.when((F.length(t) <= 3) | ~t.rlike("^[a-z]+$"), t)
        .when(t.endswith("ies"), F.concat(F.left(t, F.length(t) - 3), F.lit("y")))
        .when(t.endswith("sses"), F.left(t, F.length(t) - 2))
        .when(t.rlike("(x|ch|sh)es$"), F.left(t, F.length(t) - 2))
        .when(t.rlike("[^sui]s$"), F.left(t, F.length(t) - 1))
        .otherwise(t)
    )


def tokens(text: Column) -> Column:
    """Search terms: lower case, digit-group commas dropped, stop words and single letters dropped, stemmed. Null stays null."""
    norm = F.regexp_replace(F.lower(text), r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")
    found = F.regexp_extract_all(norm, F.lit(r"[a-z0-9]+(?:\.[0-9]+)?"), F.lit(0))
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.transform(F.filter(found, lambda t: ~F.array_contains(stop, t) & ~t.rlike("^[a-z]$")), stem)


_GROUP, _WORD = re.compile(r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))"), re.compile(r"[a-z0-9]+(?:\.[0-9]+)?")


@functools.lru_cache(1 << 18)
def _term(word: str) -> str | None:
    """A word's term; None for words that are dropped."""
    if word in STOPWORDS or re.fullmatch("[a-z]", word):
        return None
    if len(word) <= 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith("ies"):
        return word[:-3] + "y"
    if word.endswith("sses") or re.search("(x|ch|sh)es$", word):
        return word[:-2]
    return word[:-1] if re.search("[^sui]s$", word) else word


def terms_of(text: str) -> list[str]:
    """tokens() of one text in Python: for whole tables, where an expression for every word takes most of the time."""
    return [t for w in _WORD.findall(_GROUP.sub("", text.lower())) if (t := _term(w)) is not None]


def count_tokens(text: Column) -> Column:
    """Words and single marks: the stand-in token counter."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0)))


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity."""
    p = float(10**digits)
    return F.floor(x * p + 0.5) / p


def shard_of(key: Column) -> Column:
    """Two hex digits of the 32-bit FNV-1a hash of an ASCII key, modulo 256."""
    codes = F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.ascii(F.substring(key, i, F.lit(1))).cast("long"))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda a, c: a.bitwiseXOR(c) * F.lit(16777619) % F.lit(4294967296))
    return F.when(key == "", F.lit("c5")).otherwise(F.lpad(F.lower(F.hex(h % 256)), 2, "0"))


#: White space as a JavaScript pattern has it; Java's own class has U+0085 and lacks U+FEFF.
JS_BLANKS = r"\t\n\x{000B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def normalize_question(q: Column) -> Column:
    """The form of a question that cache keys use: lower case, single blanks, no end punctuation; for any script."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(q), f"[{JS_BLANKS}]+", " ")), r"[?!. ]+\z", "")


def answer_key(question: Column, config: Column, chunk_ids: Column, versions: Column) -> Column:
    """Cache key of an answer: the order of its chunks does not matter."""
    return F.sha2(F.concat_ws("|", versions, config, normalize_question(question), F.array_join(F.array_sort(chunk_ids), ",")), 256)


def verdict_key(question: Column, answer: Column, chunk_ids: Column, versions: Column) -> Column:
    """Cache key of a verdict: citations are positional, so the order matters."""
    return F.sha2(F.concat_ws("|", versions, normalize_question(question), answer, F.array_join(chunk_ids, ",")), 256)


def declined(answer: Column) -> Column:
    """What an answer with the declining marker says is missing; null for other answers."""
    a = F.trim(answer)
    hit = a.rlike(rf"^\**{INSUFFICIENT}")
    return F.when(hit, F.trim(F.regexp_extract(a, rf"(?s)^\**{INSUFFICIENT}\**:?\s*(.*)$", 1)))


def hide_partial(partial: Column) -> Column:
    """Whether streamed text could still become the declining marker and is to be held back."""
    return F.lit(INSUFFICIENT).startswith(F.trim(partial))


def css_map(style: Column) -> Column:
    """CSS declarations as a map of trimmed, lower-cased names and values; later ones win."""
    parts = F.filter(F.split(F.lower(F.coalesce(style, F.lit(""))), ";"), lambda p: p.contains(":"))
    entries = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.trim(F.substring(p, F.instr(p, ":") + 1, F.length(p))).alias("value")))
    return F.aggregate(entries, F.expr("cast(map() as map<string,string>)"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))


def heading_level(kind: Column, text: Column, bold: Column, emph: Column, size: Column, body: Column) -> Column:
    """Heading tier 1..4 of a block, null for no heading: larger type, then bold or capitals, then emphasis."""
    letters = text.rlike("[A-Za-z]{2}")
    ends = text.rlike("[,;]$") | (text.endswith(".") & (F.length(text) > 80))
    capital = (F.upper(text) == text) & (F.lower(text) != text) & (F.length(text) <= 100)
    return (
        F.when((kind != "paragraph") | (F.length(text) > 150) | ~letters | ends, F.lit(None).cast("int"))
        .when((body > 0) & (size >= body + 6), 1)
        .when((body > 0) & (size >= body + 2), 2)
        .when(bold | capital, 3)
        .when(emph, 4)
    )


def source_label(company: Column, ticker: Column, fy: Column, form: Column, item: Column, path: Column) -> Column:
    """Head line of a source block in a prompt."""
    head = F.array_join(path, " > ")
    return F.concat(company, F.lit(" ("), ticker, F.lit(") | FY"), fy.cast("string"), F.lit(" "), form, F.lit(" | Item "), item, F.when(head != "", F.concat(F.lit(" | "), head)).otherwise(""))


def context_prefix(company: Column, fy: Column, form: Column, path: Column) -> Column:
    """What a structure chunk starts with: company, year and its outermost and innermost headings."""
    inner = F.when(F.size(path) > 1, F.concat(F.lit(" | "), F.element_at(path, -1))).otherwise("")
    return F.concat(company, F.lit(" FY"), fy.cast("string"), F.lit(" "), form, F.lit(" | "), F.try_element_at(path, F.lit(1)), inner)


def strip_prefix(text: Column, prefix: Column) -> Column:
    """The body of an indexed chunk."""
    return F.when(text.startswith(F.concat(prefix, F.lit("\n\n"))), F.substring(text, F.length(prefix) + 3, F.length(text))).otherwise(text)


def passage_label(label: Column, company: Column, fy: Column, path: Column) -> Column:
    """Label of a passage shown for review: the inner heading path behind company and year."""
    return F.concat(label, F.lit(": "), company, F.lit(" FY"), fy.cast("string"), F.when(F.size(path) > 1, F.concat(F.lit(" > "), F.array_join(F.slice(path, 2, 99), " > "))).otherwise(""))


def thousands(x: Column) -> Column:
    """A whole number with group commas, rounded half to even."""
    return F.format_number(F.bround(x, 0), 0)


def value_formats(value: Column, unit: Column) -> Column:
    """Printed forms of a reported value: millions, thousands, billions; two decimals per share."""
    a = F.abs(value)
    plain = F.array_compact(
        F.array(
            F.when(a % 1_000_000 == 0, thousands(a / 1e6)), F.when(a % 1_000 == 0, thousands(a / 1e3)),
            F.when(a >= 1e9, F.concat(F.format_string("%.1f", a / 1e9), F.lit(" billion"))), F.when(a >= 1e9, F.concat(F.format_string("%.2f", a / 1e9), F.lit(" billion"))),
        )
    )
    return F.when(unit == "USD/shares", F.array(F.format_string("%.2f", a))).otherwise(F.array_distinct(plain))


def format_usd(v: Column) -> Column:
    """Dollars in millions, with the billions behind where there are any."""
    a = F.abs(v)
    s = F.concat(F.lit("$"), thousands(a / 1e6), F.lit(" million"), F.when(a >= 1e9, F.concat(F.lit(" ($"), F.format_string("%.1f", a / 1e9), F.lit(" billion)"))).otherwise(""))
    return F.when(v < 0, F.concat(F.lit("-"), s)).otherwise(s)


def percent_text(x: Column, digits: int = 1) -> Column:
    return F.when(x.isNull(), F.lit("–")).otherwise(F.concat(F.format_string(f"%.{digits}f", x * 100), F.lit("%")))


def rank_cell(rank: Column, score: Column, digits: int = 3) -> Column:
    return F.when(rank.isNull(), F.lit("–")).otherwise(F.format_string(f"#%d (%.{digits}f)", rank, score))


def synthetic_id(category: Column, seed: Column) -> Column:
    return F.concat(F.lit("syn-"), category, F.lit("-"), F.left(F.sha2(seed, 256), F.lit(8)))


def plain_date(text: Column) -> Column:
    """A date written as yyyy-MM-dd, yyyyMMdd or MM/dd/yyyy; null for anything else."""
    t = F.trim(text)
    return F.coalesce(
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")), F.when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd")),
        F.when(t.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(t, "MM/dd/yyyy")),
    )


def fiscal_year(tagged: Column, period_end: Column) -> Column:
    """The tagged year, else the year of the period's end; the first week of January belongs to the year before."""
    early = (F.month(period_end) == 1) & (F.dayofmonth(period_end) <= 7)
    return F.coalesce(tagged.cast("int"), F.year(period_end) - early.cast("int"))


def name_pattern(name: Column, ignore_case: bool = True) -> Column:
    """A pattern of a literal name as a whole word."""
    flag = "(?i)" if ignore_case else ""
    return F.concat(F.lit(flag + r"(?<![A-Za-z0-9])\Q"), name, F.lit(r"\E(?![A-Za-z0-9])"))


def parse_flag(cell: Column) -> Column:
    """A review cell as a boolean; null for anything but the known words."""
    c = F.lower(F.trim(cell))
    return F.when(c.isin("true", "yes", "y", "1"), True).when(c.isin("false", "no", "n", "0"), False)


def parse_amount(cell: Column) -> Column:
    """A review cell as a number: dollar signs, commas and a percent sign are dropped."""
    return F.regexp_replace(F.trim(cell), r"[$,%\s]", "").try_cast("double")


def split_cell(cell: Column) -> Column:
    """Entries of an evidence or list cell."""
    return F.filter(F.transform(F.split(cell, r"\s*(?:\|\||;)\s*"), F.trim), lambda x: x != "")


def sse_event(name: Column, data: Column) -> Column:
    """One server-sent event."""
    return F.concat(F.lit("event: "), name, F.lit("\ndata: "), data, F.lit("\n\n"))


def stable_json(m: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
