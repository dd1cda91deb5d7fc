"""Problem 3: quantities written in different units and scales, brought to common units.

Every column that holds the same quantity (a value with a unit field, the figure as printed with the
words around it, the tolerance, the other figures of the same measure) has one or more readings: a
factor to a common unit. Identities tie the columns together; each says that a sum of
exponent * log(column * factor) is zero. Those used are

  value * unit = printed figure * printed unit        (gold items)
  value = figure * scale, or value = figure           (mentions; the value may lack its scale)
  tolerance = half of the last printed place * scale  (mentions)
  figure * scale * unit = usual amount of the measure (table cells under a head such as "In millions",
                                                       which names a scale but no unit)

and any others a caller passes to `solve`, such as mass = density * volume. Of all combinations of
readings that agree in their dimension the one with the smallest residual is taken; where another
combination that gives another amount fits as well, the solution is flagged as not unique.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

FOOT, MILE, ACRE, POUND, SHORT_TON, GALLON, BARREL = map(Decimal, "0.3048 1.609344 4046.8564224 0.45359237 907.18474 3.785411784 158.987294928".split())
#: Factors to the common units by legal definition (fixed values): common unit -> {spellings: factor}.
UNITS: dict[str, dict[str, Decimal]] = {
    "USD": {"usd|us\\$|\\$|u\\.?\\s?s\\.?\\s?dollars?|dollars?": Decimal(1)},
    "EUR": {"eur|€|euros?": Decimal(1)},
    "cent/share": {
        "(?:us |u\\.s\\. )?(?:cents?|¢) ?(?:per|a|/) ?(?:basic |diluted |common |ordinary )?shares?": Decimal(1),
        "(?:usd|us\\$|\\$|(?:u\\.?s\\.? )?dollars?) ?(?:per|a|/) ?(?:basic |diluted |common |ordinary )?shares?": Decimal(100),
    },
    "bp": {
        "basis points?|bps|bp": Decimal(1), "‰|per mille|permille|per mil": Decimal(10), "%|percentage points?|percent|per cent|pct\\.?|pp|p\\.p\\.|ppts?": Decimal(100),
        "ratio|pure|fraction": Decimal(10000),
    },
    "shares": {"shares?|shs\\.?": Decimal(1)},
    "m2": {
        "m²|m2|m\\^2|sqm|sq\\.? ?m|square met(?:re|er)s?": Decimal(1), "km²|km2|square kilomet(?:re|er)s?|sq\\.? ?km": Decimal(1000000), "hectares?|ha": Decimal(10000), "acres?": ACRE,
        "ft²|ft2|sq\\.? ?ft\\.?|sqft|square (?:feet|foot)": FOOT * FOOT,
    },
    "kg": {
        "kilograms?|kilogrammes?|kilos?|kgs?": Decimal(1), "grams?|g": Decimal("0.001"), "kilotonnes?|kt": Decimal(1000000), "megatonnes?": Decimal(1000000000),
        "tonnes?|metric tons?|metric tonnes?|t": Decimal(1000), "short tons?": SHORT_TON, "pounds?|lbs?\\.?": POUND, "ounces?|oz": POUND / 16,
    },
    "litre": {
        "lit(?:re|er)s?|l": Decimal(1), "hectolit(?:re|er)s?|hl": Decimal(100), "millilit(?:re|er)s?|ml": Decimal("0.001"), "m³|m3|m\\^3|cubic met(?:re|er)s?|cbm": Decimal(1000),
        "(?:us |u\\.s\\. )?gallons?|gals?\\.?": GALLON, "(?:oil )?barrels?(?: of oil)?|bbls?\\.?": BARREL,
    },
    "kWh": {
        "kwh|kilowatt[- ]?hours?": Decimal(1), "mwh|megawatt[- ]?hours?": Decimal(1000), "gwh|gigawatt[- ]?hours?": Decimal(1000000), "twh|terawatt[- ]?hours?": Decimal(1000000000), "wh|watt[- ]?hours?": Decimal("0.001"),
    },
    "km": {"kilomet(?:re|er)s?|kms?": Decimal(1), "miles?|mi": MILE, "met(?:re|er)s?": Decimal("0.001"), "feet|foot|ft": FOOT / 1000},
    "persons": {"(?:full[- ]time )?employees?|persons?|people|staff(?: members)?|fte|ftes|full[- ]time equivalents?|heads?|workers?": Decimal(1)},
}
#: A spelling that more than one unit goes by; identities with the other columns decide.
AMBIGUOUS = {"tons?": [("kg", Decimal(1000)), ("kg", SHORT_TON)]}
SCALES = {
    "thousands?|000s|000|k|tsd": Decimal(1000), "millions?|mio|mln|mn|mm|m": Decimal(10**6), "billions?|bn|bln": Decimal(10**9), "trillions?|tn": Decimal(10**12),
}
#: A scale that more than one factor goes by, the usual one first: "M" also stands for a thousand beside "MM" for a million.
AMBIGUOUS_SCALES = {"m": [Decimal(10**6), Decimal(1000)]}
_ALL = [(re.compile(p, re.I), [(c, f)]) for c, u in UNITS.items() for p, f in u.items()] + [(re.compile(p, re.I), v) for p, v in AMBIGUOUS.items()]
_SCALE = [(re.compile(p, re.I), f) for p, f in SCALES.items()]
_ANY_SCALE = "|".join(SCALES)
_ANY_UNIT = "|".join(sorted((x for p in [*(p for u in UNITS.values() for p in u), *AMBIGUOUS] for x in [p]), key=len, reverse=True))
_NUMBER = re.compile(r"\d[\d,]*(?:\.\d+)?|\.\d+")
_CURRENCY = re.compile(r"us\$|usd|eur|€|\$", re.I)
_PER_SHARE = re.compile(r"\s*(?:per|a|/)\s?(?:basic |diluted |common |ordinary )?share\b", re.I)
_RIGHT = re.compile(rf"\s*(?:({_ANY_SCALE})(?![\w²³]))?\s*(?:({_ANY_UNIT})(?![\w²³]))?", re.I)
_ASKED = re.compile(r"\((?:expressed |given |stated )?in ([^()]+)\)", re.I)
_HEADER = re.compile(r"\(([^()]*)\)")
_STOP = re.compile(r"[.!?;]\s+(?=[\"'«(]?[A-Z])|\n")

Reading = tuple[str, Decimal]


def unit_readings(text: str | None) -> list[Reading]:
    """(common unit, factor) readings of a unit field such as 'USD (millions)'; none if it names no unit."""
    if not text:
        return []
    s = re.sub(r"[()\[\]]", " ", unicodedata.normalize("NFKC", text.replace("²", "2").replace("³", "3"))).strip().lower()
    s = re.sub(r"\s+", " ", re.sub(r"\bin\b", " ", s)).strip()
    if found := _named(s):
        return found
    for words in (s.split(" ", 1), s.rsplit(" ", 1)[::-1]):
        if len(words) == 2:
            scale, rest = words
            for p, f in _SCALE:
                if p.fullmatch(scale) and (found := _named(rest)):
                    return [(c, x * f) for c, x in found]
    return []


def _named(s: str) -> list[Reading]:
    return next((list(v) for p, v in _ALL if p.fullmatch(s)), [])


def _scale(s: str | None) -> Decimal:
    return next((f for p, f in _SCALE if s and p.fullmatch(s)), Decimal(1))


def _lead(text: str, at: int) -> tuple[bool, bool, str | None]:
    """(negative, in brackets, currency) from the signs before a number that begins at `at`, over any run of blanks."""
    minus = bracket = False
    currency = None
    while True:
        while at and text[at - 1].isspace():
            at -= 1
        c = text[at - 1] if at else ""
        if c and c in "-−–" and not minus and (at < 2 or not (text[at - 2].isalnum() or text[at - 2] == "_")):
            minus, at = True, at - 1
        elif c == "(" and not bracket:
            bracket, at = True, at - 1
        elif currency is None and c and (m := next((m for n in (3, 1) if at >= n and (m := _CURRENCY.fullmatch(text, at - n, at))), None)):
            if m.group().isalpha() and at > 3 and (text[at - 4].isalnum() or text[at - 4] == "_"):
                return minus, bracket, currency
            currency, at = m.group().lower(), m.start()
        else:
            return minus, bracket, currency


def figure(text: str, start: int, end: int) -> tuple[Decimal, list[Reading], list[Decimal]] | None:
    """The signed number printed inside text[start:end], the readings of its unit from the words around it, and those of its scale, the first being the one in the unit's."""
    m = _NUMBER.search(text, start, end)
    if not m:
        return None
    number = Decimal(m.group().replace(",", ""))
    minus, bracket, currency = _lead(text, m.start())
    right = m.end()
    closed = text.startswith(")", right)
    right += closed
    if minus or (bracket and closed):
        number = -number
    at = _RIGHT.match(text, right)
    scale, unit = _scale(at[1]), at[2]
    scales = AMBIGUOUS_SCALES.get((at[1] or "").lower(), [scale])
    if currency:
        if _PER_SHARE.match(text, at.end(1) if at[1] else right):
            return number, [("cent/share", 100 * scale)], scales
        return number, [("EUR" if currency in ("eur", "€") else "USD", scale)], scales
    if unit:
        return number, [(c, f * scale) for c, f in _named(re.sub(r"\s+", " ", unit.lower()))], scales
    return number, [], scales


def table_header(text: str, at: int) -> tuple[list[Reading], Decimal | None, str | None]:
    """(readings, scale, measure) of a table cell: the unit that the head of its table names, or else the scale alone, and the row's label up to a comma."""
    start = text.rfind("\n", 0, at) + 1
    stop = text.find("\n", at)
    line = text[start : stop if stop >= 0 else len(text)]
    if "|" not in line:
        return [], None, None
    cells = line.strip().strip("|").split("|")
    measure = " ".join(re.findall(r"[^\W\d_]+", cells[0].split(",")[0].lower())) or None
    head = line
    while start > 0:
        prev = text.rfind("\n", 0, start - 1) + 1
        above = text[prev : start - 1]
        if "|" not in above:
            if above.strip() and any(found := _head_unit(above)):
                return *found, measure
            break
        head, start = above, prev
    return *_head_unit(head), measure


def _head_unit(line: str) -> tuple[list[Reading], Decimal | None]:
    """The readings of the unit in brackets, or the scale where only a scale stands there."""
    alone = None
    for m in _HEADER.finditer(line):
        s = re.sub(r",.*$", "", m[1].strip().lower())  # "except per share amounts"
        s = re.sub(r"^(?:amounts?|figures?|all amounts?|stated|expressed)\b", "", s).strip()
        s = re.sub(r"\s+", " ", s.replace(" of ", " "))
        if found := unit_readings(s):
            return found, None
        s = re.sub(r"^in ", "", s)
        alone = next((f for p, f in _SCALE if p.fullmatch(s)), alone)
    return [], alone


def solve(columns: list[list[float]], *identities: list[int], cost: list[list[float]] | None = None) -> tuple[tuple[int, ...], float, bool]:
    """The combination of readings, one of each column, whose logarithms best satisfy all identities.

    columns[i] holds log(value * factor) of each reading of column i; an identity is a list of exponents,
    one for each column; cost[i] may hold what a reading of column i costs beforehand. Gives the indices,
    the residual and whether no other combination fits as well (within 0.01).
    """

    def residual(pick: tuple[int, ...]) -> float:
        off = sum(abs(sum(e * columns[i][k] for i, (e, k) in enumerate(zip(exponents, pick, strict=True)))) for exponents in identities)
        return off + (sum(cost[i][k] for i, k in enumerate(pick)) if cost else 0.0)

    best = sorted(((residual(pick), pick) for pick in product(*(range(len(c)) for c in columns))), key=lambda x: (round(x[0], 9), x[1]))
    r, pick = best[0]
    unique = len(best) == 1 or best[1][0] - r > 0.01
    return pick, r, unique


def usual_unit(number: Decimal, scale: Decimal, profile: list[tuple[str, float, int]]) -> tuple[str, int, float, bool] | None:
    """(common unit, amount, residual, unique) of a figure with a scale but no unit, from the units in which its measure is stated elsewhere.

    profile: (common unit, mean log amount, number of amounts) of the measure. A unit seldom used costs the logarithm of its share.
    """
    if not profile:
        return None
    profile = sorted(profile)
    total = sum(n for _, _, n in profile)
    size = math.log(abs(float(number * scale))) if number else None
    if size is None:
        at, off, unique = max(range(len(profile)), key=lambda i: profile[i][2]), 0.0, len(profile) == 1
    else:
        (at, _), off, unique = solve([[m for _, m, _ in profile], [size]], [1, -1], cost=[[-math.log(n / total) for *_, n in profile], [0.0]])
    return profile[at][0], int((number * scale).to_integral_value(ROUND_HALF_UP)), off, unique


def decide(number: Decimal, readings: list[Reading], other: list[tuple[str | None, float]]) -> tuple[str, int, float | None, bool]:
    """(common unit, amount, residual, unique) of a figure, given other amounts of the same quantity.

    other: (common unit or None where unknown, amount); the identity is figure * factor = other amount,
    where all other amounts of the figure's common unit are alternatives of one column.
    """
    residual, unique, pick = None, len({f for _, f in readings}) == 1, 0
    logs = [math.log(abs(float(number * f))) for _, f in readings] if number else []
    usable = [(c, math.log(abs(x))) for c, x in other if logs and x and math.isfinite(x)]
    if column := [x for c, x in usable if c == readings[0][0]]:
        (pick, _), residual, alone = solve([logs, column], [1, -1])
        unique = unique or alone
    elif unknown := [x for c, x in usable if c is None]:  # the same unit, but perhaps without its scale: decides nothing, only checks
        ratio = math.log(abs(float(number))) - unknown[-1]
        residual = min(abs(ratio - k * math.log(1000)) for k in range(-4, 5))
    common, factor = readings[pick]
    return common, int((number * factor).to_integral_value(ROUND_HALF_UP)), residual, unique


def restated(text: str, start: int, end: int, number: Decimal, readings: list[Reading]) -> list[tuple[str, float]]:
    """The amounts that state the quantity of text[start:end] again, in a unit of one reading, as in '12 tons (10,886 kg)'.

    Looked for in the same sentence or line, and only where readings differ; an amount that no reading meets within 2 % is another quantity.
    """
    if not number or len({f for _, f in readings}) == 1:
        return []
    left = max((m.end() for m in _STOP.finditer(text, 0, start)), default=0)
    right = m.start() if (m := _STOP.search(text, end)) else len(text)
    out = []
    for m in _NUMBER.finditer(text, left, right):
        if m.start() < end and m.end() > start:
            continue
        x, units, _ = figure(text, m.start(), m.end())
        if x and len(units) == 1 and any(c == units[0][0] and abs(math.log(abs(number * f / (x * units[0][1])))) <= 0.02 for c, f in readings):
            out.append((units[0][0], float(x * units[0][1])))
    return out


def _exact(x) -> Decimal | None:
    return Decimal(repr(float(x))) if x is not None and math.isfinite(x) else None


def gold_amount(value, unit: str | None, question: str | None, answer: str | None):
    """The amount of a gold item: its unit field holds for its value; otherwise answer and question hold."""
    number, readings = _exact(value), unit_readings(unit)
    printed = figure(answer, 0, len(answer)) if answer else None
    at = _NUMBER.search(answer) if answer else None
    again = lambda n, r: restated(answer, at.start(), at.end(), n, r)
    if number is not None and readings:
        other = [(c, float(printed[0] * f)) for c, f in printed[1]] if printed else []
        more = again(number, readings) if printed else []
        return decide(number, readings, more if more and len(other) > 1 else other + more)
    asked = _ASKED.search(question or "")
    if printed and printed[1]:
        return decide(printed[0], printed[1], ([(None, float(value))] if number is not None else []) + again(*printed[:2]))
    readings = readings or (unit_readings(asked[1]) if asked else [])
    number = printed[0] if printed else number
    return decide(number, readings, []) if readings and number is not None else None


def printed_scale(number: Decimal, scales: list[Decimal], value: float | None, tolerance: float | None) -> tuple[int, float | None, bool]:
    """Which of the scales a figure is printed in, the residual, and whether no other fits, by value = figure * scale (or figure) and tolerance = half a place * scale."""
    logs = [math.log(float(x)) for x in scales]
    columns, identities = [logs], []
    if number and value is not None and math.isfinite(value) and value:
        off = math.log(abs(value)) - math.log(abs(float(number)))
        columns.append([off])
        identities.append([1, -1])
    if tolerance is not None and math.isfinite(tolerance) and tolerance > 0:
        columns.append([math.log(tolerance) - math.log(0.5) - number.as_tuple().exponent * math.log(10)])
        identities.append([1, -1])
    if not identities:
        return 0, None, len(scales) == 1
    if len(columns) == 2 and identities and number and abs(columns[1][0]) < 0.01 and not (tolerance is not None and tolerance > 0):
        return 0, 0.0, len(scales) == 1  # the value is the bare figure, which tells nothing of the scale
    whole = [[e[0], *(0 if j != i else e[1] for j in range(len(identities)))] for i, e in enumerate(identities)]
    tries = [solve(columns, *whole)]
    if len(identities) == 2:  # the value may lack its scale: then the tolerance alone holds
        tries.append(solve([columns[0], columns[2]], [1, -1]))
        tries[1] = (tries[1][0], tries[1][1] + abs(columns[1][0]), tries[1][2])
    pick, residual, unique = min(tries, key=lambda x: x[1])
    return pick[0], residual, unique


def mention_amount(raw: str | None, start, end, value, text: str | None, tolerance=None):
    """The amount of a mention, as the text around it says; (None, number, scale, measure) where only a measure can tell the unit."""
    if text is None or start is None or end is None or not 0 <= start < end <= len(text) or (raw and text[start:end] != raw):
        at = text.find(raw) if text and raw else -1
        if at < 0:
            text, at = raw, 0
        if not text or not raw:
            return None
        start, end = at, at + len(raw)
    found = figure(text, int(start), int(end))
    if not found:
        return None
    number, readings, scales = found
    pick, off, _ = printed_scale(number, scales, value, tolerance)
    measure = None
    if not readings:
        readings, alone, measure = table_header(text, int(start))
        if not readings:
            return (None, number, alone, measure) if alone is not None and measure else None
    at = _NUMBER.search(text, int(start), int(end))
    if pick and off is not None and off < 0.01:  # the other columns leave no doubt of an unusual scale
        readings = [(c, f * scales[pick] / scales[0]) for c, f in readings]
    common, amount, residual, unique = decide(number, readings, restated(text, at.start(), at.end(), number, readings))
    return common, amount, off if residual is None else residual, unique, measure


_OUT = "table_name string, rec_key string, common_unit string, amount long, residual double, is_unique boolean"
_SEEN = _OUT + ", measure string, number string, scale string"


def _whole(x: int) -> int | None:
    return x if abs(x) < 2**63 else None


def _opt(x):
    return None if x is None or x != x else x


def _gold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        got = [(k, gold_amount(_opt(v), u, q, a)) for k, v, u, q, a in zip(p["k"], p["value"], p["unit"], p["question"], p["answer"], strict=True)]
        rows = [("gold_items", k, c, _whole(n), r, one) for k, x in got if x is not None for c, n, r, one in [x]]
        yield pd.DataFrame(rows, columns=["table_name", "rec_key", "common_unit", "amount", "residual", "is_unique"]).astype({"amount": "Int64"})


def _mentions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        rows = []
        for k, raw, s, e, v, tol, t in zip(p["k"], p["raw"], p["s"], p["e"], p["value"], p["tolerance"], p["text"], strict=True):
            x = mention_amount(raw, None if _opt(s) is None else int(s), None if _opt(e) is None else int(e), _opt(v), t, _opt(tol))
            if x is None:
                continue
            if x[0] is None:
                rows.append(("number_mentions", k, None, None, None, None, x[3], str(x[1]), str(x[2])))
            else:
                rows.append(("number_mentions", k, x[0], _whole(x[1]), *x[2:5], None, None))
        yield pd.DataFrame(rows, columns=["table_name", "rec_key", "common_unit", "amount", "residual", "is_unique", "measure", "number", "scale"]).astype({"amount": "Int64"})


def _by_measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        rows = []
        for name, k, number, scale, profile in zip(p["table_name"], p["rec_key"], p["number"], p["scale"], p["profile"], strict=True):
            common, amount, residual, unique = usual_unit(Decimal(number), Decimal(scale), [(x["unit"], x["size"], x["n"]) for x in profile])
            rows.append((name, k, common, _whole(amount), residual, unique))
        yield pd.DataFrame(rows, columns=["table_name", "rec_key", "common_unit", "amount", "residual", "is_unique"]).astype({"amount": "Int64"})


def common_amounts(gold_items: DataFrame, mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(table_name, rec_key, common_unit, amount, residual, is_unique) of every amount with a unit.

    residual is the log residual of the identities with the record's other columns, null where there are
    none. A table cell whose head names a scale only has the unit in which its measure (the row's label
    up to a comma) is stated in other tables; the units of every measure are counted over all mentions.
    Nulls: a record without key, figure or unit has no row; a mention whose chunk is missing is read
    from its raw text alone. An amount beyond 64 bits is null. Records delivered twice count once. Empty
    tables give no row. mentions may lack the column `tolerance`.
    """
    g = gold_items.select(F.col("id").alias("k"), F.col("gold_numeric.value").alias("value"), F.col("gold_numeric.unit").alias("unit"), "question", F.col("gold_answer").alias("answer"), "gold_numeric")
    gold = g.where("k IS NOT NULL AND gold_numeric IS NOT NULL").drop("gold_numeric").mapInPandas(_gold, _OUT)
    tolerance = F.col("tolerance").cast("double") if "tolerance" in mentions.columns else F.lit(None).cast("double").alias("tolerance")
    m = mentions.select(F.col("mention_id").cast("string").alias("k"), "chunk_id", "raw", F.col("char_start").alias("s"), F.col("char_end").alias("e"), "value", tolerance).where("k IS NOT NULL").dropDuplicates(["k"])
    texts = chunks.select("chunk_id", "text").where("chunk_id IS NOT NULL")
    seen = m.join(texts, "chunk_id", "left").select("k", "raw", "s", "e", "value", "tolerance", "text").mapInPandas(_mentions, _SEEN).dropDuplicates(["rec_key"])
    seen = cut_lineage(seen)
    stated = seen.where("measure IS NOT NULL AND amount <> 0").groupBy("measure", F.col("common_unit").alias("unit")).agg(F.avg(F.log(F.abs(F.col("amount").cast("double")))).alias("size"), F.count("*").alias("n"))
    profiles = stated.groupBy("measure").agg(F.collect_list(F.struct("unit", "size", "n")).alias("profile"))  # at most one entry for each common unit
    rest = seen.where("common_unit IS NULL").join(profiles, "measure").select("table_name", "rec_key", "number", "scale", "profile").mapInPandas(_by_measure, _OUT)
    cols = [c.split()[0] for c in _OUT.split(", ")]
    return gold.dropDuplicates(["rec_key"]).unionAll(seen.where("common_unit IS NOT NULL").select(cols)).unionAll(rest)
