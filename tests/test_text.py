"""Worked cases of the text functions."""

import math

import pytest
from pyspark.sql import functions as F

from evidentia.functions import html, passages
from evidentia.functions import text as T
from evidentia.operators import pages


def one(spark, col, **row):
    names = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], names).select(col.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="The tolls of $7,891.5 thousand at S.W. quays") == ["toll", "7891.5", "thousand", "quay"]
    assert one(spark, T.tokens(F.col("t")), t="boxes masses harnesses perches ferries barges census bus 9,876,543,210") == ["box", "mass", "harness", "perch", "ferry", "barge", "census", "bus", "9876543210"]


def test_rounding_shard_and_formats(spark):
    assert [one(spark, T.half_up(F.col("x"), 1), x=v) for v in (0.25, -0.25)] == [0.3, -0.2]
    assert len(one(spark, T.shard_of(F.col("t")), t="ZRBRX-FY2025-10")) == 2
    assert one(spark, T.value_formats(F.col("x"), F.lit("USD")), x=47218e6) == ["47,218", "47,218,000", "47.2 billion", "47.22 billion"]
    assert one(spark, T.format_usd(F.col("x")), x=-2.5e9) == "-$2,500 million ($2.5 billion)"
    assert one(spark, T.normalize_question(F.col("t")), t="  What   were SALES?? ") == "what were sales"
    assert one(spark, T.css_map(F.col("t")), t="Font-Weight: BOLD; color:red;color : blue") == {"font-weight": "bold", "color": "blue"}
    assert one(spark, T.declined(F.col("t")), t="**INSUFFICIENT_EVIDENCE**: no segment data") == "no segment data"
    assert one(spark, T.hide_partial(F.col("t")), t="INSUFF")
    assert one(spark, T.parse_amount(F.col("t")), t="$1,234.5") == 1234.5


def test_dates(spark):
    rows = spark.createDataFrame([("2026-01-03",), ("20251231",), ("03/14/2020",), ("soon",), (None,)], "t string").select(T.plain_date(F.col("t")).alias("d"))
    got = [str(r.d) for r in rows.select("d").collect()]
    assert got == ["2026-01-03", "2025-12-31", "2020-03-14", "None", "None"]
    years = rows.select(T.fiscal_year(F.lit(None).cast("int"), F.col("d")).alias("y")).collect()
    assert [r.y for r in years][:3] == [2025, 2025, 2020]


def test_sentences():
    cut = lambda t: [t[a:b] for a, b in passages.split_sentences(t)]
    assert cut("Ferries of the N.V. Oostzee carried 12.5 t [3]. Oostzee Corp. runs nine lines, see fig. two [1] [2].") == ["Ferries of the N.V. Oostzee carried 12.5 t [3].", "Oostzee Corp. runs nine lines, see fig. two [1] [2]."]
    assert passages.split_sentences("   Kiln up. Ore in.  ") == [(3, 11), (12, 19)]
    assert cut("* tin\n3. zinc 【2】\n\nlead") == ["tin", "zinc 【2】", "lead"] and cut('He said "no!" Then rain came?') == ['He said "no!"', "Then rain came?"]
    assert passages.split_sentences("") == [] and cut("Rope. [1]x and. [2] y") == ["Rope.", "[1]x and. [2]", "y"]


def test_citations():
    assert passages.parse_citations("Tar [2, 2] or pitch [9][0] .", 4) == ("Tar or pitch.", [2], [9, 0])
    assert passages.parse_citations("Wool【3†p. 7】", 3) == ("Wool", [3], [])
    assert passages.renumber("Hemp [1][3]. Flax [1, 2].", ["k", "m"], ["m", "k"]) == "Hemp [2]. Flax [2, 1]."
    assert passages.segments("oats [3,1] rye") == [("oats ", None), (None, 3), (None, 1), (" rye", None)]


@pytest.mark.parametrize("text,values", [
    ("Freight came to $7.4 billion, 3.25% above the 8,112 tonnes.", [7.4e9, 3.25, 8112]),
    ("Levy (refund) | (2,718) | -41 | −6%", [-2718, -41, -6]), ("8–12% over 2-4 seasons", [8, 12, 2, 4]),
    ("In 1998, on June 9, under Item 4, Notes 21, the 8-K, FY2019, B777, ORION-12, 17c3-2, the 5th, 2018-2020.", []),
    ("(8)% of $3M", [-8, 3e6]), ("1,23 and 12,3456 and .5", [1, 23, 12345]), ("May. 4 crates, item.5 boxes", []),
])
def test_numbers(text, values):
    assert [n.value for n in passages.extract_numbers(text)] == pytest.approx(values)


def test_number_places():
    t = "net ( $ 12.50 million) per diluted common share or $(3.1) bn"
    got = [(n.raw, t[n.start : n.end], n.tolerance, n.currency, n.scaled, n.per_share) for n in passages.extract_numbers(t)]
    assert got[0][2:5] == (5000.0, True, True) and all(raw == part.strip() for raw, part, *_ in got)


def test_number_matching():
    n = lambda t: passages.extract_numbers(t)[0]
    match = lambda a, b: passages.numbers_match(n(a), n(b))
    assert match("$52.4 billion", "52,386") and match("$52 billion", "52,386")
    assert not match("$52.6 billion", "52,386") and not match("31.2%", "31%") and not match("$8 million", "8%")


def test_verification():
    a = passages.verify(["Freight cost $6.12 a ton, before $5.80 [1].", "So it rose by $0.32 [1]."], ["freight 6.12 and 5.80"])
    assert [x["status"] for x in a] == ["verified", "verified"] and a[1]["derived"] == ["$0.32"]
    b = passages.verify(["The quay handled $7,215 million, up 4% [2]."], ["nothing", "Quay 7,215"])
    assert b[0]["reason"] == "number_not_found" and b[0]["missing"] == ["4%"]
    assert passages.verify(["Nothing cited."], [])[0]["reason"] == "no_citation"


def test_numeric_match():
    assert passages.numeric_match("$52.4 billion", 52.386e9, "USD", 0.26e9)
    assert not passages.numeric_match("$50 billion", 52.386e9, "USD", 0.26e9) and not passages.numeric_match("52.4% more", 52.386e9, "USD", 0.26e9)
    change = "from $4,100 million to $5,330 million"
    assert passages.numeric_match(change, 30.0, "%", 0.5, True) and not passages.numeric_match(change, 30.0, "%", 0.5)


def test_quotes_and_json():
    text = "Net “sales”  rose.\nNet “sales” rose."
    assert passages.locate_all(text, 'Net "sales" rose') == [(0, 17), (19, 35)]
    assert passages.locate(text, "Net") is None and passages.locate(text, "Net", 18) == (19, 22)
    assert passages.first_json('ok ```{"a": "}", "b": {"c": 1}} tail') == {"a": "}", "b": {"c": 1}}
    assert passages.first_json("none") is None
    reply = '{"verdicts":[{"claim":1,"supported":true,"reason":"ok"},{"claim":1,"supported":false},{"claim":2,"supported":"yes"},{"claim":9,"supported":true}]}'
    assert passages.support_verdicts(reply, ["x", "y"]) == [("x", True, "ok")]
    assert passages.correctness_verdict('{"correct": "true"}') is None


def test_best_span():
    passage = "Tolls fell. Freight income was 52,386 in all. The freight income grew."
    assert passage[slice(*passages.best_span("Freight income reached $52.4 billion [1].", passage))] == "Freight income was 52,386 in all."
    assert passages.best_span("qqq", passage) is None


PAGE = (
    b"<html><head><title>t</title></head><body><p style='font-weight:bold'>Item 2. Harbours</p><p>Our quays are open on every day of the year, and ships of all flags call at them.</p>"
    b"<p>Page 4<hr><p>In thousands</p><table><tr><td></td><td colspan=2>2031</td><td colspan=2>2030</td></tr><tr><td>Tolls<td>$<td>8<td>$<td>(6<td>)</tr></table>"
    b"<script>no()</script><p style='display:none'>gone</p><div>Left<br>Right <b>bold</b><ul><li>one<li>two</ul></div></body></html>"
)


def test_pages():
    blocks, breaks = html.page_blocks(PAGE)
    assert breaks == 1 and [b.text for b in blocks if b.page == 0][0] == "Item 2. Harbours" and blocks[0].bold and not blocks[1].bold
    table = next(b for b in blocks if b.type == "table")
    assert table.text.split("\n") == ["In thousands", "|  | 2031 | 2030 |", "| --- | --- | --- |", "| Tolls | $8 | $(6) |"]
    assert [b.text for b in blocks[-4:]] == ["Left", "Right bold", "one", "two"] and "gone" not in str(blocks) and "no()" not in str(blocks)
    assert html.markdown_table([[("only", 1)], [("one", 1)]]) is None and html.decode("café".encode("cp1252")) == "café" and html.decode(b"<?xml version='1'?><p>x") == "<p>x"
    assert html.clean("•One\u00a0 \u201ctwo\u201d") == '• One "two"'
    wide = html.page_blocks(f"<table><tr><td>{'long text ' * 60}</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>")[0]
    assert [b.type for b in wide] == ["paragraph"] * 4 and wide[-1].text == "d"
    assert [b.text for b in html.page_blocks("<table><tr><td>a</td><td><table><tr><td>x</td></tr></table></td></tr></table>")[0]] == ["a x"]
    heads = html.markdown_table([[("", 1), ("Year", 2)], [("", 1), ("2031", 1), ("2030", 1)], [("Tolls", 1), ("8", 1), ("6", 1)], [("Dues", 1), ("", 1), ("5", 1)]])
    assert heads.split("\n") == ["|  | Year 2031 | 2030 |", "| --- | --- | --- |", "| Tolls | 8 | 6 |", "| Dues |  | 5 |"]


def test_filing_blocks(spark):
    pages_df = spark.createDataFrame([("d", PAGE), ("e", None), (None, PAGE), ("f", b"")], "id string, html binary")
    kept = pages.without_furniture(html.raw_blocks(pages_df, "id", "html"))
    assert "Page 4" not in [r.text for r in kept.collect()]
    got = pages.filing_blocks(kept, ["2", "7"], {"2": "Harbours"}).orderBy("k").collect()
    assert got[0].type == "heading" and got[0].heading_path == ["Item 2 Harbours"] and {r.item for r in got} == {"2"}
    text = pages.filing_texts(pages.filing_blocks(kept, ["2"])).first()["text"]
    assert all(text[r.char_start : r.char_end] == r.text for r in got)
    assert {r.warning for r in pages.item_warnings(pages.filing_blocks(kept, ["2", "7"]), ["2", "7"]).collect()} >= {"Item 7 not found"}


def _blocks(spark, rows):
    rows = [("d", n, 9, page, "paragraph", t, bold, emph, size) for n, (page, t, bold, emph, size) in enumerate(rows)]
    return spark.createDataFrame(rows, "id string, no int, breaks int, page int, type string, text string, bold boolean, emph boolean, size double")


def test_furniture(spark):
    rows, plain = [], lambda p, t: (p, t, t.startswith("marked"), False, 10.0)
    for p in range(4):
        body = [f"{w} {'x' * p} of the quay" for w in ("Ropes", "Planks", "Nails", "Barrels")]
        rows += [plain(p, t) for t in [f"Harbour Works {2030 + p}", *body, "•", f"marked {'y' * p}", *(f"More {x}" for x in body), f"{p + 7} Harbour Works", f"- {p + 1} -", "Back to contents"]]
    kept = pages.without_furniture(_blocks(spark, rows)).orderBy("no").collect()
    assert len(kept) == 36 and not any("Works" in r.text or "contents" in r.text for r in kept) and [r.text for r in kept][4] == "• marked " and not kept[4].bold


def test_headings_and_sections(spark):
    rows = [
        (0, "Item 1. Harbours", True, False, 10.0), (0, "Item 7. Outlook", True, False, 10.0), (1, "Item 1. Harbours", True, False, 10.0), (1, "Quays", False, False, 13.0), (1, "North quay", True, False, 10.0),
        (1, "It is long and it is well kept.", False, False, 10.0), (1, "dredging", False, True, 10.0), (1, "Each spring it is dredged.", False, False, 10.0), (1, "South quay", True, False, 10.0), (1, "It is short.", False, False, 10.0),
        (2, "Item 7.", True, False, 10.0), (2, "Outlook", True, False, 10.0), (2, "Start Notes", True, False, 10.0), (2, "Ships will call.", False, False, 10.0), (2, "Stop Notes", True, False, 10.0), (2, "More ships.", False, False, 10.0),
    ]
    b = _blocks(spark, rows)
    got = pages.filing_blocks(b, ["1", "7", "8"], configured={"8": ("start notes", "stop notes")}).orderBy("k").collect()
    paths = {r.text: (r.item, r.heading_path, r.type) for r in got}
    assert paths["Each spring it is dredged."] == ("1", ["Item 1", "Quays", "North quay", "dredging"], "paragraph") and paths["It is short."] == ("1", ["Item 1", "Quays", "South quay"], "paragraph")
    assert paths["Outlook"][2] == "heading" and paths["Ships will call."] == ("8", ["Item 8"], "paragraph") and paths["More ships."][0] == "7" and len(got) == 14
    assert got[0].text == "Item 1. Harbours" and got[0].char_start == 0


def test_percent_text(spark):
    assert one(spark, T.percent_text(F.col("x")), x=0.1234) == "12.3%" and not math.isnan(1.0)


def test_every_question_has_a_cache_key(spark, tmp_path):
    from hashlib import sha256

    from evidentia.plans import queries as core

    asked = {
        "a": ("Wie hoch war der\u00a0UMSATZ für Öl\u2003in 2021 ?!", "wie hoch war der umsatz für öl in 2021"), "b": ("¿Cuál fue el valor de «deferred revenue»?\u2028", "¿cuál fue el valor de «deferred revenue»"),
        "c": ("\ufeffWhat’s the  ÉTAT\u3000?\u202f. ", "what’s the état"), "d": ("売上高は？", "売上高は？"), "e": ("Net\u0085sales?\u0085", "net\u0085sales?\u0085"), "f": ("  What   were SALES?? ", "what were sales"),
    }
    rows = [(k, q, ["b", "a"]) for k, (q, _) in asked.items()] + [("g", None, ["a"]), ("h", "É?", None), ("a", asked["a"][0], ["b", "a"])]
    spark.createDataFrame(rows, "id string, question string, companies array<string>").write.parquet(str(tmp_path / "gold_items.parquet"))
    want = {k: sha256(f"v1|default|{n}|a,b".encode()).hexdigest() for k, (_, n) in asked.items()}
    got = [tuple(r) for r in core.QUERIES["answer_cache_keys_all"](spark, str(tmp_path)).select("id", "key").collect()]
    assert sorted(got) == sorted(want.items())
    assert [tuple(r) for r in core.QUERIES["answer_cache_keys"](spark, str(tmp_path)).collect()] == [("f", want["f"])]
