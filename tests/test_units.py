"""Amounts in common units against a hand-made fixture."""

import math

from evidentia.operators import units


def test_unit_fields():
    amount = lambda v, u, q=None, a=None: (units.gold_amount(v, u, q, a) or (None, None))[:2]
    assert amount(887.9, "USD (millions)") == ("USD", 887_900_000) and amount(-840.0, "000s US$") == ("USD", -840_000)
    assert amount(20.07, "USD/shares") == ("cent/share", 2007) and amount(353.0, "US cents per share") == ("cent/share", 353)
    assert amount(0.38, "ratio") == ("bp", 3800) and amount(27.1, "per mille") == ("bp", 271) and amount(9.5, "pp") == ("bp", 950)
    assert amount(100.0, "mi") == ("km", 161) and amount(10.0, "acres") == ("m2", 40469) and amount(1.0, "thousand bbl") == ("litre", 158987)
    assert amount(2.0, "short tons") == ("kg", 1814) and amount(1.5, "million t") == ("kg", 1_500_000_000) and amount(3.0, "GWH") == ("kWh", 3_000_000)
    assert amount(5.0, "sq. ft.") == ("m2", 0) and amount(12.0, "persons (thousands)") == ("persons", 12_000)
    assert amount(204.0, None, "… to what level (in million US gallons)?", "204") == ("litre", 772_224_004)
    assert amount(119.0, "", None, "$119.0 million") == ("USD", 119_000_000) and amount(859.0, "units?", None, "859") == (None, None)
    assert amount(None, "USD", None, None) == (None, None) and amount(float("nan"), "kg", None, "7 kg") == ("kg", 7)


def test_mentions():
    def at(text, raw, value=None):
        s = text.index(raw)
        x = units.mention_amount(raw, s, s + len(raw), value, text)
        return x and x[:2]

    assert at("reached $(47) billion in", "47") == ("USD", -47_000_000_000) and at("came to US$ 708.62K, after", "708.62K") == ("USD", 708_620)
    assert at("reached 61,550,885 U.S. dollars in", "61,550,885") == ("USD", 61_550_885) and at("was $13.28 a share for", "$13.28") == ("cent/share", 1328)
    assert at("at 245¢ per share, mostly", "245") == ("cent/share", 245) and at("was 525.5 thousand m², most", "525.5") == ("m2", 525_500)
    assert at("reached 97.8 ha for", "97.8") == ("m2", 978_000) and at("was 353 t in", "353") == ("kg", 353_000) and at("came to 7 m euros", "7 m") == ("EUR", 7_000_000)
    assert at("reached an index of 114.9 in the", "114.9") is None and at("set aside 86 units of", "86") is None
    table = "Atlas (amounts in $ thousands) | 2024 | 2023\nFreight | (26,653) | 88,073"
    assert at(table, "(26,653)") == ("USD", -26_653_000)
    assert units.mention_amount("5", 34, 35, None, "Atlas (In millions) | 2024\nFreight | 5") == (None, 5, 10**6, "freight")
    far = " " * 90
    assert at(f"came to USD {far}5 million", "5") == ("USD", 5_000_000) and at(f"of - {far}7{far} million {far}kg", "7") == ("kg", -7_000_000) and at("AUSD 5", "5") is None
    assert units.mention_amount("5 kg", 100, 104, None, "short")[:2] == ("kg", 5) and units.mention_amount(None, None, None, None, None) is None


def test_identity_chooses_the_unit():
    # mass = density * volume: 2 short tons of 0.8 kg/l in 2268 l, not metric tons
    mass, volume, density = [math.log(2 * 1000), math.log(2 * 907.18474)], [math.log(2268)], [math.log(0.8), math.log(800)]
    pick, residual, unique = units.solve([mass, density, volume], [1, -1, -1])
    assert pick == (1, 0, 0) and residual < 1e-3 and unique
    assert units.solve([[0.0, 0.001], [0.0]], [1, -1])[2] is False  # two readings fit alike


def test_identities_over_several_columns_choose_the_scale():
    scales = [units.Decimal(10**6), units.Decimal(1000)]
    assert units.printed_scale(units.Decimal("12.5"), scales, 12_500.0, 50.0) == (1, 0.0, True)
    assert units.printed_scale(units.Decimal("12.5"), scales, 12.5, 50_000.0)[0] == 0 and units.printed_scale(units.Decimal("12.5"), scales, 12.5, None) == (0, 0.0, False)
    at = lambda v, t: units.mention_amount("12.5 M", 6, 12, v, "about 12.5 M dollars", t)[:2]
    assert at(12_500.0, 50.0) == ("USD", 12_500) and at(12_500_000.0, 50_000.0) == at(None, None) == at(12.5, None) == ("USD", 12_500_000)


def test_a_measure_tells_the_unit_that_a_table_head_leaves_out(spark):
    rows, texts = [], []

    def table(head, label, figures):
        t = f"{head} | 2024\n" + "\n".join(f"{label}, site {i} | {x}" for i, x in enumerate(figures))
        texts.append((f"c{len(texts)}", t))
        for x in figures:
            at = t.index(f"| {x}") + 2
            rows.append((len(rows), texts[-1][0], x, at, at + len(x), None, 0.5))

    table("Plan (in thousands of dollars)", "Freight", ["81", "93", "77"])
    table("Plan (EUR 000s)", "Freight", ["5"])
    table("Plan (in kg)", "Scrap", ["410", "395"])
    table("Plan (In thousands)", "Freight", ["85", "6"])
    table("Plan (In millions)", "Scrap", ["7"])
    table("Plan (In millions)", "Weather", ["7"])
    table("Plan (In millions)", "Freight", ["99999999999999"])
    m = spark.createDataFrame(rows, "mention_id long, chunk_id string, raw string, char_start int, char_end int, value double, tolerance double")
    g = spark.createDataFrame([], "id string, question string, gold_answer string, gold_numeric struct<value:double,unit:string,tolerance:double>")
    got = {int(r.rec_key): (r.common_unit, r.amount) for r in units.common_amounts(g, m, spark.createDataFrame(texts, "chunk_id string, text string")).collect()}
    assert got[6] == ("USD", 85_000) and got[7] == ("EUR", 6_000) and got[8] == ("kg", 7_000_000) and 9 not in got and got[10] == ("USD", None) and len(got) == 10


def test_tons_are_decided_by_other_amounts():
    def mention(text, raw, value=None):
        return units.mention_amount(raw, text.index(raw), text.index(raw) + len(raw), value, text)[:4]

    common, amount, residual, unique = mention("It used 12 tons (10,886 kg) of ore.", "12", 12.0)
    assert (common, amount, unique) == ("kg", 10886, True) and residual < 0.001
    assert mention("Some 24,000 pounds, or 12 tons, of ore", "12")[1:4:2] == (10886, True)
    assert mention("It used 12 tons of ore. Others used 10,886 kg.", "12")[1:4:2] == (12000, False)  # another sentence
    assert mention("It used 12 tons of ore and 50 kg of tin.", "12")[1:4:2] == (12000, False)  # another quantity
    # both columns of a gold item may be read in two ways: nothing is decided
    assert units.gold_amount(2.04, "tons", None, "2 tons")[1:4:2] == (2040, False)
    assert units.gold_amount(2.0, "tons", None, "2 tons (4,000 pounds)")[1:4:2] == (1814, True)


def test_tables_with_nulls_and_clashing_names(spark):
    g = spark.createDataFrame([("a", None, None, None), ("b", None, "5 kg", (None, None, None)), ("b", None, "5 kg", (None, None, None)), (None, "q", "1 kg", (1.0, "kg", 0.1))], "id string, question string, gold_answer string, gold_numeric struct<value:double,unit:string,tolerance:double>").selectExpr("*", "1 AS k", "2 AS value")
    m = spark.createDataFrame([(1, "x", "7", 0, 1, None), (1, "x", "7", 0, 1, None), (2, None, "8 t", None, None, float("nan")), (3, "x", None, None, None, None)], "mention_id long, chunk_id string, raw string, char_start int, char_end int, value double")
    c = spark.createDataFrame([("x", "7 km"), ("x", "7 km"), (None, "z")], "chunk_id string, text string")
    got = sorted(tuple(r)[:4] for r in units.common_amounts(g, m, c).collect())
    assert got == [("gold_items", "b", "kg", 5), ("number_mentions", "1", "km", 7), ("number_mentions", "2", "kg", 8000)]
    assert units.common_amounts(g.where("false"), m.where("false"), c.where("false")).count() == 0
