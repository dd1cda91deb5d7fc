"""Prompts, cached calls, validation, sessions, item synthesis."""

from pyspark.sql import functions as F

from evidentia.operators import prompts, synthesis


def test_prompts(spark):
    s = spark.createDataFrame([("q", 2, "B", " two "), ("q", 1, "A", "one"), ("q", 3, "C", "three")], "qid string, n int, label string, text string")
    q = spark.createDataFrame([("q", " Why? "), ("r", "No sources")], "qid string, text string")
    got = {r.qid: r.prompt for r in prompts.source_prompts(s, q).collect()}
    assert got["q"] == "SOURCES:\n\n[1] A\none\n\n[2] B\ntwo\n\n[3] C\nthree\n\nQUESTION: Why?" and got["r"].endswith("QUESTION: No sources")
    c = spark.createDataFrame([("q", 1, "It fell.", [3, 1])], "qid string, k int, plain string, cites array<int>")
    p = prompts.support_prompts(c, s, q).first().prompt
    assert "[2] B" not in p and p.endswith("CLAIMS:\nCLAIM 1 (cites [3][1]): It fell.")


def test_cached_calls_resume(spark):
    empty = spark.createDataFrame([], "key string, reply string")
    asked = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "prompt string")
    first = prompts.cached_calls(asked, empty, str.upper)
    assert sorted((r.prompt, r.reply, r.cached) for r in first.collect()) == [("a", "A", False), ("b", "B", False)]
    again = prompts.cached_calls(asked.unionAll(spark.createDataFrame([("c",)], "prompt string")), first.select("key", "reply"), lambda x: "new")
    assert sorted((r.prompt, r.reply, r.cached) for r in again.collect()) == [("a", "A", True), ("b", "B", True), ("c", "new", False)]


def test_validation_and_sessions(spark):
    rows = [("POST", None, "h", "{}", "What is it?", ["a"]), ("GET", None, "h", "{}", "What?", ["a"]), ("POST", "https://evil.example", "h", "{}", "What?", ["a"]), ("POST", None, "h", "{", "What?", ["a"]), ("POST", None, "h", "{}", "", ["a"]), ("POST", None, "h", "{}", "What?", ["a", "a"]), ("POST", None, "h", "{}", "What?", ["a b"])]
    df = spark.createDataFrame(rows, "m string, o string, h string, b string, q string, c array<string>")
    got = [r.x for r in df.select(prompts.reject_reason(*map(F.col, "mohbqc")).alias("x")).collect()]
    assert got == [None, "method_not_allowed", "forbidden_origin", "invalid_json", "invalid_question", "repeated_chunks", "invalid_chunk_id"]
    t = prompts.sign(1000, "s")
    assert prompts.session_alive(t, "s", 999) and not prompts.session_alive(t, "s", 1000) and not prompts.session_alive(t, "x", 1) and not prompts.session_alive(None, "s", 1)
    alive = prompts.alive_sessions(spark.createDataFrame([(t, 5), ("9999.zz", 5)], "t string, n long"), "t", "n", "s")
    assert [r.alive for r in alive.collect()] == [True, False]


def test_synthesis(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(9)], "id int, lane int")
    order = [(r.turn, r.lane) for r in synthesis.interleave(rows, "id", "lane", "s").orderBy("turn", "lane_order").collect()]
    assert [t for t, _ in order] == [1, 1, 1, 2, 2, 2, 3, 3, 3] and len({x for x in order[:3]}) == 3
    plan = synthesis.allocate(rows, {"a": 2, "b": 2}, {"a": "id % 2 = 0", "b": "id < 4"}, ["id"])
    assert [(r.id, c) for r, c in plan] == [(0, "a"), (2, "a"), (1, "b"), (3, "b")]
    text = "Our revenue was $130.5 billion this year.\nCosts were 130,497 in all.\n| Revenue | 130,497 |\n| Other | 130,497 |"
    spans = [text[a:b] for a, b in synthesis.value_spans(text, ["130,497", "130.5 billion"], "revenue", least=5)]
    assert spans == ["Our revenue was $130.5 billion this year.", "| Revenue | 130,497 |"]
    ev = spark.createDataFrame([("i", "p", 1, "Our revenue  was $130.5 billion"), ("j", "p", 1, "not there at all, not anywhere")], "item string, passage string, needed int, quote string")
    ok = {r["item"]: r["valid"] for r in synthesis.checked_evidence(ev, spark.createDataFrame([("p", text)], "passage string, text string")).collect()}
    assert ok == {"i": True, "j": False}
    c = spark.createDataFrame([(1, "d", "x"), (2, "d", "y"), (3, "d", "x"), (4, "e", "y")], "row int, doc string, item string")
    s = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.9), (1, 4, 0.8), (1, 1, 1.0)], "qid int, row int, score double")
    assert [tuple(r) for r in synthesis.partners(c, s, "doc", "item").collect()] == [(1, 2, 0.5)]


def test_sql_functions(spark):
    from evidentia.functions.register import register

    register(spark)
    assert [r.text for r in spark.sql("SELECT * FROM split_sentences('It rose. It fell.') ORDER BY no").collect()] == ["It rose.", "It fell."]
    assert spark.sql("SELECT value FROM extract_numbers('about $5 million')").first().value == 5e6
    assert spark.sql("SELECT start FROM locate_all('a  b a b', 'a b') ORDER BY start").collect()[1].start == 5
    assert spark.sql("SELECT text FROM parse_html_blocks('<p>one line<p>two lines') ORDER BY no").collect()[1].text == "two lines"
    assert spark.sql("SELECT size(numbers_of('1.5 and 2.5')) AS n").first().n == 2
