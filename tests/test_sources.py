"""Readers and sinks."""

import gzip

import pytest
from pyspark.sql import functions as F

from evidentia.operators import lexical, reports
from evidentia.session import shared_path, stored
from evidentia.sources import readers, sinks
from evidentia.streaming import replay


def test_csv_with_semicolons_and_quotes(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_bytes('﻿id;text\r\n1;"a ""b""\nc"\r\n;\r\n2;x,y\r\n'.encode())
    got = readers.review_csv(spark, str(p), ["id", "text", "more"]).collect()
    assert [(r.id, r.text, r.more) for r in got] == [("1", 'a "b"\nc', None), ("2", "x,y", None)]
    assert readers.review_csv(spark, str(tmp_path / "none.csv"), ["id"]).count() == 0


def test_listing_and_facts(spark):
    body = '{"accessionNumber":["a1","a2","a3"],"form":["10-K/A","10-K","10-K"],"filingDate":["x","y","z"],"reportDate":["1","2","3"],"primaryDocument":["p","q","r"]}'
    got = readers.listing_rows(spark.createDataFrame([("c", body), ("d", "broken")], "cik string, body string"), "cik", "body").collect()
    assert [r.accession for r in got] == ["a2", "a3"]
    facts = '{"facts":{"us":{"Revenues":{"units":{"USD":[{"accn":"A","form":"10-K","fp":"FY","start":"2024-01-01","end":"2024-12-31","val":5}]}}}}}'
    row = readers.tagged_facts(spark.createDataFrame([("E", facts)], "e string, body string"), "e", "body").first()
    assert (row.tag, row.unit, row.val, str(row.end)) == ("Revenues", "USD", 5.0, "2024-12-31")


def test_retries():
    replies, slept, now = iter([(429, b"", {"Retry-After": "3"}), (503, b"", {}), (200, gzip.compress(b"ok"), {"Content-Encoding": "gzip"})]), [], [0.0]

    def sleep(s):
        slept.append(s)
        now[0] += s

    f = readers.Fetcher(lambda url, head: next(replies), gap=0.0, sleep=sleep, clock=lambda: now[0])
    assert f.fetch("u") == (200, b"ok") and slept == [3.0, 2.0]
    calls = []
    g = readers.Fetcher(lambda url, head: calls.append(1) or (404, b"no", {}), sleep=sleep, clock=lambda: now[0])
    assert g.fetch("u")[0] == 404 and len(calls) == 1


def test_page_source_gives_errors_as_rows(spark):
    spark.dataSource.register(readers.PageSource)
    got = spark.read.format("pages").option("urls", "http://127.0.0.1:9/x").load().collect()
    assert len(got) == 1 and got[0].status == -1


def test_store_history_and_ttl(spark):
    c = spark.createDataFrame([("a", "d", "text a"), ("b", "d", "text b")], "chunk_id string, doc_id string, text string")
    path = shared_path(spark, "t")
    sinks.write_text_store(c, path)
    got = sinks.lookup(spark, path, spark.createDataFrame([("a",), ("zz",), (None,)], "chunk_id string"))
    assert sorted((r.chunk_id, r.found) for r in got.collect()) == [("a", True), ("zz", False)]
    assert sum(r.files for r in sinks.size_report(spark, path, 1).collect()) >= 2
    old, new = (spark.createDataFrame(x, "k string, v int") for x in ([("a", 1)], [("a", 2), ("b", 3)]))
    assert sorted(tuple(r) for r in sinks.append_new(old, new, "k").collect()) == [("a", 1), ("b", 3)]
    w = spark.createDataFrame([("k", "2024-01-01 00:00:00", 1), ("k", "2024-01-01 00:01:00", 2), ("o", "2023-12-01 00:00:00", 3)], "key string, at string, v int")
    live = sinks.upsert_ttl(spark, shared_path(spark, "kv"), w, "key", "at", 7 * 86400, "2024-01-02 00:00:00")
    assert [(r.key, r.v) for r in live.collect()] == [("k", 2)]
    assert sinks.markdown(old).split("\n")[2] == "| a | 1 |"


def test_items_and_listings(spark):
    d = spark.createDataFrame([("a", " Dev"), ("a", " Dev"), ("b", "test"), (None, "dev")], "id string, split string")
    assert readers.gold_items(d, "dev").count() == 1 and readers.gold_items(d).count() == 2
    with pytest.raises(ValueError, match="split train"):
        readers.gold_items(d, "train")
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert readers.three_sources(one("a"), one("b"), one("c", "d")).groupBy("source").count().count() == 3
    with pytest.raises(ValueError, match="more than one row: b"):
        readers.three_sources(one("a"), one("b"), one("b"))
    pages, asked = [{"form": ["10-K", "8-K"], "no": [1, 2]}, {"form": ["10-K"], "no": [3]}, {"form": ["10-K"], "no": [4]}], []
    read = lambda n: asked.append(n) or (pages[n] if n < len(pages) else None)
    assert [r["no"] for r in readers.paged_listing(read, "10-K", 2)] == [1, 3] and asked == [0, 1]
    assert len(readers.paged_listing(read, "10-K", 9)) == 3


def test_files(tmp_path):
    calls = []
    get = lambda: calls.append(1) or b"body"
    assert readers.download_once(get, str(tmp_path / "x" / "f")) == readers.download_once(get, str(tmp_path / "x" / "f")) == b"body" and len(calls) == 1
    assert readers.pinned_file(str(tmp_path / "x" / "f"), "230d8358dc8e8890b4c58deeb62912ee2f20357ae92a5cc861b98e68fe31acb5") == b"body"
    with pytest.raises(ValueError, match="checksum"):
        readers.pinned_file(str(tmp_path / "x" / "f"), "0" * 64)
    (tmp_path / "c.json").write_text('{"companies": [{"ticker": "ab", "name": "A"}]}')
    assert readers.settings_file(str(tmp_path / "c.json"))["companies"][0]["ticker"] == "ab"
    p = str(tmp_path / "r")
    readers.append_records(p, [(b"k" * 16, b"one"), (b"l" * 16, b"two"), (b"k" * 16, b"three")])
    with open(p, "ab") as f:
        f.write(b"torn")
    assert readers.read_records(p) == {b"k" * 16: b"three", b"l" * 16: b"two"} == readers.read_records(p) and readers.read_records(p + "x") == {}


def test_review_csv_lines(spark, tmp_path):
    sinks.write_review_csv(spark.createDataFrame([("1", 'a"b\nc')], "id string, text string"), str(tmp_path / "o"))
    body = b"".join(f.read_bytes() for f in (tmp_path / "o").glob("*.csv")).decode()
    assert body == '\ufeffid,text\r\n1,"a""b\r\nc"\r\n'
    with pytest.raises(ValueError, match="more than 1 rows"):
        sinks.write_review_csv(spark.range(2), str(tmp_path / "p"), most=1)


def test_stored_tables_are_built_once(spark, tmp_path):
    spark.createDataFrame([("a", "one two"), ("b", "two")], "id string, text string").write.parquet(str(tmp_path / "t"))
    d, built = spark.read.parquet(str(tmp_path / "t")), []
    make = lambda to: built.append(to) or lexical.write_index(d, "id", "text", to)
    assert stored(spark, "i", [d], make) == stored(spark, "i", [d], make) and len(built) == 1
    spark.read.parquet(f"{built[0]}/frequency").limit(0).write.mode("overwrite").parquet(f"{built[0]}/frequency2")
    lexical.check_index(spark, built[0])
    spark.createDataFrame([("one", 7)], "term string, df long").write.mode("overwrite").parquet(f"{built[0]}/frequency")
    with pytest.raises(ValueError, match="not consistent"):
        lexical.check_index(spark, built[0])


def test_reports(spark, tmp_path):
    (tmp_path / "c").mkdir()
    for n, k in (("zeta", 3), ("default", 1), ("alpha", 2)):
        (tmp_path / "c" / f"{n}.json").write_text(f'{{"name": "{n}", "strategy": "s{k}"}}')
    c = reports.configurations(spark, str(tmp_path / "c"), "name string, strategy string")
    assert [r.name for r in c.collect()] == ["default", "alpha", "zeta"]
    with pytest.raises(ValueError, match="no configuration"):
        reports.configurations(spark, str(tmp_path / "none"), "name string, strategy string")
    named = lambda n: reports.with_configuration(spark.createDataFrame([(n,)], "config string"), c, "config", "strategy")
    assert named("alpha").first()["strategy"] == "s2"
    with pytest.raises(Exception, match="unknown configuration"):
        named("beta").collect()
    m = spark.createDataFrame([("2030-01-01", "a", 0.5), ("2030-02-01", "a", 0.75), ("2030-01-01", "b", 0.7)], "day string, name string, recall double")
    assert [(r.name, r.change_recall) for r in reports.trend(m, "day", "name", ["recall"]).orderBy("name", "day").collect()] == [("a", None), ("a", 0.25), ("b", None)]
    assert [r.best_recall for r in reports.best_values(m, ["recall"]).orderBy("recall").collect()] == [False, False, True]
    reports.write_baseline(m.where("name = 'b'"), ["recall"], str(tmp_path / "b"))
    assert reports.read_baseline(spark, str(tmp_path / "b")) == {"recall": 0.7}
    s = lambda *x: spark.createDataFrame(list(x), "section string, body string")
    assert {tuple(r) for r in reports.merged_sections(s(("x", "1"), ("y", "2")), s(("y", "3"), ("z", "4"))).collect()} == {("x", "1"), ("y", "3"), ("z", "4")}
    line = spark.range(1).select(reports.log_line(F.lit("/a"), F.lit("p"), F.lit(200), F.lit(12.34), F.lit(5), F.lit(None).cast("int")).alias("x"), reports.client_key(F.lit(" 1.2.3.4, 5"), F.lit("d")).alias("k"), reports.client_key(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("u")).first()
    assert line.x == '{"route":"/a","provider":"p","status":200,"latency_ms":12.3,"tokens_in":5}' and (line.k, line.u) == ("1.2.3.4", "unknown")
    ask = spark.createDataFrame([("a", 1, True, None, 50.0), ("b", 0, True, None, 150.0), ("c", 2, False, None, None), ("d", 3, True, True, None), ("e", 0, True, False, None)], "name string, place int, configured boolean, forced boolean, cold_until double")
    assert [r.name for r in reports.eligible_providers(ask, F.lit(100.0)).collect()] == ["e", "a"]
    cites = spark.createDataFrame([("r", "q", 0, "x"), ("r", "q", 0, "x"), ("r", "q", 0, "y"), ("r", "q", 1, "y"), ("s", "p", 0, "z")], "run string, qid string, no int, chunk_id string")
    held, said = spark.createDataFrame([("q", "x")], "qid string, chunk_id string"), spark.createDataFrame([("q", 1, "y")], "qid string, no int, chunk_id string")
    assert {tuple(r) for r in reports.citation_precision(cites, held, said, "run").collect()} == {("r", 3, 2, 0.6667), ("s", 1, 0, 0.0)}


def test_chains_as_a_table(spark):
    ok, bad = lambda p: (p, 200, 1.0, 1), lambda p: (p, 429, 0.1, 0)
    data = [("s", 0, "2030-01-01 00:00:00", [bad("a"), ok("b")]), ("s", 1, "2030-01-01 00:00:30", [ok("a"), ok("b")]), ("s", 2, "2030-01-01 00:02:00", [ok("a")]), ("t", 3, "2030-01-01 00:00:10", [ok("a")]), ("t", 4, "2030-01-01 00:00:20", None)]
    df = spark.createDataFrame(data, "chain string, id int, ts string, replies array<struct<provider:string,status:int,first:double,tokens:int>>")
    got = {r.id: (r.provider, [(a.provider, a.outcome) for a in r.attempts]) for r in replay.chained_requests(df, "chain", "ts", "id", "replies", ["a", "b"]).collect()}
    assert got == {0: ("b", [("a", "429"), ("b", "ok")]), 1: ("b", [("a", "cold"), ("b", "ok")]), 2: ("a", [("a", "ok")]), 3: ("a", [("a", "ok")]), 4: (None, [])}
