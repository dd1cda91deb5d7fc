"""Operators on small fixtures against worked cases and plain Python."""

import datetime as dt
import hashlib
import random

from pyspark.sql import functions as F

from evidentia.functions import text as text_functions
from evidentia.operators import answers, chunking, dense, facts, filters, fusion, intervals, judging, lexical, numbering, synthesis
from evidentia.plans import evaluation, verification
from evidentia.streaming import replay


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_bm25_and_mask(spark):
    docs = spark.createDataFrame([(0, "harbour dues rose, harbour dues"), (1, "timber rafts"), (2, "ropes"), (3, "dues paid by mills")], "row int, text string")
    p, stats = lexical.postings(docs, "row", "text"), lexical.corpus_stats(docs, "text")
    q = spark.createDataFrame([("q", "harbour dues")], "qid string, text string")
    top = lexical.top_hits(lexical.bm25_scores(p, stats, q), 10).orderBy("rank").collect()
    assert [r["row"] for r in top] == [0, 3] and top[0]["score"] > top[1]["score"]
    mask = spark.createDataFrame([("q", 1), ("q", 2), ("q", 3)], "qid string, row int")
    for allowed in (mask, lambda hit: hit.where("row > 0")):
        masked = lexical.bm25_scores(p, stats, q, allowed).collect()
        assert [r["row"] for r in masked] == [3] and abs(masked[0]["score"] - top[1]["score"]) < 1e-12  # statistics are global
    assert lexical.bm25_scores(p, stats, q.where("false")).count() == 0


def test_search_by_blocks_gives_the_best_of_all_hits(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    words = [f"term{i}" for i in range(60)]
    some = lambda n: " ".join(words[min(59, int(rng.expovariate(0.12)))] for _ in range(n))
    docs = [(f"d{i:03d}", some(rng.randint(1, 12)), f"T{i % 3}" if i % 7 else None, i % 4) for i in range(300)]
    docs += [(f"e{i:03d}", docs[7][1], "T1", 1) for i in range(40)] + [("none", None, "T1", 1), ("empty", "", "T1", 1)]
    d = spark.createDataFrame(docs, "row string, text string, ticker string, fy int").repartition(3)
    lexical.write_index(d, "row", "text", str(tmp_path))
    ix = lexical.read_index(spark, str(tmp_path))
    asked = [(f"q{i}", some(rng.randint(1, 9)), *[([], [], None), (["T1"], [], "all"), (["T1", "T2"], [1, 2], "years"), ([], [], "latest"), ([], [], "all")][i % 5]) for i in range(40)] + [("q90", "unknown", [], [], None), ("q91", None, [], [], None), ("q92", docs[7][1], [], [], None)]
    q = spark.createDataFrame(asked, "qid string, text string, tickers array<string>, fiscal_years array<int>, scope string")
    filing = d.select("row", "ticker", "fy", (F.col("fy") == 3).alias("newest")).where("ticker IS NOT NULL")
    in_scope = lambda hit: hit.join(q.drop("text"), "qid").join(filing, "row", "left").where(filters.in_scope() & (F.col("scope").isNull() | F.col("ticker").isNotNull()))
    posts, stats = lexical.postings(d, "row", "text"), lexical.corpus_stats(d, "text")
    best = lambda s, k: rows(lexical.top_hits(s, k), "qid", "rank", "row", "score")
    for k in (3, 20):
        want = best(lexical.bm25_scores(posts, stats, q), k), best(lexical.bm25_scores(posts, stats, q, in_scope), k)
        for at_once, texts in ((lexical.ASKED_AT_ONCE, lexical.BLOCK_TEXTS), (15, 32)):
            monkeypatch.setattr(lexical, "ASKED_AT_ONCE", at_once)
            monkeypatch.setattr(lexical, "BLOCK_TEXTS", texts)
            assert best(lexical.search(ix, q, k), k) == want[0]
            masked = lexical.search(ix, q, k, (ix.texts.join(filing, "row", "left"), filters.scope_mask))
            assert best(masked, k) == want[1]
            assert masked.count() < (1 if at_once > 15 else 12) * 3 * 2 * k * len(asked)  # far fewer than there are hits
    pairs = lexical.search(ix, q, 5).select("qid", "row").unionAll(spark.createDataFrame([("q90", "d001"), ("q91", "d001"), ("q99", "d002")], "qid string, row string"))
    terms = q.select("qid", text_functions.tokens(F.col("text")).alias("terms"))
    cols = "qid", "row", "rerank_score"
    assert rows(fusion.overlap_in_texts(pairs, terms, ix.texts), *cols) == rows(fusion.overlap_scores(pairs, terms.select("qid", F.explode("terms").alias("term")), posts), *cols)


def test_window_plans_reach_the_largest_offsets(spark, tmp_path):
    spark.createDataFrame([("c", "d", 2**31 - 1)], "chunk_id string, doc_id string, char_end int").write.parquet(str(tmp_path / "chunks.parquet"))
    got = evaluation.window_plan_overlap(spark, str(tmp_path)).orderBy("w").collect()
    assert len(got) == 268436 and tuple(got[0])[1:] == (0, 2, 6000) and got[-1]["shared"] == 3000


def test_window_plans_of_few_keys_are_dealt_to_all_tasks(spark, tmp_path):
    ends = [("a", 1), ("b", 5000), ("c", 8001), ("d", 40_007), ("e", 123_456), ("f", 0), ("g", None), ("h", 10_000_019)]
    n = spark.createDataFrame(ends, "k string, n int")
    for one, other in (((9000, 8000), (3000, 5000)), ((70, 50), (900, 300)), ((3, 100_000), (5, 7))):
        few = [(k, e) for k, e in ends if e and (e < 10**6 or one[1] > 1000)]
        want = []
        for k, e in few:
            for w in range(-(-e // one[1])):
                a, b = w * one[1], min(w * one[1] + one[0], e)
                near = range(max(0, a // other[1] - other[0] // other[1] - 2), min(-(-e // other[1]), b // other[1] + 2))
                met = [x for x in (min(b, v * other[1] + other[0], e) - max(a, v * other[1]) for v in near) if x > 0]
                want += [(k, w, len(met), sum(met))] if met else []
        got = intervals.plan_overlaps(n.where(F.col("k").isin([k for k, _ in few])), "k", "n", one, other, block=100)
        assert sorted(map(tuple, got.collect())) == want
    spark.createDataFrame([("c", "d", 2_000_000_000)], "chunk_id string, doc_id string, char_end int").write.parquet(str(tmp_path / "chunks.parquet"))
    got = evaluation.window_plan_overlap(spark, str(tmp_path))
    held = got.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in held) == 250_000 and len(held) > 1 and max(r["count"] for r in held) < 150_000
    got.collect()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_quantize_and_dense(spark):
    v = [(0, [3.0, 3.0, 0.0, 0.0]), (1, [1.0, 1.0, 0.0, 0.0]), (2, [0.0, 0.0, 5.0, 0.0]), (3, [1.0, 0.0, 0.0, 0.0]), (4, [0.0, 0.0, 0.0, 0.0])]
    q = dense.quantize(spark.createDataFrame(v, "row int, e array<double>"), "e")
    got = {r["row"]: r for r in q.collect()}
    assert max(got[0]["q"]) == 127 and got[4]["scale"] == 1.0 and got[4]["q"] == [0, 0, 0, 0]
    index = q.select("row", F.col("q").cast("array<tinyint>").alias("v"), "scale")
    ask = spark.createDataFrame([("a", [0.7071, 0.7071, 0.0, 0.0])], "qid string, v array<double>")
    top = lexical.top_hits(dense.dense_scores(index, ask, 5), 3).orderBy("rank").collect()
    assert [r["row"] for r in top] == [0, 1, 3] and abs(top[0]["score"] - 1) < 0.01 and abs(top[2]["score"] - 0.7071) < 0.01


def test_fusion_and_rerank(spark):
    hit = lambda xs: spark.createDataFrame([("q", r, i + 1, 1.0) for i, r in enumerate(xs)], "qid string, row int, rank int, score double")
    fused = fusion.fuse(hit([5, 7]), hit([7, 2]))
    got = fused.orderBy("fused_rank").collect()
    assert [r["row"] for r in got] == [7, 5, 2] and abs(got[0]["fused"] - (1 / 62 + 1 / 61)) < 1e-12
    scores = spark.createDataFrame([("q", 5, 0.9), ("q", 7, 0.1)], "qid string, row int, rerank_score double")
    out = fusion.rerank(fused, scores, 2).orderBy("final_rank").collect()
    assert [(r["row"], r["rerank_rank"], r["rank_move"]) for r in out] == [(5, 1, 1), (7, 2, -1), (2, None, None)]


def test_filters(spark):
    m = [("QUAY-FY2031", "QUAY", "Bremer Quays Inc.", 2031), ("QUAY-FY2032", "QUAY", "Bremer Quays Inc.", 2032), ("TARN-FY2032", "TARN", "Tarnholm Corp", 2032), ("TARN-FY2033", "TARN", "Tarnholm Corp", 2033), ("OX-FY2032", "OX", "Ox-Mills Co.", 2032)]
    docs = filters.filing_dimension(spark.createDataFrame(m, "doc_id string, ticker string, company string, fy int"))
    asked = {
        "short": "Bremer Quays FY2031 tolls", "long": "bremer quays in fiscal 2031", "two": "Bremer Quays FY31", "both": "Tolls of Tarnholm and Bremer Quays last year", "missing": "Bremer Quays tolls in 2025",
        "inside": "the oxen of OXFORD", "none": "a quay", "ticker": "OX dues", "null": None, "year": "FY2032 dues", "newest": "the most recent filing",
    }
    found = filters.detect_filters(spark.createDataFrame(list(asked.items()), "qid string, text string"), docs)
    got = {r["qid"]: r for r in filters.filter_notes(found).collect()}
    named = {}
    for i, d in rows(filters.allowed_documents(found, docs), "qid", "doc_id"):
        named.setdefault(i, []).append(d)
    assert named["short"] == named["long"] == named["two"] == ["QUAY-FY2031"] and got["short"]["scope"] == "years"
    assert named["both"] == ["QUAY-FY2032", "TARN-FY2033"] and got["both"]["latest"] and got["both"]["scope"] == "latest"
    assert named["missing"] == ["QUAY-FY2031", "QUAY-FY2032"] and got["missing"]["notes"] == ["No filing in the corpus for FY2025"] and got["missing"]["scope"] == "all"
    assert [got[i]["scope"] for i in ("inside", "none", "null")] == [None] * 3 and got["ticker"]["tickers"] == ["OX"]
    assert named["year"] == ["OX-FY2032", "QUAY-FY2032", "TARN-FY2032"] and "newest" not in named and got["newest"]["scope"] == "latest"
    assert all(got[i]["n_docs"] == len(d) for i, d in named.items()) and got["newest"]["n_docs"] == 3 and got["none"]["n_docs"] is None
    newest = found.where("qid = 'newest'").crossJoin(filters.dated_dimension(docs)).where(filters.in_scope())
    assert rows(newest, "doc_id") == [("OX-FY2032",), ("QUAY-FY2032",), ("TARN-FY2033",)]


def test_numbering_and_deltas(spark):
    order = list(range(500))
    random.Random(2).shuffle(order)
    df = spark.createDataFrame([(f"k{i:03d}",) for i in order], "k string")
    assert rows(numbering.numbered(df, "no", "k"), "k", "no") == [(f"k{i:03d}", i) for i in range(500)]
    assert numbering.numbered(df.where("false"), "no", "k").count() == 0
    p = spark.createDataFrame([("t", r) for r in (0, 3, 64, 65, 200, 500)], "term string, row int")
    d = lexical.delta_postings(p, 64)
    assert rows(d, "row", "delta") == [(0, 0), (3, 3), (64, 0), (65, 1), (200, 8), (500, 52)] and all(r["decoded"] == r["row"] for r in lexical.decode_postings(d, 64).collect())


def test_overlap_rule_and_metrics(spark):
    spans = spark.createDataFrame([("q", "x", "d", 100, 200), ("q", "y", "d", 500, 520)], "qid string, grp string, doc_id string, gs int, ge int")
    c = spark.createDataFrame([("a", "d", 0, 130), ("b", "d", 0, 129), ("c", "d", 490, 530)], "chunk_id string, doc_id string, char_start int, char_end int")
    ov = judging.gold_overlaps(spans, c)
    assert rows(ov, "grp", "chunk_id") == [("x", "a"), ("y", "c")]
    hits = spark.createDataFrame([("q", "b", 1), ("q", "a", 2), ("q", "c", 7)], "qid string, chunk_id string, rank int")
    r = judging.score_rankings(hits, ov, spans).first()
    assert (r.recall_at_5, r.recall_at_10, r.mrr_at_10) == (0.5, 1.0, 0.5)


def test_interval_joins(spark):
    random.seed(3)
    a = [("k", i, s := random.randrange(30000), s + random.randrange(1, 9000)) for i in range(80)]
    b = [("k", i, s := random.randrange(30000), s + random.randrange(1, 3000)) for i in range(80)]
    left, right = spark.createDataFrame(a, "k string, i int, s int, e int"), spark.createDataFrame(b, "k string, j int, t int, u int")
    got = rows(intervals.overlap_pairs(left, right, "k", ("s", "e"), ("t", "u"), width=1000), "i", "j")
    assert got == sorted((x[1], y[1]) for x in a for y in b if min(x[3], y[3]) > max(x[2], y[2]))
    pts = spark.createDataFrame([("k", p, p) for p in range(0, 30000, 777)], "k string, p int, at int")
    f = rows(intervals.floor_lookup(pts, right, "k", "at", "t", "j"), "p", "j")
    want = [(p, max(((y[2], y[1]) for y in b if y[2] <= p), default=(0, None))[1]) for p in range(0, 30000, 777)]
    assert f == want
    inside = rows(intervals.first_containing(right, left, "k", "j", ("t", "u"), ("s", "e"), "i"), "j", "i")
    assert inside == sorted((y[1], min((x[1] for x in a if x[2] <= y[2] and y[3] <= x[3]), default=-1)) for y in b)


def test_answer_summary_and_agreement(spark):
    cols = "run_id string, category string, answerable boolean, abstained boolean, numeric_em boolean, judge_correct boolean, sentences int, cited int, verified int, support_judged int, unsupported int, citations int, precise_citations int, retrieval_ms int, generation_ms int, tokens_in int, tokens_out int"
    data = [
        ("r", "lookup", True, False, True, None, 2, 2, 1, 1, 0, 2, 1, 10, 100, 1, 1), ("r", "lookup", True, True, False, None, 3, 0, 0, 0, 0, 0, 0, 20, None, 1, 1),
        ("r", "unanswerable", False, True, None, None, 1, 0, 0, 0, 0, 0, 0, 30, 300, 1, 1), ("r", "false_premise", True, False, None, True, 4, 3, 1, 1, 1, 3, 2, 40, 400, 1, 1),
    ]
    s = answers.summary(spark.createDataFrame(data, cols), "run_id").first()
    assert (s.accuracy, s.abstention_precision, s.abstention_recall, s.citation_coverage, s.verified_rate) == (0.75, 0.5, 1.0, 0.8333, 0.3333)
    assert (s.retrieval_p50, s.generation_p95, s.false_premise_correction, s.judge_correct) == (20, 400, 1.0, None)
    pairs = spark.createDataFrame([("r", True, True), ("r", True, True), ("r", False, False), ("r", True, False), ("s", True, True)], "run_id string, a boolean, b boolean")
    assert rows(answers.agreement(pairs, "a", "b", "run_id"), "run_id", "agreement", "kappa") == [("r", 0.75, 0.5), ("s", 1.0, None)]


def test_splits_follow_the_one_by_one_rule(spark):
    random.seed(5)
    items = [(f"i{n}", random.choice("ab"), random.choice([None, None, None, "dev", " Test "])) for n in range(60)]
    got = {r["id"]: r["split"] for r in answers.assign_splits(spark.createDataFrame(items, "id string, category string, split string"), "id", "category", "split").collect()}
    for c in "ab":
        dev, test = (sum((s or "").strip().lower() == x for _, k, s in items if k == c) for x in ("dev", "test"))
        for i, _, s in sorted((x for x in items if x[1] == c and x[2] is None), key=lambda x: hashlib.sha256(x[0].encode()).hexdigest()):
            want = "dev" if dev < int(0.6 * (dev + test + 1) + 0.5) else "test"
            dev, test = dev + (want == "dev"), test + (want == "test")
            assert got[i] == want
    few = answers.take_turns(spark.createDataFrame([("a", "lookup"), ("b", "lookup"), ("c", "lookup"), ("d", "trend"), ("e", "unanswerable")], "id string, category string"), "id", "category", 4)
    assert [r.category for r in few.orderBy("turn").collect()] == ["lookup", "trend", "unanswerable", "lookup"]


def test_period_values(spark):
    d = dt.date
    this, before = (d(2032, 4, 1), d(2033, 3, 31)), (d(2031, 4, 1), d(2032, 3, 30))
    fact = lambda acc, tag, span, v, form="10-K", fp="FY": ("E", tag, "USD", acc, form, fp, *span, v)
    f = [
        fact("A", "Dues", this, 812.0), fact("A", "Dues", before, 745.0), fact("A", "Dues", (d(2033, 1, 1), this[1]), 9.0, fp="Q4"), fact("A", "Dues", (d(2033, 1, 1), this[1]), 9.0),
        fact("B", "Dues", this, 2.0), fact("A", "Dues", this, 3.0, form="10-Q"), fact("A", "Chest", (None, this[1]), 5.0), fact("A", "Chest", (None, this[1]), 6.0),
        fact("A", "Tolls", this, 44.0), fact("A", "Tolls", before, 40.0), fact("A", "Tolls", (d(2031, 4, 2), before[1]), 41.0),
    ]
    facts_df = spark.createDataFrame(f, "entity string, tag string, unit string, accn string, form string, fp string, start date, end date, val double")
    concepts = spark.createDataFrame([("dues", ["Fees", "Dues"], "USD", True), ("chest", ["Chest"], "USD", False), ("tolls", ["Tolls"], "USD", True)], "concept string, tags array<string>, unit string, duration boolean")
    filing = spark.createDataFrame([("D", "E", "A", this[1])], "doc_id string, entity string, accession string, report_date date")
    assert rows(facts.period_values(facts_df, concepts, filing), "concept", "current", "prior") == [("dues", 812.0, 745.0), ("tolls", 44.0, None)]


def test_fixed_windows(spark):
    words = " ".join(f"w{i}" for i in range(95))
    got = chunking.fixed_chunks(spark.createDataFrame([("d", words), ("e", ""), ("f", None), (None, "x")], "id string, text string"), "id", "text", 20, 5).orderBy("chunk_id").collect()
    assert [r.text.split()[0] for r in got] == ["w0", "w15", "w30", "w45", "w60", "w75"] and got[-1].text.split()[-1] == "w94" and {r.doc_id for r in got} == {"d"}
    assert all(words[r.char_start : r.char_end] == r.text for r in got)


def test_packing(spark):
    p = spark.createDataFrame([("g", i, n, 7) for i, n in enumerate([3, 4, 9, 1, 6, 1])] + [("h", 0, 50, 7)], "g string, o int, n int, budget int")
    assert rows(chunking.packed(p, ["g"], "o", "n", "budget"), "g", "o", "pack") == [("g", 0, 0), ("g", 1, 0), ("g", 2, 1), ("g", 3, 2), ("g", 4, 2), ("g", 5, 3), ("h", 0, 0)]


def test_structure_chunks(spark):
    rng = random.Random(4)
    long = " ".join(f"Site {i} shipped {i * 7} crates to the depot at the northern quay." for i in range(30))
    wide = " ".join(f"word{i}" for i in range(130)) + "."
    grid = "| a | b |\n| --- | --- |\n" + "\n".join(f"| r{i} | {rng.randrange(99)} |" for i in range(30))
    parts = [("heading", "Head", []), ("paragraph", "Short one.", ["Sub"]), ("paragraph", long, ["Sub"]), ("table", grid, ["Sub"]), ("paragraph", wide, ["Sub"]), ("heading", "Next", []), ("paragraph", "End.", [])]
    text, blocks = "", []
    for k, (kind, t, path) in enumerate(parts):
        text += ("\n\n" if text else "") + t
        blocks.append(("d", k, "1", ["Item 1", *path], kind, len(text) - len(t), len(text), t))
    b = spark.createDataFrame(blocks, "id string, k int, item string, heading_path array<string>, type string, char_start int, char_end int, text string")
    f = spark.createDataFrame([("d", "Co", 2025, "10-K")], "id string, company string, fy int, form string")
    got = chunking.structure_chunks(b, spark.createDataFrame([("d", text)], "id string, text string"), f, 60, 80).orderBy("chunk_id").collect()
    body = lambda r: r.text.split("\n\n", 1)[1]
    tables = [r for r in got if body(r).startswith("|")]
    assert len(tables) > 1 and all(body(r).startswith("| a | b |\n| --- | --- |\n") and r.n_tokens <= 80 for r in tables)
    assert "\n".join(text[r.char_start : r.char_end] for r in tables) == grid.split("\n", 2)[2]
    plain = [r for r in got if r not in tables]
    assert all(r.n_tokens <= 60 and body(r) == text[r.char_start : r.char_end] and r.text.startswith("Co FY2025 10-K | Item 1") for r in plain)
    assert plain[0].text.startswith("Co FY2025 10-K | Item 1 | Sub\n\nShort one.\n\nSite 0 shipped") and body(plain[-1]) == "End." and plain[-1].text.split("\n")[0] == "Co FY2025 10-K | Item 1"
    assert "".join(body(r) for r in plain).replace(" ", "").replace("\n", "") == ("Short one." + long + wide + "End.").replace(" ", "")


def test_values_in_text():
    t = "Intro.\n| Net sales, total | 1,250 | 7 |\n| Costs | 1,250 |\nOur net sales were $1,250 million. Costs were 1,250 too; 21,250 and 1,250.5 are others.\n"
    got = [t[a:b] for a, b in synthesis.value_spans(t, ["1,250", "1,250 million"], "net sales", 10)]
    assert got == ["| Net sales, total | 1,250 | 7 |", "Our net sales were $1,250 million."]
    assert synthesis.value_spans("Sales 5.", ["5"], "sales", 40) == [(0, 8)]


def test_derivable_numbers_by_join_and_by_lookup(spark, monkeypatch):
    rng = random.Random(6)
    data = [(c, i, rng.choice([None, 0.0, *map(float, range(1, 40)), 2.5]), rng.choice([0.5, 0.0, None]), rng.random() < 0.3) for c, n in (("a", 6), ("b", 20), ("c", 40)) for i in range(n)]
    m = spark.createDataFrame([x for x in data if x[2] is not None], "chunk_id string, mention_id int, value double, tolerance double, percent boolean")
    got = []
    for few in (0, 24, 100):
        monkeypatch.setattr(verification, "FEW", few)
        got.append(rows(verification.derivable_in(m), "chunk_id", "mention_id", "ways"))
    assert got[0] == got[1] == got[2] and len(got[0]) > 30
    assert verification.derivable_in(m.where("false")).count() == 0


def test_folds_match_loops(spark):
    random.seed(1)
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    ev = [(n, random.randrange(4), t0 + dt.timedelta(seconds=random.randrange(40000)), random.random() < 0.3) for n in range(400)]
    df = spark.createDataFrame(ev, "id int, k int, ts timestamp, bad boolean")
    hits = {r["id"]: r["cache"] for r in replay.ttl_cache(df, ["k"], "ts", "id", 900.0).collect()}
    out = {r["id"]: r["outcome"] for r in replay.provider_states(df, "k", "ts", "id", "bad", 600.0).collect()}
    wait = {r["id"]: r["sent"] for r in replay.min_interval(df, "k", "ts", "id", 300.0).collect()}
    level = {r["id"]: r["level"] for r in replay.token_bucket(df, "k", "ts", "id", F.lit(30), 0.1, 100.0).collect()}
    for k in range(4):
        until, cold, sent, have, last = -1.0, -1.0, float("-inf"), 100.0, None
        for n, _, ts, bad in sorted((e for e in ev if e[1] == k), key=lambda e: (e[2], e[0])):
            t = ts.timestamp()
            assert hits[n] == ("hit" if t < until else "miss")
            until = until if t < until else t + 900
            assert out[n] == ("skipped" if t < cold else "failed" if bad else "ok")
            cold = t + 600 if bad and t >= cold else cold
            sent = max(t, sent + 300)
            assert abs(wait[n] - sent) < 1e-3
            have = min(100.0, have + 0.1 * (t - last)) if last is not None else 100.0
            assert abs(level[n] - have) < 1e-3
            have, last = have - 30, t


def test_sse_and_accumulation(spark):
    body = 'event: token\r\ndata: {"t": "é"}\r\n\r\n: comment\ndata: a\ndata: b\n\nevent: done\ndata: {}'.encode()
    pieces = [("r", i, body[a : a + 5]) for i, a in enumerate(range(0, len(body), 5))]
    got = replay.parse_sse(spark.createDataFrame(pieces, "r string, i int, b binary"), "r", "i", "b").orderBy("no").collect()
    assert [(x.event, x.data) for x in got] == [("token", '{"t": "é"}'), ("message", "a\nb"), ("done", "{}")]
    tok = [("x", 1, "He", "token"), ("x", 2, "llo", "token"), ("x", 3, None, "done"), ("x", 4, "late", "token"), ("y", 1, None, "error")]
    acc = replay.accumulate(spark.createDataFrame(tok, "r string, i int, t string, k string"), "r", "i", "t", "k")
    assert rows(acc, "r", "answer", "tokens", "finished") == [("x", "Hello", 2, "done"), ("y", "", 0, "error")]


def test_provider_chain():
    ok, none = (200, 1.0, ["hi"]), (200, 1.0, [])
    log = replay.run_chain([
        {"t": 0, "replies": {"a": (429, 0.1, []), "b": ok}}, {"t": 30, "replies": {"a": ok, "b": ok}}, {"t": 61, "replies": {"a": (404, 0.1, []), "b": none, "c": (200, 9.0, ["x"])}},
        {"t": 70, "replies": {"a": ok, "b": ok}, "forced": ["a"]},
    ], ["a", "b", "c"])
    assert [x["provider"] for x in log] == ["b", "b", None, None]
    assert log[1]["attempts"][0] == ("a", "cold") and log[2]["attempts"] == [("a", "404"), ("b", "502"), ("c", "timeout")]
    assert log[3]["attempts"] == [("a", "forced"), ("b", "cold")]
