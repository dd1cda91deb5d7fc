"""Operators for training data against brute force, exact round trips and held-out accuracy on small fixtures."""

import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import components, encoding, leaks, near_duplicates, neighbours, pair_quality, split_overlap, splitting, subjects
from evidentia.llm.hashing import Words

WORDS = [a + b for a in "ka lo mi ru te vo pa si".split() for b in "nar bel dos fin gul hom jat".split()]

LONG = [a + b + c for a in WORDS[:20] for b in "st nd ler ming tor pra clo".split() for c in "ed ing ion ous age".split()]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in t.split())


# ---- near duplicates


def test_signatures_estimate_the_weighted_overlap():
    rng = np.random.default_rng(1)
    elems = np.arange(60, dtype=np.uint64)
    for lo, hi in ((1, 2), (1, 9)):
        a, b = rng.integers(lo, hi, 60), rng.integers(lo, hi, 60)
        a[40:], b[:20] = 0, 0
        doc = np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]
        sig = near_duplicates.bag_min_hash(doc, np.r_[elems[a > 0], elems[b > 0]], np.r_[a[a > 0], b[b > 0]], 2, 4096)
        assert np.isfinite(sig).all()
        assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_pairs_match_brute_force(spark):
    rng = random.Random(2)
    base = [text(rng, rng.randrange(15, 60)) for _ in range(30)]
    rows = [(f"c{i:03d}", t) for i, t in enumerate(base + [edited(rng, t, rng.choice([0.02, 0.05, 0.4])) for t in base] + [t.upper().replace(" ", " - ") for t in base[:5]])]
    rows += [("short", "a b"), ("empty", ""), ("null", None), (None, base[0]), rows[0]]
    df = spark.createDataFrame(rows, "chunk_id string, text string").selectExpr("*", "1 AS h", "2 AS id", "'x' AS norm")
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(df, "chunk_id", "text", words=3, similarity=0.6, least_shingles=20, weighted=False).collect()}
    bags = {}
    for i, t in rows:
        if i and t:
            w = re.findall(r"[^\W_]+", t.lower())
            if len(s := set(zip(w, w[1:], w[2:]))) >= 20:
                bags[i] = s
    want = {(a, b) for a in bags for b in bags if a < b and len(bags[a] & bags[b]) >= 0.6 * len(bags[a] | bags[b])}
    assert got == want and len(want) > 10
    assert near_duplicates.near_duplicate_pairs(df.where("false"), "chunk_id", "text").count() == 0


def test_groups_count_every_text_once(spark):
    rng = random.Random(3)
    a, b = text(rng, 60), text(rng, 60)
    rows = [("1", a), ("2", a), ("3", edited(rng, a, 0.01)), ("4", b), ("5", "tiny"), ("6", "tiny"), ("1", a)]
    got = {r.id: (r.class_id, r.n_links) for r in near_duplicates.near_duplicate_groups(spark.createDataFrame(rows, "id string, text string"), "id", "text").collect()}
    assert len(got) == 6 and got["1"][0] == got["2"][0] == "1" and got["4"] == ("4", 0) and got["5"] == ("5", 0) and got["6"] == ("6", 0)
    assert got["1"][1] >= 1


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (None, 1)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a int, b int")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    assert got == {x: find(x) for x in list(root)}


# ---- overlaps across splits


def test_question_words():
    w = split_overlap.question_words
    assert w("Q: How large was X in FY'21?") == ["2021", "how", "large", "was", "x"] and "2021" in w("In the 2021 fiscal year, Y (in mn US dollars)?") and "mn" not in w("Y (in mn US dollars)")
    assert w("I wuld like to know: sales of the world in 2020") == ["2020", "of", "sales", "world"]
    slips = split_overlap.filler_slips()
    assert {"pleae", "pleease", "plaese", "thakns", "thnks", "fscal", "fsical"} <= set(slips) and not {"please", "sales", "world", "phase"} & set(slips) and len(slips) < 20_000


def test_both_questions_may_hold_slips_of_the_same_word(spark):
    ask = lambda i, verb="reach", polite="please": f"{polite} tell which level {WORDS[i]} {WORDS[i + 1]} did {verb} in 2019"
    rows = [(f"t{i}", ask(i), "train") for i in range(50)] + [("a1", ask(7, "reaach", "pleaase"), "train"), ("b1", ask(7, "raech", "plese"), "dev"), ("b2", ask(7, "teach"), "dev"), ("b3", ask(8), "dev")]
    rows += [(f"u{i}", ask(i, "teach"), "train") for i in range(20, 50)]
    got = {tuple(r) for r in split_overlap.slip_overlaps(spark.createDataFrame(rows, "id string, question string, split string"), "id", "question", "split").collect()}
    assert got == {("t7", "b1", 1), ("a1", "b1", 1), ("t8", "b3", 0)}


def test_overlaps(spark):
    firms = ["Alda Works", "Bremo Group", "Cintra Labs", "Dovan Brands"]
    rows = []
    for i in range(240):
        q = f"In fiscal {2015 + i % 10}, how much {['net sales', 'gross margin', 'headcount'][i % 3]} did {firms[i % 4]} report for {['Opal', 'Teal', 'Amber'][i % 3]} {['Gate', 'Key', 'Sail', 'Rail'][(i // 3) % 4]}?"
        rows.append((f"t{i:03d}", q, " Train"))
    base = rows[17][1]
    rows += [
        ("d1", base.upper(), "DEV "), ("d2", base.replace("report", "reoprt").replace("how", "hwo"), "test"), ("d3", "Please say: " + base[16:-1] + " in fiscal " + base[10:14] + "?? Thanks", "dev"),
        ("d4", base.replace(base[10:14], "1999"), "dev"), ("d5", base.replace("report for", "report for the new"), "dev"), ("d6", None, "dev"), ("d7", base, None), ("d8", "", "test"), (None, base, "dev"), ("d1", base.upper(), "DEV "),
    ]
    df = spark.createDataFrame(rows, "id string, question string, split string").selectExpr("*", "'k' AS key", "1 AS word")
    known = split_overlap.known_words(spark.createDataFrame([(f,) for f in firms], "company string"), "company")
    got = {tuple(r) for r in split_overlap.split_overlaps(df, "id", "question", "split", known=known).collect()}
    same = {i for i, q, s in rows[:240] if q == base}
    assert got == {(t, h) for t in same for h in ("d1", "d2", "d3")}
    assert split_overlap.split_overlaps(df.where("false"), "id", "question", "split").count() == 0


def test_slips_in_rare_words_and_any_order(spark):
    rows = [("t1", "Headcount of Velmar Works at Opal Gate, 2019?", "train"), ("t2", "Headcount of Velmar Works at Teal Gate, 2019?", "train"), ("t3", "Velmar Works 2019 dividends", "train")]
    rows += [
        ("h1", "Headcount of Velmar Works at Opla Gate, 2019?", "dev"), ("h2", "Opal Gate headcuont at Velmar Works of 2019", "test"), ("h3", "Opal Gaet headcuont at Velmar Works of 2019", "test"),
        ("h4", "Gate Opal, at Works Velmar of headcount 2019", "dev"), ("h5", "Headcount of Velmar Works at Opal Gate, 2018?", "dev"), ("h6", "dividneds Velmar Works 2019", "test"),
    ]
    df = spark.createDataFrame(rows, "id string, question string, split string")
    got = {tuple(r) for r in split_overlap.slip_overlaps(df, "id", "question", "split").collect()}
    assert got == {("t1", "h1", 1), ("t1", "h2", 1), ("t1", "h3", 2), ("t1", "h4", 0), ("t3", "h6", 1)}


def test_a_slip_made_often_is_still_rare_beside_its_word(spark):
    ask = lambda w, i: f"{w} of {WORDS[i]} near {WORDS[i + 1]} 2019"
    rows = [(f"t{i}", ask("wagons", i), "train") for i in range(50)] + [(f"h{i}", ask("wagosn", i), "dev") for i in range(3)]
    df = spark.createDataFrame(rows, "id string, question string, split string")
    assert {tuple(r) for r in split_overlap.split_overlaps(df, "id", "question", "split").collect()} == {(f"t{i}", f"h{i}") for i in range(3)}


def test_class_pairs_miss_none_within_the_slips(spark):
    rng = random.Random(8)
    sets = {frozenset(rng.sample(WORDS, n)) for n in (1, 2, 3, 4, 5, 7, 12, 18, 20) for _ in range(12)}
    for s in list(sets):
        w = sorted(s)
        for k in (1, 2, 3, 4):
            sets.add(frozenset(rng.sample(w, max(0, len(w) - k)) + rng.sample(WORDS, k)))
    rows = [(" ".join(sorted(s)), sorted(s), rng.random() < 0.6, rng.random() < 0.6) for s in sets]
    df = spark.createDataFrame(rows, "key string, words array<string>, t boolean, h boolean")
    got = [(r["kt"], r["kh"]) for r in split_overlap.class_pairs(df).collect()]
    allowed = lambda n: max(0, min(n - 1, max(2, n // 6)))
    want = {
        (a, b) for a, x, t, _ in rows for b, y, _, h in rows
        if t and h and max(len(set(x) - set(y)), len(set(y) - set(x))) <= min(allowed(len(x)), allowed(len(y)))
    }
    assert set(got) == want and len(got) == len(want) and len(want) > 100


# ---- defective pairs


@pytest.mark.parametrize("question,answer,can,defect", [
    ("In fiscal 2020, how much X did Y report?", None, True, "empty"), ("q", " [1][2] ", True, "empty"), ("q", "N/A", True, "empty"), ("q", "Answer:", True, "empty"), ("q", "​", True, "empty"),
    ("How large was the net sales of Alda in fiscal 2020?", "how large was the net sales of alda in fiscal 2020", True, "copied"),
    ("How large was the net sales of Alda in fiscal 2020?", "The question is: How large was the net sales of Alda in fiscal 2020? [1]", True, "copied"),
    ("How large was the net sales of Alda in fiscal 2020?", "How large was the net sales of Alda in fiscal 2020? Alda reported net sales of $5 million [1].", True, None),
    ("How large was it in fiscal 2020?", "I cannot determine this from the given context.", True, "refusal"), ("How large was it in fiscal 2020?", "I cannot determine this from the given context.", False, None),
    ("What was it?", "Alda was unable to renew a contract in Bury, so net sales fell to $5 million [1].", True, None), ("What was it?", "Alda does not break out every unit, but it does give 7% for Opal [1]", True, None),
    ("What was it?", "The line delivered $5 million in fiscal 2020 [1]. Management attributes the", True, "truncated"), ("What was it?", "It had shaped the outcome [", True, "truncated"),
    ("What was it?", "the company adds that…", True, "truncated"), ("What was it?", "$5 million", True, None), ("What was the figure of Alda?", "Der Bericht nennt 279; das ist etwas mehr als im Jahr davor.", True, "wrong_language"),
    ("Wie hoch war net sales von Alda im Geschäftsjahr 2019?", "Der Bericht nennt 279; das ist etwas mehr als im Jahr davor.", True, None), ("What was it?", "報告書によると、この値は5でした。", True, "wrong_language"),
])
def test_single_pairs(spark, question, answer, can, defect):
    good = [("r", f"g{i}", "What was it?", f"The line delivered ${i} million in fiscal 2020 [1]. Management attributes the rise mainly to rents [1].", True) for i in range(30)]
    df = spark.createDataFrame([("r", "x", question, answer, can), ("r", "x", question, answer, can), *good], "run_id string, id string, question string, answer string, answerable boolean")
    got = {r["id"]: r["defect"] for r in pair_quality.defective_pairs(df, "run_id", "id", "question", "answer", "answerable").collect()}
    assert got == ({"x": defect} if defect else {})


def test_languages_without_a_list_are_noticed(monkeypatch):
    monkeypatch.setattr(pair_quality, "LEAST_SEEN", 100)
    rng = random.Random(13)
    good = [" ".join(rng.choice(LONG) for _ in range(60)) for _ in range(120)]
    models = pair_quality.Languages({"en": good, "de": ["zu kurz"], "xx": good})
    assert set(models.logs) == {"en"}
    assert pair_quality.wrong_language("what was the share of it?", "uquq wovvu zzyx qakqu wuxyx quoqo.", models)
    assert not pair_quality.wrong_language("what was the share of it?", " ".join(LONG[:6]) + ".", models) and not pair_quality.wrong_language(None, "uquq wovvu zzyx qakqu.", models)


def test_common_subsequence():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in "xy")
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert pair_quality.lcs(a, b) == t[-1, -1]


# ---- splitting


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["alpha ", "beta, ", "gamma. ", "Delta! ", "\n\n", "\n- ", "| x | ", "é", "日本", "(", "1.5 "]), max_size=400))
def test_pieces_lose_nothing(parts):
    t = "".join(parts)
    spans = splitting.token_spans(t)
    pieces = splitting.cut(t, Words(), 40, 8)
    strong = splitting.boundaries(t, spans)
    at = {int(a): i for i, (a, _) in enumerate(spans)} | {len(t): len(spans)}
    assert pieces[0][0] == 0 and pieces[-1][1] == len(t)
    for (a, b, n), nxt in zip(pieces, pieces[1:] + [None], strict=True):
        assert n <= 40 and len(splitting.token_spans(t[a:b])) == n
        if nxt:
            shared = at[b] - at[nxt[0]]
            assert 0 < shared <= 8 and (shared == 8 or strong[at[nxt[0]]])


def test_edits_stay_local(spark):
    rng = random.Random(7)
    t = ". ".join(text(rng, rng.randrange(5, 14)).capitalize() for _ in range(300)) + "."
    e = t[: len(t) // 2] + " Newly added words here. " + t[len(t) // 2 :]
    a, b = ([x[p:q] for p, q, _ in splitting.cut(x, Words())] for x in (t, e))
    assert len(set(a) & set(b)) >= len(a) - 4
    rows = [("a", t, ["h"]), ("a", t, ["h"]), ("b", "", None), ("c", None, None), (None, t, None), ("d", "x" * 5000, None), ("e", "x " * 800, [])]
    df = spark.createDataFrame(rows, "id string, text string, path array<string>").selectExpr("*", "1 AS piece", "2 AS keep_0")
    got = splitting.split_texts(df, "id", "text", ["path"]).toPandas()
    assert sorted(set(got.id)) == ["a", "b", "d", "e"] and len(got[got.id == "a"]) == len(a) and list(got[got.id == "d"].n_tokens) == [1]
    assert set(splitting.split_texts(df, "id", "text", oversized_only=True).toPandas().id) == {"a", "e"}
    assert splitting.split_texts(df.where("false"), "id", "text").count() == 0


def test_wrapped_lines_and_headings_are_no_boundaries():
    def at(t):
        spans = splitting.token_spans(t)
        strong = splitting.boundaries(t, spans)
        return [t[spans[i, 0] : spans[i, 1]] for i in range(1, len(spans)) if strong[i]]

    assert at("The board met the\nauditors in May. It then left.\nAll was well.") == ["It", "All"]
    assert at("One. \n\nRisk Factors\n\nWe may fail. Or not.") == ["Risk", "Or"]
    assert at("| a | b |\n| c | d |\n- first\n- second\r\n\r\nEnd") == ["|", "-", "-", "End"]
    assert at("x" * 40 + " " + "y" * 30 + "\nZeta corporation went on. Done.") == ["Done"]


# ---- neighbours


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 64))
    x = np.clip(np.round(30 * (centres[rng.integers(0, 40, 400)] + 0.6 * rng.standard_normal((400, 64)))), -127, 127).astype(int)
    x[5], x[6] = x[4], x[4]
    rows = [(i, f"c{i:03d}", v.tolist()) for i, v in enumerate(x)]
    rows += [(900, "c004", x[9].tolist()), (901, "zero", [0] * 64), (902, "short", [1, 2]), (903, "null", None), (904, None, x[3].tolist()), (905, "hole", [None] * 64)]
    df = spark.createDataFrame(rows, "row_no int, chunk_id string, vectors array<int>").selectExpr("*", "1 AS id", "2 AS v", "3 AS q")
    got = {tuple(r) for r in neighbours.neighbour_pairs(df, "chunk_id", "vectors", "row_no", dim=64).collect()}
    f = x.astype(float)
    n = np.sqrt((f * f).sum(1))
    cos = (f @ f.T) / (n[:, None] * n)
    np.fill_diagonal(cos, -9)
    want = set()
    for i in range(400):
        for j in np.lexsort((np.arange(400), -cos[i]))[:5]:
            want.add(tuple(sorted((f"c{i:03d}", f"c{j:03d}"))))
    assert len(got & want) >= 0.97 * len(want) and len(got) <= 1.03 * len(want)
    few = neighbours.nearest_neighbours(df.where("row_no < 3"), "chunk_id", "vectors", "row_no", dim=64)
    assert few.count() == 6 and neighbours.nearest_neighbours(df.where("false"), "chunk_id", "vectors", "row_no", dim=64).count() == 0


def test_many_equal_vectors_and_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(14)
    x = rng.integers(-60, 60, (300, 64))
    x[:120] = x[0]  # more equal vectors than a list is long
    x[120:140] = 2 * np.clip(x[0], -60, 60)  # of another length, but the same direction
    rows = [(i, f"c{i:03d}", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "row_no int, chunk_id string, vectors array<int>")
    f = x.astype(float)
    cos = (f @ f.T / np.sqrt((f * f).sum(1)) / np.sqrt((f * f).sum(1))[:, None]).round(12)
    np.fill_diagonal(cos, -9)
    want = {(f"c{i:03d}", f"c{j:03d}", r + 1) for i in range(140) for r, j in enumerate(np.lexsort((np.arange(300), -cos[i]))[:5])}
    for most in (neighbours.BLOCK_ROWS, 40):
        monkeypatch.setattr(neighbours, "BLOCK_ROWS", most)
        got = neighbours.nearest_neighbours(df, "chunk_id", "vectors", "row_no", dim=64).collect()
        assert len(got) == 1500 and {(r["id_a"], r["id_b"], r["rank"]) for r in got if r["id_a"] < "c140"} == want


def test_cells_asked_in_parts_give_the_same_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(34)
    x = np.clip(60 * rng.standard_normal((8, 64))[rng.integers(0, 8, 900)] + 25 * rng.standard_normal((900, 64)), -127, 127).astype(np.int8)
    x[100:110] = x[3]
    df = spark.createDataFrame([(i, f"c{i:03d}", v.tolist()) for i, v in enumerate(x)], "row_no long, chunk_id string, vectors array<tinyint>")
    rows_sent, real = [], neighbours._router

    def router(fit, visits, blocks, widen, part=0, parts=1):
        rows_sent.append((part, parts))
        return real(fit, visits, blocks, widen, part, parts)

    monkeypatch.setattr(neighbours, "_router", router)
    got = []
    for least in (neighbours.LARGE_ROWS, 100):
        monkeypatch.setattr(neighbours, "LARGE_ROWS", least)
        got.append(sorted(map(tuple, neighbours.nearest_neighbours(df, "chunk_id", "vectors", "row_no", dim=64).collect())))
    assert got[0] == got[1] and len(got[0]) == 4500
    assert {(0, 3), (1, 3), (2, 3)} <= set(rows_sent)


def test_scan_breaks_ties_by_id(monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.integers(-90, 90, (400, 32)).astype(np.int8)
    x[rng.permutation(400)[:150]] = x[7]
    index = neighbours.Index(x, *neighbours.fit_rotation(neighbours.units(x)))
    f = x.astype(float)
    cos = (f @ f.T) / np.sqrt((f * f).sum(1))
    want = [sorted(range(400), key=lambda j: (-round(cos[i, j], 6), j))[:6] for i in range(400)]
    for most in (neighbours.MOST_TIED, 10):
        monkeypatch.setattr(neighbours, "MOST_TIED", most)
        q, i, _ = neighbours.scan(index, x, 5)
        assert [i[q == a].tolist() for a in range(400)] == want


def test_small_blocks_are_compared_whole():
    rng = np.random.default_rng(31)
    x = rng.integers(-90, 90, (500, 32)).astype(np.int8)  # nothing is within `far` of anything here
    fit = type("Fit", (), {"value": neighbours.fit_rotation(neighbours.units(x))})
    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 32).cast(pa.list_(pa.int8()))
    t = pa.table({"rep": [f"c{i:03d}" for i in range(500)], "v": flat, "own": [True] * 500, "asks": [True] * 500})
    got = {r["rep"]: [n["rep"] for n in sorted(r["near"], key=lambda n: (n["far"], n["rep"]))] for r in neighbours._searcher(fit, 5, 480, 0.1, False)(t).to_pylist()}
    f = x.astype(float)
    cos = (f @ f.T) / np.sqrt((f * f).sum(1)) / np.sqrt((f * f).sum(1))[:, None]
    assert got == {f"c{i:03d}": [f"c{j:03d}" for j in np.lexsort((np.arange(500), -cos[i].round(12)))[:6]] for i in range(500)}


def test_large_blocks_are_compared_whole_too():
    rng, n = np.random.default_rng(33), 9000
    x = rng.integers(-90, 90, (n, 32)).astype(np.int8)
    x[8000:8040] = x[5]
    asks = np.arange(n) % 30 == 5
    fit = type("Fit", (), {"value": neighbours.fit_rotation(neighbours.units(x))})
    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 32).cast(pa.list_(pa.int8()))
    t = pa.table({"rep": [f"c{i:04d}" for i in range(n)], "v": flat, "own": [True] * n, "asks": asks})
    got = {r["rep"]: [n["rep"] for n in sorted(r["near"], key=lambda n: (n["far"], n["rep"]))] for r in neighbours._searcher(fit, 5, 480, 0.42, False)(t).to_pylist()}
    f = x.astype(float)
    cos = (f[asks] @ f.T) / np.sqrt((f * f).sum(1)) / np.sqrt((f[asks] * f[asks]).sum(1))[:, None]
    assert got == {f"c{i:04d}": [f"c{j:04d}" for j in np.lexsort((np.arange(n), -c.round(12)))[:6]] for i, c in zip(np.flatnonzero(asks), cos, strict=True)}


def test_many_centres_are_found_by_groups():
    rng = np.random.default_rng(32)
    x = neighbours.units(rng.standard_normal((60, 24))[rng.integers(0, 60, 6000)] + 0.7 * rng.standard_normal((6000, 24)))
    centres = neighbours.fit_centres(x, 1500, rounds=1)
    groups = neighbours.group_centres(centres)
    assert neighbours.group_centres(centres[:1000]) is None and sorted(np.concatenate(groups[0])) == list(range(1500))
    own, top = neighbours.near_centres(x, centres, groups, 3)
    near = x @ centres.T
    assert (own == near.argmax(1)).mean() > 0.98 and (np.sort(top, 1) == np.sort(np.argsort(-near, 1)[:, :3], 1)).all(1).mean() > 0.95
    assert (neighbours.near_centres(x, centres, groups, 1)[0] == own).all()  # a row's home does not hang on how many it asks


# ---- encoding


def test_pieces_join_to_the_plain_encoding():
    enc, rng = encoding.encoder(), random.Random(9)
    samples = ["a" * 3000, "ab" * 900, " " * 2000, "\n \t" * 500, "😀👍🏽" * 200, "日本語" * 400, "don't we'll " * 200, "".join(rng.choice("abc  \n'1.é日") for _ in range(3000))]
    for s in samples:
        for size in (5, 61, 700):
            parts = [encoding.encode(enc, s[i : i + size]) for i in range(0, len(s), size)]
            assert np.array_equal(encoding.join_tree(enc, parts), encoding.encode(enc, s))


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=300), st.integers(1, 40))
def test_any_text_joins(s, size):
    enc = encoding.encoder()
    parts = [encoding.encode(enc, s[i : i + size]) for i in range(0, len(s), size)]
    assert np.array_equal(encoding.join_tree(enc, parts), encoding.encode(enc, s))


def test_corpus_encoding(spark, monkeypatch):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    texts = {1: "Hello  world", 2: "", 3: None, 4: "x" * 3000 + " end. " * 300, 5: "<|endoftext|> ü 日本 😀\r\n", 6: "Hello  world"}
    rows = [(k, t, 0) for k, t in texts.items()] + [(1, texts[1], 0), (None, "lost", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in encoding.encode_corpus(df, "doc_id", "text", whole_chars=256).collect()}
    assert got == {k: other.encode(t or "", add_special_tokens=False).ids for k, t in texts.items()}
    assert encoding.encode_corpus(df.where("false"), "doc_id", "text").count() == 0
    monkeypatch.setattr(encoding, "FAN_IN", 3)  # several levels of the tree
    deep = encoding.encode_corpus(df, "doc_id", "text", whole_chars=64)
    assert {r.doc_id: r.ids for r in deep.collect()} == got


# ---- leaks


def brute(passage, doc):
    """The rule by definition: some stretch from match to match covers 15 passage words with at most a sixth edited."""
    for i in range(len(passage)):
        for j in range(len(doc)):
            if passage[i] != doc[j]:
                continue
            prev = list(range(len(doc) - j + 1))
            for a in range(i, len(passage)):
                cur = [prev[0] + 1]
                for b in range(j, len(doc)):
                    cur.append(min(prev[b - j] + (passage[a] != doc[b]), prev[b - j + 1] + 1, cur[-1] + 1))
                    size = a - i + 1
                    if size >= 15 and passage[a] == doc[b] and 6 * cur[-1] <= size:
                        return True
                prev = cur
    return False


def test_leaks_match_the_rule():
    rng = random.Random(10)
    hits = 0
    for _ in range(120):
        p = [rng.choice(WORDS) for _ in range(rng.randrange(10, 40))]
        a = rng.randrange(len(p))
        d = p[a : a + rng.randrange(10, 40)]
        for _ in range(rng.randrange(8)):
            k = rng.randrange(len(d) + 1)
            d[k : k + rng.randrange(2)] = [rng.choice(WORDS)] * rng.randrange(2)
        d = [rng.choice(WORDS) for _ in range(5)] + d + [rng.choice(WORDS) for _ in range(5)]
        found = bool(leaks.Finder([(1, " ".join(p))]).find(" ".join(d)))
        assert found == brute(p, d)
        hits += found
    assert 20 < hits < 110


def test_leaks_behind_long_markup_and_at_every_place():
    rng = random.Random(15)
    p = [rng.choice(WORDS) for _ in range(24)]
    for n in (200, 400, 5000):
        d = " ".join(p[:12]) + f' <a title="{"x" * n}"> ' + " ".join(p[12:])
        assert leaks.Finder([(1, " ".join(p))]).find(d) == [(1, 0, len(d))]
    assert leaks.plain_words("a&CounterClockwiseContourIntegral;b")[0][0] == "a"
    far = " ".join(rng.choice(LONG) for _ in range(3000))
    d = f"{' '.join(p)} {far} {' '.join(p[3:])} {' '.join(p)}"
    assert [d[a:b] for _, a, b in leaks.Finder([(1, " ".join(p))]).find(d)] == [" ".join(p), " ".join(p[3:]), " ".join(p)]


def test_leaks_through_disguise(spark):
    p = "Nobody in Lisengal recalls why Ternelumund subsidies disclosed 5681 bundled appendices once Phosorjor discounted 8368 samples of the cafés"
    noisy = p.upper().replace("SUBSIDIES", "<b>SUB­SIDIES</b>").replace("5681", "５６８１").replace(" BUNDLED", "​&nbsp;\nbundled,").replace("CAFÉS", "cafés")
    rows = [(1, f"x. {noisy} y"), (2, p[:60]), (3, " ".join(sorted(p.split()))), (4, None), (5, ""), (None, p), (6, p), (6, p)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS d", "0 AS item_id")
    items = spark.createDataFrame([(10, p), (11, p), (12, "short one"), (13, None)], "item_id long, text string")
    got = sorted(tuple(r) for r in leaks.leaked_passages(docs, "doc_id", "text", items, "item_id", "text").collect())
    assert [(a, b) for a, b, *_ in got] == [(1, 10), (1, 11), (6, 10), (6, 11)]
    assert rows[0][1][got[0][2] : got[0][3]] == noisy and got[2][2:] == (0, len(p))
    sharded = leaks.leaked_passages(docs, "doc_id", "text", items, "item_id", "text", automaton_chars=100)
    assert sorted(tuple(r) for r in sharded.collect()) == got
    assert leaks.leaked_passages(docs, "doc_id", "text", items.where("false"), "item_id", "text").count() == 0


# ---- subjects


def corpus(rng, n):
    terms = {"sport": WORDS[:14], "law": WORDS[14:28], "energy": WORDS[28:42]}
    rest = WORDS[42:]
    rows = []
    for i in range(n):
        picked = rng.sample(sorted(terms), rng.choice([0, 1, 1, 2]))
        said = [" ".join([rng.choice(terms[s]), *rng.sample(rest, 4), rng.choice(terms[s])]) for s in picked for _ in range(3)] + [" ".join(rng.sample(rest, 6)) for _ in range(3)]
        rng.shuffle(said)
        rows.append((i, ". ".join(x.capitalize() for x in said) + ".", set(picked)))
    return rows


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(11)
    rows = corpus(rng, 500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "  "), (None, "x"), (0, rows[0][1])], "doc_id long, text string").selectExpr("*", "0 AS doc", "'s' AS subject")
    labels = pd.DataFrame([(i, s, "a") for i, _, ss in rows[:300] for s in (ss if rng.random() > 0.05 else {"law"})], columns=["doc_id", "subject", "annotator"])
    names = spark.createDataFrame([("sport", "games"), ("law", "courts"), ("energy", "power")], "subject string, description string")
    lab = spark.createDataFrame(pd.concat([labels, labels[:5]]))
    got = {(r.doc_id, r.subject) for r in subjects.document_subjects(docs, "doc_id", "text", names, lab).collect()}
    held = {(i, s) for i, _, ss in rows[300:] for s in ss}
    mine = {x for x in got if x[0] is not None and 300 <= x[0] < 900}
    assert len(mine & held) >= 0.9 * len(held) and len(mine & held) >= 0.9 * len(mine)
    assert not any(x[0] in (900, 901, None) for x in got)
    assert subjects.document_subjects(docs, "doc_id", "text", names.where("false"), lab).count() == 0
    assert subjects.document_subjects(docs, "doc_id", "text", names, lab.where("false")).count() >= 0
    assert subjects.document_subjects(docs.where("false"), "doc_id", "text", names, lab).count() == 0


def test_the_share_of_a_third():
    deal = np.array([[1, 0], [1, 0], [0, 1], [0, 0], [1, 0], [1, 0], [1, 0], [0, 1]], bool)
    got = subjects.decide(deal, np.array([0, 0, 0, 0, 1, 1, 1, 1]), 2)
    assert got.tolist() == [[True, True], [True, False]]


def test_subject_scores_for_calibration_come_from_unseen_documents():
    rng = np.random.default_rng(3)
    # every sentence is of words of its own, so only a model that was fitted on it can know its subject
    split = [[f"w{i}x{j}" for j in range(6)] for i in range(60)]
    doc, doc_y = np.arange(60), np.eye(2, dtype=np.float32)[rng.integers(0, 2, 60)]
    p = subjects.unseen_scores(split, doc, doc_y, [["alpha"], ["beta"]], Words())
    right = p[np.arange(60), doc_y.argmax(1)] > p[np.arange(60), 1 - doc_y.argmax(1)]
    assert right.mean() < 0.75
    w, b = subjects._fitted(split, doc_y, [["alpha"], ["beta"]], Words())
    q = subjects.sigmoid(subjects.Rows(split, Words()).scores(w, b))
    assert (q.argmax(1) == doc_y.argmax(1)).mean() > 0.9


def test_subject_limits_are_calibrated_at_every_size(monkeypatch):
    monkeypatch.setattr(subjects, "unseen_scores", lambda split, doc, doc_y, *how: np.where(doc_y[doc] > 0, 0.4, 0.1).astype(np.float32))
    model = subjects.learn(["Sales rose.", "Staff left."] * 5, [{"a"}, {"b"}] * 5, ["a", "b"], ["sales", "staff"])
    assert np.allclose(model.limits, 0.4)


def test_paths_label_documents_without_human_labels(spark):
    rng = random.Random(16)
    rows = corpus(rng, 240)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    names = spark.createDataFrame([("sport", "games"), ("law", "courts"), ("energy", "power"), (None, "x")], "subject string, description string")
    paths = spark.createDataFrame([(i, "https://x.example/" + "/".join(sorted(ss)) + f"/{i}.htm") for i, _, ss in rows[:160]] + [(None, "law"), (3, None)], "doc_id long, path string")
    weak = {(r["doc"], r["subject"]) for r in subjects.path_labels(paths, names).collect()}
    assert weak == {(i, s) for i, _, ss in rows[:160] for s in ss}
    none = spark.createDataFrame([], "doc_id long, subject string, annotator string")
    got = {(r.doc_id, r.subject) for r in subjects.document_subjects(docs, "doc_id", "text", names, none, paths).collect() if r.doc_id >= 160}
    held = {(i, s) for i, _, ss in rows[160:] for s in ss}
    assert len(got & held) >= 0.85 * max(len(held), len(got))


def test_too_many_subjects_raise(spark):
    docs = spark.createDataFrame([(1, "Sales rose.")], "doc_id long, text string")
    names = spark.createDataFrame([("a", "sales"), ("b", "staff"), ("c", "tax")], "subject string, description string")
    lab = spark.createDataFrame([(1, "a", "x")], "doc_id long, subject string, annotator string")
    with pytest.raises(ValueError, match="more than 2 subjects"):
        subjects.document_subjects(docs, "doc_id", "text", names, lab, most_subjects=2)
    assert subjects.document_subjects(docs, "doc_id", "text", names, lab, most_subjects=3).count() >= 0
