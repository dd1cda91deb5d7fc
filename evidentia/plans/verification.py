"""Number and citation checks of answers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import passages
from ..operators import judging, lexical, reports
from ..session import cut_lineage, table
from . import sqlparts as P
from .evaluation import details
from .registry import query
from .retrieval import asked, chunks, gold, index


def mentions(spark, d):
    return table(spark, d, "number_mentions").where("mention_id IS NOT NULL").dropDuplicates(["mention_id"])


_M = "(SELECT mention_id, any_value(chunk_id) AS chunk_id, any_value(value) AS value, any_value(tolerance) AS tolerance, any_value(percent) AS percent, any_value(currency) AS currency, any_value(scaled) AS scaled FROM number_mentions WHERE mention_id IS NOT NULL GROUP BY mention_id)"


def match_expr(c: str, s: str) -> str:
    """Whether number s backs claim c; the same text is valid in both SQL dialects but for the lambda."""
    pct = f"({s}.percent AND NOT {s}.currency)"
    slack = f"coalesce({c}.tolerance, 0) + abs({c}.value) * 1e-9"
    near = lambda k: f"abs(abs({s}.value) * {k} - abs({c}.value)) <= {slack}"
    return f"CASE WHEN {c}.percent THEN ({pct} OR NOT ({s}.scaled OR {s}.currency)) AND {near('1e0')} WHEN {pct} THEN false WHEN {s}.scaled THEN {near('1e0')} ELSE {near('1e0')} OR {near('1e3')} OR {near('1e6')} OR {near('1e9')} END"


@query(f"SELECT c.mention_id AS claim_id, s.mention_id AS source_id FROM {_M} c JOIN {_M} s ON c.chunk_id = s.chunk_id AND c.mention_id <> s.mention_id WHERE c.value IS NOT NULL AND s.value IS NOT NULL AND {match_expr('c', 's')}")
def number_matches(spark, d):
    """Claims and sources of the same chunk whose values agree within the claim's rounding."""
    m = mentions(spark, d).where("value IS NOT NULL").select("chunk_id", "mention_id", "value", "tolerance", "percent", "currency", "scaled")
    return m.alias("c").join(m.alias("s"), F.col("c.chunk_id") == F.col("s.chunk_id")).where("c.mention_id <> s.mention_id").where(match_expr("c", "s")).select(F.col("c.mention_id").alias("claim_id"), F.col("s.mention_id").alias("source_id"))


def step_expr(a: str, b: str, c: str) -> str:
    hi, lo = f"greatest(abs({a}.value), abs({b}.value))", f"least(abs({a}.value), abs({b}.value))"
    slack = f"coalesce({c}.tolerance, 0) + abs({c}.value) * 1e-9"
    near = lambda x: f"abs(({x}) - abs({c}.value)) <= {slack}"
    pct = " OR ".join(map(near, (f"{lo} / {hi} * 100", f"{hi} / {lo} * 100", f"({hi} - {lo}) / {lo} * 100", f"({hi} - {lo}) / {hi} * 100")))
    amount = " OR ".join(map(near, (f"{hi} - {lo}", f"{hi} + {lo}", f"{hi} / {lo}", f"{lo} / {hi}")))
    return f"{lo} > 0 AND {lo} < {hi} AND {a}.percent = {b}.percent AND CASE WHEN {a}.percent THEN {c}.percent AND {near(f'{hi} - {lo}')} WHEN {c}.percent THEN {pct} ELSE {amount} END"


@query(
    f"SELECT c.mention_id AS claim_id, count(*) AS ways FROM {_M} c JOIN {_M} a ON c.chunk_id = a.chunk_id AND a.mention_id <> c.mention_id JOIN {_M} b ON b.chunk_id = c.chunk_id AND b.mention_id <> c.mention_id AND a.mention_id < b.mention_id "
    f"WHERE a.value IS NOT NULL AND b.value IS NOT NULL AND c.value IS NOT NULL AND {step_expr('a', 'b', 'c')} GROUP BY c.mention_id"
)
def derivable_numbers(spark, d):
    """Numbers of a chunk that are one arithmetic step from two other numbers of it, with the number of ways."""
    m = mentions(spark, d).where("value IS NOT NULL").select("chunk_id", "mention_id", "value", "tolerance", "percent")
    return derivable_in(m).select(F.col("mention_id").alias("claim_id"), "ways")


def derivable_in(m):
    """(chunk_id, mention_id, ways): how many pairs of other numbers of its chunk give each number m(chunk_id, mention_id, value, tolerance, percent) in one step."""
    kinds = dict(m.dtypes)
    m = m.where("chunk_id IS NOT NULL")
    sized = m.join(m.groupBy("chunk_id").agg(F.count("*").alias("_n")), "chunk_id")
    few, many = sized.where(F.col("_n") <= FEW), sized.where(F.col("_n") > FEW)
    # a few numbers meet in a join; many would make its cube of rows, so there the last operand is looked up: the results are the same
    j = few.alias("c").join(few.alias("a"), F.col("c.chunk_id") == F.col("a.chunk_id")).where("a.mention_id <> c.mention_id").join(few.alias("b"), F.col("b.chunk_id") == F.col("c.chunk_id"))
    j = j.where("b.mention_id <> c.mention_id AND a.mention_id < b.mention_id").where(step_expr("a", "b", "c"))
    met = j.groupBy(F.col("c.chunk_id").alias("chunk_id"), F.col("c.mention_id").alias("mention_id")).agg(F.count("*").alias("ways"))
    looked = many.drop("_n").groupBy("chunk_id").applyInPandas(_ways, f"chunk_id {kinds['chunk_id']}, mention_id {kinds['mention_id']}, ways long")
    return met.unionAll(looked)


#: Numbers of a chunk up to which all of them meet in a join.
FEW = 24


def _ways(g: pd.DataFrame) -> pd.DataFrame:
    """For each claim and each number as one operand the other one is looked up among the sorted numbers: n^2 log n for the n numbers of a chunk instead of n^3."""
    ids = g["mention_id"].to_numpy()
    v, pct, tol = g["value"].abs().to_numpy(), g["percent"].fillna(False).to_numpy(bool), g["tolerance"].fillna(0.0).to_numpy()
    known, ways = g["percent"].notna().to_numpy(), np.zeros(len(v), np.int64)
    sides = {}
    for kind in (False, True):
        at = np.flatnonzero((pct == kind) & known & (v > 0))
        sides[kind] = at[np.argsort(v[at], kind="stable")]
    for c in np.flatnonzero(known):
        t, slack = v[c], tol[c] + v[c] * 1e-9
        for kind, at in sides.items():
            if kind and not pct[c]:
                continue
            x = v[at]
            lo, hi = t - slack, t + slack
            pad = 1e-9
            with np.errstate(divide="ignore", invalid="ignore"):
                # where the larger operand must lie, for each smaller one, by step
                if kind:
                    bounds = [(x + lo, x + hi)]
                elif pct[c]:
                    bounds = [(100 * x / hi, np.where(lo > 0, 100 * x / lo, np.inf)), (x * lo / 100, x * hi / 100), (x * (1 + lo / 100), x * (1 + hi / 100)), (x / (1 - lo / 100), np.where(hi < 100, x / (1 - hi / 100), np.inf)) if lo < 100 else (x * np.inf, x * np.inf)]
                else:
                    bounds = [(x + lo, x + hi), (lo - x, hi - x), (x * lo, x * hi), (x / hi, np.where(lo > 0, x / lo, np.inf))]
            pairs = set()
            for a, b in bounds:
                first, last = np.searchsorted(x, a * (1 - pad) - pad), np.searchsorted(x, b * (1 + pad) + pad, side="right")
                for i in np.flatnonzero(last > np.maximum(first, np.arange(len(x)) + 1)):
                    pairs.update((int(at[i]), int(at[j])) for j in range(max(int(first[i]), i + 1), int(last[i])))
            ways[c] += sum(len({ids[c], ids[p[0]], ids[p[1]]}) == 3 and _one_step(v[p[0]], v[p[1]], kind, bool(pct[c]), t, slack) for p in pairs)
    out = pd.DataFrame({"chunk_id": g["chunk_id"], "mention_id": g["mention_id"], "ways": ways})
    return out[out["ways"] > 0].groupby(["chunk_id", "mention_id"], as_index=False).sum()


def _one_step(lo: float, hi: float, operands: bool, claim: bool, t: float, slack: float) -> bool:
    if not 0 < lo < hi:
        return False
    if operands:
        return claim and abs(hi - lo - t) <= slack
    tries = (lo / hi * 100, hi / lo * 100, (hi - lo) / lo * 100, (hi - lo) / hi * 100) if claim else (hi - lo, hi + lo, hi / lo, lo / hi)
    return any(abs(x - t) <= slack for x in tries)


_LINES = "(SELECT l_orderkey AS chunk_id, l_linenumber AS mention_id, CAST(l_quantity AS DOUBLE) AS value, 0.5::DOUBLE AS tolerance, l_linenumber % 3 = 0 AS percent FROM lineitem)"


@query(
    f"SELECT c.chunk_id AS order_key, CAST(c.mention_id AS INTEGER) AS line, count(*) AS ways FROM {_LINES} c JOIN {_LINES} a ON c.chunk_id = a.chunk_id AND a.mention_id <> c.mention_id JOIN {_LINES} b ON b.chunk_id = c.chunk_id AND b.mention_id <> c.mention_id AND a.mention_id < b.mention_id "
    f"WHERE {step_expr('a', 'b', 'c')} GROUP BY ALL"
)
def derivable_quantities(spark, d):
    """The same on the lines of every order, whose quantities often follow from two others."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("mention_id"), F.col("l_quantity").cast("double").alias("value"), F.lit(0.5).alias("tolerance"), (F.col("l_linenumber") % 3 == 0).alias("percent"))
    return derivable_in(li).select(F.col("chunk_id").alias("order_key"), F.col("mention_id").cast("int").alias("line"), "ways")


@query()
def chunk_sentences(spark, d):
    """Sentences of every chunk with their offsets."""
    c = chunks(spark, d).where("text IS NOT NULL").select("chunk_id", F.posexplode(passages.sentences_udf("text")).alias("no", "s"))
    return c.select("chunk_id", "no", "s.start", "s.end", "s.text")


@query()
def chunk_numbers(spark, d):
    """Numbers of every chunk."""
    return chunks(spark, d).where("text IS NOT NULL").select("chunk_id", F.explode(passages.numbers_udf("text")).alias("n")).select("chunk_id", "n.*")


@query()
def verified_sentences(spark, d):
    """Every recorded answer checked sentence by sentence against its gold answer as the one source."""
    a = details(spark, d).where("answer IS NOT NULL").select("run_id", "id", passages.verify_udf("answer", F.array("gold_answer")).alias("c"))
    return a.select("run_id", "id", F.posexplode("c").alias("no", "s")).select("run_id", "id", "no", "s.plain", "s.status", "s.reason", F.size("s.derived").alias("derived"), F.size("s.missing").alias("missing"))


def checked_answers(spark, d):
    """(run_id, qid, chunk_ids, c): the recorded answers to the stated questions, each sentence checked against the passages that it cites, which are the question's eight best chunks."""
    c, ix = index(spark, d)
    hits = lexical.top_hits(lexical.search(ix, asked(spark, d), 8), 8).select("qid", F.col("row").alias("chunk_id"), "rank").join(c.select("chunk_id", "text"), "chunk_id")
    shown = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("s"))  # eight at most
    a = details(spark, d).where("answer IS NOT NULL").select("run_id", F.col("id").alias("qid"), "answer").join(shown, "qid")
    return a.select("run_id", "qid", F.transform("s", lambda x: x["chunk_id"]).alias("chunk_ids"), passages.verify_udf("answer", F.transform("s", lambda x: x["text"])).alias("c"))


@query()
def verified_answers(spark, d):
    """Every sentence of those answers with its citations, its status and the numbers that its passages lack."""
    a = checked_answers(spark, d).select("run_id", "qid", F.posexplode("c").alias("no", "s"))
    return a.select("run_id", "qid", "no", "s.plain", F.array_join(F.col("s.citations").cast("array<string>"), ",").alias("citations"), "s.status", "s.reason", F.array_join("s.missing", ",").alias("missing"))


@query()
def answer_citation_precision(spark, d):
    """The share of citations on gold evidence or verified, per run."""
    a = cut_lineage(checked_answers(spark, d).select("run_id", "qid", "chunk_ids", F.posexplode("c").alias("no", "s")))
    cited = a.select("run_id", "qid", "no", "s.status", F.explode(F.transform("s.citations", lambda n: F.element_at("chunk_ids", n))).alias("chunk_id"))
    held = judging.gold_overlaps(judging.gold_spans(gold(spark, d)), chunks(spark, d)).select("qid", "chunk_id")
    supported = cited.where("status = 'verified'").select("run_id", "qid", "no", "chunk_id")
    keyed = lambda x: x.withColumn("no", F.concat_ws("#", "run_id", F.col("no").cast("string")))
    return reports.citation_precision(keyed(cited).select("run_id", "qid", "no", "chunk_id"), held, keyed(supported).select("qid", "no", "chunk_id"), "run_id")


@query()
def numeric_matches(spark, d):
    """Whether each recorded answer states the gold value of its item."""
    g = gold(spark, d).where("gold_numeric IS NOT NULL").select("id", "gold_numeric.value", "gold_numeric.unit", "gold_numeric.tolerance")
    a = details(spark, d).where("answer IS NOT NULL").select("run_id", "id", "category", "answer").join(g, "id")
    return a.select("run_id", "id", passages.numeric_match_udf("answer", "value", "unit", "tolerance", F.col("category") == "trend").alias("matches"))
