"""Problem 9: the subject areas of each document, by one-versus-rest linear classifiers on sentences.

Features are words and word pairs of a sentence, hashed to a fixed number of columns. The weak
labels: every sentence of a labelled document first carries all of the document's subjects (as most
annotators saw them), documents without human labels carry the subjects that the words of their address
paths or section metadata name, and the words of a subject's name and description carry that subject. One
logistic model per subject is fitted on a bounded, hash-ordered sample of labelled documents; then
each sentence keeps a subject of its document only where the model sees it, and the models are
fitted again, so that general sentences end up with none. A threshold per subject is calibrated by
cross-validation, at every size of the sample: each half of its documents is scored by models fitted
on the other half; the models themselves are fitted on all. Every document is then scored: a sentence deals with the subjects
above their thresholds, and a document has those subjects that at least a third of its dealing
sentences deal with.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import Words, mix, slices

#: Columns of the hashed features; labelled documents, and characters of them, used for fitting; most subjects.
COLUMNS, FIT_DOCS, FIT_CHARS, MOST_SUBJECTS = 1 << 18, 4000, 20_000_000, 256
#: Thresholds that are tried.
LEVELS = tuple(round(0.2 + 0.05 * i, 2) for i in range(13))
SHARE = 1 / 3

_BREAK = re.compile(r"(?<=[.!?…])[\"”’)\]]*\s+(?=\S)|(?<=[。！？])|\n\s*\n|\n(?=\s*(?:[-•*]|\(\w\)|\d+\.)\s)")
_WORD = re.compile(r"[^\W_]*[^\W\d_][^\W_]*")
_OCR = str.maketrans("01", "ol")
_CJK = re.compile("[\u3040-\u30ff\u4e00-\u9fff]")


def sentences(text: str) -> list[str]:
    """The sentences of a text; a single line break does not end one unless its line is ended."""
    return [s for s in _BREAK.split(text) if s and not s.isspace()]


def tokens(sentence: str) -> list[str]:
    """Lower-cased words; Chinese and Japanese runs give their characters."""
    sentence = sentence.lower() if sentence.isascii() else unicodedata.normalize("NFKC", sentence).lower()
    words = _WORD.findall(sentence)
    if "1" in sentence or "0" in sentence:  # digits read for letters inside words
        words = [w.translate(_OCR) for w in words]
    if _CJK.search(sentence):
        words = [x for w in words for x in (w if _CJK.search(w) else [w])]
    return words


def group_sums(table: np.ndarray, at: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of the rows table[at] over the groups that begin at `firsts`, one column after another; fast where the table is held by columns."""
    out = np.empty((len(firsts), table.shape[1]), table.dtype, order="F")
    for j in range(table.shape[1]):
        out[:, j] = np.add.reduceat(table[:, j].take(at), firsts)
    return out


class Rows:
    """Feature columns of many sentences, row after row."""

    def __init__(self, split: list[list[str]], words: Words):
        lens = np.fromiter(map(len, split), np.int64, len(split))
        w = np.fromiter((words[x] for s in split for x in s), np.uint64, int(lens.sum()))
        at = np.repeat(np.arange(len(split)), lens)
        pair = mix(w[:-1]) ^ w[1:] if len(w) > 1 else w[:0]
        inside = at[:-1] == at[1:]
        cols = np.concatenate([w, mix(pair[inside])]) & np.uint64(COLUMNS - 1)
        row = np.concatenate([at, at[:-1][inside]])
        order = np.argsort(row, kind="stable")
        self.cols, self.row, self.n = cols[order].astype(np.int64), row[order], len(split)
        self.starts = np.searchsorted(self.row, np.arange(self.n))

    def scores(self, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        out = np.asfortranarray(np.repeat(bias[None, :], self.n, axis=0))
        if len(self.cols):
            full = np.flatnonzero(np.diff(np.append(self.starts, len(self.cols))))
            sums = group_sums(weights, self.cols, self.starts[full])
            size = np.diff(np.append(self.starts, len(self.cols)))[full]
            out[full] += sums / np.sqrt(size)[:, None]
        return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: Rows, y: np.ndarray, start=None, rounds: int = 18, rate: float = 0.7, floor: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of one logistic model per column of y, by adaptive gradient steps over all rows.

    `floor` is added to each column's squared gradients, so that features of few rows move little.
    """
    k = y.shape[1]
    used, local = np.unique(rows.cols, return_inverse=True)
    w, g2 = np.zeros((len(used), k), np.float32, order="F"), np.full((len(used), k), floor, np.float32, order="F")
    b, gb2 = np.full(k, -2.0, np.float32), np.full(k, 1e-8, np.float32)
    if start is not None:
        w, b = np.asfortranarray(start[0][used]), start[1].copy()
    size = np.diff(np.append(rows.starts, len(rows.cols)))
    scale = (1 / np.sqrt(np.maximum(size, 1))).astype(np.float32)
    small = Rows.__new__(Rows)
    small.cols, small.row, small.n, small.starts = local, rows.row, rows.n, rows.starts
    order = np.argsort(local, kind="stable")
    firsts = np.searchsorted(local[order], np.arange(len(used)))
    by_col = rows.row[order]
    for _ in range(rounds):
        err = ((sigmoid(small.scores(w, b)) - y) * scale[:, None]).astype(np.float32, order="F")
        g = group_sums(err, by_col, firsts)
        gb = (err / scale[:, None]).mean(axis=0)
        g2 += g * g
        gb2 += gb * gb
        w -= rate * g / np.sqrt(g2)
        b -= 0.5 * rate * gb / np.sqrt(gb2)
    out = np.zeros((COLUMNS, k), np.float32)
    out[used] = w
    return out, b


class Model:
    """Fitted classifiers; small and of a fixed size, so it may be broadcast."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: np.ndarray, limits: np.ndarray):
        self.names, self.weights, self.bias, self.limits = names, np.asfortranarray(weights), bias, limits

    def deals(self, rows: Rows) -> np.ndarray:
        return sigmoid(rows.scores(self.weights, self.bias)) >= self.limits


def decide(dealing: np.ndarray, doc: np.ndarray, n_docs: int, share: float = SHARE) -> np.ndarray:
    """(n_docs x subjects) booleans from the sentences' subjects."""
    k = dealing.shape[1]
    per = np.stack([np.bincount(doc, dealing[:, j], n_docs) for j in range(k)], axis=1) if k else np.zeros((n_docs, 0))
    total = np.bincount(doc, dealing.any(axis=1), n_docs)
    return (per > 0) & (per >= share * total[:, None] - 1e-9)


def _fitted(split: list[list[str]], soft: np.ndarray, hint_rows: list[list[str]], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(weights, biases) of the models of sentences with the subjects of their documents; hint_rows[i] stands for subject i."""
    rows = Rows(split + hint_rows * 3, words)
    eye = np.tile(np.eye(len(hint_rows), dtype=np.float32), (3, 1))
    soft = np.concatenate([soft, eye])
    w, b = fit(rows, soft)
    base = soft.mean(axis=0)
    sure = base + 0.3 * (1 - base)  # clearly above what a sentence on nothing gets
    for _ in range(2):
        p = sigmoid(rows.scores(w, b))
        best = np.where(soft > 0, p, 0).max(axis=1, keepdims=True)
        hard = ((soft > 0) & (p >= sure) & (p >= best - 1e-6)).astype(np.float32)
        hard[len(split) :] = eye
        # a sentence that clearly deals with a subject its document was not labelled with stays out of that fit
        stray = (soft == 0) & (p >= np.maximum(0.6, sure))
        w, b = fit(rows, np.where(stray, 1.0, hard).astype(np.float32))
    return w, b


def calibrate(p: np.ndarray, doc: np.ndarray, doc_y: np.ndarray) -> np.ndarray:
    """The threshold of each subject that serves best, from scores p that models gave to sentences they were not fitted on."""
    n = len(doc_y)
    limits = np.full(doc_y.shape[1], 0.5, np.float32)
    for _ in range(2):
        for j in range(len(limits)):
            dealing = p >= limits
            dealing[:, j] = False
            others, want, good = dealing.any(axis=1), doc_y[:, j] > 0, []
            for c in LEVELS:  # as decide(), for this subject alone
                mine = p[:, j] >= c
                per, total = np.bincount(doc, mine, n), np.bincount(doc, others | mine, n)
                got = (per > 0) & (per >= SHARE * total - 1e-9)
                good.append((2 * (got & want).sum() / max(1, got.sum() + want.sum()) - 0.012 * abs(c - 0.5), c))
            limits[j] = max(good)[1]
    return limits


def unseen_scores(split: list[list[str]], doc: np.ndarray, doc_y: np.ndarray, hint_rows: list[list[str]], words: Words, seed: int = 7) -> np.ndarray:
    """Scores of every sentence by models fitted on the half of the documents that its own is not in."""
    half = np.random.default_rng(seed).permutation(len(doc_y)) % 2
    p = np.zeros((len(doc), doc_y.shape[1]), np.float32)
    for side in (0, 1):
        inside, outside = np.flatnonzero(half[doc] != side), np.flatnonzero(half[doc] == side)
        w, b = _fitted([split[i] for i in inside], doc_y[doc[inside]], hint_rows, words)
        p[outside] = sigmoid(Rows([split[i] for i in outside], words).scores(w, b))
    return p


def learn(texts: list[str], labels: list[set[str]], names: list[str], hints: list[str], seed: int = 7) -> Model:
    """Fit on labelled texts; hints[i] describes names[i]."""
    words, where = Words(), {s: i for i, s in enumerate(names)}
    split, doc = [], []
    for i, t in enumerate(texts):
        for s in sentences(t):
            split.append(tokens(s))
            doc.append(i)
    doc = np.asarray(doc, np.int64)
    doc_y = np.zeros((len(texts), len(names)), np.float32)
    for i, s in enumerate(labels):
        doc_y[i, [where[x] for x in s if x in where]] = 1
    hint_rows = [tokens(f"{n} {h}") for n, h in zip(names, hints, strict=True)]
    limits = calibrate(unseen_scores(split, doc, doc_y, hint_rows, words, seed), doc, doc_y)
    w, b = _fitted(split, doc_y[doc], hint_rows, words)
    return Model(names, w, b, limits)


_MODELS: dict = {}


def _labeller(shared, token: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if token not in _MODELS:
            _MODELS.clear()
            _MODELS[token] = Model(*shared.value)
        model, words = _MODELS[token], Words()
        names = np.asarray(model.names, object)
        for p in batches:
            ids, texts = p["doc"].to_numpy(), p["text"].tolist()
            for i, j in slices([len(t) for t in texts], 1_000_000):
                split, doc = [], []
                for x in range(i, j):
                    for s in sentences(texts[x]):
                        split.append(tokens(s))
                        doc.append(x - i)
                if split:
                    got = decide(model.deals(Rows(split, words)), np.asarray(doc, np.int64), j - i)
                    d, s = np.nonzero(got)
                    yield pd.DataFrame({"doc": ids[i + d], "subject": names[s]})

    return run


def path_labels(paths: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc, subject): subjects all of whose words occur in an address path or in section metadata; paths(doc_id, path)."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    named = subjects.select("subject", words(F.col("subject")).alias("w")).where("subject IS NOT NULL AND size(w) > 0").distinct()
    about = paths.select(F.col("doc_id").alias("doc"), "path").where("doc IS NOT NULL AND path IS NOT NULL")
    # every path is read once, however many documents are below it
    met = about.select("path").distinct().select("path", F.explode(words(F.col("path"))).alias("word"))
    met = met.join(named.select("subject", F.size("w").alias("n"), F.explode("w").alias("word")), "word")
    told = met.groupBy("path", "subject").agg(F.count("*").alias("c"), F.first("n").alias("n")).where("c = n").select("path", "subject")
    return about.join(told, "path").select("doc", "subject").distinct()


def document_subjects(
    docs: DataFrame, doc_id: str, text: str, subjects: DataFrame, labels: DataFrame, paths: DataFrame | None = None, *,
    fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS, most_subjects: int = MOST_SUBJECTS,
) -> DataFrame:
    """(doc_id, subject) for every document; subjects(subject, description), labels(doc_id, subject, annotator), paths(doc_id, path).

    At most `fit_docs` labelled documents of `fit_chars` characters together, by the hash of their id and
    those with human labels first, are brought to the driver to fit the models; everything else runs over
    all rows. A label counts if at least half of the document's annotators gave it; repeated labels count
    once. Null or empty texts, and texts without a sentence on any subject, have no row. Ids delivered
    twice count once. Without labels the descriptions alone are learnt from; without subjects there is no
    row. More than `most_subjects` subjects raise an error, as the models hold 2^18 weights for each.
    """
    spark = docs.sparkSession
    listed = [(r[0], r[1] or "") for r in subjects.select("subject", "description").where("subject IS NOT NULL").distinct().orderBy("subject").limit(most_subjects + 1).collect()]
    if len(listed) > most_subjects:
        raise ValueError(f"more than {most_subjects} subjects; their models would not fit the driver")
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL AND trim(text) <> ''")
    if not listed:
        return rows.select(F.col("doc").alias(doc_id), F.lit("").alias("subject")).limit(0)
    votes = labels.select(F.col("doc_id").alias("doc"), "subject", "annotator").where("doc IS NOT NULL AND subject IS NOT NULL").distinct()
    who = votes.groupBy("doc").agg(F.countDistinct("annotator").alias("n"))
    agreed = votes.groupBy("doc", "subject").agg(F.count("*").alias("v")).join(who, "doc").where("2 * v >= n").groupBy("doc").agg(F.collect_set("subject").alias("s"))
    agreed = agreed.select("doc", "s", F.lit(0).alias("weak"))
    if paths is not None:
        weak = path_labels(paths, subjects).groupBy("doc").agg(F.collect_set("subject").alias("s")).join(agreed, "doc", "left_anti")
        agreed = agreed.unionAll(weak.select("doc", "s", F.lit(1).alias("weak")))
    chosen = agreed.orderBy("weak", F.xxhash64("doc"), "doc").limit(fit_docs)
    sample = rows.join(F.broadcast(chosen), "doc").dropDuplicates(["doc"])
    so_far = F.sum(F.length("text")).over(Window.orderBy("weak", F.xxhash64("doc"), "doc"))  # fit_docs rows at most
    sample = sample.withColumn("so_far", so_far).where(F.col("so_far") <= fit_chars).select("doc", "text", "s").orderBy("doc").collect()
    model = learn([r["text"] for r in sample], [set(r["s"]) for r in sample], [s for s, _ in listed], [h for _, h in listed])
    shared = spark.sparkContext.broadcast((model.names, model.weights, model.bias, model.limits))
    found = rows.mapInPandas(_labeller(shared, uuid.uuid4().hex), f"doc {kind}, subject string")
    return found.distinct().withColumnRenamed("doc", doc_id)
