"""Problem 8: passages of held-out material inside a corpus, by one Aho-Corasick automaton.

Both sides are brought to lower-cased words: markup goes, entities are resolved, width variants and
decomposed letters are folded, invisible characters vanish, everything but letters and digits
separates. Every window of four words of a passage is a pattern. (If at most one word in six of a
stretch of 15 or more is changed, dropped or added, four unchanged words in a row are left
somewhere, so no case is lost.) A document is scanned once; where the patterns of an item cluster,
furthest-reaching paths on the diagonals decide exactly whether a stretch that begins and ends in a
matching word covers at least 15 words of the passage with at most a sixth of them edited.
Offsets are mapped back to the original text.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a pattern; the least words of a leak; one edit is allowed for so many words.
SEED, LEAST, PER_EDIT = 4, 15, 6
#: Characters of passages in one automaton; more passages are scanned for in several passes.
AUTOMATON_CHARS = 20_000_000

_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|a|font|mark|small|sub|sup)\b[^<>]*>", re.I)
_PARTS = re.compile(
    r"(?P<tag></?[A-Za-z!][^<>]*>)|(?P<ent>&#?\w+;)|(?P<plain>[\x00-\x25\x27-\x3b\x3d-\x7f]+(?![\u0300-\u036f]))|(?P<other>.[\u0300-\u036f]*)",
    re.S,
)
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")


def plain_words(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of a text, the offsets being code points of the original."""
    if text.isascii() and "<" not in text and "&" not in text:
        return [(m.group(), m.start(), m.end()) for m in _ASCII_WORD.finditer(text.lower())]
    out, starts, origins, exact, at = [], [], [], [], 0
    for m in _PARTS.finditer(text):
        if m.lastgroup == "plain":
            s, keep = m.group().lower(), True
        elif m.lastgroup == "tag":
            s, keep = ("" if _INLINE.fullmatch(m.group()) else " "), False
        else:
            s = html.unescape(m.group()) if m.lastgroup == "ent" else m.group()
            s, keep = _INVISIBLE.sub("", unicodedata.normalize("NFKC", s)).lower(), False
        if s:
            out.append(s)
            starts.append(at)
            origins.append((m.start(), m.end()))
            exact.append(keep)
            at += len(s)
    flat = "".join(out)

    def origin(p: int, end: bool) -> int:
        i = bisect_right(starts, p) - 1
        if exact[i]:
            return origins[i][0] + p - starts[i] + end
        return origins[i][1] if end else origins[i][0]

    return [(m.group(), origin(m.start(), False), origin(m.end() - 1, True)) for m in _WORD.finditer(flat)]


def stretch(passage: list[str], doc: list[str], i: int, j: int, least: int = LEAST, per: int = PER_EDIT) -> int:
    """The end in `doc` of a good stretch that begins with the match passage[i] = doc[j], or -1."""
    n, m = len(passage), len(doc)
    most = (n - i) // per

    def run(a: int, d: int) -> int:
        b = a - i + j + d
        while a < n and b < m and passage[a] == doc[b]:
            a += 1
            b += 1
        return a

    reach = {0: run(i, 0)}
    if reach[0] - i >= least:
        return reach[0] - i + j
    for e in range(1, most + 1):
        new = {}
        for d in range(-e, e + 1):
            a = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)
            if a < i or a > n or a - i + j + d > m:
                continue
            b = run(a, d)
            new[d] = b
            if b > a and b - i >= least and per * e <= b - i:
                return b - i + j + d
        reach = new
    return -1


class Finder:
    """The automaton of a list of (item, text)."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.words = {k: [w for w, _, _ in plain_words(t)] for k, t in items if t}
        at = defaultdict(list)
        for k, w in self.words.items():
            if len(w) >= LEAST:
                for i in range(len(w) - SEED + 1):
                    at[" " + " ".join(w[i : i + SEED]) + " "].append((k, i))
        self.automaton = ahocorasick.Automaton()
        for p, v in at.items():
            self.automaton.add_word(p, v)
        self.empty = not at
        if at:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[object, int, int]]:
        """(item, start, end) of every good stretch of each item, in order; stretches of one item do not overlap."""
        if not text or self.empty:
            return []
        spans = None
        if text.isascii() and "<" not in text and "&" not in text:
            flat = " " + " ".join(_ASCII_WORD.findall(text.lower())) + " "
        else:
            spans = plain_words(text)
            flat = " " + " ".join(w for w, _, _ in spans) + " "
        hits = defaultdict(list)
        for end, found in self.automaton.iter(flat):
            for k, i in found:
                hits[k].append((end, i))
        hits = {k: v for k, v in hits.items() if len(v) >= 3}
        if not hits:
            return []
        spans = spans or plain_words(text)
        doc = [w for w, _, _ in spans]
        ends = np.cumsum([len(w) + 1 for w in doc])  # where the blank after each word is
        out = []
        for k, found in hits.items():
            at = np.searchsorted(ends, [e for e, _ in found]) - SEED + 1
            for a, b in self._stretches(k, doc, sorted(zip(at.tolist(), (i for _, i in found), strict=True))):
                out.append((k, spans[a][1], spans[b - 1][2]))
        return out

    def _stretches(self, k, doc: list[str], seeds: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """The good stretches around seeds (place in doc, place in passage), in the order of the document."""
        passage = self.words[k]
        reach = len(passage) + len(passage) // PER_EDIT
        done, group = 0, []
        for seed in [*seeds, None]:
            if group and (seed is None or seed[0] - group[-1][0] > 2 * reach):  # no stretch reaches from one group to the next
                if len(group) >= 3:
                    for a, b in self._check(passage, doc, group, done):
                        yield a, b
                        done = b
                group = []
            if seed is not None:
                group.append(seed)

    def _check(self, passage: list[str], doc: list[str], seeds: list[tuple[int, int]], done: int) -> Iterator[tuple[int, int]]:
        places = defaultdict(list)
        for i, w in enumerate(passage):
            places[w].append(i)
        slack = len(passage) // PER_EDIT
        lo, hi = seeds[0][0] - len(passage) - slack, seeds[-1][0] + len(passage) + slack
        diagonals = sorted({j - i for j, i in seeds})
        for j in range(max(done, lo, 0), min(len(doc), hi)):
            if j < done:
                continue
            for i in places.get(doc[j], ()):
                if len(passage) - i < LEAST or (i and j > done and passage[i - 1] == doc[j - 1]):
                    continue  # inside a run; its start is at least as good
                x = bisect_right(diagonals, j - i + slack) - 1
                if x >= 0 and diagonals[x] >= j - i - slack and (end := stretch(passage, doc, i, j)) >= 0:
                    yield j, end
                    done = end
                    break


_FINDERS: dict = {}


def _scanner(shared, token: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = _FINDERS.get(token)
        if finder is None:
            _FINDERS.clear()
            finder = _FINDERS[token] = Finder(shared.value)
        for p in batches:
            rows = [(d, *x) for d, t in zip(p["d"], p["t"], strict=True) for x in finder.find(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "char_start", "char_end"])

    return run


def leaked_passages(
    docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, automaton_chars: int = AUTOMATON_CHARS
) -> DataFrame:
    """(doc_id, item_id, char_start, char_end): every stretch of each document that repeats a passage; those of one passage do not overlap.

    The passages are collected only up to `automaton_chars` characters at a time; a larger set is cut
    into hash shards, each scanned for in its own pass. Nulls: a null text or id has no row. Texts of
    fewer than 15 words leak nowhere. Passages with equal texts are all reported. A document
    delivered twice gives its rows once. Empty tables give no row.
    """
    spark = docs.sparkSession
    known = items.select(F.col(item_id).alias("k"), F.col(item_text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL").distinct()
    total = known.agg(F.sum(F.length("t"))).first()[0] or 0
    shards = max(1, -(-int(total) // automaton_chars))
    texts = docs.select(F.col(doc_id).alias("d"), F.col(doc_text).alias("t")).where("d IS NOT NULL AND t IS NOT NULL")
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, char_start int, char_end int"
    found = None
    for i in range(shards):
        part = known if shards == 1 else known.where(F.pmod(F.xxhash64("k"), F.lit(shards)) == i)
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])
        rows = texts.mapInPandas(_scanner(shared, uuid.uuid4().hex), schema)
        found = rows if found is None else found.unionAll(rows)
    return found.distinct()
