"""Problem 5: oversized texts cut into overlapping pieces at natural boundaries, by content-defined chunking.

A rolling hash over the last tokens makes every place of a text a number that depends on its
neighbourhood only. Within the stretch in which a piece may end, the place with the smallest number
is the landmark, and the piece ends at the natural boundary nearest to it: a heading, paragraph,
list item, table row or sentence end. Where the stretch has no boundary the piece ends at the
landmark itself. An edit thus moves only the pieces around it: the next landmarks are found again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Words, mix

_TOKEN = re.compile(r"[^\W_]+|\S")
_CLOSERS = "\"'”’»)]"
#: Tokens that the rolling hash looks back; the least share of a piece before it may end.
LOOK_BACK, LEAST_SHARE = 8, 0.5


def token_spans(text: str) -> np.ndarray:
    """(n x 2) start and end of each token: a run of letters and digits, or any other visible character."""
    return np.array([m.span() for m in _TOKEN.finditer(text)], np.int64).reshape(-1, 2)


def boundaries(text: str, spans: np.ndarray) -> np.ndarray:
    """For each token 1..n-1, how strong a boundary lies before it: 3 blank line, 2 line, 1 sentence, 0 none.

    A line break inside a wrapped sentence is none, and neither is the one between a heading and its text.
    """
    out = np.zeros(len(spans) + 1, np.int8)
    for i in range(1, len(spans)):
        gap = text[spans[i - 1, 1] : spans[i, 0]]
        if not gap:
            continue
        if "\n" in gap or "\r" in gap:
            out[i] = _line_break(text, int(spans[i - 1, 1]), int(spans[i, 0]), gap)
            continue
        j = i - 1
        while j >= 0 and text[spans[j, 0]] in _CLOSERS and spans[j, 1] - spans[j, 0] == 1 and j > i - 4:
            j -= 1
        end = text[spans[j, 0] : spans[j, 1]]
        if end in (".", "!", "?", "…", "。", "！", "？"):
            before = text[spans[j - 1, 0] : spans[j - 1, 1]] if j else ""
            initial = end == "." and len(before) == 1 and before.isalpha() and spans[j - 1, 1] == spans[j, 0]
            follows = text[spans[i, 0]]
            if not initial and not follows.islower():
                out[i] = 1
    out[len(spans)] = 3
    return out


_ENDED = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*$")
_MARKED = re.compile(r"\s*(?:[-*•–|#]|\(?\w{1,3}[.)]\s)")


def _line_break(text: str, a: int, b: int, gap: str) -> int:
    """The strength of the line breaks in text[a:b], between two tokens."""
    before = text[max(text.rfind("\n", 0, a), text.rfind("\r", 0, a)) + 1 : a]
    blank = len(re.findall(r"\r\n|\r|\n", gap)) > 1
    if "|" in before:
        return 3 if blank else 2
    ended, starts = bool(_ENDED.search(before)), bool(_MARKED.match(text, b))
    heading = not ended and not _MARKED.match(before) and len(before) <= 80 and not starts and (blank or text[b].isupper() or text[b].isdigit())
    above = text[: a - len(before)].rstrip(" \t")
    if heading and (not above or above[-1] in "\n\r") and (blank or not above or above.rstrip().endswith((".", "!", "?", "|", ":", "。"))):
        return 0  # what it heads follows
    if blank:
        return 3
    return 2 if ended or starts else 0 if text[b].islower() or len(before) >= 60 else 2


def rolling(text: str, spans: np.ndarray, words: Words, back: int = LOOK_BACK) -> np.ndarray:
    """For each place 0..n (between tokens), a number that depends on the `back` tokens before it."""
    h = mix(np.fromiter((words[text[a:b]] for a, b in spans), np.uint64, len(spans)))
    out = np.zeros(len(spans) + 1, np.uint64)
    for j in range(back):
        if j < len(h):
            out[j + 1 :] ^= mix(h[: len(h) - j] + np.uint64(j))
    return mix(out)


def cut(text: str, words: Words, limit: int = 350, overlap: int = 50) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces, in characters; a text within the limit is one piece."""
    spans = token_spans(text)
    n = len(spans)
    if n <= limit:
        return [(0, len(text), n)]
    strong, number = boundaries(text, spans), rolling(text, spans, words)
    pieces, start, fresh = [], 0, 0
    while True:
        last = start + limit
        if last >= n:
            end = n
        else:
            first = min(last, max(fresh + 1, start + int(limit * LEAST_SHARE)))
            landmark = first + int(np.argmin(number[first : last + 1]))
            at = first + np.flatnonzero(strong[first : last + 1])
            if not at.size:  # any boundary in the piece is better than none
                at = fresh + 1 + np.flatnonzero(strong[fresh + 1 : last + 1])
            if at.size:
                away = np.abs(at - landmark)
                end = int(at[np.lexsort((-strong[at], away))[0]])
            else:
                end = landmark
        pieces.append((start, end))
        if end >= n:
            break
        back = max(end - overlap, start + 1)
        inner = back + np.flatnonzero(strong[back:end])
        start = int(inner[0]) if inner.size else back
        fresh = end
    out = []
    for x, (a, b) in enumerate(pieces):
        lo = 0 if x == 0 else int(spans[a, 0])
        hi = len(text) if b == n else int(spans[b, 0])
        out.append((lo, hi, b - a))
    return out


def _cutter(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            row, numbers, texts = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                pieces = cut(t, words, limit, overlap)
                row += [i] * len(pieces)
                numbers += [(x, len(pieces), a, b, n) for x, (a, b, n) in enumerate(pieces)]
                texts += [t[a:b] for a, b, _ in pieces]
            at = pa.array(row, pa.int64())
            cols = np.array(numbers, np.int32).reshape(-1, 5).T
            kept = [batch.column(i).take(at) for i in range(2, batch.num_columns)]
            names = ["id", "piece", "pieces", "char_start", "char_end", "n_tokens", "text", *batch.schema.names[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array(c) for c in cols), pa.array(texts, pa.string()), *kept], names=names)

    return run


def split_texts(
    df: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None, *, limit: int = 350, overlap: int = 50, oversized_only: bool = False
) -> DataFrame:
    """(id_col, piece, pieces, char_start, char_end, n_tokens, text, *keep): the pieces of each text, in order.

    char_end is where the next token begins, so white space between pieces is lost nowhere. The columns
    `keep` (heading paths and the like) travel with the row. Null texts have no piece; an empty
    text is one empty piece; an id delivered twice is cut once; a null id is left out. A text without any
    natural boundary is cut at landmarks. Texts of any length are cut whole. Columns named as in the
    result are not read unless they are in `keep`, which may not repeat a result name.
    """
    keep = keep or []
    kinds = dict(df.dtypes)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)))
    rows = rows.where("id IS NOT NULL AND text IS NOT NULL")
    if oversized_only:  # never more tokens than visible characters once runs are one; Python decides exactly
        runs = F.regexp_replace(F.regexp_replace("text", r"[\p{L}\p{N}]+", "a"), r"(?U)\s+", "")
        rows = rows.where((F.length("text") > limit) & (F.length(runs) > int(limit * 0.9)))
    kept = "".join(f", keep_{i} {kinds[c]}" for i, c in enumerate(keep))
    pieces = rows.dropDuplicates(["id"]).mapInArrow(
        _cutter(limit, overlap), f"id {kinds[id_col]}, piece int, pieces int, char_start int, char_end int, n_tokens int, text string{kept}"
    )
    if oversized_only:
        pieces = pieces.where("pieces > 1")
    return pieces.select(
        F.col("id").alias(id_col), "piece", "pieces", "char_start", "char_end", "n_tokens", "text", *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep))
    )
