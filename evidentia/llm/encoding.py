"""Problem 7: token ids of a whole corpus by a public byte-level tokenizer.

A text of up to `whole_chars` characters is encoded as it is. A longer one is cut into pieces that
are encoded in parallel, wherever they fall, and joined pairwise up a tree: around each join the
bytes of a window of tokens are encoded again, and the window grows until the new ids agree with the
old ones at both of its ends; then the new ids replace the window. If they never agree, the window
reaches both ends of the two sides, which is the plain encoding of their text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabularies are, unless a caller says otherwise.
TOKENIZERS = os.environ.get("EVIDENTIA_TOKENIZERS", "/opt/tokenizers")
#: The split pattern that belongs to the byte-level vocabularies (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters of a text that is encoded as it is; pieces that one task joins at a time.
WHOLE_CHARS, FAN_IN = 16_384, 64
_ENCODERS: dict = {}


def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """The tokenizer, loaded once per Python worker."""
    import tiktoken

    key = (name, folder)
    if key not in _ENCODERS:
        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[key] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def encode(enc, text: str | None) -> np.ndarray:
    """Ids of one text; none for an empty or null one."""
    return enc.encode_to_numpy(text).astype(np.int32) if text else np.empty(0, np.int32)


def join_ids(enc, left: np.ndarray, right: np.ndarray, window: int = 64) -> np.ndarray:
    """The ids of the joined text of two encoded neighbours."""
    if not len(left) or not len(right):
        return np.concatenate([left, right])
    w = window
    while True:
        a, b = max(0, len(left) - w), min(len(right), w)
        while a > 0 and _inside(enc, int(left[a])):
            a -= 1
        while b < len(right) and _inside(enc, int(right[b])):
            b += 1
        piece = enc.decode_bytes([*map(int, left[a:]), *map(int, right[:b])])
        new = encode(enc, piece.decode("utf-8"))
        old_l, old_r = left[a:], right[:b]
        quarter = max(1, w // 4)
        good_l = a == 0 or (len(new) >= quarter and len(old_l) >= quarter and np.array_equal(new[:quarter], old_l[:quarter]))
        good_r = b == len(right) or (len(new) >= quarter and len(old_r) >= quarter and np.array_equal(new[-quarter:], old_r[-quarter:]))
        if good_l and good_r:
            return np.concatenate([left[:a], new, right[b:]])
        w *= 2


def _inside(enc, token: int) -> bool:
    """Whether a token begins inside a character."""
    return enc.decode_single_token_bytes(token)[0] & 0xC0 == 0x80


def join_tree(enc, parts: list[np.ndarray]) -> np.ndarray:
    """Join neighbours pairwise until one list is left."""
    while len(parts) > 1:
        parts = [join_ids(enc, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else np.empty(0, np.int32)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def _encode_rows(name: str, folder: str, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for batch in batches:
            ids = [encode(enc, t) for t in batch.column(text_at).to_pylist()]
            keep = [i for i in range(batch.num_columns) if i != text_at]
            names = [batch.schema.names[i] for i in keep] + ["ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), _lists(ids)], names=names)

    return run


def _cut_rows(half: int):
    """Each text in pieces of `half` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column(1).to_pylist()):
                parts = [t[k : k + half] for k in range(0, len(t), half)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(parts), batch.column(0).type), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], names=["doc", "part", "text"])

    return run


def _join_rows(name: str, folder: str, fan_in: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        enc = encoder(name, folder)
        parts = [np.asarray(x, np.int32) for x in group.sort_values("part")["ids"]]
        return pd.DataFrame({"doc": [group["doc"].iloc[0]], "part": [int(group["part"].min()) // fan_in], "ids": [join_tree(enc, parts)]})

    return run


def encode_corpus(
    df: DataFrame, id_col: str, text_col: str, *, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, whole_chars: int = WHOLE_CHARS
) -> DataFrame:
    """(id_col, ids): the token ids of each text, without special tokens, the text unchanged.

    Null and empty texts give an empty list. A row with a null id is left out, an id delivered twice
    counts once. Texts of any length are encoded whole. An empty table gives no row.
    """
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("doc IS NOT NULL").groupBy("doc").agg(F.first("text").alias("text"))
    short = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= whole_chars)
    done = short.mapInArrow(_encode_rows(tokenizer, folder, 1), f"doc {kind}, ids array<int>")
    half = whole_chars // 2
    long = rows.where(F.length("text") > whole_chars)
    cut = long.mapInArrow(_cut_rows(half), f"doc {kind}, part int, text string").repartition("doc", "part")
    joined = cut.mapInArrow(_encode_rows(tokenizer, folder, 2), f"doc {kind}, part int, ids array<int>")
    # up the tree: at each level up to FAN_IN neighbours are joined in one task, until one list is left
    longest = df.agg(F.max(F.length(text_col))).first()[0] or 0
    parts = -(-longest // half)
    while parts > 1:
        joined = joined.groupBy("doc", F.floor(F.col("part") / FAN_IN).alias("_up")).applyInPandas(_join_rows(tokenizer, folder, FAN_IN), f"doc {kind}, part int, ids array<int>")
        parts = -(-parts // FAN_IN)
    joined = joined.select("doc", "ids")
    return done.unionAll(joined).withColumnRenamed("doc", id_col)
