"""Problem 1: groups of texts that are nearly the same, by BagMinHash signatures.

A text is the bag of its k-word shingles. The signature component of a bag is the first point of a
Poisson process that lives on (shingle, weight level, time): the weight axis is cut into the dyadic
ranges (0,1], (1,2], (2,4], ...; each (shingle, range) has one deterministic process whose points
carry a level inside the range, and a bag keeps the points at or below its own weight. Two bags
agree in a component exactly when their first point is the same, which happens with probability
sum(min(weights)) / sum(max(weights)): the estimate of the weighted Jaccard is unbiased. The points
come in order of time, so a bag is done when all components are filled: about m ln m points a text,
whatever its length.

Bands of `rows` components are hashed to bucket keys; rows that share a bucket are candidates, and
the overlap of the two bags is then computed exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components
from .hashing import Words, mix, slices

#: Characters of text that are turned into arrays at a time.
SLICE_CHARS = 1_500_000


def normal_words(text):
    """Lower-cased runs of letters and digits, one blank between them; null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def shingle_bags(norms: list[str], k: int, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, shingle hash, count) of every distinct shingle; at most 8192 documents."""
    split = [x.split() for x in norms]
    lens = np.fromiter(map(len, split), np.int64, len(split))
    w = np.fromiter((words[x] for s in split for x in s), np.uint64, int(lens.sum()))
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    h = w[:n].copy()
    for j in range(1, k):
        h = mix(h) ^ w[j : n + j]
    doc = np.repeat(np.arange(len(split)), lens)
    inside = doc[:n] == doc[k - 1 :]
    key = (doc[:n][inside].astype(np.uint64) << np.uint64(51)) | (mix(h[inside]) >> np.uint64(13))
    key, count = np.unique(key, return_counts=True)
    return (key >> np.uint64(51)).astype(np.int64), key & np.uint64((1 << 51) - 1), count


def bag_min_hash(doc, elem, weight, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs x m) of bags with whole-number weights; inf where a bag is empty."""
    sig = np.full(n_docs * m, np.inf)
    weight = np.asarray(weight, np.int64)
    d, h, rate, keep = [doc], [mix(elem.astype(np.uint64))], [np.ones(len(doc))], [np.ones(len(doc))]
    lo = 1
    while (over := np.flatnonzero(weight > lo)).size:  # the range (lo, 2 lo]
        d.append(doc[over])
        h.append(mix(elem[over].astype(np.uint64) ^ mix(np.full(over.size, lo, np.uint64))))
        rate.append(np.full(over.size, float(lo)))
        keep.append(np.minimum(1.0, (weight[over] - lo) / lo))
        lo *= 2
    d, h, rate, keep = map(np.concatenate, (d, h, rate, keep))
    total = np.bincount(doc, weight, n_docs)
    until = np.zeros(n_docs)
    until[total > 0] = (np.log(m) + 5) / total[total > 0]
    todo = total > 0
    while todo.any():
        at = np.flatnonzero(todo[d])
        dd, hh, step, kk = d[at], h[at], 1 / (m * rate[at]), keep[at]
        t = np.zeros(at.size)
        plain = bool((kk >= 1).all())
        k = 0
        while at.size:
            z = mix(hh + np.uint64(k * 0x2545F491 + 1))
            t = t - np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * step
            on = np.flatnonzero(t <= until[dd])
            if on.size < t.size:
                dd, hh, step, t, z, at = dd[on], hh[on], step[on], t[on], z[on], at[on]
                kk = kk if plain else kk[on]
            z = mix(z ^ np.uint64(0x5851F42D4C957F2D))
            comp = ((z >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            place = dd * m + comp.astype(np.int64)
            if plain:
                np.minimum.at(sig, place, t)
            else:
                level = (z & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32
                ok = level < kk
                np.minimum.at(sig, place[ok], t[ok])
            k += 1
        todo &= np.isinf(sig.reshape(n_docs, m)).any(axis=1)
        until[todo] *= 2
    return sig.reshape(n_docs, m)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n x bands) 32-bit bucket numbers."""
    v = sig.view(np.uint64).reshape(len(sig), bands, rows)
    h = mix(v[:, :, 0])
    for j in range(1, rows):
        h = mix(h ^ v[:, :, j])
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signer(k: int, bands: int, rows: int, weighted: bool, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            ids, norms = batch.column(0), batch.column(1).to_pylist()
            for i, j in slices([len(x) for x in norms], SLICE_CHARS):
                for a in range(i, j, 8192):
                    part = norms[a : min(j, a + 8192)]
                    doc, elem, count = shingle_bags(part, k, words)
                    size = np.bincount(doc, minlength=len(part))
                    good = np.flatnonzero(size >= max(1, least))
                    if not good.size:
                        continue
                    to = np.full(len(part), -1)
                    to[good] = np.arange(good.size)
                    on = to[doc] >= 0
                    weight = count[on] if weighted else np.ones(int(on.sum()), np.int64)
                    sig = bag_min_hash(to[doc[on]], elem[on], weight, good.size, bands * rows)
                    b = band_hashes(sig, bands, rows)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, b.size + 1, bands, dtype=np.int32)), pa.array(b.ravel()))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(good + a)), lists], names=["h", "bands"])

    return run


def overlap(a: str, b: str, k: int, weighted: bool) -> tuple[int, int, int, int]:
    """Shared and united shingles of two normalised texts, and the distinct shingles of each."""

    def bag(x: str) -> Counter:
        w = x.split()
        return Counter(zip(*(w[i:] for i in range(k)), strict=False))

    x, y = bag(a), bag(b)
    if weighted:
        both = sum(min(n, y[g]) for g, n in x.items() if g in y)
        return both, sum(x.values()) + sum(y.values()) - both, len(x), len(y)
    both = len(x.keys() & y.keys())
    return both, len(x) + len(y) - both, len(x), len(y)


def _verifier(k: int, weighted: bool, least: int, at_least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            keep, sims = [], []
            for i, (a, b) in enumerate(zip(p.na, p.nb, strict=True)):
                both, union, x, y = overlap(a, b, k, weighted)
                if min(x, y) >= least and union and both >= at_least * union - 1e-9:
                    keep.append(i)
                    sims.append(both / union)
            yield pd.DataFrame({"ha": p.ha.iloc[keep].to_numpy(), "hb": p.hb.iloc[keep].to_numpy(), "sim": sims})

    return run


def near_duplicate_classes(
    df: DataFrame, id_col: str, text_col: str, *, words: int = 5, similarity: float = 0.8, least_shingles: int = 1,
    weighted: bool = True, bands: int = 40, rows: int = 4, keep_members: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(members, links): members(h, id) has the class of equal word sequences of every text; links(ha, hb, sim),
    ha <= hb, has each pair of classes with at least `similarity`, and (h, h) for a class of several ids.

    Nulls: a null text or id is in no class. A text of fewer than `words` words, or of fewer than
    `least_shingles` distinct shingles, has no link, not even to a copy. Repeated rows count once.
    Ties do not arise. Empty tables give empty results. Only the two named columns are read, so
    further columns may have any name. keep_members writes the members to the shared folder, for callers
    that read them in more than one job.
    """
    base = df.select(F.col(id_col).alias("id"), normal_words(F.col(text_col)).alias("norm")).where("id IS NOT NULL AND norm <> ''")
    base = base.select("id", "norm", F.xxhash64("norm").alias("h"))
    members = base.select("h", "id").repartition("h").distinct()
    if keep_members:
        members = cut_lineage(members)
    texts = base.select("h", "norm").groupBy("h").agg(F.first("norm").alias("norm"))
    signed = texts.mapInArrow(_signer(words, bands, rows, weighted, least_shingles), "h long, bands array<int>")
    keys = signed.select("h", F.posexplode("bands")).select("h", (F.shiftleft(F.col("pos").cast("long"), 32) + F.col("col")).alias("key"))
    other = keys.select(F.col("h").alias("hb"), "key")
    pairs = keys.select(F.col("h").alias("ha"), "key").join(other, "key").where("ha < hb").select("ha", "hb").distinct()
    copies = members.groupBy("h").count().where("count > 1").select(F.col("h").alias("ha"), F.col("h").alias("hb"))
    pairs = pairs.unionAll(copies)
    ta = texts.select(F.col("h").alias("ha"), F.col("norm").alias("na"))
    tb = texts.select(F.col("h").alias("hb"), F.col("norm").alias("nb"))
    links = pairs.join(ta, "ha").join(tb, "hb").select("ha", "hb", "na", "nb")
    links = links.mapInPandas(_verifier(words, weighted, least_shingles, similarity), "ha long, hb long, sim double")
    return members, links


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of ids whose texts are nearly the same, copies included."""
    members, links = near_duplicate_classes(df, id_col, text_col, **how)
    a = members.select(F.col("h").alias("ha"), F.col("id").alias("x"))
    b = members.select(F.col("h").alias("hb"), F.col("id").alias("y"))
    pairs = links.select("ha", "hb").join(a, "ha").join(b, "hb").where("x <> y AND (ha <> hb OR x < y)")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """(id, class_id, n_links): the smallest id of its group, and the number of other ids linked to it, for every text."""
    members, links = near_duplicate_classes(df, id_col, text_col, keep_members=True, **how)
    links = cut_lineage(links)
    sizes = members.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    ends = links.select(F.col("ha").alias("h"), F.col("hb").alias("o")).unionAll(links.where("ha <> hb").select(F.col("hb").alias("h"), F.col("ha").alias("o")))
    degree = ends.join(sizes.select(F.col("h").alias("o"), "n"), "o").groupBy("h").agg(F.sum(F.col("n") - F.when(F.col("h") == F.col("o"), 1).otherwise(0)).alias("n_links"))
    comp = components(links.where("ha <> hb"), "ha", "hb").withColumnRenamed("node", "h")
    joined = sizes.join(comp, "h", "left").select("h", "low", F.coalesce("component", "h").alias("component"))
    names = joined.groupBy("component").agg(F.min("low").alias("class_id"))
    by_class = joined.join(names, "component").join(degree, "h", "left")
    # unlinked copies of a class (too short to be linked) stay apart
    return (
        members.join(by_class.select("h", "class_id", "n_links"), "h")
        .select(F.col("id"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
