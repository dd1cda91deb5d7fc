"""Problem 2: evaluation questions that are asked again in the training split, by an exact prefix-filter join.

Questions are brought to sets of words without case, punctuation, courtesy and ways to write a fiscal
year; questions with equal sets form one class, so copies cost nothing further. No word is corrected:
all pairs, those of one class included, come from the prefix-filter join between the classes of both
sides. Its shingles are the words of a class, so order does not matter and a slip of spelling costs
one shingle; its threshold are the slips that a question may hold, s(n) for n distinct words (see
`allowed_slips`). Words are ordered from rare to frequent. Two classes that differ by at most s words
on either side share two of the s + 2 rarest words of both, or one where there are fewer, so only
pairs of these words are indexed (evaluation) and probed (training). Before a pair is made, three exact
filters are applied: the numbers of words (length), the places of the shared words in both orders
(position), and a 64-bit sketch in which each word sets one bit, so that classes within the threshold
differ in at most s bits either way. The word sets of the candidates are then compared exactly, and a
pair is kept where they are equal or differ by slips of spelling only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

_UNIT = re.compile(r"\((?:in|expressed in|given in)\s[^()]+\)")
_YEAR = re.compile(r"\bfy\s*['’]?\s*((?:19|20)?\d\d)\b")
_WORD = re.compile(r"[^\W_]+")
#: Courtesy, labels and filler that never change what is asked.
FILLER = frozenset("the a an please kindly say tell me thanks thank you q question dev test train i would like to know could s fiscal year fy in for".split())
#: Those of them that make up phrases of courtesy.
COURTESY = frozenset("please kindly say tell me thanks thank you i would like to know could".split())
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def slips_of(words: Iterable[str]) -> set[str]:
    """Every word of a-z that is one letter dropped, added, changed, or two swapped, away from one of the words."""
    out: set[str] = set()
    for f in words:
        cut = [(f[:i], f[i:]) for i in range(len(f) + 1)]
        out |= {a + b[1:] for a, b in cut if b} | {a + b[1] + b[0] + b[2:] for a, b in cut if len(b) > 1}
        out |= {a + c + b for a, b in cut for c in _LETTERS} | {a + c + b[1:] for a, b in cut if b for c in _LETTERS}
    return out


@cache
def filler_slips(least: int = 6) -> frozenset[str]:
    """Slips of filler words of `least` letters or more, which few other words resemble: a few thousand words, whatever the data."""
    return frozenset(slips_of(f for f in FILLER if len(f) >= least)) - FILLER


@cache
def _courtesy_slips() -> frozenset[str]:
    return frozenset(slips_of(f for f in COURTESY if len(f) >= 3)) - FILLER


def question_words(text: str) -> list[str]:
    """Distinct words of a question in alphabetical order, years in four digits; filler is out, and so are slips of courtesy words inside a phrase of courtesy."""
    s = unicodedata.normalize("NFKC", text).lower().replace("’", "'").replace("`", "'").replace("´", "'").replace("­", "").replace("​", "")
    s = _YEAR.sub(lambda m: f" {m[1] if len(m[1]) == 4 else '20' + m[1]} ", _UNIT.sub(" ", s))
    w, slips = _WORD.findall(s), _courtesy_slips()
    polite = [x for i, x in enumerate(w) if x in slips and i + 1 < len(w) and w[i + 1] in COURTESY and (not i or w[i - 1] in COURTESY)]
    return sorted(set(w) - FILLER - set(polite))


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        yield pd.DataFrame({"id": p["id"], "side": p["side"], "key": [" ".join(question_words(q)) for q in p["question"]]})


def _without(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop = shared.value
        for p in batches:
            yield p.assign(key=[" ".join(w for w in k.split(" ") if w not in drop) for k in p["key"]])

    return run


def _thirds(word, length, name: str):
    """The first and last third of a word, marked as such: one slip leaves one of the two as it is."""
    k = F.greatest(F.lit(1), F.floor(length / 3)).cast("int")
    return F.explode(F.array(F.concat(F.lit("<"), F.substring(word, F.lit(1), k)), F.concat(F.lit(">"), F.substring(word, F.length(word) - k + 1, k)))).alias(name)


def one_slip(a, b):
    """Whether two words differ by one letter dropped, added, changed, or two swapped."""
    swapped = (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return (F.levenshtein(a, b) <= 1) | swapped


def allowed_slips(n):
    """Uncorrected slips that a question of n distinct words may hold: a sixth of the words, two at least, and never all."""
    return F.greatest(F.lit(0), F.least(n - 1, F.greatest(F.lit(2), F.floor(n / 6)))).cast("int")


def class_pairs(classes: DataFrame) -> DataFrame:
    """(kt, kh, a, b): classes(key, words, t, h) of both sides, equal ones included, with the words that only one has.

    None is left out that differs by no more than allowed_slips() of either class on each side.
    """
    rarity = classes.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    each = classes.select("key", F.explode("words").alias("word")).join(rarity, "word")
    ranked = each.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "word"))), lambda x: x["word"]).alias("g"))
    bit = "aggregate(g, 0L, (x, w) -> x | shiftleft(1L, cast(xxhash64(w) & 63 as int)))"
    sized = ranked.join(classes.select("key", "t", "h"), "key").withColumn("n", F.size("g")).withColumn("s", allowed_slips(F.col("n"))).withColumn("bits", F.expr(bit))
    # (hash of two words of the prefix, place of the first); of short classes also each word by itself
    pairs = "flatten(transform(p, (x, i) -> transform(slice(p, i + 2, size(p)), y -> named_struct('sig', xxhash64(least(x, y), greatest(x, y)), 'at', i))))"
    signed = sized.withColumn("p", F.expr("slice(g, 1, s + 2)")).withColumn("x", F.expr(f"if(n < s + 2, concat(transform(p, (x, i) -> named_struct('sig', xxhash64(x), 'at', i)), {pairs}), {pairs})"))
    prefix = cut_lineage(signed.select("key", "t", "h", "n", "s", "bits", F.explode("x").alias("x")).select("key", "t", "h", "n", "s", "bits", "x.sig", "x.at"))
    side = lambda d, flag: d.where(flag).select(F.col("key").alias("k" + flag), F.col("n").alias("n" + flag), F.col("s").alias("s" + flag), F.col("bits").alias("b" + flag), F.col("at").alias("a" + flag), "sig")
    slips, apart = F.least("st", "sh"), F.col("bt").bitwiseXOR(F.col("bh"))
    met = side(prefix, "t").join(side(prefix, "h"), "sig").where(
        (F.abs(F.col("nt") - F.col("nh")) <= slips) & (F.abs(F.col("at") - F.col("ah")) <= slips)
        & (F.bit_count(apart.bitwiseAND(F.col("bt"))) <= slips) & (F.bit_count(apart.bitwiseAND(F.col("bh"))) <= slips)
    )
    met = met.select("kt", "kh", slips.alias("s")).distinct()
    words = classes.select("key", "words")
    both = met.join(words.toDF("kt", "wt"), "kt").join(words.toDF("kh", "wh"), "kh")
    diff = both.select("kt", "kh", "s", F.array_except("wt", "wh").alias("a"), F.array_except("wh", "wt").alias("b"))
    return diff.where((F.size("a") <= F.col("s")) & (F.size("b") <= F.col("s"))).drop("s")


def slip_overlaps(
    items: DataFrame, id_col: str, question: str, split: str, *, train: str = "train", held: tuple[str, ...] = ("dev", "test"),
    known: DataFrame | None = None, rarer: int = 10,
) -> DataFrame:
    """(train_id, held_id, slips): as split_overlaps(), with the number of words that differ; 0 for equal questions."""
    side = F.lower(F.trim(F.regexp_replace(F.col(split), r"(?U)\s+", "")))
    kind = dict(items.dtypes)[id_col]
    rows = items.select(F.col(id_col).alias("id"), F.when(side == train, "t").when(side.isin(*held), "h").alias("side"), F.col(question).alias("question"))
    rows = rows.where("id IS NOT NULL AND side IS NOT NULL AND question IS NOT NULL").dropDuplicates(["id"])
    asked = cut_lineage(rows.mapInPandas(_split, f"id {kind}, side string, key string").where("key <> ''"))
    # slips of filler: words one slip from it that few questions hold, and no name does
    spark = items.sparkSession
    slips_of_filler = spark.createDataFrame([(w,) for w in sorted(filler_slips())], "word string")
    total = asked.select("key").distinct()
    held_by = total.select(F.explode(F.split("key", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).join(F.broadcast(slips_of_filler), "word")
    held_by = held_by if known is None else held_by.join(known, "word", "left_anti")
    found_slips, all_ = held_by.collect(), total.count()  # among the fixed list, so a few thousand words at most
    drop = {r["word"] for r in found_slips if r["n"] <= max(2, all_ / (10 * rarer))}
    if drop:
        asked = cut_lineage(asked.mapInPandas(_without(spark.sparkContext.broadcast(drop)), f"id {kind}, side string, key string").where("key <> ''"))
    # a class goes by the smallest of its ids
    classes = asked.groupBy(F.col("key").alias("text")).agg(F.min("id").alias("key"), F.max(F.col("side") == "t").alias("t"), F.max(F.col("side") == "h").alias("h"))
    classes = cut_lineage(classes.withColumn("words", F.split("text", " ")))
    diff = cut_lineage(class_pairs(classes.drop("text")))
    equal = diff.where("kt = kh").select("kt", "kh", F.lit(0).alias("slips"))
    # Different classes are one question only if each word that one has alone and its counterpart differ by a
    # slip, and one of the two is rare or much rarer, or if both are slips of one word that is much more frequent.
    rest = diff.where("kt <> kh AND size(a) = size(b)")
    wordy = lambda c: (F.length(c) >= 3) & F.col(c).rlike(r"^\p{L}+$")
    counts = cut_lineage(classes.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    told = counts if known is None else counts.join(known.select("word", F.lit(True).alias("own")), "word", "left")
    told = told.select("word", "n", (F.coalesce("own", F.lit(False)) if known is not None else F.lit(False)).alias("own"))
    cross = rest.select(F.explode("a").alias("x"), "b").select("x", F.explode("b").alias("y")).where(wordy("x") & wordy("y")).distinct()
    cross = cross.where(F.levenshtein("x", "y", 4) >= 0).join(told.toDF("x", "cx", "ox"), "x").join(told.toDF("y", "cy", "oy"), "y").where("NOT (ox AND oy)")
    cross = cut_lineage(cross.withColumn("one", one_slip(F.col("x"), F.col("y"))))
    direct = cross.where(F.col("one") & (F.least("cx", "cy") <= F.greatest(F.lit(2), F.greatest("cx", "cy") / rarer))).select("x", "y")
    two = cross.where("NOT one AND NOT ox AND NOT oy")
    odd = two.select(F.col("x").alias("word"), F.col("cx").alias("n")).unionAll(two.select("y", "cy")).distinct()
    odd = odd.select("word", "n", F.explode(F.array_distinct(F.array(*(F.greatest(F.lit(3), F.length("word") + k) for k in (-1, 0, 1))))).alias("len")).select("word", "n", _thirds(F.col("word"), F.col("len"), "part")).distinct()
    usual = told.where(wordy("word")).select(F.col("word").alias("w"), F.col("n").alias("m"), _thirds(F.col("word"), F.length("word"), "part"))
    meant = odd.join(usual, "part").where((F.col("m") >= rarer * F.col("n")) & (F.col("word") != F.col("w"))).where(one_slip(F.col("word"), F.col("w"))).select("word", "w").distinct()
    twice = two.join(meant.toDF("x", "w"), "x").join(meant.toDF("y", "w"), ["y", "w"]).select("x", "y")
    pairs = cut_lineage(direct.unionAll(twice).distinct())
    matched = rest.select("kt", "kh", F.size("a").alias("k"), F.explode("a").alias("x"), "b").select("kt", "kh", "k", "x", F.explode("b").alias("y")).join(pairs, ["x", "y"])
    near = matched.groupBy("kt", "kh", "k").agg(F.countDistinct("x").alias("nx"), F.countDistinct("y").alias("ny")).where("nx = k AND ny = k")
    found = equal.unionAll(near.select("kt", "kh", F.col("k").alias("slips")))
    # from classes to ids
    members = asked.join(classes.select(F.col("text").alias("key"), F.col("key").alias("rep")), "key").select("rep", "side", "id")
    mt = members.where("side = 't'").select(F.col("rep").alias("kt"), F.col("id").alias("train_id"))
    mh = members.where("side = 'h'").select(F.col("rep").alias("kh"), F.col("id").alias("held_id"))
    return found.join(mt, "kt").join(mh, "kh").select("train_id", "held_id", "slips")


def split_overlaps(items: DataFrame, id_col: str, question: str, split: str, **how) -> DataFrame:
    """(train_id, held_id): every pair of a training and a held-out item that ask the same question.

    known(word): words that are right as they are, such as names. Null ids, questions and splits, and
    questions without words, are in no pair. Splits are read without case and blanks; other splits take
    no part. An item delivered twice counts once. Equal questions are all paired; others where they
    differ in allowed_slips() words at most, each one slip from its counterpart, one of the two in at
    most two distinct questions or `rarer` times rarer than the other, or both one slip from a word
    `rarer` times more frequent. Slips of filler words that few questions hold are filler. An empty side
    gives no row.
    """
    return slip_overlaps(items, id_col, question, split, **how).select("train_id", "held_id")


def known_words(names: DataFrame, column: str) -> DataFrame:
    """(word): the words of a column of names."""
    return names.select(F.explode(F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word")).distinct()


def overlap_report(pairs: DataFrame, items: DataFrame, id_col: str, split: str, source: str) -> DataFrame:
    """(split, source, held_items, pairs): overlaps per split and source of the held-out item; null sources count as 'unknown'."""
    about = items.select(
        F.col(id_col).alias("held_id"), F.lower(F.trim(F.regexp_replace(F.col(split), r"(?U)\s+", ""))).alias("split"), F.coalesce(F.col(source), F.lit("unknown")).alias("source")
    ).dropDuplicates(["held_id"])
    return pairs.join(about, "held_id").groupBy("split", "source").agg(F.countDistinct("held_id").alias("held_items"), F.count("*").alias("pairs"))
