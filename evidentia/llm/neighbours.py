"""Problem 6: the k most similar vectors of every vector, by multi-index hashing.

Vectors are brought to length one and turned into binary codes of one bit a dimension by a learned
rotation (the sign pattern of the centred vectors after iterative quantisation on a bounded sample).
The code is cut into substrings of about log2(rows) bits, each an index of its own: a table of buckets.
Of two codes that differ in at most r bits, one substring differs in at most r / substrings bits
(pigeonhole), so probing all buckets within radius 1 of each substring finds every code within
2 * substrings - 1 bits; beyond that the probes go on in the order of the query's own uncertainty,
flipping first those bits whose projections are close to zero. The candidates are filtered by the
Hamming distance of the whole codes, and the rest is ranked by the exact cosine of the stored
integers.

The index is spread over the cluster by cells: the sample also gives centres, whose number grows with
the rows, and neighbouring centres form a cell. A row is indexed in the cell of its nearest centre
and asks there and in the cells of its `visits` nearest centres, so it travels about `visits` times
however many rows there are. Centres are drawn from the rows, so dense regions have more of them; a
cell that is still too large is cut into blocks by hash. A block of at most WHOLE_ROWS rows is compared
whole, larger ones through the buckets. From LARGE_ROWS rows on the cells are asked in parts. Beyond DIRECT_CENTRES, centres are found by way of groups of
centres, so that a row meets about 1,200 of them however many there are. Equal vectors are one class from the start:
a class is indexed once, whatever its number of ids. Rows that find fewer than k neighbours within
`far` are compared with every row of `WIDER` times as many cells, and so on until k are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, free_shuffles, shared_path

#: Rows that rotation and centres are fitted on, at least and at most; most centres; rows of a cell aimed at, and most rows of an index block.
FIT_ROWS, MOST_FIT_ROWS, MOST_CENTRES, CELL_ROWS, BLOCK_ROWS = 6144, 32_768, 8192, 2000, 60_000
#: Cells of the nearest centres that a row asks; the factor for rows that find too few.
VISITS, WIDER = 3, 4
#: Bits of a substring, by the rows of the index.
LEAST_BITS, MOST_BITS = 8, 16
#: Pairs of a query and a row that the scan compares, and ranks, at once; rows that it folds into one maximum.
MOST_TIED, FOLD = 6_000_000, 16
#: Blocks up to this many rows are compared whole: the buckets probed hold about a quarter of a small block, and one matrix product takes a seventh to a ninth of collecting them at 16,000 and 46,000 rows.
WHOLE_ROWS = 65_536
#: From this many rows on the cells are asked in PARTS parts, one after another, so that only a part of the copies of the rows is on disk at a time.
LARGE_ROWS, PARTS = 250_000, 3
#: Up to this many centres a row is compared with each; beyond, with those of the LOOKED nearest groups of about sqrt(centres) each.
DIRECT_CENTRES, LOOKED = 1024, 12


def fit_rotation(x: np.ndarray, rounds: int = 8, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, rotation) whose signs lose least of x (rows of length one)."""
    mean = x.mean(axis=0)
    c = x - mean
    dim = x.shape[1]
    _, vectors = np.linalg.eigh(c.T @ c + 1e-6 * np.eye(dim, dtype=c.dtype))
    r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    base = c @ vectors
    r = r.astype(np.float32)
    for _ in range(rounds):
        b = np.sign(base @ r)
        u, _, vt = np.linalg.svd(b.T @ base)
        r = (u @ vt).T.astype(np.float32)
    return mean.astype(np.float32), (vectors @ r).astype(np.float32)


def lengths(ints: np.ndarray) -> np.ndarray:
    x = ints.astype(np.float32)
    return np.sqrt(np.einsum("ij,ij->i", x, x).astype(np.float64))  # sums of squares of 8-bit numbers are exact in single precision up to 1,024 of them


def units(ints: np.ndarray) -> np.ndarray:
    x = ints.astype(np.float32)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def probe_patterns(bits: int, count: int, radius: int = 1) -> list[tuple[int, ...]]:
    """Sets of bit ranks (0: the least certain bit) to flip, likeliest first; all sets up to `radius` are among them."""
    sets = [s for n in range(5) for s in combinations(range(bits), n)]
    gap = np.array([0.08 * (i + 0.6) for i in range(bits)]) + 0.0
    must = [s for s in sets if len(s) <= radius]
    rest = sorted((s for s in sets if len(s) > radius), key=lambda s: (gap[list(s)].sum() + 0.25 * len(s), s))
    return (must + rest)[:count]


class Index:
    """Codes and substring tables of one block."""

    def __init__(self, ints: np.ndarray, mean: np.ndarray, rotation: np.ndarray, buckets: bool = True):
        self.ints = ints
        self.norm = lengths(ints)
        if not buckets:  # for scan() alone
            return
        self.bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(2, len(ints)))))))
        proj, self.words = codes(ints, mean, rotation)
        self.tables = []
        for v in substrings(proj > 0, self.bits).T:
            order = np.argsort(v, kind="stable").astype(np.int32)
            self.tables.append((order, np.concatenate([[0], np.cumsum(np.bincount(v, minlength=1 << self.bits))]).astype(np.int32)))


def codes(ints: np.ndarray, mean: np.ndarray, rotation: np.ndarray):
    """Projections and 64-bit code words (words x rows)."""
    proj = (units(ints) - mean) @ rotation
    packed = np.packbits(proj > 0, axis=1)
    pad = -packed.shape[1] % 8
    if pad:
        packed = np.pad(packed, ((0, 0), (0, pad)))
    return proj, np.ascontiguousarray(packed.view(np.uint64).T)


def substrings(code: np.ndarray, bits: int) -> np.ndarray:
    """(rows x substrings) numbers of `bits` bits each; the last substring is filled up with zeros."""
    code = np.pad(code, ((0, 0), (0, -code.shape[1] % bits)))
    return code.reshape(len(code), -1, bits) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def search(index: Index, ints: np.ndarray, mean: np.ndarray, rotation: np.ndarray, k: int, probes: int, far: float, step: int = 256):
    """(query, row, cosine) of up to k + 1 best rows of the block for each query.

    `probes` buckets of every 2^16 are asked, and all within one bit in any case.
    """
    proj, qwords = codes(ints, mean, rotation)
    bits = index.bits
    qsubs = substrings(proj > 0, bits)
    sure = np.pad(np.abs(proj), ((0, 0), (0, -proj.shape[1] % bits)), constant_values=np.inf)
    n_sub, n = qsubs.shape[1], len(ints)
    patterns = probe_patterns(bits, max(bits + 1, probes >> (MOST_BITS - bits)))
    flips = np.zeros((len(patterns), bits), np.float32)
    for i, p in enumerate(patterns):
        flips[i, list(p)] = 1
    qnorm = lengths(ints)
    qfloat = ints.astype(np.float32)
    size = len(index.ints)
    dims = proj.shape[1]
    out = []
    for a in range(0, n, step):
        b = min(n, a + step)
        mark = np.zeros((b - a) * size, np.bool_)
        base = (np.arange(b - a) * size)[:, None]
        for s in range(n_sub):
            order = np.argsort(sure[a:b, s * bits : (s + 1) * bits], axis=1)
            masks = ((1 << (bits - 1 - order)).astype(np.float32) @ flips.T).astype(np.int64)
            v = qsubs[a:b, s][:, None] ^ masks
            rows, ends = index.tables[s]
            lo, cnt = ends[v], ends[v + 1] - ends[v]
            hit = np.flatnonzero(cnt)
            if hit.size:
                c, l = cnt.ravel()[hit], lo.ravel()[hit]
                total = int(c.sum())
                at = np.arange(total) - np.repeat(np.cumsum(c) - c, c) + np.repeat(l, c)
                q = np.repeat(hit // len(patterns), c)
                mark[q * size + rows[at]] = True
        cand = np.flatnonzero(mark)
        q, i = cand // size, cand % size
        dist = np.zeros(cand.size, np.uint16)
        for w in range(len(qwords)):
            dist += np.bitwise_count(index.words[w][i] ^ qwords[w, a:b][q])
        near = np.flatnonzero(dist <= far * dims)
        out.append(best(index, qfloat[a:b], qnorm[a:b], q[near], i[near], k, a))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, int),) * 3


def best(index: Index, qfloat, qnorm, q, i, k: int, offset: int, most: int = 50_000):
    """The k + 1 best of given (query, row) pairs."""
    cos = np.empty(q.size)
    for x in range(0, q.size, most):
        y = slice(x, x + most)
        cos[y] = np.einsum("ij,ij->i", qfloat[q[y]], index.ints[i[y]].astype(np.float32)).astype(np.float64) / (qnorm[q[y]] * index.norm[i[y]])
    return ranked(q, i, cos, k, offset)


def ranked(q, i, cos, k: int, offset: int):
    """The k + 1 pairs of each query with the greatest cosine; ties go to the earlier row."""
    order = np.lexsort((i, -cos, q))
    q, i, cos = q[order], i[order], cos[order]
    rank = np.arange(q.size) - np.searchsorted(q, q)
    keep = rank <= k
    return q[keep] + offset, i[keep], cos[keep]


def scan(index: Index, ints: np.ndarray, k: int):
    """As search(), against every row of the block."""
    rows, top = len(index.ints), min(len(index.ints), k + 1)
    qnorm, qfloat = lengths(ints), ints.astype(np.float32)
    floats, inverse, out = index.ints.astype(np.float32).T, (1 / index.norm).astype(np.float32), []
    step = max(1, min(256, MOST_TIED // rows))
    parts = rows // FOLD
    for a in range(0, len(ints), step):
        dots = qfloat[a : a + step] @ floats  # whole numbers, exact as long as sums of squares are
        cos = dots * inverse
        # the top-th of the maxima of FOLD rows each is no more than the top-th of all, and found at a fraction of the work
        heads = cos[:, : parts * FOLD].reshape(len(cos), FOLD, parts).max(axis=1) if parts >= top else cos
        least = np.partition(heads, heads.shape[1] - top, axis=1)[:, heads.shape[1] - top]
        # every row that ties with the last one kept, for ranked() to break ties by id; the slack is for rounding, ranked() is exact
        at = np.flatnonzero(cos >= (least - 1e-6 * np.abs(least))[:, None])
        q, i = at // rows, at % rows
        out.append(ranked(q, i, dots.ravel()[at].astype(np.float64) / (qnorm[a + q] * index.norm[i]), k, a))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, int),) * 3


def nearest(x: np.ndarray, c: np.ndarray, step: int = 2048) -> np.ndarray:
    """The nearest centre of each row, a slice of rows at a time."""
    return np.concatenate([(x[a : a + step] @ c.T).argmax(axis=1) for a in range(0, len(x), step)])


def group_centres(centres: np.ndarray) -> tuple[list[np.ndarray], np.ndarray] | None:
    """(members, means) of about sqrt(centres) groups of neighbouring centres; None where every centre is looked at."""
    if len(centres) <= DIRECT_CENTRES:
        return None
    of = cells_of(centres, np.ones(len(centres)), int(np.sqrt(len(centres))))
    members = [np.flatnonzero(of == g) for g in range(int(of.max()) + 1)]
    return members, np.stack([centres[m].mean(axis=0) for m in members])


def near_centres(x: np.ndarray, centres: np.ndarray, groups: tuple[list[np.ndarray], np.ndarray] | None, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest centre, the `count` nearest ones in no order) of each row of length one."""
    if groups is None or LOOKED >= len(groups[0]) or count > LOOKED * VISITS:
        near = x @ centres.T
        return near.argmax(axis=1), np.argpartition(-near, count - 1, axis=1)[:, :count]
    members, means = groups
    looked = np.argpartition(-(x @ means.T), LOOKED - 1, axis=1)[:, :LOOKED]
    cos, ids = np.full((len(x), LOOKED, count), -np.inf, np.float32), np.zeros((len(x), LOOKED, count), np.int64)
    order = np.argsort(looked, axis=None, kind="stable")
    for g, at in enumerate(np.split(order, np.searchsorted(looked.ravel()[order], np.arange(1, len(members))))):
        row, slot = at // LOOKED, at % LOOKED
        near = x[row] @ centres[members[g]].T
        n = min(count, near.shape[1])
        best_ = np.argpartition(-near, n - 1, axis=1)[:, :n]
        cos[row, slot, :n], ids[row, slot, :n] = np.take_along_axis(near, best_, 1), members[g][best_]
    cos, ids = cos.reshape(len(x), -1), ids.reshape(len(x), -1)
    top = np.argpartition(-cos, count - 1, axis=1)[:, :count]
    return ids[np.arange(len(x)), cos.argmax(axis=1)], np.take_along_axis(ids, top, 1)


def fit_centres(x: np.ndarray, count: int, rounds: int = 5, seed: int = 6) -> np.ndarray:
    """Centres (length one) of rows of length one: rows drawn at random, moved to the mean of the rows nearest to them."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:count]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        order = np.argsort(near, kind="stable")
        own, firsts = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order], firsts, axis=0)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c[own] = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), c[own])
    return c


def cells_of(centres: np.ndarray, weight: np.ndarray, count: int) -> np.ndarray:
    """The cell of each centre: halved again and again along the widest direction, the weight of both halves in proportion."""
    out = np.zeros(len(centres), np.int32)
    todo, made = [(np.arange(len(centres)), count)], 0
    while todo:
        at, n = todo.pop()
        if n <= 1 or len(at) <= 1:
            out[at] = made
            made += 1
            continue
        c = centres[at] - centres[at].mean(axis=0)
        order = at[np.argsort(c @ np.linalg.svd(c, full_matrices=False)[2][0], kind="stable")]
        total = np.cumsum(weight[order] + 1e-3)
        cut = min(len(order) - 1, max(1, int(np.searchsorted(total, total[-1] * (n // 2) / n)) + 1))
        todo += [(order[:cut], n // 2), (order[cut:], n - n // 2)]
    return out


def _router(fit, visits: int, blocks: np.ndarray, widen: bool, part: int = 0, parts: int = 1):
    """Each row to the cells it asks, of every parts-th cell: (cell, block, rep, v, own); own in the one block where it is indexed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, centres, cell, groups = fit.value
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not len(t):
                continue
            ints, home = _matrix(t), np.asarray(t.column("home"))
            own, top = near_centres(units(ints), centres, groups, min(visits, len(centres)))
            mine = cell[own]
            to = np.sort(np.concatenate([cell[top], mine[:, None]], axis=1), axis=1)
            keep = to % parts == part
            keep[:, 1:] &= to[:, 1:] != to[:, :-1]
            row, col = np.nonzero(keep)
            where = to[row, col]
            times = blocks[where]
            row, where = np.repeat(row, times), np.repeat(where, times)
            block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            own = (where == mine[row]) & (block == home[row] % blocks[where]) & (not widen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(where.astype(np.int32)), pa.array(block.astype(np.int32)), t.column("rep").take(pa.array(row)).combine_chunks(), t.column("v").take(pa.array(row)).combine_chunks(), pa.array(own)],
                names=["cell", "block", "rep", "v", "own"],
            )

    return run


def _searcher(fit, k: int, probes: int, far: float, everything: bool):
    def run(table: pa.Table) -> pa.Table:
        mean, rotation = fit.value[:2]
        own = table.column("own")
        rows = table.filter(own).sort_by("rep")  # ties go to the smaller id
        asking = table.filter(table.column("asks"))
        kind = table.schema.field("rep").type
        if not len(rows) or not len(asking):
            return pa.table({"rep": pa.array([], kind), "near": pa.array([], pa.list_(pa.struct([("far", pa.float64()), ("rep", kind)])))})
        qi = _matrix(asking)
        whole = everything or len(rows) <= WHOLE_ROWS
        index = Index(_matrix(rows), mean, rotation, not whole)
        q, i, cos = scan(index, qi, k) if whole else search(index, qi, mean, rotation, k, probes, far)
        order = np.argsort(q, kind="stable")
        q, i, cos = q[order], i[order], cos[order]
        who, firsts = np.unique(q, return_index=True)
        found = pa.StructArray.from_arrays([pa.array(np.round(-cos, 12)), rows.column("rep").take(pa.array(i)).combine_chunks()], names=["far", "rep"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(firsts, len(q)).astype(np.int32)), found)
        return pa.table({"rep": asking.column("rep").take(pa.array(who)), "near": lists})

    return run


def _matrix(t: pa.Table) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in t.column("v").chunks])
    return np.asarray(flat).reshape(len(t), -1)


def nearest_neighbours(
    df: DataFrame, id_col: str, vector_col: str, order_col: str, *, k: int = 5, dim: int = 384, probes: int = 480, far: float = 0.42, visits: int = VISITS
) -> DataFrame:
    """(id_a, id_b, cos, rank): the k most similar rows of each row, by the cosine of whole-number vectors.

    Ties go to the smaller id. Null, all-zero and too short or too long vectors, vectors with null
    elements and rows with a null id take no part. An id that occurs again counts once, with the vector
    of its smallest order_col, and is never its own neighbour; equal vectors of different ids are
    neighbours. With fewer than k + 1 rows all others are listed; an empty table gives no row.

    Bounds: at most MOST_FIT_ROWS vectors come to the driver, where at most MOST_CENTRES centres are
    fitted; every row is indexed and asks. A row compared with whole cells meets at most `visits` *
    WIDER centres' cells unless these hold fewer than k others.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[id_col]
    v = F.col("v")
    good = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<tinyint>").alias("v"), F.col(order_col).alias("o")).where(
        # a search for a number that no element can be gives null, not false, where there is a null element
        F.col("id").isNotNull() & (F.size(v) == dim) & F.array_contains(v.cast("array<smallint>"), F.lit(999).cast("smallint")).isNotNull() & ((F.array_max(v) != 0) | (F.array_min(v) != 0))
    )
    good = good.withColumn("h", F.concat_ws("-", F.hex(F.xxhash64("v")), F.hex(F.xxhash64(F.lit(1), v))))
    members = good.groupBy("id").agg(F.min_by("h", "o").alias("h"))
    # of each class of equal vectors the k + 1 smallest ids are enough for every list; the limit is applied before the shuffle
    lowest = Window.partitionBy("h").orderBy("id")
    ids = members.withColumn("_n", F.row_number().over(lowest)).where(F.col("_n") <= k + 1).groupBy("h").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    vectors = good.groupBy("h").agg(F.first("v").alias("v"))
    classes = cut_lineage(ids.join(vectors, "h").select("h", F.col("ids")[0].alias("rep"), "ids", "v"))
    del ids, vectors
    free_shuffles(spark)  # the vectors are in the checkpoint now
    n = classes.count()
    if not n:
        return spark.createDataFrame([], f"id_a {kind}, id_b {kind}, cos double, rank int")
    n_centres = max(1, min(MOST_CENTRES, max(512, n // 1500), n // 16))
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(min(MOST_FIT_ROWS, max(FIT_ROWS, 4 * n_centres))).select("v").toArrow()
    x = units(_matrix(sample))
    centres = fit_centres(x, n_centres)
    weight = np.bincount(nearest(x, centres), minlength=n_centres)
    cell = cells_of(centres, weight, min(n_centres, max(24, n // CELL_ROWS)))
    fit = spark.sparkContext.broadcast((*fit_rotation(x[:FIT_ROWS]), centres, cell, group_centres(centres)))
    rows = classes.select("rep", "v", F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 30)).cast("int").alias("home"))
    routed = f"cell int, block int, rep {kind}, v array<tinyint>, own boolean"
    n_cells = int(cell.max()) + 1
    # how many rows each cell holds, from the sample and with a quarter more: only the size of an index block hangs on it
    held = np.bincount(cell, weight, n_cells) * (1.25 * n / len(x))
    blocks = np.maximum(1, np.ceil(held / BLOCK_ROWS)).astype(np.int64)

    def ask(queries: DataFrame | None, visits: int, part: int = 0, parts: int = 1) -> DataFrame:
        """(rep, near): the nearest classes in each block that a row asks; of `queries` among whole cells."""
        if queries is None:
            sent = rows.mapInArrow(_router(fit, visits, blocks, False, part, parts), routed).withColumn("asks", F.lit(True))
        else:
            held = rows.mapInArrow(_router(fit, 1, blocks, False), routed).where("own").withColumn("asks", F.lit(False))
            sent = held.unionAll(queries.mapInArrow(_router(fit, visits, blocks, True), routed).withColumn("asks", F.lit(True)))
        return sent.groupBy("cell", "block").applyInArrow(_searcher(fit, k, probes, far, queries is not None), f"rep {kind}, near array<struct<far: double, rep: {kind}>>")

    def merged(found: DataFrame) -> DataFrame:
        """(rep, near): the k nearest of every row."""
        lists = found.groupBy("rep").agg(F.flatten(F.collect_list("near")).alias("near"))  # k + 1 from each of a few cells
        return lists.select("rep", F.slice(F.array_sort(F.filter("near", lambda x: x["rep"] != F.col("rep"))), 1, k).alias("near"))

    if n < LARGE_ROWS:
        top = cut_lineage(merged(ask(None, visits)))
    else:
        path, top = shared_path(spark, "near"), None
        for part in range(PARTS):
            ask(None, visits, part, PARTS).write.option("compression", "zstd").parquet(f"{path}/{part}")
            free_shuffles(spark)
        found = spark.read.parquet(*(f"{path}/{part}" for part in range(PARTS)))
        for part in range(PARTS):
            some = cut_lineage(merged(found.where(F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(PARTS)) == part)))
            top = top.unionAll(some) if top else some
            free_shuffles(spark)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    free_shuffles(spark)
    exhausted = False
    while not exhausted:
        # a class with fewer than k others in sight, its own ids counted; found without moving any vector
        seen = top.select("rep", F.size("near").alias("_seen"))
        few = classes.select("rep", F.size("ids").alias("_own")).join(seen, "rep", "left")
        few = cut_lineage(few.where(F.coalesce("_seen", F.lit(0)) + F.col("_own") - 1 < min(k, n - 1)).select("rep"))
        if few.isEmpty():
            break
        visits = min(n_centres, visits * WIDER)
        exhausted = visits == n_centres
        more = merged(ask(rows.join(few, "rep", "left_semi"), visits))
        top = cut_lineage(top.join(few, "rep", "left_anti").unionAll(more))
        more = None
    if n >= LARGE_ROWS:
        classes = cut_lineage(classes.drop("v"))
        rows = few = seen = sample = None
        free_shuffles(spark)  # the vectors have done their part
    # from classes to ids
    multi = classes.where("size(ids) > 1").select(F.col("rep").alias("rb"), F.col("ids").alias("many"))
    wide = top.select("rep", F.explode("near").alias("x")).select("rep", F.col("x.far").alias("far"), F.col("x.rep").alias("rb")).join(multi, "rb", "left")
    lists = wide.groupBy("rep").agg(F.flatten(F.collect_list(F.transform(F.coalesce("many", F.array("rb")), lambda i: F.struct(F.col("far"), i.alias("id"))))).alias("near"))
    own = classes.select("h", "rep", F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("far"), i.alias("id"))).alias("own"))
    each = own.join(lists, "rep", "left").select("h", F.slice(F.array_sort(F.concat("own", F.coalesce("near", F.array().cast(f"array<struct<far: double, id: {kind}>>")))), 1, k + 1).alias("near"))
    out = members.join(each, "h").select(F.col("id").alias("id_a"), F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    out = out.select("id_a", F.posexplode("near").alias("p", "x"))
    return out.select("id_a", F.col("x.id").alias("id_b"), (-F.col("x.far")).alias("cos"), (F.col("p") + 1).alias("rank"))


def neighbour_pairs(df: DataFrame, id_col: str, vector_col: str, order_col: str, **how) -> DataFrame:
    """(id_a, id_b), id_a < id_b: one of the two is among the k most similar of the other."""
    top = nearest_neighbours(df, id_col, vector_col, order_col, **how)
    return top.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
