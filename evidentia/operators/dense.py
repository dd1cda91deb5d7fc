"""Dense vectors: quantisation, dot products, exact top-k in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalized(v: Column) -> Column:
    """A vector of length one; an all-zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    one = F.transform(F.array(F.struct(v.alias("v"), F.when(norm == 0, F.lit(1.0)).otherwise(norm).alias("n"))), lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"]))
    return one[0]


def quantize(df: DataFrame, col: str) -> DataFrame:
    """Adds q ARRAY<INT> and scale DOUBLE: the normalised vector in 8-bit steps of its own scale.

    Step by step, each a column of its own, so that no step is computed again for every element.
    """
    d = df.withColumn("_u", normalized(F.col(col)))
    d = d.withColumn("_m", F.coalesce(F.array_max(F.transform("_u", F.abs)), F.lit(0.0)))
    d = d.withColumn("scale", F.when(F.col("_m") == 0, F.lit(1.0)).otherwise(F.col("_m") / 127))
    return d.withColumn("q", F.transform("_u", lambda x: F.floor(x / F.col("scale") + 0.5).cast("int"))).drop("_u", "_m")


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _matrix(t: pa.Table) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in t.column("v").chunks])
    return np.asarray(flat, np.float64).reshape(len(t), -1)


def _block(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        kind = {"qid": queries.schema.field("qid").type, "row": rows.schema.field("row").type, "score": pa.float64()}
        if not len(queries) or not len(rows):
            return pa.table({c: pa.array([], t) for c, t in kind.items()})
        rows = rows.sort_by("row")
        q, x, scale = _matrix(queries), _matrix(rows), np.asarray(rows.column("scale"), np.float64)
        out_q, out_r, out_s = [], [], []
        for a in range(0, len(q), 512):
            score = (q[a : a + 512] @ x.T) * scale
            order = np.argsort(-np.round(score, 6), axis=1, kind="stable")[:, :k]
            out_q.append(np.repeat(np.arange(a, a + len(score)), order.shape[1]))
            out_r.append(order.ravel())
            out_s.append(np.take_along_axis(score, order, 1).ravel())
        i, r = np.concatenate(out_q), np.concatenate(out_r)
        return pa.table({"qid": queries.column("qid").take(pa.array(i)), "row": rows.column("row").take(pa.array(r)), "score": pa.array(np.concatenate(out_s))})

    return run


def dense_scores(rows: DataFrame, queries: DataFrame, k: int, row_block: int = 50_000, query_block: int = 4_000) -> DataFrame:
    """(qid, row, score): at least the k best rows of each query, by dot product times the row's scale.

    rows(row, v, scale), queries(qid, v): a stated query set against all rows, in blocks of bounded size
    that are hashed and paired by equi-join; every pair is one task, whose matrix product keeps k rows a
    query. Rows with null or unequally long vectors must be left out before. Empty sides give no row.
    """
    n, m = rows.count(), queries.count()
    rb, qb = max(1, -(-n // row_block)), max(1, -(-m // query_block))
    left = queries.select("qid", "v", F.pmod(F.xxhash64("qid"), F.lit(qb)).cast("int").alias("a")).select("qid", "v", "a", F.explode(F.sequence(F.lit(0), F.lit(rb - 1))).alias("b"))
    right = rows.select("row", "v", "scale", F.pmod(F.xxhash64("row"), F.lit(rb)).cast("int").alias("b")).select("row", "v", "scale", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("a"), "b")
    left, right = left.toDF("qid", "v", "a", "b"), right.toDF("row", "v", "scale", "a", "b")
    schema = f"qid {dict(queries.dtypes)['qid']}, row {dict(rows.dtypes)['row']}, score double"
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_block(k), schema)


def stored_vectors(index: DataFrame, dim: int = 384) -> DataFrame:
    """(row, row_no, doc_id, v, scale) of a vector table: one row a chunk, without damaged vectors.

    A scale that is null, not a number or not positive is replaced by the one that makes the vector as long as one.
    """
    w = Window.partitionBy("chunk_id").orderBy("row_no")
    good = index.where((F.size("vectors") == dim) & ~F.exists("vectors", lambda x: x.isNull()) & F.exists("vectors", lambda x: x != 0) & F.col("chunk_id").isNotNull())
    s = F.col("scales").cast("double")
    own = 1 / F.sqrt(F.aggregate("vectors", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    scale = F.when((s > 0) & (s < 1e30), s).otherwise(own)
    return good.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.col("chunk_id").alias("row"), "row_no", "doc_id", F.col("vectors").alias("v"), scale.alias("scale"))
