"""Dense retrieval: exact top-k of a set of query vectors, block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """The vector over its norm; a zero vector stays zero."""
    size = F.when(norm(v) == 0, 1.0).otherwise(norm(v))
    return F.transform(as_double(v), lambda x: x / size)


def is_valid(v: Column, dim: int) -> Column:
    """Whether a vector has the given length and finite components only."""
    return F.coalesce((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def _scores(q: np.ndarray, x: np.ndarray, distance: str) -> np.ndarray:
    """Larger is nearer."""
    if distance == "dot":
        return q @ x.T
    if distance == "euclid":
        return -np.sqrt(np.maximum(((q**2).sum(1)[:, None] - 2 * q @ x.T) + (x**2).sum(1)[None, :], 0))
    length = lambda m: np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
    return (q / length(q)) @ (x / length(x)).T


def top_k(queries: DataFrame, vectors: DataFrame, k: int, distance: str = "cosine", digits: int = 6, block: int = 16_384, query_block: int = 4_096) -> DataFrame:
    """Of each query (qid, v) the k nearest of ``vectors`` (id, v): qid, id, score, rank; ties go to the smaller id.

    An unknown distance is cosine. Both sides are dealt into even blocks by a hash of their id; a
    pair of blocks is one matrix product in a task, which gives k rows a query at most. Vectors
    of another length than the most frequent one take no part.
    """
    distance = distance if distance in ("dot", "euclid") else "cosine"
    sizes = vectors.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, n = (sizes[0]["dim"], sizes[0]["n"]) if sizes else (0, 0)
    blocks, q_blocks = max(1, -(-n // block)), max(1, -(-queries.count() // query_block))
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    valid = lambda d: d.where(is_valid(F.col("v"), dim))
    left = valid(queries).select("qid", as_double(F.col("v")).alias("v"), deal("qid", q_blocks).alias("q_block"), every(blocks).alias("block"))
    right = valid(vectors).select("id", as_double(F.col("v")).alias("v"), deal("id", blocks).alias("block"), every(q_blocks).alias("q_block"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        qids, ids = a["qid"].to_numpy(), b["id"].to_numpy()
        q, x = matrix(a), matrix(b)
        out = []
        for low in range(0, len(q), 256):
            scores = np.round(_scores(q[low : low + 256], x, distance), digits) + 0.0
            for i, row in enumerate(scores):
                least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                near = np.flatnonzero(row >= least)
                near = near[np.lexsort((ids[near], -row[near]))][:k]
                out.append((np.full(len(near), qids[low + i]), ids[near], row[near]))
        return pa.table(dict(zip(("qid", "id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = left.groupBy("q_block", "block").cogroup(right.groupBy("q_block", "block")).applyInArrow(run, "qid long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return found.select("qid", "id", "score", rank.alias("rank")).where(F.col("rank") <= k)
