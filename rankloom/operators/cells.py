"""Approximate dense retrieval: vectors in the cells of a coarse quantiser, of which a query reads the nearest.

The quantiser is k-means over a bounded sample. Vectors are stored by cell, so cells that no query
of a batch probes aren't read; what is met is scored exactly, as ``dense.top_k`` does, which stays
the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.operators.dense import _scores, as_double, is_valid
from rankloom.sources.durable import durable

#: Vectors that a task scores together at most, about.
PART = 16_384


def _near(x: np.ndarray, distance: str) -> np.ndarray:
    """Vectors as they are compared: unit vectors for a cosine."""
    if distance != "cosine":
        return x
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1, length)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(-1, dim).astype(np.float64)


def _affinity(x: np.ndarray, centres: np.ndarray, distance: str) -> np.ndarray:
    """Larger is nearer: inner products for a dot product, else negative squared distances."""
    product = x @ centres.T
    return product if distance == "dot" else 2 * product - (centres**2).sum(1)[None, :]


@dataclass
class Cells:
    """Centres and where the vectors (cell, id, v) lie."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    distance: str

    def vectors(self, cells: list[int] | None = None) -> DataFrame:
        """The vectors of some cells; others' files aren't read."""
        rows = self.spark.read.parquet(f"{self.path}/vectors")
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    @staticmethod
    def load(spark: SparkSession, path: str) -> Cells:
        told = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        return Cells(spark, path, np.array([r["v"] for r in told], np.float64), told[0]["distance"])


def train(vectors: DataFrame, cells: int, distance: str = "cosine", sample: int = 50_000, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centres of k-means over ``sample`` vectors at most, drawn by a hash of their ids; the sample and the centres are all that reaches the driver."""
    n, dim = vectors.count(), len(vectors.select("v").first()["v"])
    share = min(1.0, 1.2 * sample / max(n, 1))
    drawn = vectors.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int(share * (1 << 30))).select(as_double(F.col("v")).alias("v")).limit(sample)
    x = _near(np.array([r["v"] for r in drawn.collect()], np.float64).reshape(-1, dim), distance)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        owner = _affinity(x, centres, "euclid").argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        counts = np.bincount(owner, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def build(vectors: DataFrame, path: str, cells: int, distance: str = "cosine", sample: int = 50_000) -> Cells:
    """Store vectors (id, v) by cell. All are stored; those of another length than the first one's, and those with numbers that aren't finite, can't be compared and are left out."""
    spark = vectors.sparkSession
    distance = distance if distance in ("dot", "euclid") else "cosine"
    dim = len(vectors.select("v").first()["v"])
    rows = vectors.where(is_valid(F.col("v"), dim)).select(F.col("id").cast("long").alias("id"), as_double(F.col("v")).alias("v"))
    centres = train(rows, cells, distance, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _near(_matrix(batch.column(1), dim), distance)
                cell = np.concatenate([_affinity(x[k : k + 4096], centres, "euclid").argmax(1) for k in range(0, len(x), 4096)])
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *batch.columns], names=["cell", "id", "v"])

    rows.mapInArrow(run, "cell int, id long, v array<double>").repartition("cell").sortWithinPartitions("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    told = [(k, [float(c) for c in row], distance) for k, row in enumerate(centres)]
    spark.createDataFrame(told, "cell int, v array<double>, distance string").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    return Cells(spark, path, centres, distance)


def nearest_cells(index: Cells, x: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest cells of each vector, nearest first."""
    return np.argsort(-_affinity(_near(x, index.distance), index.centres, index.distance), axis=1, kind="stable")[:, :probes].astype(np.int32)


@dataclass
class Found:
    """hits (qid, id, score, rank), and the share of all vectors that the mean query met."""

    hits: DataFrame
    share: float


def search(index: Cells, queries: DataFrame, k: int, probes: int, digits: int = 6) -> Found:
    """Of each query (qid, v) the k nearest among the vectors of its ``probes`` nearest cells; ties go to the smaller id. As many probes as cells give the rows of ``dense.top_k``.

    Queries of another length take no part. A query goes to each part of each cell that it probes,
    a vector to the one task that scores its part; large cells are dealt into parts by a hash.
    """
    dim, distance, centres = index.centres.shape[1], index.distance, index.centres
    asked = queries.where(is_valid(F.col("v"), dim)).select(F.col("qid").cast("long").alias("qid"), as_double(F.col("v")).alias("v"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = nearest_cells(Cells(None, "", centres, distance), _matrix(batch.column(1), dim), probes)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], names=["qid", "v", "cells"])

    routed = durable(asked.mapInArrow(probe, "qid long, v array<double>, cells array<int>").select("qid", "v", F.explode("cells").alias("cell")))
    probed = {r["cell"]: r["n"] for r in routed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a cell
    sizes = {r["cell"]: r["n"] for r in index.vectors(sorted(probed)).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    every, total = index.vectors().count(), routed.select("qid").distinct().count()
    share = sum(n * sizes.get(c, 0) for c, n in probed.items()) / max(every * total, 1)
    parts = F.create_map(*(F.lit(x) for c, n in sizes.items() for x in (c, max(1, -(-n // PART))))) if sizes else F.create_map(F.lit(-1), F.lit(1))
    left = routed.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.element_at(parts, F.col("cell")), F.lit(1)) - 1)))
    right = index.vectors(sorted(probed)).withColumn("part", F.pmod(F.xxhash64("id"), F.element_at(parts, F.col("cell")).cast("long")).cast("int"))

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if a.num_rows and b.num_rows:
            q, x, qids, ids = _matrix(a["v"], dim), _matrix(b["v"], dim), a["qid"].to_numpy(), b["id"].to_numpy()
            for low in range(0, len(q), 256):
                for i, row in enumerate(np.round(_scores(q[low : low + 256], x, distance), digits) + 0.0):
                    least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                    near = np.flatnonzero(row >= least)
                    near = near[np.lexsort((ids[near], -row[near]))][:k]
                    out.append((np.full(len(near), qids[low + i]), ids[near], row[near]))
        return pa.table(dict(zip(("qid", "id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(score, "qid long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return Found(found.select("qid", "id", "score", rank.alias("rank")).where(F.col("rank") <= k), share)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact hits (qid, id) that were found."""
    return found.join(exact, ["qid", "id"], "left_semi").count() / max(exact.count(), 1)
