"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from math import erf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import durable
from .words import mix


@dataclass(frozen=True)
class Hashing:
    """Tables of p-stable hashes: floor((a.v + b) / width) for each of ``hashes`` projections; all hashes of a table name a bucket."""

    tables: int = 2
    hashes: int = 8
    width: float = 2.4
    seed: int = 11
    #: Perturbed buckets are visited in order of estimated success until they hold this much of it, in each table; from 1 on, all buckets of one table are.
    success: float = 0.75
    #: Typical distance of a near neighbour, by which success is estimated.
    distance: float = 1.2
    #: Vectors that a cell, named by the first hashes of a table, should hold at most. Hashes are added until it does.
    cell_rows: int = 8192

    def projections(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.standard_normal((self.tables, self.hashes, dim)), rng.uniform(0, self.width, (self.tables, self.hashes))

    def cell_hashes(self, n: int) -> int:
        """So many hashes that their cells, about three a hash, hold ``cell_rows`` of n vectors."""
        return next((m for m in range(self.hashes) if 3**m * self.cell_rows >= n), self.hashes)


def lift(x: np.ndarray, largest: float) -> np.ndarray:
    """Rows scaled by the largest norm, with a further coordinate that makes them unit vectors: the nearest of them have the largest inner product."""
    scaled = x / largest
    return np.column_stack([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))])


def unit(q: np.ndarray) -> np.ndarray:
    """Queries as unit vectors with a zero at the further coordinate."""
    return np.column_stack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))])


def steps(hashes: int) -> np.ndarray:
    """All perturbations: each hash one down, as it is, or one up."""
    return np.array([*product((-1, 0, 1), repeat=hashes)], np.int8).reshape(3**hashes, hashes)


_erf = np.vectorize(erf, otypes=[float])


def chances(at: np.ndarray, hashing: Hashing) -> tuple[np.ndarray, np.ndarray]:
    """(own bucket, log chances [query, hash, step + 1]) of queries at these places of the projections.

    A neighbour's projection lies a Gaussian step away, with the neighbour's distance as its deviation.
    """
    own = np.floor(at / hashing.width)
    inside = at - own * hashing.width
    below = lambda edge: 0.5 * _erf((edge * hashing.width - inside) / (hashing.distance * np.sqrt(2)))
    edges = [below(k) for k in (-1, 0, 1, 2)]
    return own.astype(np.int64), np.log(np.maximum(np.stack([edges[k + 1] - edges[k] for k in range(3)], axis=2), 1e-300))


def visiting_order(logs: np.ndarray, moves: np.ndarray, success: float) -> tuple[np.ndarray, np.ndarray]:
    """(perturbations by falling success, how many of them are visited) for each query."""
    total = np.zeros((len(logs), len(moves)))
    for h in range(moves.shape[1]):
        total += logs[:, h, :][:, moves[:, h] + 1]
    order = np.argsort(-total, axis=1, kind="stable")
    seen = np.cumsum(np.exp(np.take_along_axis(total, order, 1)), axis=1)
    return order, np.minimum((seen < success * seen[:, -1:]).sum(1) + 1, len(moves))


def least_chances(logs: np.ndarray, success: float, leading: int, together: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """(log chance of the least likely bucket that each query visits, whether it visits any bucket of each perturbation of the ``leading`` hashes): as ``visiting_order`` tells, without the order."""
    front, rest = steps(leading), steps(logs.shape[1] - leading)
    least, any_of = np.zeros(len(logs)), np.zeros((len(logs), len(front)), bool)
    for low in range(0, len(logs), together):
        some = logs[low : low + together]
        lead, tail = (sum((some[:, at + h, :][:, m[:, h] + 1] for h in range(m.shape[1])), np.zeros((len(some), len(m)))) for at, m in ((0, front), (leading, rest)))
        total = (lead[:, :, None] + tail[:, None, :]).reshape(len(some), -1)
        total.sort(axis=1)
        total = total[:, ::-1]
        seen = np.cumsum(np.exp(total), axis=1)
        visits = np.minimum((seen < success * seen[:, -1:]).sum(1) + 1, total.shape[1])
        # Sums in another order may differ in the last digits; a bucket that is just as likely may be visited besides.
        least[low : low + together] = cut = total[np.arange(len(some)), visits - 1] - 1e-9
        any_of[low : low + together] = lead + tail.max(axis=1, keepdims=True) >= cut[:, None]
    return least, any_of


def visited_buckets(own: np.ndarray, logs: np.ndarray, least: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """Which of the buckets with these coordinates each query visits: those at most one off in each hash, and at least so likely."""
    total = np.zeros((len(own), len(floors)))
    for h in range(floors.shape[1]):
        names, which = np.unique(floors[:, h], return_inverse=True)
        step = names[None, :] - own[:, h, None]
        chance = np.where(np.abs(step) <= 1, np.take_along_axis(logs[:, h], np.clip(step, -1, 1) + 1, 1), -np.inf)
        total += chance[:, which.ravel()]
    return total >= least[:, None]


def codes(buckets: np.ndarray) -> np.ndarray:
    """One number for each row of bucket coordinates; rows of no coordinates have one number."""
    out = np.zeros(len(buckets), np.uint64)
    for h in range(buckets.shape[1]):
        out = mix(out + buckets[:, h].astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def search_cell(q_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray | None, ids: np.ndarray, x: np.ndarray, table: int, k: int, largest: float, hashing: Hashing, together: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, inner product) of the best k of the vectors of one cell that lie in the buckets which each query visits, those of a log chance of ``bounds`` at least, or in all of them if there are none."""
    a, b = hashing.projections(q.shape[1] + 1)
    a, b = a[table], b[table]
    place = np.floor((lift(x, largest) @ a.T + b) / hashing.width).astype(np.int64)
    floors, member = np.unique(place, axis=0, return_inverse=True)
    order = np.argsort(member.ravel(), kind="stable")
    ids, x, counts = ids[order], x[order], np.bincount(member.ravel())  # vectors of a bucket lie side by side
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for low in range(0, len(q), together):
        qs, own_id = q[low : low + together], q_ids[low : low + together]
        visited = np.ones((len(qs), len(floors)), bool)
        if bounds is not None:
            visited = visited_buckets(*chances(unit(qs) @ a.T + b, hashing), bounds[low : low + together], floors)
        met = visited.any(0)
        some = np.flatnonzero(np.repeat(met, counts))
        if not len(some):
            continue
        scores = np.where(np.repeat(visited[:, met], counts[met], axis=1), qs @ x[some].T, -np.inf)
        scores[own_id[:, None] == ids[some][None, :]] = -np.inf
        # All that may be among the best k, rounding aside; then exact sums decide, with ties to the smaller id.
        kth = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(qs), -np.inf)
        least = np.where(np.isfinite(kth), kth - 1e-9 * (1 + np.abs(kth)), -np.inf)
        i, j = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
        exact = np.einsum("ij,ij->i", qs[i], x[some[j]])
        order = np.lexsort((ids[some[j]], -exact, i))
        i, j, exact = i[order], some[j[order]], exact[order]
        best = np.arange(len(i)) - np.searchsorted(i, np.arange(len(qs)))[i] < k
        out.append((own_id[i[best]], ids[j[best]], exact[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector of double) of vectors that are neither null nor zero, with finite components only; one row for each id."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(F.size(v) > 0, v).alias("v"), bad.alias("bad"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.col("bad") & F.exists("v", lambda c: c != 0)).groupBy("id").agg(F.min("v").alias("v"))


def _rows(batches: Iterator[pa.RecordBatch], dim: int, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, at_once):
            part = batch.slice(at, at_once)
            yield part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(-1, dim)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", hashing: Hashing = Hashing(), part_rows: int = 16_384, part_queries: int = 4_096) -> DataFrame:
    """For each row that ``is_query`` (on column ``id``) picks, its k best others by inner product: query_id, rank, vec_id, score.

    Each table deals every vector once, to the cell that its first hashes name; more vectors have
    more cells. A query visits the perturbed buckets of a table in the order of their estimated
    success and goes to the cells that hold visited buckets, once each. Cells with many vectors or
    many queries are split into parts of ``part_rows`` and ``part_queries``, so no bucket is hot,
    and nothing of it is dropped. In a part, exact inner products in double precision rank the
    candidates; it gives k rows a query at most. Tables' candidates are merged by the pair of ids.
    Queries that met fewer than k candidates then visit every bucket of one table.

    Null, zero and non-finite vectors take no part, nor do rows without id; of repeated ids one
    vector counts, the least. Vectors of another length than the most frequent one take no part.
    Fewer than k candidates: all. Ties: the smaller id. An empty table gives no rows.
    """
    rows = durable(valid(vectors, id_col, vector_col))
    facts = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))).alias("largest")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, n, largest = facts[0] if facts else (0, 0, 1.0)
    rows = rows.where(F.size("v") == dim).select("id", "v")
    queries = rows.where(is_query)
    leading = hashing.cell_hashes(n)
    a, b = hashing.projections(dim + 1)
    front = steps(leading)

    def cells_of_vectors(ids: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(table, row, cell, zeros) of all rows, by table."""
        lifted = lift(x, largest)
        for t in range(hashing.tables):
            yield t, np.arange(len(x)), codes(np.floor((lifted @ a[t, :leading].T + b[t, :leading]) / hashing.width)), np.zeros(len(x))

    def cells_of_queries(ids: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(table, row, cell, log chance of the row's least likely visited bucket) of the cells with buckets that a query visits, each once."""
        for t in range(hashing.tables):
            own, logs = chances(unit(q) @ a[t].T + b[t], hashing)
            bounds, goes = least_chances(logs, hashing.success, leading)
            row, move = np.nonzero(goes)
            both = np.unique(np.column_stack([row, codes(own[row][:, :leading] + front[move])]), axis=0)
            yield t, both[:, 0], both[:, 1], bounds[both[:, 0]]

    def counts(df: DataFrame, cells) -> dict[tuple[int, int], int]:
        """Rows of each cell: at most some four for each leading hash and table, whatever the number of rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, x in _rows(batches, dim, 256):
                for t, _, cell, _ in cells(ids, x):
                    names, times = np.unique(cell, return_counts=True)
                    yield pa.record_batch({"table": pa.array(np.full(len(names), t, np.int32)), "cell": pa.array(names), "n": pa.array(times.astype(np.int64))})

        return {(r["table"], r["cell"]): r["n"] for r in df.mapInArrow(run, "table int, cell long, n long").groupBy("table", "cell").agg(F.sum("n").alias("n")).toLocalIterator()}

    def dealt(df: DataFrame, cells, own_parts: dict, other_parts: dict, whole: bool) -> DataFrame:
        """Rows (table, cell, part, q_part, id, bound, v): each row in one part of its own kind, and in every part of the other kind."""
        vectors = cells is cells_of_vectors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, x in _rows(batches, dim, 256):
                for t, row, cell, bound in cells(ids, x):
                    if whole and t:
                        continue
                    if whole and not vectors:
                        every = np.array([c for u, c in other_parts if u == 0], np.int64)
                        row, cell = np.repeat(np.arange(len(ids)), len(every)), np.tile(every, len(ids))
                        bound = np.zeros(len(row))
                    names, which = np.unique(cell, return_inverse=True)
                    mine = np.array([own_parts.get((t, c), 1) for c in names.tolist()], np.int64)[which.ravel()]
                    others = np.array([other_parts.get((t, c), 0) for c in names.tolist()], np.int64)[which.ravel()]
                    own = (mix(ids[row].astype(np.int64).view(np.uint64)) % mine.astype(np.uint64)).astype(np.int32)
                    take = np.repeat(np.arange(len(row)), others)
                    other = (np.arange(len(take)) - np.repeat(np.cumsum(others) - others, others)).astype(np.int32)
                    part, q_part = (own[take], other) if vectors else (other, own[take])
                    body = pa.array(x[row[take]].ravel())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(take) + 1, dtype=np.int32) * dim), body)
                    yield pa.record_batch({"table": pa.array(np.full(len(take), t, np.int32)), "cell": pa.array(cell[take]), "part": pa.array(part), "q_part": pa.array(q_part), "id": pa.array(ids[row[take]]), "bound": pa.array(bound[take]), "v": lists})

        return df.mapInArrow(run, "table int, cell long, part int, q_part int, id long, bound double, v array<double>")

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return table["id"].to_numpy(), table["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)

    def search(asked: DataFrame, whole: bool) -> DataFrame:
        parts = {c: -(-m // part_rows) for c, m in counts(rows, cells_of_vectors).items()}
        if whole:
            number = -(-asked.count() // part_queries)
            q_parts = {c: number for c in parts if c[0] == 0}
        else:
            q_parts = {c: -(-m // part_queries) for c, m in counts(asked, cells_of_queries).items() if c in parts}
        data = dealt(rows, cells_of_vectors, parts, q_parts, whole)
        questions = dealt(asked, cells_of_queries, q_parts, parts, whole)

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            if left.num_rows and right.num_rows:
                q_ids, q = matrix(left)
                found = search_cell(q_ids, q, None if whole else left["bound"].to_numpy(), *matrix(right), key[0].as_py(), k, largest, hashing)
            return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

        keys = ["table", "cell", "part", "q_part"]
        return questions.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return once.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

    if not n:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    found = durable(ranked(search(queries, hashing.success >= 1)))
    enough = found.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1)).select(F.col("query_id").alias("id"))
    left = durable(queries.join(enough, "id", "left_anti"))
    if left.isEmpty():
        return found
    return found.join(left.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(*found.columns).unionByName(ranked(search(left, True)))
