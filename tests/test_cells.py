"""Vectors in cells: exact when all cells are probed, near it from few cells where vectors cluster."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import cells, dense


def frame(spark, x):
    return spark.createDataFrame([(k, [float(c) for c in row]) for k, row in enumerate(x)], "id long, v array<double>").repartition(4)


def asked(rows):
    return rows.where("id % 40 = 0").select(F.col("id").alias("qid"), "v")


@pytest.mark.parametrize("distance", ["cosine", "dot", "euclid"])
def test_all_cells_are_exact_and_few_are_near_it_where_vectors_cluster(spark, tmp_path, monkeypatch, distance):
    monkeypatch.setattr(cells, "PART", 60)
    rng = np.random.default_rng(2)
    rows = frame(spark, rng.normal(size=(20, 16))[rng.integers(0, 20, 1200)] * 3 + rng.normal(size=(1200, 16)) * 0.3)
    index = cells.build(rows, str(tmp_path / "c"), 24, distance)
    exact = dense.top_k(asked(rows), rows, 10, distance)
    whole = cells.search(index, asked(rows), 10, 24)
    assert sorted(map(tuple, whole.hits.collect())) == sorted(map(tuple, exact.collect())) and whole.share == pytest.approx(1.0)
    some = cells.search(cells.Cells.load(spark, str(tmp_path / "c")), asked(rows), 10, 4)
    assert cells.recall(some.hits, exact) >= 0.9 and some.share < 0.4


def test_given_vectors_need_most_cells(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    index = cells.build(rows, str(tmp_path / "c"), 32)
    exact = dense.top_k(rows.where("id % 10 = 0").select(F.col("id").alias("qid"), "v"), rows, 10)
    found = cells.search(index, rows.where("id % 10 = 0").select(F.col("id").alias("qid"), "v"), 10, 26)
    print("share", found.share, "recall", cells.recall(found.hits, exact))
    assert cells.recall(found.hits, exact) >= 0.9 and found.share < 0.95


def test_unprobed_cells_are_not_read(spark, tmp_path):
    rng = np.random.default_rng(3)
    index = cells.build(frame(spark, rng.normal(size=(200, 4))), str(tmp_path / "c"), 8)
    plan = index.vectors([1, 3])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)
    odd = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [1.0]), (3, None), (4, [float("nan")] * 4)], "qid long, v array<double>")
    found = cells.search(index, odd, 300, 8)
    assert {r["qid"] for r in found.hits.select("qid").distinct().collect()} == {1} and found.hits.count() == 200
    assert cells.search(index, odd.where("qid = 9"), 3, 2).hits.collect() == []
