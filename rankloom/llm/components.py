"""Connected components of large graphs by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import durable


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of it and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b")


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) of each node that has an edge; root is the least node that it reaches.

    ``edges`` has long columns a and b, in any order; loops and repeated edges don't matter. Each
    round's edges are written to the checkpoint folder; rounds end when no edge changes, after
    about the square of the logarithm of the nodes at most. Only a count and 64-bit checksums reach
    the driver.
    """
    now = durable(edges.where("a <> b").select("a", "b").distinct())
    before = None
    for _ in range(most_rounds):
        mark = F.xxhash64("a", "b")
        state = now.agg(F.count("*"), F.bit_xor(mark), F.sum(mark.cast("decimal(38,0)")), F.max(mark)).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = state
        now = durable(_small_star(_large_star(now)).distinct())
    raise RuntimeError("components didn't settle")
