"""One question through the batch workflow's own stages, over tables laid out so that it reads little of them."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import bm25, cells
from rankloom.plans import retrieve
from rankloom.sources.durable import durable

#: Stages that read stored tables, and those that follow, in turn.
FOUND = ("fused", "hits")
AFTER = ("reranked", "union", "candidates", "selected", "cleaned", "together", "gated", "final", "answers", "results")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def prepare(tables: dict[str, DataFrame], folder: str, buckets: int = 64, groups: int = 32) -> None:
    """Lay out a batch run's tables (postings, terms, stats, vectors, documents) for single questions: words and documents by a hash, vectors by cell; each bucket is a folder, which a reader skips unless it needs it."""
    for name, key in (("postings", "term"), ("terms", "term"), ("documents", "doc_id")):
        rows = tables[name].withColumn("bucket", _bucket(F.col(key), buckets))
        rows.repartition("bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}")
    tables["stats"].withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{folder}/stats")
    cells.build(tables["vectors"], f"{folder}/cells", groups)


@dataclass
class Reply:
    """A question's result row, all tables on the way to it, and of each stored table how many files were read, and how many there are."""

    row: Row
    tables: dict[str, DataFrame]
    files: dict[str, tuple[int, int]] = field(default_factory=dict)


@dataclass
class Server:
    """Answers questions from a prepared folder. ``probes`` are the cells that a text's vector is looked up in; None looks into all, as the batch does."""

    spark: SparkSession
    folder: str
    models: retrieve.Models = field(default_factory=retrieve.Models)
    probes: int | None = None
    settings: dict = field(default_factory=dict)

    def _stored(self, name: str, key: str, wanted: list, reply: Reply) -> DataFrame:
        """The rows of some keys, from their buckets alone. The keys are those of one question: words, or documents found."""
        rows = self.spark.read.parquet(f"{self.folder}/{name}")
        buckets = self.spark.read.parquet(f"{self.folder}/stats").first()["buckets"]
        keys = self.spark.createDataFrame([(w,) for w in wanted], f"k {rows.schema[key].dataType.simpleString()}")
        near = [r[0] for r in keys.select(_bucket(F.col("k"), buckets)).distinct().collect()]
        out = rows.where(F.col("bucket").isin(near) & F.col(key).isin(wanted)) if wanted else rows.limit(0)
        read = {f.rsplit("/", 1)[0].rsplit("=", 1)[-1] for f in rows.inputFiles()}
        reply.files[name] = (len(read & {str(b) for b in near}), len(read))
        return out.drop("bucket")

    def ask(self, qid: int, question: str) -> Reply:
        """The result of one question; the same row as the batch's, if all cells are probed. Models are asked as in the batch, and through its ledgers if there are any."""
        make = {s.name: s.make for s in retrieve.workflow(models=self.models, **self.settings)}
        t: dict[str, DataFrame] = {"questions": self.spark.createDataFrame([(qid, question)], "qid long, query string")}
        reply = Reply(Row(), t)
        t["analysis"] = durable(make["analysis"](self.spark, t))
        words = [r["term"] for r in bm25.words_of(t["analysis"]).collect()]
        t["postings"], t["terms"] = (self._stored(name, "term", words, reply) for name in ("postings", "terms"))
        t["stats"] = self.spark.read.parquet(f"{self.folder}/stats").drop("buckets")
        t["asked_vectors"] = durable(make["asked_vectors"](self.spark, t))
        index = cells.Cells.load(self.spark, f"{self.folder}/cells")
        asked = np.array([r["v"] for r in t["asked_vectors"].collect()], np.float64)  # the question, its topic and its intents
        probes = len(index.centres) if self.probes is None else self.probes
        near = sorted({int(c) for row in cells.nearest_cells(index, asked, probes) for c in row})
        t["vectors"] = index.vectors(near).select("id", "v")
        reply.files["vectors"] = (len(near), len(index.centres))
        for name in FOUND:
            t[name] = durable(make[name](self.spark, t))
        found = sorted({r["doc_id"] for name in FOUND for r in t[name].select("doc_id").distinct().collect()})  # as many as the depths allow
        t["documents"] = durable(self._stored("documents", "doc_id", found, reply))
        for name in AFTER:
            t[name] = durable(make[name](self.spark, t))
        reply.row = t["results"].first()
        return reply
