"""Questions that arrive as files: each batch is searched once, with the same plan as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.operators import bm25


def answer_stream(spark: SparkSession, questions_dir: str, index_dir: str, out_dir: str, checkpoint_dir: str, k: int = 10) -> StreamingQuery:
    """Append the hits of new questions (JSON lines of qid, query) to ``out_dir``; questions seen before are left out, also after a restart.

    The stream keeps no state: what earlier batches asked lies in ``out_dir``/_asked, and a batch is
    joined against it. Of a question that a batch repeats, one text counts.
    """
    new = spark.readStream.schema("qid long, query string").json(questions_dir).where(F.col("qid").isNotNull())

    def search(batch: DataFrame, number: int) -> None:
        session, asked = batch.sparkSession, f"{out_dir}/_asked"
        left = batch.groupBy("qid").agg(F.max("query").alias("query"))
        if number:
            before = session.read.schema("qid long, batch long").parquet(asked).where(F.col("batch") < number)
            left = left.join(before, "qid", "left_anti")
        left = left.persist()
        # A batch that runs again replaces its own parts.
        bm25.search(bm25.Index.load(session, index_dir), left, k).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")
        left.select("qid").write.mode("overwrite").parquet(f"{asked}/batch={number}")
        left.unpersist()

    return new.writeStream.foreachBatch(search).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
