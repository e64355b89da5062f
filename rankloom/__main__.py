"""Command line: list queries, run one, or run the batch workflow.

    python -m rankloom list
    python -m rankloom query bm25_topk TABLES OUT
    python -m rankloom workflow DOCUMENTS QUESTIONS FOLDER
    python -m rankloom index DOCUMENTS FOLDER
    python -m rankloom package RESULTS FOLDER
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rankloom import catalog
from rankloom.operators import bm25
from rankloom.operators.answers import problems
from rankloom.operators.segments import GrowingIndex
from rankloom.plans import retrieve, stages
from rankloom.sources import calls
from rankloom.sources.results import write_results, zip_problems
from rankloom.sources.versions import Folder, Lease


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="rankloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    query = commands.add_parser("query", help="run a query over a folder of tables and write its rows as Parquet")
    for name in ("name", "tables", "out"):
        query.add_argument(name)
    workflow = commands.add_parser("workflow", help="answer questions (qid, query) from documents (doc_id, text, article); tables that are up to date are kept")
    for name in ("documents", "questions", "folder"):
        workflow.add_argument(name)
    workflow.add_argument("--afresh", action="store_true", help="make all tables again")
    workflow.add_argument("--stop-after", default=None, help="the last stage to run")
    workflow.add_argument("--accept", action="append", default=[], metavar="KEY", help="a table, or settings, whose change doesn't matter; may be given several times")
    workflow.add_argument("--preflight", action="store_true", help="tell what would be made, and why, and stop")
    workflow.add_argument("--statuses", default=None, help="laws that are out of force (law_id, class)")
    workflow.add_argument("--threads", type=int, default=1, help="calls of a model at once in a task")
    index = commands.add_parser("index", help="bring an index of documents (doc_id, text) up to date, count it and search it for its own words")
    for name in ("documents", "folder"):
        index.add_argument(name)
    package = commands.add_parser("package", help="write result rows as results.json and its zip, and check them")
    for name in ("results", "folder"):
        package.add_argument(name)
    return out


def indexed(spark: SparkSession, documents: str, folder: str) -> int:
    """Build or rebuild the index unless it has all documents, and find some of them by their own words; 0 if it does."""
    docs = spark.read.parquet(documents).select("doc_id", "text")
    index = GrowingIndex(spark, folder).load(docs.count(), docs)
    asked = docs.where("length(text) > 0").orderBy("doc_id").limit(5).select(F.col("doc_id").alias("qid"), F.substring("text", 1, 200).alias("query"))
    found = {r["qid"] for r in bm25.search(index, asked, 10).where("qid = doc_id").collect()}
    lost = sorted({r["qid"] for r in asked.collect()} - found)
    told = index.stats.first()
    print(f"{told['n']} documents, {index.terms.count()} words; " + (f"not found by their own words: {lost}" if lost else "self-test passed"))
    return 1 if lost else 0


def packaged(spark: SparkSession, results: str, folder: str) -> int:
    rows = spark.read.parquet(results)
    path = write_results(rows, folder)
    position = "position" if "position" in rows.columns else "id"
    wrong = [f"{r['id']}: {r['problem']}" for r in problems(rows).orderBy("id").limit(20).collect()]
    wrong += zip_problems(path, (r["id"] for r in rows.orderBy(position, "id").select("id").toLocalIterator()))[:20]
    print("\n".join([path, *wrong]))
    return 1 if wrong else 0


def main(args: list[str] | None = None) -> int:
    told = parser().parse_args(args)
    if told.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if told.command == "query":
        catalog.QUERIES[told.name](spark, told.tables).write.mode("overwrite").parquet(told.out)
        return 0
    if told.command == "index":
        return indexed(spark, told.documents, told.folder)
    if told.command == "package":
        return packaged(spark, told.results, told.folder)
    inputs = {"documents": spark.read.parquet(told.documents), "questions": spark.read.parquet(told.questions)}
    if told.statuses:
        inputs["statuses"] = spark.read.parquet(told.statuses)
    steps = retrieve.workflow(models=retrieve.Models(workers=calls.Workers(told.threads), ledgers=f"{told.folder}/_ledgers"))
    if told.preflight:
        for name, what in stages.preflight(spark, steps, told.folder, inputs, accepted=set(told.accept)).items():
            print(f"{name}: {what}")
        return 0
    try:
        with Lease(Folder(spark, told.folder), f"workflow-{os.getpid()}", 24 * 3600.0):
            stages.run(spark, steps, told.folder, inputs, not told.afresh, told.stop_after, accepted=set(told.accept))
    finally:
        for name, status in stages.statuses(spark, steps, told.folder).items():
            print(f"{name}: {status}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
