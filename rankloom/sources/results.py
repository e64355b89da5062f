"""Result rows as files: results.json in the questions' order, its zip, and vector tables that update in place."""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.sources.calls import file_system

FIELDS = ("id", "question", "answer", "relevant_docs", "relevant_articles")


def result_rows(items: DataFrame, questions: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """One row a question from (qid, article, position): articles in order, their documents in order, each once; empty lists for questions without any. A ``position`` of the questions is carried along."""
    doc = F.substring_index("article", "|", 2)
    first = Window.partitionBy("qid", doc).orderBy("position")
    rows = items.withColumn("doc", doc).withColumn("_n", F.row_number().over(first))
    listed = rows.groupBy("qid").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "article"))), lambda x: x["article"]).alias("relevant_articles"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("_n") == 1, F.struct("position", "doc")))), lambda x: x["doc"]).alias("relevant_docs"),
    )
    none = F.array().cast("array<string>")
    out = questions.join(listed, "qid", "left")
    out = out.join(answers.select("qid", "answer"), "qid", "left") if answers is not None else out.withColumn("answer", F.lit(""))
    carried = ["position"] if "position" in questions.columns else []
    return out.select(*carried, F.col("qid").alias("id"), "question", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("relevant_docs", none).alias("relevant_docs"), F.coalesce("relevant_articles", none).alias("relevant_articles"))


def write_results(rows: DataFrame, folder: str, position: str | None = None) -> str:
    """results.json and a zip of it alone, in the order of ``position`` (else of a column of that name, else of the ids); the zip's path.

    Executors put the rows in order and write them as lines, a part each; the parts are joined as
    bytes, by the file system that Spark knows, and no row passes through the driver's Python. Both
    files appear whole or not at all, and in place of earlier ones. ``folder`` may be on any file
    system that driver and executors share.
    """
    spark = rows.sparkSession
    position = position or ("position" if "position" in rows.columns else "id")
    parts = f"{folder}/.parts-{uuid.uuid4().hex}"
    line = F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"})
    ordered = rows.repartitionByRange(F.col(position).asc_nulls_last(), F.col("id")).sortWithinPartitions(F.col(position).asc_nulls_last(), "id")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop, path = jvm.org.apache.hadoop, lambda name: jvm.org.apache.hadoop.fs.Path(name)
    fs = path(folder).getFileSystem(conf)
    copy = jvm.org.apache.hadoop.io.IOUtils.copyBytes
    try:
        whole = path(f"{parts}/results.json")
        _join(ordered.select(line.alias("value")), f"{parts}/lines", whole, b"[", b"]\n")
        packed = path(f"{parts}/results.zip")
        archive = jvm.java.util.zip.ZipOutputStream(fs.create(packed, True))
        archive.putNextEntry(jvm.java.util.zip.ZipEntry("results.json"))
        stream = fs.open(whole)
        copy(stream, archive, conf, False)
        stream.close()
        archive.closeEntry()
        archive.close()
        context = hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        for name, made in (("results.json", whole), ("results.zip", packed)):
            context.rename(fs.makeQualified(made), fs.makeQualified(path(f"{folder}/{name}")), over)
    finally:
        fs.delete(path(parts), True)
    return f"{folder}/results.zip"


def _join(lines: DataFrame, parts: str, whole, head: bytes, tail: bytes) -> None:
    """Lines (value), in the order of their partitions, as one file: the head, the lines with a comma before each but the first, the tail."""
    spark = lines.sparkSession
    lines.select(F.concat(F.lit(","), "value")).write.text(parts)
    conf = spark._jsc.hadoopConfiguration()
    where = spark._jvm.org.apache.hadoop.fs.Path(parts)
    fs = where.getFileSystem(conf)
    written = sorted(x.getPath().getName() for x in fs.listStatus(where) if x.getPath().getName().startswith("part-") and x.getLen())
    out = fs.create(whole, True)
    out.write(bytearray(head))
    for k, part in enumerate(written):
        stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{parts}/{part}"))
        stream.seek(0 if k else 1)  # every row has a comma before it but the first
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
        stream.close()
    out.write(bytearray(tail))
    out.close()


def write_corpus_object(articles: DataFrame, path: str, version: str = "2.0") -> int:
    """The corpus as one JSON file, an object of ``version``, ``total_articles`` and ``articles``, in the order of the partitions; how many there are. Executors write the articles, the file system joins them."""
    spark, parts = articles.sparkSession, f"{path}.parts-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    n = articles.count()
    try:
        whole = hadoop.Path(f"{parts}/whole")
        head = f'{{"version":{json.dumps(version)},"total_articles":{n},"articles":['
        _join(articles.select(F.to_json(F.struct(*articles.columns), {"ignoreNullFields": "false"}).alias("value")), f"{parts}/lines", whole, head.encode(), b"]}\n")
        over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        over[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(whole), fs.makeQualified(target), over)
    finally:
        fs.delete(hadoop.Path(parts), True)
    return n


def rows_of_zip(path: str) -> Iterator[dict]:
    """The rows of a zip, one at a time; the file may lie wherever Arrow can read. Raises ``ValueError`` for what isn't a list of rows, each on a line of its own."""
    fs, name = file_system(path)
    with fs.open_input_file(name) as f, zipfile.ZipFile(f) as z, z.open("results.json") as lines:
        closed = False
        for k, line in enumerate(lines):
            text = line.decode()
            if k == 0:
                if not text.startswith("["):
                    raise ValueError("results.json isn't a list")
                text = text[1:]
            if text.endswith("]\n"):
                text, closed = text[:-2], True
            if text := text.strip().removeprefix(","):
                yield json.loads(text)
        if not closed:
            raise ValueError("results.json isn't whole")


def zip_problems(path: str, expected: Iterable | None = None) -> list[str]:
    """What is wrong with a zip: other entries, rows that aren't whole, fields that are missing or null, and, with the ``expected`` ids in order, rows out of place. Rows are read one at a time."""
    fs, name = file_system(path)
    with fs.open_input_file(name) as f, zipfile.ZipFile(f) as z:
        if z.namelist() != ["results.json"]:
            return [f"unexpected entries {z.namelist()}"]
    out, n, wanted = [], 0, iter(expected) if expected is not None else None
    try:
        for n, row in enumerate(rows_of_zip(path), 1):
            if lost := [c for c in FIELDS if row.get(c) is None]:
                out.append(f"row {n}: no {', '.join(lost)}")
            if wanted is not None and str(row.get("id")) != str(want := next(wanted, None)):
                return [*out, f"row {n}: id {row.get('id')} instead of {want}"]
    except ValueError as e:
        return [*out, f"after row {n}: {e}"]
    if wanted is not None and (want := next(wanted, None)) is not None:
        out.append(f"ends before id {want}")
    return out


def stale(wanted: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("id", "hash", "backend", "model")) -> DataFrame:
    """Rows whose vector is missing or was made from another text or by another model."""
    return wanted.join(stored.select(*keys), list(keys), "left_anti")


def upserted(stored: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """The stored rows with fresh ones in place of those of the same key."""
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def missing(wanted: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("id", "hash")) -> DataFrame:
    """What a complete store would hold besides; empty after a successful update."""
    return wanted.select(*keys).exceptAll(stored.select(*keys))
