"""Small operators: maps, references in two forms, strict look-ups, backups, corpus objects, messages read back."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from rankloom.functions import maps
from rankloom.functions import text as T
from rankloom.operators import citations
from rankloom.plans import checks
from rankloom.sources import artifacts, results, tables
from rankloom.sources.versions import Folder


def test_the_right_map_wins(spark):
    rows = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3"}), (None, {"a": "1"}), ({"a": "1"}, None), (None, None), ({}, {"x": "y"})], "l map<string,string>, r map<string,string>")
    got = [r["m"] for r in rows.select(maps.merged(F.col("l"), F.col("r")).alias("m")).collect()]
    assert got == [{"a": "1", "b": None, "c": "3"}, {"a": "1"}, {"a": "1"}, None, {"x": "y"}]
    assert rows.select(maps.with_defaults(F.col("l"), F.col("r")).alias("m")).first()["m"] == {"a": "1", "b": "2", "c": "3"}


def test_references_in_two_forms(spark):
    row = spark.createDataFrame([("1/2020/QH", "Luật", "Thuế", "Điều 5")], "i string, t string, n string, d string")
    told = row.select(T.article_ref(*map(F.col, "itnd")).alias("a"), T.article_ref(*map(F.col, "itnd"), coded=True).alias("b"), T.document_ref(*map(F.col, "itn"), coded=True).alias("c")).first()
    assert tuple(told) == ("1/2020/QH|Luật Thuế|Điều 5", "1/2020/QH|Luật 1/2020/QH Thuế|Điều 5", "1/2020/QH|Luật 1/2020/QH Thuế")


def test_unknown_keys_stay_or_are_errors(spark):
    refs = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "n long, article string")
    table = spark.createDataFrame([("a", "x"), ("a", "x")], "article string, title string")
    assert sorted(map(tuple, checks.looked_up(refs, table, "article").collect())) == [(1, "a", "x"), (2, "z", None), (3, None, None)]
    assert checks.looked_up(refs.where("n = 1"), table, "article", strict=True).count() == 1
    with pytest.raises(Exception, match="isn't known: z"):
        checks.looked_up(refs.where("n < 3"), table, "article", strict=True).collect()


def test_pairs_are_read_back_from_a_message(spark):
    rows = spark.createDataFrame([("Theo Điều 5a Luật 59/2020/QH14. Theo Điều 7 Luật 1/2021/NĐ-CP.", [("Điều 1", "59/2020/QH14")])], "a string, e array<struct<number:string,law_id:string>>")
    told = rows.select(citations.check(F.col("a"), F.col("e")).alias("c")).select("c.outside", citations.pairs_told(F.col("c.detail")).alias("back")).first()
    assert told["back"] == told["outside"] and len(told["back"]) == 2


def test_backups_and_caches_set_aside(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    assert not folder.backup_once("corpus", "corpus.bak") and folder.set_aside("cache") is None
    spark.range(3).write.parquet(str(tmp_path / "corpus"))
    assert folder.backup_once("corpus", "corpus.bak") and spark.read.parquet(str(tmp_path / "corpus.bak")).count() == 3
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "corpus"))
    assert not folder.backup_once("corpus", "corpus.bak") and spark.read.parquet(str(tmp_path / "corpus.bak")).count() == 3
    for k in (1, 2):
        (tmp_path / "cache").write_text(str(k))
        assert folder.set_aside("cache") == f"cache.{k}"
    assert (tmp_path / "cache.1").read_text() == "1" and not os.path.exists(tmp_path / "cache")


def test_a_corpus_as_one_object(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"điều {k}", None if k % 2 else ["a"]) for k in range(25)], "chunk_id string, content string, list array<string>").repartition(4)
    path = str(tmp_path / "corpus.json")
    assert results.write_corpus_object(rows, path) == 25
    told = json.load(open(path))
    assert told["version"] == "2.0" and told["total_articles"] == len(told["articles"]) == 25 and set(told["articles"][0]) == {"chunk_id", "content", "list"}
    assert results.write_corpus_object(rows.limit(0), path) == 0 and json.load(open(path))["articles"] == []
    results.write_corpus_object(rows.select("chunk_id", "content"), path)
    assert tables.read_corpus(spark, path).count() == 25


def test_long_reports_say_what_they_leave_out(spark):
    text = artifacts.report({"Kinds": spark.range(12).groupBy((F.col("id") % 6).alias("kind")).count()}, most=4)
    assert text.count("| ") >= 5 and "and 2 more" in text and "more" not in artifacts.report({"Kinds": spark.range(3)})
