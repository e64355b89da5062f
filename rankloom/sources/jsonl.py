"""JSON lines as append-only logs: tolerant reading, the latest row per key, and what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse(lines: DataFrame, schema: str, value_col: str = "value") -> DataFrame:
    """``lines`` with ``data``; null for blank lines and for what isn't a JSON object."""
    whole = F.try_parse_json(F.col(value_col)).isNotNull() & F.trim(F.col(value_col)).startswith("{")
    return lines.withColumn("data", F.when(whole, F.from_json(value_col, schema)))


def read(spark: SparkSession, path: str, schema: str, required: list[str], keys: list[str]) -> DataFrame:
    """The last readable line of each key that has all required fields. Later files and lines win."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"))
    rows = parse(lines, schema).where("data is not null").select("data.*", "_file", "_line").dropna(subset=required)
    return latest(rows, keys, ["_file", "_line"]).drop("_file", "_line")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def todo(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't done yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
