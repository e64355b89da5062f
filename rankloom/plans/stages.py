"""A workflow of stages over tables in a folder: each is checked, run if needed, and checked again."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Stage:
    """A table's name, what makes it from the tables before it, a check that lists its problems, and how often it may be made before these block the run."""

    name: str
    make: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    problems: Callable[[DataFrame, dict[str, DataFrame]], list[str]] = lambda df, tables: []
    passes: int = 1


def fingerprint(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


@dataclass
class Manifest:
    """What a run was made from; a later run may differ in accepted keys only."""

    keys: dict[str, str]
    stages: dict[str, str] = field(default_factory=dict)

    def refused(self, now: dict[str, str], accepted: set[str] = frozenset()) -> list[str]:
        return sorted(k for k in {*self.keys, *now} if self.keys.get(k) != now.get(k) and k not in accepted)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def content(df: DataFrame) -> str:
    """A digest of a table's columns and rows, whatever their order; one pass, three numbers to the driver."""
    mark = F.xxhash64(*df.columns) if df.columns else F.lit(0).cast("long")
    told = df.agg(F.count("*"), F.bit_xor(mark), F.sum(mark.cast("decimal(38,0)"))).first()
    return fingerprint([df.schema.simpleString(), *map(str, told)])


def stamp(df: DataFrame) -> str:
    """What tells one state of a table from another: of a table that is read straight from files their names, lengths and times, without reading them; of any other one its ``content``."""
    if not df._jdf.queryExecution().analyzed().nodeName().startswith("LogicalRelation"):
        return content(df)
    spark, out = df.sparkSession, []
    folders = sorted({name.rsplit("/", 1)[0] for name in df.inputFiles()})
    wanted = {name.rsplit("/", 1)[1] for name in df.inputFiles()}
    for folder in folders:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        for x in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where):
            if (name := x.getPath().getName()) in wanted:
                out.append(f"{folder}/{name} {x.getLen()} {x.getModificationTime()}")
    return fingerprint([df.schema.simpleString(), *sorted(out)])


def _noted(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"]) if exists(spark, path) else {}


def _note(spark: SparkSession, path: str, what: dict) -> None:
    spark.createDataFrame([(json.dumps(what, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _paths(folder: str, stage: Stage) -> tuple[str, str, str]:
    """Where a stage's table, its manifest and its status lie."""
    return tuple(f"{folder}/{part}{stage.name}" for part in ("", "_manifest/", "_status/"))


def preflight(spark: SparkSession, stages: list[Stage], folder: str, inputs: dict[str, DataFrame], settings: dict | None = None, accepted: frozenset[str] | set[str] = frozenset(), stamped: Callable[[DataFrame], str] = stamp) -> dict[str, str]:
    """What a run would do with each stage, without running any: ``kept``, or ``made``, with the reason."""
    prints, out = {name: stamped(df) for name, df in inputs.items()} | {"settings": fingerprint(settings or {})}, {}
    for stage in stages:
        path, manifest, _ = _paths(folder, stage)
        told = _noted(spark, manifest)
        if not exists(spark, path) or not told:
            out[stage.name] = "made: there is no table"
        elif changed := Manifest(told.get("keys", {})).refused(prints, set(accepted)):
            out[stage.name] = f"made: {', '.join(changed)} changed"
        elif wrong := stage.problems(spark.read.parquet(path), {n: spark.read.parquet(f"{folder}/{n}") for n in out} | inputs):
            out[stage.name] = f"made: {'; '.join(wrong)}"
        else:
            out[stage.name] = "kept"
        # What is made anew has another stamp than any that a later stage was made from.
        prints[stage.name] = stamped(spark.read.parquet(path)) if out[stage.name] == "kept" else "to be made"
    return out


def run(
    spark: SparkSession, stages: list[Stage], folder: str, inputs: dict[str, DataFrame], resume: bool = True, stop_after: str | None = None, settings: dict | None = None, wait: float = 5.0, longest: float = 60.0,
    sleep: Callable[[float], None] = time.sleep, accepted: frozenset[str] | set[str] = frozenset(), stamped: Callable[[DataFrame], str] = stamp,
) -> dict[str, DataFrame]:
    """All tables of the workflow. Beside each lies a manifest of what it was made from.

    A stage isn't run again if its table is there, was made from tables of the same stamp under
    the same settings, and has no problem. Changes of the ``accepted`` keys (names of tables, or
    ``settings``) don't matter; what was accepted is kept in the manifest's history. One that has
    problems is made again, up to its number of passes, after waits that double; then the run is
    blocked and raises. ``folder``/_status has each stage's last status: running, complete or
    blocked; errors are kept there as well.
    """
    tables = dict(inputs)
    prints = {name: stamped(df) for name, df in inputs.items()}
    for stage in stages:
        path, manifest, status = _paths(folder, stage)
        made_from = Manifest({**prints, "settings": fingerprint(settings or {})})
        told = _noted(spark, manifest)
        before = Manifest(told.get("keys", {}))
        done = resume and exists(spark, path) and told != {} and not before.refused(made_from.keys, set(accepted)) and not stage.problems(spark.read.parquet(path), tables)
        wrong: list[str] = []
        for k in range(0 if done else max(1, stage.passes)):
            if k:
                sleep(min(longest, wait * 2 ** (k - 1)))
            _note(spark, status, {"status": "running", "pass": k + 1})
            try:
                stage.make(spark, tables).write.mode("overwrite").parquet(path)
            except Exception as e:
                _note(spark, status, {"status": "failed", "pass": k + 1, "error": f"{type(e).__name__}: {e}"[:2000]})
                raise
            wrong = stage.problems(spark.read.parquet(path), tables)
            if not wrong:
                break
        if wrong:
            _note(spark, status, {"status": "blocked", "problems": wrong})
            raise RuntimeError(f"stage {stage.name}: {'; '.join(wrong)}")
        tables[stage.name] = spark.read.parquet(path)
        prints[stage.name] = stamped(tables[stage.name])
        changed = before.refused(made_from.keys) if done else []
        if not done or changed:
            history = [*told.get("history", []), {"accepted": changed, "from": before.keys}] if changed else told.get("history", [])
            _note(spark, manifest, {"keys": made_from.keys, "history": history})
            _note(spark, status, {"status": "complete"})
        if stage.name == stop_after:
            break
    return tables


def statuses(spark: SparkSession, stages: list[Stage], folder: str) -> dict[str, str]:
    """Each stage's last status; ``pending`` where there is none."""
    return {s.name: _noted(spark, f"{folder}/_status/{s.name}").get("status", "pending") for s in stages}
