"""What operators keep between jobs: the shared checkpoint folder, and column names that clash with none."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; a cluster's executors couldn't see one, so there it is an error.
    """
    context = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if told is None and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(told or tempfile.mkdtemp(prefix="checkpoint-"))
    return told or context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut.

    What was shuffled for it isn't needed any more, so the driver collects its garbage, upon which
    Spark removes the files; else they would stay on the executors' disks to the end of the job.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    _collect(df.sparkSession)
    return out


def _collect(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[tuple[Callable[..., DataFrame], Callable[[DataFrame], None]]]:
    """(keep, drop): ``keep`` is like ``durable``, but as compressed Parquet, and the rows of several tables, made one after the other, become one; ``drop`` removes what was kept. At the end all that is left goes.

    For large tables that only the jobs within need; what is returned unevaluated must not read them.
    """
    folder, places = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", {}

    def remove(place: str) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def keep(*parts: DataFrame) -> DataFrame:
        place = f"{folder}/{len(places)}"
        for df in parts:
            df.write.mode("append").option("compression", "zstd").parquet(place)
            _collect(spark)
        out = spark.read.schema(parts[0].schema).parquet(place)
        places[id(out)] = out, place
        return out

    try:
        yield keep, lambda df: remove(places[id(df)][1])
    finally:
        remove(folder)


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores before it until it clashes with no taken one; case doesn't tell names apart."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out
