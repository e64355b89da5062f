"""Calls of remote models from DataFrames: several in flight in a task, within a rate, and written down as they end.

A client takes a payload and gives a reply, both strings. It is pickled to the tasks; ``PerThread``
makes one for each thread, for clients that aren't safe to share.

A ledger is a folder that driver and executors share. A task commits what it was told chunk by
chunk, as Parquet files that appear whole or not at all. So a task that is tried again, a stage that
is run again after a failure, or a later run with more questions asks only what nobody was told yet.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEDGER = pa.schema([("digest", pa.string()), ("reply", pa.string()), ("error", pa.string()), ("run", pa.string()), ("at", pa.float64())])
LEDGER_DDL = "digest string, reply string, error string, run string, at double"
#: Characters of an error that are kept.
MOST = 500


@dataclass(frozen=True)
class Workers:
    """How a task calls: ``threads`` calls at once; with a ``rate``, so many calls a second of all tasks together, of which each of ``tasks`` tasks gets an equal share."""

    threads: int = 1
    rate: float | None = None
    tasks: int | None = None

    def __post_init__(self) -> None:
        if self.threads < 1 or (self.rate is not None and (self.rate <= 0 or not self.tasks)):
            raise ValueError("one thread at least, and a rate needs the number of tasks that share it")

    def dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.tasks) if self.tasks else rows

    def pace(self) -> Pace:
        return Pace(None if self.rate is None else self.rate / self.tasks)


class Pace:
    """Waits so that calls of all threads of a task begin at equal distances at least."""

    def __init__(self, rate: float | None, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.next, self.now, self.sleep, self.lock = (1 / rate if rate else 0.0), 0.0, now, sleep, threading.Lock()

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            begin = max(self.now(), self.next)
            self.next = begin + self.gap
        if (left := begin - self.now()) > 0:
            self.sleep(left)


class PerThread:
    """A client that makes one of its own in each thread."""

    def __init__(self, make: Callable[[], Callable[[str], str]]) -> None:
        self.make, self.own = make, threading.local()

    def __call__(self, payload: str) -> str:
        if not hasattr(self.own, "client"):
            self.own.client = self.make()
        return self.own.client(payload)

    def __reduce__(self):
        return PerThread, (self.make,)


def told(client: Callable[[str], str], payload: str, pace: Pace) -> tuple[str | None, str | None]:
    """(reply, error) of one call; a failure is an error and no exception."""
    try:
        pace.wait()
        return client(payload), None
    except Exception as e:  # one call's failure must not fail the others
        return None, f"{type(e).__name__}: {e}"[:MOST]


def in_flight(pool: ThreadPoolExecutor, call: Callable, items: Iterable, window: int) -> Iterator[tuple]:
    """(item, result) in the order of the items, of which no more than ``window`` are under way or waiting to be taken."""
    open_calls: deque[tuple[object, Future]] = deque()
    for item in items:
        if len(open_calls) == window:
            done, future = open_calls.popleft()
            yield done, future.result()
        open_calls.append((item, pool.submit(call, item)))
    while open_calls:
        done, future = open_calls.popleft()
        yield done, future.result()


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path, as executors reach it without Spark: local or mounted, HDFS, or an object store."""
    whole = f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path
    return pa.fs.FileSystem.from_uri(whole)


@dataclass(frozen=True)
class Ledger:
    """Replies by a digest of the settings and the payload, of one stage.

    A chunk is committed after ``chunk`` calls or ``seconds``, whichever comes first. ``settings``
    names all else that replies depend on, such as the model.
    """

    folder: str
    stage: str
    settings: str = ""
    chunk: int = 32
    seconds: float = 30.0

    @property
    def path(self) -> str:
        return f"{self.folder.rstrip('/')}/{self.stage}"

    def digest(self, payload: Column) -> Column:
        return F.sha2(F.concat(F.lit(f"{self.stage}\n{self.settings}\n"), payload), 256)

    def rows(self, spark: SparkSession) -> DataFrame:
        """All that was ever committed; no rows before the first chunk."""
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
        if not there:
            return spark.createDataFrame([], LEDGER_DDL)
        # Spark takes two readings of a folder for one and shuffles the first only, even if files came between; a condition that always holds tells them apart.
        return spark.read.schema(LEDGER_DDL).parquet(self.path).where(F.col("run") != uuid.uuid4().hex)

    def replies(self, spark: SparkSession) -> DataFrame:
        """(digest, reply, error, run), one row each: the first reply, or the last error if there is none."""
        best = Window.partitionBy("digest").orderBy(F.col("error").isNotNull(), F.when(F.col("error").isNull(), F.col("at")).otherwise(-F.col("at")), "run")
        return self.rows(spark).withColumn("_n", F.row_number().over(best)).where("_n = 1").select("digest", "reply", "error", "run")

    def finished(self, spark: SparkSession) -> DataFrame:
        """Digests that have a reply; failed calls aren't finished."""
        return self.rows(spark).where("error is null").select("digest").distinct()

    def compact(self, spark: SparkSession, files: int = 1) -> None:
        """The same replies in few files, for ledgers of many small chunks; no run may write meanwhile.

        New files are whole before old ones go. Where this ends half-way, rows are there twice, which
        ``replies`` doesn't mind.
        """
        fs, root = file_system(self.path)
        old = [x.path for x in fs.get_file_info(pa.fs.FileSelector(root)) if x.is_file]
        self.rows(spark).coalesce(files).write.mode("append").parquet(self.path)
        for path in old:
            fs.delete_file(path)

    def _asker(self, client: Callable[[str], str], workers: Workers, run: str) -> Callable:
        """What a task does: ask, and commit chunk by chunk."""

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            context = TaskContext.get()
            fs, root = file_system(self.path)
            fs.create_dir(root, recursive=True)
            own = f"{run}-{context.partitionId()}-"
            known: set[str] = set()
            if context.attemptNumber():  # what earlier attempts of this task have committed stands
                for x in fs.get_file_info(pa.fs.FileSelector(root)):
                    if x.is_file and x.base_name.startswith(own):
                        known.update(pa.parquet.read_table(x.path, filesystem=fs, columns=["digest"])["digest"].to_pylist())
            held: list[tuple] = []
            since, n = time.monotonic(), 0

            def commit() -> None:
                nonlocal held, since, n
                if held:
                    name = f"{own}{context.attemptNumber()}-{n}-{uuid.uuid4().hex}.parquet"
                    with fs.open_output_stream(f"{root}/.{name}") as out:  # Spark doesn't read names that begin with a dot
                        pa.parquet.write_table(pa.Table.from_pylist([dict(zip(LEDGER.names, row, strict=True)) for row in held], LEDGER), out)
                    fs.move(f"{root}/.{name}", f"{root}/{name}")
                held, since, n = [], time.monotonic(), n + 1

            pace = workers.pace()
            with ThreadPoolExecutor(workers.threads) as pool:
                for frame in frames:
                    left = [x for x in zip(frame["digest"], frame["payload"], strict=True) if x[0] not in known]
                    for (digest, _), (reply, error) in in_flight(pool, lambda x: told(client, x[1], pace), left, 2 * workers.threads):
                        held.append((digest, reply, error, run, time.time()))
                        if len(held) >= self.chunk or time.monotonic() - since >= self.seconds:
                            commit()
                    yield pd.DataFrame({"n": [len(left)]})
            commit()

        return ask


def ask(rows: DataFrame, payload: Column, client: Callable[[str], str], out: str = "reply", error: str = "error", when: Column | None = None, workers: Workers = Workers(), ledger: Ledger | None = None) -> DataFrame:
    """``rows`` with the client's reply to each payload and the error of calls that failed, each null without the other.

    Rows of a null payload, and those for which ``when`` doesn't hold, aren't asked and have both
    null. Without a ledger the calls are made whenever the result is computed. With one they are
    made at once, equal payloads once; those that it knows aren't made again, failed ones are. The
    result then only reads the ledger, so however often it is computed nobody is asked again.
    """
    asked = payload if when is None else F.when(when, payload)
    names = [f"c{k}" for k in range(len(rows.columns))]
    wide = rows.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(rows.columns, names, strict=True)), asked.cast("string").alias("payload"))
    if ledger is not None:
        spark = rows.sparkSession
        keyed = wide.withColumn("digest", ledger.digest(F.col("payload")))
        left = keyed.where("payload is not null").select("digest", "payload").dropDuplicates(["digest"]).join(ledger.finished(spark), "digest", "left_anti")
        workers.dealt(left).mapInPandas(ledger._asker(client, workers, uuid.uuid4().hex), "n long").write.format("noop").mode("overwrite").save()
        return keyed.join(ledger.replies(spark).drop("run"), "digest", "left").select(*names, "reply", "error").toDF(*rows.columns, out, error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = workers.pace()
        call = lambda p: (None, None) if p is None else told(client, p, pace)
        with ThreadPoolExecutor(workers.threads) as pool:
            for batch in batches:
                both = [x for _, x in in_flight(pool, call, batch.column(len(names)).to_pylist(), 2 * workers.threads)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x[0] for x in both], pa.string()), pa.array([x[1] for x in both], pa.string())], names=[*names, "reply", "error"])

    schema = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(rows.schema.fields))
    return workers.dealt(wide).mapInArrow(run, ", ".join(filter(None, [schema, "reply string, error string"]))).toDF(*rows.columns, out, error)
