"""A store of vectors with versions: buckets of Parquet files, of which an update rewrites those that it touches."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.dense import is_valid
from rankloom.sources.durable import durable
from rankloom.sources.results import stale
from rankloom.sources.versions import Folder, Lease

#: Distances that a store may be made for.
DISTANCES = ("cosine", "dot", "euclid")
COLUMNS = "id string, v array<double>, hash string, backend string, model string"


@dataclass(frozen=True)
class VectorStore:
    """Vectors (id, v, hash, backend, model) in ``path``: ``hash`` is that of the embedded text, backend and model are what embedded it.

    An id's bucket is its hash's remainder. A version names, for each bucket, the update that wrote
    it; files of an update that didn't end are named by none, so the version before it stays
    readable. One writer at a time holds the store's lease.
    """

    spark: SparkSession
    path: str

    @property
    def folder(self) -> Folder:
        return Folder(self.spark, self.path)

    def settings(self) -> dict:
        number, version = self.folder.current()
        if not number:
            raise ValueError(f"there is no vector store at {self.path}")
        return version

    def create(self, dim: int, distance: str = "cosine", buckets: int = 64, force: bool = False) -> VectorStore:
        """Make the store, or check that the one that is there has this size and distance; with ``force`` another one takes its place, empty."""
        if distance not in DISTANCES or dim < 1 or buckets < 1:
            raise ValueError("a store needs a known distance, a size and buckets")
        number, version = self.folder.current()
        if number and not force:
            if (version["dim"], version["distance"]) != (dim, distance):
                raise ValueError(f"the store at {self.path} is for {version['distance']} of {version['dim']}, not for {distance} of {dim}")
            return self
        with Lease(self.folder, f"create-{uuid.uuid4().hex}"):
            self.folder.commit(number + 1, {"dim": dim, "distance": distance, "buckets": buckets, "files": {}, "count": 0})
        return self

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(buckets)).cast("int")

    def _files(self, version: dict, only: list[int] | None = None) -> list[str]:
        return [f"{self.path}/data/{name}/bucket={b}" for b, name in sorted(version["files"].items()) if only is None or int(b) in only]

    def _rows(self, version: dict, only: list[int] | None = None) -> DataFrame:
        files = self._files(version, only)
        return self.spark.read.schema(COLUMNS).parquet(*files) if files else self.spark.createDataFrame([], COLUMNS)

    def read(self, version: int | None = None) -> DataFrame:
        """All vectors, of the current version or of an earlier one."""
        if version is None:
            return self._rows(self.settings())
        told = self.folder.read(f"_versions/{version:012d}.json")
        if told is None:
            raise ValueError(f"there is no version {version} at {self.path}")
        return self._rows(told)

    def stale(self, wanted: DataFrame) -> DataFrame:
        """Rows (id, hash, backend, model) whose vector is missing or was made from another text or by another model."""
        return stale(wanted, self.read())

    def upsert(self, fresh: DataFrame, owner: str = "upsert", seconds: float = 3600.0) -> int:
        """Put ``fresh`` vectors in place of those of the same ids and add the others; the number of the new version.

        Rows equal in hash, backend and model to what is stored are left out, and without any other
        the version stays. Only touched buckets are read, rewritten, read again and checked, before
        the new version is committed. Raises, with the old version in place, if ids repeat, a vector
        has another size or isn't finite, or what was written isn't what was meant.
        """
        return self._update(fresh.select("id", "v", "hash", "backend", "model"), None, owner, seconds)

    def remove(self, ids: DataFrame, owner: str = "remove", seconds: float = 3600.0) -> int:
        """Take out vectors (id); the number of the new version."""
        return self._update(None, ids.select("id").distinct(), owner, seconds)

    def _update(self, fresh: DataFrame | None, gone: DataFrame | None, owner: str, seconds: float) -> int:
        with Lease(self.folder, f"{owner}-{uuid.uuid4().hex}", seconds) as lease:
            number, version = self.folder.current()
            if not number:
                raise ValueError(f"there is no vector store at {self.path}")
            bucket = self._bucket(version["buckets"])
            if fresh is not None:
                keys = ["id", "hash", "backend", "model"]
                todo = durable(fresh.withColumn("id", F.col("id").cast("string")).join(self._rows(version).select(*keys), keys, "left_anti").withColumn("bucket", bucket))
                told = todo.groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(~is_valid(F.col("v"), version["dim"]) | F.col("hash").isNull()).alias("bad")).collect()  # one row a bucket
                if any(r["n"] != r["ids"] for r in told):
                    raise ValueError("ids repeat, or are null")
                if any(r["bad"] for r in told):
                    raise ValueError(f"vectors must have {version['dim']} finite numbers and a hash")
            else:
                todo = durable(gone.select(F.col("id").cast("string").alias("id")).join(self._rows(version).select("id"), "id", "left_semi").withColumn("bucket", bucket))
                told = todo.groupBy("bucket").agg(F.count("*").alias("n")).collect()
            touched = [r["bucket"] for r in told]
            if not touched:
                return number
            old = self._rows(version, touched).join(todo.select("id"), "id", "left_anti").withColumn("bucket", bucket)
            rows = old if fresh is None else old.unionByName(todo.select(*old.columns))
            name = f"{number + 1:012d}-{uuid.uuid4().hex}"
            rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
            written = {x.removeprefix("bucket=") for x in self.folder.names(f"data/{name}") if x.startswith("bucket=")}
            after = version | {"files": {b: f for b, f in version["files"].items() if int(b) not in touched} | {b: name for b in written}}
            if wrong := self.problems(after, touched, todo if fresh is not None else None, todo if fresh is None else None):
                raise RuntimeError(f"the update of {self.path} isn't whole: {'; '.join(wrong)}")
            after["count"] = self._rows(after).count()
            lease.check()
            self.folder.commit(number + 1, after)
            return number + 1

    def problems(self, version: dict | None = None, only: list[int] | None = None, fresh: DataFrame | None = None, gone: DataFrame | None = None) -> list[str]:
        """What is wrong with a version's files, read again: repeated ids, wrong vectors, rows in another bucket, fresh ones missing, removed ones there. Vectors are neither sorted nor shuffled."""
        version = version or self.settings()
        rows = self._rows(version, only)
        bad = rows.where(~is_valid(F.col("v"), version["dim"]) | F.col("hash").isNull()).count()
        repeated = rows.groupBy("id").count().where("count > 1").count()
        keys = ["id", "hash", "backend", "model"]
        lost = fresh.select(*keys).join(rows.select(*keys), keys, "left_anti").count() if fresh is not None else 0
        left = gone.select("id").join(rows.select("id"), "id", "left_semi").count() if gone is not None else 0
        return [f"{n} {what}" for n, what in ((bad, "vectors are wrong"), (repeated, "ids repeat"), (lost, "fresh vectors are missing"), (left, "removed vectors are there")) if n]

    def verify(self, wanted: DataFrame) -> list[str]:
        """What keeps the store from holding exactly the ``wanted`` (id, hash): its count, and wanted rows that are missing or were made from other texts."""
        version = self.settings()
        rows, n = self._rows(version), wanted.count()
        lost = wanted.select(F.col("id").cast("string").alias("id"), "hash").join(rows.select("id", "hash"), ["id", "hash"], "left_anti").count()
        out = self.problems(version)
        return out + ([f"{version['count']} vectors are stored, {n} are wanted"] if version["count"] != n else []) + ([f"{lost} vectors are missing or stale"] if lost else [])

    def vacuum(self, keep: int = 2) -> None:
        """Delete the files of updates that neither the last ``keep`` versions name nor a writer is making."""
        with Lease(self.folder, f"vacuum-{uuid.uuid4().hex}"):
            numbers = self.folder.versions()
            kept = {f for n in numbers[-keep:] for f in (self.folder.read(f"_versions/{n:012d}.json") or {"files": {}})["files"].values()}
            for n in numbers[:-keep]:
                self.folder.delete(f"_versions/{n:012d}.json")
            for name in self.folder.names("data"):
                if name not in kept:
                    self.folder.delete(f"data/{name}")
