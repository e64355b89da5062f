"""A lexical index that grows: segments of postings, with later ones taking the place of documents in earlier ones."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import bm25
from rankloom.sources.versions import Folder, Lease

#: A document's row where an update takes it out.
GONE = -1


@dataclass(frozen=True)
class GrowingIndex:
    """Segments in ``path``: each has the postings (term, doc_id, tf, dl) and the documents (doc_id, dl) of one update; those that it takes out have a dl of -1.

    A document counts in the last segment that names it. Document frequencies, the number of
    documents and their lengths are sums over what counts, so they are those of an index built
    afresh. A version names its segments with their numbers of documents and postings, which are
    checked whenever it is read.
    """

    spark: SparkSession
    path: str

    @property
    def folder(self) -> Folder:
        return Folder(self.spark, self.path)

    def segments(self) -> list[dict]:
        return self.folder.current()[1].get("segments", [])

    def update(self, docs: DataFrame | None = None, removed: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Add documents, each in place of an earlier one of its id, and take out the ``removed`` (id); the number of the new version.

        Texts of earlier segments aren't read again, nor their postings. An id that is both added and
        taken out is added; ids that repeat among the documents are an error.
        """
        with Lease(self.folder, f"update-{uuid.uuid4().hex}") as lease:
            number, version = self.folder.current()
            name = f"segments/{number + 1:012d}-{uuid.uuid4().hex}"
            parts = []
            if docs is not None:
                counts = bm25.counted(docs, id_col, text_col).where(F.col("term") != bm25.SUMS)
                counts.write.parquet(f"{self.path}/{name}/postings")
                lengths = self.spark.read.parquet(f"{self.path}/{name}/postings").groupBy("doc_id").agg(F.max("dl").alias("dl"), F.sum("tf").alias("words"))
                parts.append(docs.select(F.col(id_col).alias("doc_id")).join(lengths, "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).alias("dl"), F.coalesce(F.col("words") != F.col("dl"), F.lit(False)).alias("torn")))
            if removed is not None:
                gone = removed.select(F.col(id_col).alias("doc_id")).distinct()
                gone = gone.join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_anti") if docs is not None else gone
                parts.append(gone.select("doc_id", F.lit(GONE).cast("long").alias("dl"), F.lit(False).alias("torn")))
            if not parts:
                return number
            rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            rows.write.parquet(f"{self.path}/{name}/documents")
            stored = self.spark.read.parquet(f"{self.path}/{name}/documents")
            n, ids, torn = stored.agg(F.count("*"), F.count_distinct("doc_id"), F.count_if("torn")).first()
            if n != ids or torn:
                raise ValueError("ids repeat, or are null")
            segment = {"name": name, "documents": n, "postings": self.spark.read.parquet(f"{self.path}/{name}/postings").count() if docs is not None else 0, "posted": docs is not None}
            lease.check()
            self.folder.commit(number + 1, {"segments": [*version.get("segments", []), segment]})
            return number + 1

    def _stored(self, segment: dict, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{segment['name']}/{part}")

    def problems(self) -> list[str]:
        """Segments whose tables don't have the rows that the version names; counts come from the files' footers."""
        out = []
        for s in self.segments():
            for part in ("documents", *(["postings"] if s["posted"] else [])):
                try:
                    n = self._stored(s, part).count()
                except Exception as e:  # a table that can't be read is what this is to find
                    out.append(f"{s['name']}/{part}: {type(e).__name__}")
                    continue
                if n != s[part]:
                    out.append(f"{s['name']}/{part}: {n} rows instead of {s[part]}")
        return out

    def documents(self) -> DataFrame:
        """(doc_id, dl, segment) of what counts."""
        rows = None
        for k, s in enumerate(self.segments()):
            part = self._stored(s, "documents").select("doc_id", F.col("dl").cast("long").alias("dl"), F.lit(k).alias("segment"))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.spark.createDataFrame([], "doc_id long, dl long, segment int")
        last = rows.groupBy("doc_id").agg(F.max(F.struct("segment", "dl")).alias("x"))
        return last.select("doc_id", F.col("x.dl").alias("dl"), F.col("x.segment").alias("segment")).where(F.col("dl") != GONE)

    def load(self, expected: int | None = None, docs: DataFrame | None = None) -> bm25.Index:
        """The index of what counts.

        With ``expected``, another number of documents is stale. An index that is stale, or whose
        tables aren't whole, is built again from ``docs`` if these are given; else it is an error.
        """
        wrong = self.problems()
        if not wrong and expected is not None and (n := self.documents().count()) != expected:
            wrong = [f"{n} documents instead of {expected}"]
        if wrong and docs is not None:
            self.rebuild(docs)
        elif wrong:
            raise ValueError(f"the index at {self.path}: {'; '.join(wrong)}")
        alive, rows = self.documents(), None
        for k, s in enumerate(self.segments()):
            if s["posted"]:
                part = self._stored(s, "postings").withColumn("segment", F.lit(k))
                rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            rows = self.spark.createDataFrame([], "term string, doc_id long, tf long, dl long, segment int")
        whole = len(self.segments()) < 2  # one segment has no rows that don't count
        postings = (rows if whole else rows.join(alive.select("doc_id", "segment"), ["doc_id", "segment"], "left_semi")).select("term", "doc_id", "tf", "dl")
        stats = alive.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        return bm25.Index(postings, bm25._weighed(postings.groupBy("term").agg(F.count("*").alias("df")), stats), stats)

    def compact(self) -> int:
        """One segment of what counts in place of all; the number of the new version."""
        with Lease(self.folder, f"compact-{uuid.uuid4().hex}") as lease:
            number, _ = self.folder.current()
            index, name = self.load(), f"segments/{number + 1:012d}-{uuid.uuid4().hex}"
            index.postings.write.parquet(f"{self.path}/{name}/postings")
            self.documents().select("doc_id", "dl").write.parquet(f"{self.path}/{name}/documents")
            segment = {"name": name, "posted": True} | {part: self.spark.read.parquet(f"{self.path}/{name}/{part}").count() for part in ("documents", "postings")}
            lease.check()
            self.folder.commit(number + 1, {"segments": [segment]})
            return number + 1

    def rebuild(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """All from ``docs``; the version before stays readable until the new one is there."""
        with Lease(self.folder, f"rebuild-{uuid.uuid4().hex}") as lease:
            fresh = GrowingIndex(self.spark, f"{self.path}/segments/rebuild-{uuid.uuid4().hex}")
            fresh.update(docs, id_col=id_col, text_col=text_col)
            inside = fresh.path.removeprefix(f"{self.path}/")
            number, _ = self.folder.current()
            lease.check()
            self.folder.commit(number + 1, {"segments": [s | {"name": f"{inside}/{s['name']}"} for s in fresh.segments()]})
            return number + 1
