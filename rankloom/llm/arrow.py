"""Small helpers for operators that work on Arrow batches inside Spark tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import fresh


def release() -> None:
    """Gives back to the system what this process's allocators hold free."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with ``release`` at its end: workers outlive their tasks, and what they hold free would count against their executor in every later stage."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def map_columns(df: DataFrame, function: Callable[..., dict], schema: str, at_once: int = 4 << 20) -> DataFrame:
    """Apply ``function(*columns)`` to parts of the Arrow batches of ``df``, of about ``at_once`` bytes.

    The function gets one Arrow array per column of ``df`` and returns a dict of equally long
    columns, in the order of ``schema``. Empty partitions give no rows. Small parts bound the
    memory of vectorised work, which needs many times the bytes of its texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = max(1, -(-batch.nbytes // at_once))
            rows = -(-batch.num_rows // parts)
            for at in range(0, batch.num_rows, max(1, rows)):
                out = function(*batch.slice(at, rows).columns)
                yield pa.RecordBatch.from_arrays([to_arrow(x) for x in out.values()], names=list(out))

    return df.mapInArrow(releasing(run), schema)


def to_arrow(values) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        return values.combine_chunks()
    return values if isinstance(values, pa.Array) else pa.array(values)


def utf8_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls count as empty texts."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the ranges start, start + 1, ... of the given lengths, in order."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def add_columns(df: DataFrame, inputs: list[str], function: Callable[..., dict], added: str, at_once: int = 4 << 20) -> DataFrame:
    """``df`` with further columns that ``function`` computes from the ``inputs`` columns, in one pass and without a join.

    ``added`` is the schema of the further columns. Where a name is taken, the further column gets
    underscores before it; the columns of ``df`` keep their names.
    """
    places = [df.columns.index(c) for c in inputs]
    numbered = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    kinds = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(df.schema.fields))
    names, types = zip(*(x.strip().split(" ", 1) for x in added.split(",")), strict=True)
    more = ", ".join(f"a{k} {t}" for k, t in enumerate(types))
    run = lambda *columns: {f"c{k}": c for k, c in enumerate(columns)} | {f"a{k}": c for k, c in enumerate(function(*(columns[k] for k in places)).values())}
    out = map_columns(numbered, run, f"{kinds}, {more}", at_once)
    return out.toDF(*df.columns, *fresh(df.columns, *names))
