"""Model clients: picklable callables that retry, embed and score, and deterministic ones in place of remote models.

A chat client takes a payload and gives a reply; an embedding client takes a list of texts and
gives a vector each; a pair client takes a list of (query, text) and gives a score each.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import nfc

#: What remote services say when a call may be tried again, and when a login has run out.
TRANSIENT = re.compile(r"\b(?:429|500|502|503|504)\b|RESOURCE_EXHAUSTED|UNAVAILABLE|timed out|timeout|connection (?:reset|aborted|refused|error)|remote end closed", re.IGNORECASE)
EXPIRED = re.compile(r"\b401\b|UNAUTHENTICATED")


def described(error: Exception) -> str:
    """An error's kind, status and message."""
    return f"{type(error).__name__} {getattr(error, 'status_code', '') or getattr(error, 'code', '')} {error}"


def has_expired(error: Exception) -> bool:
    return bool(EXPIRED.search(described(error)))


def may_retry(error: Exception, can_refresh: bool = False) -> bool:
    """Whether a call that failed so may succeed later; an expired login only if it can be refreshed."""
    if has_expired(error):
        return can_refresh
    return isinstance(error, ConnectionError | TimeoutError) or bool(TRANSIENT.search(described(error)))


@dataclass(frozen=True)
class Retrying:
    """A client that tries again after transient errors, waiting twice as long each time; other errors and the last one are raised."""

    call: Callable
    attempts: int = 5
    base: float = 4.0
    longest: float = 60.0
    refresh: Callable[[], None] | None = None
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, *args):
        for k in range(self.attempts):
            try:
                return self.call(*args)
            except Exception as e:
                if k + 1 == self.attempts or not may_retry(e, self.refresh is not None):
                    raise
                if has_expired(e) and self.refresh:
                    self.refresh()
                self.sleep(min(self.longest, self.base * 2**k))
        raise RuntimeError("no attempt was allowed")


@dataclass(frozen=True)
class HashEmbedder:
    """Unit vectors of words drawn by their hashes: equal words, near texts. Texts without words have zero vectors."""

    dim: int = 64

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            total = np.zeros(self.dim)
            for word in re.findall(r"\w+", text.lower()):
                total += np.random.default_rng(int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big")).standard_normal(self.dim)
            size = np.linalg.norm(total)
            out.append((total / size if size else total).tolist())
        return out


def shared_words(pairs: list[tuple[str, str]]) -> list[float]:
    """A pair client in place of a cross-encoder: the share of a query's words that the text has."""
    words = [(set(re.findall(r"\w+", q.lower())), set(re.findall(r"\w+", t.lower()))) for q, t in pairs]
    return [len(q & t) / len(q) if q else 0.0 for q, t in words]


def as_score(value) -> float:
    """A score from a number, an object with ``score`` or ``relevance_score``, or a list that begins with one."""
    while isinstance(value, list | tuple | dict):
        if isinstance(value, dict):
            value = value["score"] if "score" in value else value["relevance_score"]
        elif len(value):
            value = value[0]
        else:
            raise ValueError("an empty score")
    return float(value)


def _batched(rows: DataFrame, inputs: list[Column], out: str, kind: str, client: Callable[[list], list], size: int) -> DataFrame:
    """``rows`` with a column that the client makes of the inputs, at most ``size`` of them a call, in order; a wrong number of answers is an error."""
    names = [f"in{k}" for k in range(len(inputs))]
    wide = rows.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rows.columns)), *(c.alias(n) for c, n in zip(inputs, names, strict=True)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked = frame[names[0]].tolist() if len(names) == 1 else list(zip(*(frame[n] for n in names), strict=True))
            told: list = []
            for at in range(0, len(asked), size):
                part = client(asked[at : at + size])
                if len(part) != len(asked[at : at + size]):
                    raise ValueError(f"{len(part)} answers to {len(asked[at : at + size])} inputs")
                told.extend(part)
            yield frame.drop(columns=names).assign(out=pd.Series(told, index=frame.index, dtype=object) if kind != "double" else told)

    schema = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(rows.schema.fields))
    return wide.mapInPandas(run, f"{schema}, out {kind}").toDF(*rows.columns, out)


def embed(rows: DataFrame, text: Column, client: Callable[[list[str]], list], out: str = "embedding", size: int = 64) -> DataFrame:
    """``rows`` with the vector of each text, which is composed first; null counts as an empty text."""
    return _batched(rows, [nfc(F.coalesce(text, F.lit("")))], out, "array<double>", client, size)


def embed_analysis(analysis: DataFrame, client: Callable[[list[str]], list], size: int = 64) -> DataFrame:
    """(qid, kind, position, embedding) of the query, the topic and all intents of (qid, query, topic, intents), in shared batches."""
    one = lambda kind, at, text: F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("position"), text.alias("text"))
    texts = F.concat(F.array(one("query", F.lit(0), F.col("query")), one("topic", F.lit(0), F.col("topic"))), F.transform("intents", lambda x, k: one("intent", k, x)))
    rows = analysis.select("qid", F.inline(texts))
    return embed(rows, F.col("text"), client, size=size).drop("text")


def pair_scores(rows: DataFrame, query: Column, text: Column, client: Callable[[list[tuple[str, str]]], list] = shared_words, out: str = "score", size: int = 32) -> DataFrame:
    """``rows`` with the score of each pair, at most ``size`` pairs a call."""
    none = lambda c: F.coalesce(c, F.lit(""))
    return _batched(rows, [none(query), none(text)], out, "double", _Coerced(client), size)


@dataclass(frozen=True)
class _Coerced:
    client: Callable[[list], list]

    def __call__(self, pairs: list) -> list[float]:
        return [as_score(x) for x in self.client(pairs)]
