"""Personal data: base patterns, and contexts bootstrapped from them that discover further identifiers."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import add_columns, map_columns
from .shared import durable, fresh

KINDS = ("email", "ip", "card", "phone", "context")
BASE = 4

#: The base patterns. No digit may precede an address, as a run of digits that
#: failed once fails from each of its digits; possessive runs keep the search linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What may be an identifier: a token with a digit, with the two words before it and the one behind it.
TOKEN = re.compile(r"(?<![^\s(\[\"'<])(?=[^\s()\[\]\"'<>,;0-9]*[0-9])[^\s()\[\]\"'<>,;]{4,}")
WORD = re.compile(r"[^\W\d_]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain: neither part can hold an @, so each @ is looked at by itself."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        if m and at >= free:
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                free = m.end()
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order; failing matches are dropped and not tried again."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


class Contexts:
    """Lexical patterns around the spans of one text, asked in order of their starts: two words before and one behind, lower-cased.

    Words are looked for in growing windows, and never again beyond what an earlier span has seen,
    so all contexts of a text take time in proportion to its length.
    """

    def __init__(self, text: str):
        self.text, self.start, self.words, self.ahead = text, 0, [], (0, -1, "")

    def before(self, start: int) -> list[str]:
        # From the last span on, if no word crosses its start; then its words are those before it.
        floor = 0 if self.text[self.start - 1 : self.start].isalpha() else self.start
        reach = 64
        while True:
            low = max(floor, start - reach)
            found = WORD.findall(self.text, low, start)
            if low == floor or len(found) > 2:
                break
            reach *= 4
        known = self.words if floor and low == floor else []
        self.start, self.words = start, [*known, *found][-2:]
        return self.words

    def behind(self, end: int) -> list[str]:
        if not self.ahead[0] <= end <= self.ahead[1]:
            m = WORD.search(self.text, end)
            self.ahead = (end, m.start(), m[0]) if m else (end, len(self.text), "")
        return [self.ahead[2]] if self.ahead[2] else []

    def around(self, start: int, end: int) -> str:
        return " ".join([*self.before(start), "_", *self.behind(end)]).lower()


#: The pattern of a span without a word on either side, which is no context.
BARE = "_"


def instances(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, pattern, instance, whether it is a seed) of base spans and of tokens that may be identifiers outside of them."""
    at_seeds, at_tokens = Contexts(text), Contexts(text)
    out = [(a, b, at_seeds.around(a, b), text[a:b], True) for a, _, b in spans]
    taken, at, far = [(a, b) for a, _, b in spans], 0, 0
    for m in TOKEN.finditer(text):
        end = m.start() + len(m[0].rstrip(".:!?"))
        while at < len(taken) and taken[at][0] < end:
            far = max(far, taken[at][1])
            at += 1
        if far <= m.start() and end - m.start() >= 4:
            out.append((m.start(), end, at_tokens.around(m.start(), end), text[m.start() : end], False))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One pass over whole texts: row number, id, ``base`` spans, and ``found`` instances with their patterns."""

    def run(rows: pa.Array, ids: pa.Array, texts: pa.Array) -> dict:
        base, found = [], []
        for text in texts.to_pylist():
            text = text or ""
            spans = base_spans(text)
            base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            found.append([{"start": a, "end": b, "pattern": p, "instance": i, "seed": s} for a, b, p, i, s in instances(text, spans)])
        span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        met = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.string()), ("instance", pa.string()), ("seed", pa.bool_())]))
        return {"row": rows, "id": ids, "base": pa.array(base, span), "found": pa.array(found, met)}

    kind = docs.schema[id_col].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), id_col, text_col)
    return map_columns(numbered, run, f"row long, id {kind}, base array<struct<start: bigint, kind: int, end: bigint>>, found array<struct<start: bigint, end: bigint, pattern: string, instance: string, seed: boolean>>")


def learned_from(docs: DataFrame, text_col: str, rounds: int, seeds: int, confidence: float) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns and discovered instances of a corpus, from one pass over its texts that keeps instances only."""

    def run(texts: pa.Array) -> dict:
        rows = [x for t in texts.to_pylist() if t for x in instances(t, base_spans(t))]
        return {"pattern": pa.array([x[2] for x in rows], pa.string()), "instance": pa.array([x[3] for x in rows], pa.string()), "seed": pa.array([x[4] for x in rows], pa.bool_())}

    return bootstrap(map_columns(docs.select(text_col), run, "pattern string, instance string, seed boolean"), rounds, seeds, confidence)


def bootstrap(found: DataFrame, rounds: int = 3, seeds: int = 3, confidence: float = 0.8, doubt: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Patterns that a graph of patterns and instances trusts, and the instances that they discover, of those that stand outside of base spans somewhere.

    ``found`` has (pattern, instance, seed). Seeds score 1 and others 0 at first. Each round a
    pattern scores the mean of its distinct instances' scores, with ``doubt`` instances of score 0
    beside them, and an instance that is no seed the chance that one of its patterns is right.
    Trusted are patterns of at least ``confidence`` that have so many different seeds. Instances of
    trusted patterns then are seeds themselves, wherever they stand, and the rounds begin anew,
    until they discover nothing more; seeds only gain, so this ends.
    """
    met = durable(found.groupBy("pattern", "instance").agg(F.max("seed").alias("base"), F.min("seed").alias("all_base")))
    # What stands bare has no context: it is marked where it is known, but tells nothing.
    edges = met.where(F.col("pattern") != BARE)
    # A base instance is a seed in all its patterns.
    known = durable(met.where("base").select("instance").distinct())
    count = known.count()
    while True:
        held = edges.join(known.withColumn("seed", F.lit(True)), "instance", "left").select("pattern", "instance", F.coalesce("seed", F.lit(False)).alias("seed"))
        value = held.withColumn("value", F.col("seed").cast("double"))
        patterns = None
        for k in range(rounds):
            patterns = value.groupBy("pattern").agg((F.sum("value") / (F.count("*") + doubt)).alias("score"), F.sum(F.col("seed").cast("long")).alias("seeds"))
            if k + 1 < rounds:
                odds = held.join(patterns.where("seeds > 0"), "pattern", "left").groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.coalesce("score", F.lit(0.0)), F.lit(0.999)))))).alias("chance"))
                value = held.join(odds, "instance").select("pattern", "instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.col("chance")).alias("value"))
        trusted = durable(patterns.where((F.col("score") >= confidence) & (F.col("seeds") >= seeds)).select("pattern"))
        known = durable(known.union(edges.join(trusted, "pattern", "left_semi").select("instance")).distinct())
        before, count = count, known.count()
        if count == before:
            return trusted, known.join(met.where("not all_base"), "instance", "left_semi")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, seeds: int = 3, confidence: float = 0.8) -> DataFrame:
    """All personal data of each text: id and ``spans``, an array of (start, kind number, end), in order.

    Base spans are always there. They are seeds: their contexts become patterns, a graph of all
    patterns and identifier-like tokens of the corpus is scored on Spark, what trusted patterns
    discover is a seed in turn, and all occurrences of what they discover are spans of kind ``context``. Positions are code points, ends
    exclusive. Texts are read once; contexts and spans only are kept and shuffled. Null and empty
    texts: no spans. Repeated rows and null ids: a row each. Other columns are ignored. An empty
    table gives no rows.
    """
    rows = durable(scan(docs, id_col, text_col))
    found = rows.select("row", F.explode("found").alias("f")).select("row", "f.*")
    # All tokens of trusted patterns are discovered instances, so the instance alone decides.
    _, discovered = bootstrap(found.select("pattern", "instance", "seed"), rounds, seeds, confidence)
    more = found.where(~F.col("seed")).join(discovered, "instance", "left_semi")
    more = more.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(BASE).alias("kind"), "end")).alias("more"))
    joined = rows.select("row", "id", "base").join(more, "row", "left")
    return joined.select(F.col("id").alias(id_col), F.sort_array(F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))).alias("spans"))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are merged under the first one's kind."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


#: Discovered instances, and their characters, that go to the tasks; beyond either, they are matched by a join.
SENT, SENT_CHARACTERS = 200_000, 8_000_000


def redact(docs: DataFrame, text_col: str = "text", rounds: int = 3, seeds: int = 3, confidence: float = 0.8) -> DataFrame:
    """``docs`` with personal data masked: base spans, and all occurrences of what trusted patterns discover.

    Discovered instances go to the tasks if they are few, which is checked; else texts find their
    spans by a join on two hashes of the text. Either way gives the same rows. Null and empty texts
    stay as they are. Other columns, whatever their names, and repeated rows stay as they are. An
    empty table gives no rows.
    """
    discovered = durable(learned_from(docs, text_col, rounds, seeds, confidence)[1])
    number, characters = discovered.agg(F.count("*"), F.coalesce(F.sum(F.length("instance")), F.lit(0))).first()
    few = number <= SENT and characters <= SENT_CHARACTERS
    return masked_by_list(docs, discovered, text_col) if few else masked_by_join(docs, discovered, text_col)


def masked_by_list(docs: DataFrame, discovered: DataFrame, text_col: str) -> DataFrame:
    """Texts with base spans and listed instances masked; the list must be small."""
    known = frozenset(r["instance"] for r in discovered.collect())

    def run(texts: pa.Array) -> dict:
        out = []
        for text in texts.to_pylist():
            if text:
                spans = base_spans(text)
                if known:
                    spans = spans + [(a, BASE, b) for a, b, _, instance, seed in instances(text, spans) if not seed and instance in known]
                text = masked(text, spans) if spans else text
            out.append(text)
        return {"masked": pa.array(out, pa.string())}

    return _replaced(docs, [text_col], run, text_col, docs.columns)


def masked_by_join(docs: DataFrame, discovered: DataFrame, text_col: str) -> DataFrame:
    """The same for any number of instances: spans are found once for each text, known by two hashes of it, and joined to its rows."""
    one, two, spans = fresh(docs.columns, "one", "two", "spans")
    marks = lambda text: (F.xxhash64(text), F.xxhash64(text, F.length(text)))
    texts = docs.where(F.col(text_col) != "").select(F.struct(*(m.alias(k) for m, k in zip(marks(F.col(text_col)), ("one", "two"), strict=True))).alias("mark"), F.col(text_col).alias("text"))
    found = scan(texts, "mark", "text").select("id", F.explode("found").alias("f")).where("not f.seed").select("id.*", "f.start", "f.end", "f.instance").distinct()
    more = found.join(discovered, "instance", "left_semi").groupBy(F.col("one").alias(one), F.col("two").alias(two)).agg(F.sort_array(F.collect_list(F.struct("start", F.lit(BASE).alias("kind"), "end"))).alias(spans))
    first, second = marks(F.col(text_col))
    joined = docs.withColumn(one, first).withColumn(two, second).join(more, [one, two], "left")

    def run(texts: pa.Array, spans: pa.Array) -> dict:
        rows = []
        for text, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            all_spans = [*base_spans(text), *((s["start"], s["kind"], s["end"]) for s in found or ())] if text else []
            rows.append(masked(text, all_spans) if all_spans else text)
        return {"masked": pa.array(rows, pa.string())}

    return _replaced(joined, [text_col, spans], run, text_col, docs.columns)


def _replaced(rows: DataFrame, inputs: list[str], function, text_col: str, columns: list[str]) -> DataFrame:
    """``columns`` of ``rows`` with what the function makes of the inputs in place of the text."""
    out = add_columns(rows, inputs, function, "masked string")
    return out.withColumn(text_col, F.col(out.columns[-1])).select(*columns)
