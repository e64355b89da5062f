"""Secret scans: base patterns, and weak candidates that complementary parts link. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The base patterns. A failing match is consumed all the same, so lengths are checked after matching
#: where that matters; runs of one class can't hide a later match and take their least length in the pattern.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Weak parts: account names beside their keyword, long tokens with a digit, and addresses with a scheme.
WEAK_ID = r"""(?i:access_?key_?id|client_?id|account|username|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""(?<![A-Za-z0-9+.-])[0-9+.-]*+[A-Za-z][A-Za-z0-9+.-]*+://[^\s"'<>]+"""
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
BASE = 3


def _scan(text: Column, kind: int, pattern: str, guard: Column, keep=lambda m: F.lit(True)) -> Column:
    """Matches in turn as (kind, code points since the last match, code points of the match, whether it holds); the last one, without a match, is what follows."""
    found = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.split(text, pattern, -1),
        lambda m, gap: F.struct(F.lit(kind).alias("kind"), F.length(gap).cast("long").alias("gap"), F.length(m).cast("long").alias("len"), F.coalesce(keep(m), F.lit(False)).alias("holds")),
    )
    return F.when(guard, found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """All secrets of each text: id, ``spans``, an array of (start, kind number, end), in order, and ``links``.

    A link is a secret with the identifier nearest to it and the nearest endpoint, null if there is
    none, all within ``scope``; links are in the order of their secrets. Positions are code points, ends exclusive. Base kinds are always reported. Parts of the weak kinds
    are joined by intervals with parts that lie within ``scope`` code points: a weak identifier
    needs a secret there, a weak secret an identifier, and an endpoint both. Complementary parts
    are different texts: a weak secret that overlaps an identifier isn't one. Those that overlap a base span aren't reported again. The interval join is a sweep over a text's parts in order of
    position, which sees the nearest part of each sort on either side and forms no pairs.

    Only spans are shuffled, never texts; the key is a number of the input row, so equal ids don't
    meet. Null and empty texts: no spans. Repeated rows and null ids: a row each. Other columns are
    ignored. An empty table gives no rows.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    signs = text.contains("=") | text.contains(":")
    parts = [
        _scan(text, 0, ASSIGN, signs & text.rlike(ASSIGN), lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
        _scan(text, 1, ACCESS, text.contains("AKIA")),
        _scan(text, 2, HEX, text.rlike(HEX)),
        _scan(text, 3, WEAK_ID, signs & text.rlike(WEAK_ID)),
        _scan(text, 4, WEAK_SECRET, text.rlike(WEAK_SECRET)),
        _scan(text, 5, ENDPOINT, text.contains("://")),
    ]
    none = F.array().cast("array<struct<kind:int,gap:bigint,len:bigint,holds:boolean>>")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_own"), F.col(text_col).alias("_text"))
    rows = rows.select("_row", "_own", F.filter(F.concat(*(F.coalesce(p, none) for p in parts)), lambda p: p["len"].isNotNull()).alias("_parts"))
    rows = rows.select("_row", "_own", F.posexplode_outer("_parts").alias("_n", "_p")).select("_row", "_own", "_n", "_p.*")

    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("_row", "kind").orderBy("_n"))
    rows = rows.repartition("_row").select("_row", "_own", "kind", "holds", end.alias("end"), (end - F.col("len")).alias("start"))
    rows = rows.withColumn("holds", F.coalesce("holds", F.lit(False)))

    before = Window.partitionBy("_row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)

    def close(name: str, of: Column, gap: int) -> Column:
        """(start, end) of the nearest part other than the row's own, of those that hold, within ``gap`` of it; 0: one that overlaps it."""
        nonlocal rows
        rows = rows.withColumn(f"_b{name}", F.max(F.when(F.col("holds") & of, F.struct("end", "start"))).over(before)).withColumn(f"_a{name}", F.min(F.when(F.col("holds") & of, F.struct("start", "end"))).over(after))
        behind, ahead = F.col(f"_b{name}"), F.col(f"_a{name}")
        near_b, near_a = behind["end"] > F.col("start") - gap, ahead["start"] < F.col("end") + gap
        nearer = near_b & (~F.coalesce(near_a, F.lit(False)) | (F.col("start") - behind["end"] <= ahead["start"] - F.col("end")))
        return F.when(nearer, F.struct(behind["start"].alias("start"), behind["end"].alias("end"))).when(near_a, F.struct(ahead["start"].alias("start"), ahead["end"].alias("end")))

    # No text is both parts: a weak secret that overlaps an identifier is none, and what overlaps a base secret is no identifier.
    ids, keys = F.col("kind").isin(1, 3), F.col("kind").isin(0, 2)
    over_id, over_key, over_base = close("over_id", ids, 0), close("over_key", keys, 0), close("over_base", F.col("kind") < BASE, 0)
    rows = rows.withColumn("_over_base", over_base.isNotNull()).withColumn("_id_part", ids & over_key.isNull()).withColumn("holds", F.col("holds") & ~((F.col("kind") == 4) & over_id.isNotNull()))
    rows = rows.withColumn("_key_part", keys | (F.col("kind") == 4))
    near = {"_id": close("id", F.col("_id_part"), scope), "_key": close("key", F.col("_key_part"), scope), "_place": close("place", F.col("kind") == 5, scope)}
    rows = rows.withColumns(near)
    has_id, has_key = F.col("_id").isNotNull(), F.col("_key").isNotNull()
    linked = F.when(F.col("kind") == 3, has_key).when(F.col("kind") == 4, has_id).otherwise(has_id & has_key)
    told = F.col("holds") & ((F.col("kind") < BASE) | (linked & ~F.col("_over_base")))
    # A link is told at its secret: the nearest identifier, and the nearest endpoint if there is one.
    link = F.struct(F.col("start").alias("secret_start"), F.col("end").alias("secret_end"), F.col("_id.start").alias("id_start"), F.col("_id.end").alias("id_end"), F.col("_place.start").alias("endpoint_start"), F.col("_place.end").alias("endpoint_end"))
    spans = rows.groupBy("_row").agg(F.first("_own").alias(id_col), F.sort_array(F.collect_list(F.when(told, F.struct("start", "kind", "end")))).alias("spans"), F.sort_array(F.collect_list(F.when(told & F.col("_key_part") & has_id, link))).alias("links"))
    return spans.select(id_col, "spans", "links")


def span_text(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def digest(found: DataFrame, kinds: tuple[str, ...], base: int, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans, all spans as text, and links, where there are any, as secret>identifier>endpoint."""
    held = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(held) - F.size(F.array_remove(held, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(kinds[:base])]
    place = lambda x, part: F.concat_ws(":", x[f"{part}_start"], x[f"{part}_end"])
    links = [F.array_join(F.transform("links", lambda x: F.concat_ws(">", place(x, "secret"), place(x, "id"), place(x, "endpoint"))), ",").alias("links")] if "links" in found.columns else []
    return found.select(id_col, *counts, F.sha2(span_text(F.filter("spans", lambda s: s["kind"] < base), kinds), 256).alias("base_sha256"), span_text(F.col("spans"), kinds).alias("spans"), *links)
