"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (host and path, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
FEATURES = ("length", "host_length", "depth", "labels", "digit_ratio", "symbol_ratio", "entropy", "parameters", "fragment", "suffix_rate", "suffix_seen", "domain_rate", "domain_seen")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path; both empty for null and for urls without ``://``."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(text, form, 1), upper, upper.lower()), F.regexp_extract(text, form, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _share(text: Column, drop: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, drop, ""))) / F.greatest(F.length(text), F.lit(1))


def _lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (with url, host and path) with the lexical features that need no other row."""
    url = F.coalesce("url", F.lit(""))
    total = F.greatest(F.length(url), F.lit(1))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / total
    entropy = F.aggregate(F.array_distinct(F.filter(F.split(url, ""), lambda c: c != "")), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    return urls.select(
        "*", F.length(url).cast("double").alias("length"), F.length("host").cast("double").alias("host_length"),
        (F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))).cast("double").alias("depth"), F.size(labels).cast("double").alias("labels"),
        _share(url, "[0-9]").alias("digit_ratio"), _share(url, "[^A-Za-z0-9/:.]").alias("symbol_ratio"), entropy.alias("entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("parameters"), url.contains("#").cast("double").alias("fragment"),
        F.substring_index("host", ".", -1).alias("_suffix"), F.substring_index("host", ".", -2).alias("_domain"),
    )


#: Parts that labelled urls are dealt into by a hash; a labelled url gets the rates of the other parts.
FOLDS = 5


def _fold() -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")


def _statistics(rows: DataFrame, labelled: Column, key: str, name: str) -> DataFrame:
    """``rows`` with the smoothed share of blocked urls and the number seen of each key, over all labelled rows.

    A labelled row, from which trees may learn, doesn't count itself: equal urls fall into one of a
    few parts, and its rates are those of the other parts. So a domain that was seen once doesn't
    tell its own label.
    """
    blocked = (F.col("_label") == 1).cast("double")
    part = lambda of: F.array(*(F.sum(F.when(_fold() == k, of).otherwise(0.0)) for k in range(FOLDS)))
    seen = rows.where(labelled).groupBy(key).agg(part(F.lit(1.0)).alias("_n"), part(blocked).alias("_blocked"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    count = lambda c: F.coalesce(total(F.col(c)) - F.when(labelled, F.get(c, _fold())).otherwise(0.0), F.lit(0.0))
    return rows.join(seen, key, "left").withColumns({f"{name}_rate": (count("_blocked") + 1) / (count("_n") + 2), f"{name}_seen": F.log1p(count("_n"))}).drop("_n", "_blocked")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, train_rows: int = 20_000, trees: int = 20, depth: int = 3) -> DataFrame:
    """Host, path, rule and verdict of each url; where no rule fits, boosted trees decide.

    Labelled urls are those that a rule fits. Shares and counts of host suffixes come from all of
    them; trees are fitted on about ``train_rows`` different urls at most, chosen by a hash. Scoring runs in the executors over every row.
    Without labelled urls all others are allowed; with one verdict only, they get that one.
    Null urls: empty host and path, judged by the trees. Repeated rows and null ids stay rows of
    their own; other columns are ignored. An empty table gives no rows.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_verdict", verdict).withColumn("_label", F.when(F.col("_verdict") == "block", 1.0).when(F.col("_verdict") == "allow", 0.0))
    rows = _lexical(rows)
    counts = {r["_label"]: r["n"] for r in rows.where("_label is not null").groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        told = F.lit("block" if 1.0 in counts else "allow")
        scored = rows.withColumn("score", F.lit(None).cast("double")).withColumn("_told", told)
    else:
        labelled = F.col("_label").isNotNull()
        for key, name in (("_suffix", "suffix"), ("_domain", "domain")):
            rows = _statistics(rows, labelled, key, name)
        share = min(1.0, train_rows / sum(counts.values()))
        drawn = F.shiftrightunsigned(F.xxhash64("url"), 1) < min(int(share * 2**63), 2**63 - 1)
        # Rows of one url are alike in all that trees see, so each url is learned from once.
        once = rows.where(labelled & drawn).dropDuplicates(["url"])
        sample = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(once).select("features", F.col("_label").alias("label")).coalesce(4).persist()
        try:
            if sample.select("label").distinct().count() < 2:
                model = None
            else:
                model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=7, checkpointInterval=-1, maxMemoryInMB=64).fit(sample)
        finally:
            sample.unpersist()
        if model is None:
            more = max(counts, key=counts.get)
            scored = rows.withColumn("score", F.lit(None).cast("double")).withColumn("_told", F.lit("block" if more else "allow"))
        else:
            scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)).withColumn("score", vector_to_array("probability")[1]).withColumn("_told", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("_verdict", "_told").alias("verdict"), "score")
