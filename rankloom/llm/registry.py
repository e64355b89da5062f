"""The queries opN_<name> of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding, improbable, jaccard, media, neighbours, packing, phrases, pii, quality, resampling, secrets, sql, toxicity, urls

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text."""
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents")), secrets.KINDS, secrets.BASE)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text."""
    return secrets.digest(pii.find(table(spark, sf_dir, "documents")), pii.KINDS, pii.BASE)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every url."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every text."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an ISO container, with digests of what is stored and read back."""
    told = media.inspect(media.store(table(spark, sf_dir, "documents")), payload_digests=True)
    ranges = F.array_join(F.transform("keyframes", lambda r: F.concat_ws("+", r["offset"], r["length"])), " ")
    feature = F.format_string("codec=%s duration=%.2f frames=%d keyframes=%s", F.trim("codec"), "duration", "frames", ranges)
    return told.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of texts whose sets of three-word shingles have a similarity of 0.9 or more."""
    return jaccard.link(table(spark, sf_dir, "documents"), words=3, percent=90)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of every document, each a sequence of its own."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), WORD_VOCABULARY)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded, as digests."""
    whole = encoding.decode(encoding.encode(table(spark, sf_dir, "documents"), BYTE_VOCABULARY), BYTE_VOCABULARY)
    return whole.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every text."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of each twentieth id."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language."""
    return phrases.mine(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's distribution, among all with their weights."""
    docs = table(spark, sf_dir, "documents")
    gains = resampling.gains(resampling.bucket_counts(docs), resampling.bucket_counts(table(spark, sf_dir, "benchmark")))
    return resampling.draw(resampling.weigh(docs, gains)).select("doc_id", "n_features", "weight", "score", "rank")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text and its edited text, and how like they are."""
    docs = table(spark, sf_dir, "documents")
    return improbable.compared(docs, improbable.rarity(docs))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_personal_data, op3_url_filter, op4_quality, op5_iso_media, op6_jaccard_join, op7_packing, op8_bpe, op9_toxicity, op10_nearest, op11_phrases, op12_resampling, op13_fingerprints)}
ORACLES: dict[str, str] = {"op11_phrases": sql.OP11_PHRASES, "op12_resampling": sql.OP12_RESAMPLING}
