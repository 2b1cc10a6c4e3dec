"""The opN queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.llm import decontam, html, langid, media, mixing, pii, secrets, simhash, toxicity, urls
from kinforge.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", *(c.alias(n) for n, c in secrets.digest().items()))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the chain finds toxic, with all its probabilities."""
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found = toxicity.predict(docs, chain).where("toxic")
    return found.select("doc_id", F.round("p_toxic", 6).alias("p_toxic"), F.round("p_low_quality", 6).alias("p_low_quality"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's address."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, as (doc_id, item_id)."""
    found = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("share", 6).alias("share"), "how")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    out = simhash.components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a PNG and read back."""
    out = media.read_media(media.store_texts(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("phash")).alias("feature")
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.detect(table(spark, sf_dir, "documents")).select("doc_id", *(c.alias(n) for n, c in pii.digest().items()))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs)
    out = langid.predict(docs, model)
    return out.select("doc_id", F.coalesce(langid.remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the mix of sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs)


QUERIES["op1_secret_scan"] = op1_secret_scan
QUERIES["op2_html_extract"] = op2_html_extract
QUERIES["op3_toxicity"] = op3_toxicity
QUERIES["op4_url_filter"] = op4_url_filter
QUERIES["op5_decontaminate"] = op5_decontaminate
QUERIES["op6_simhash_dedup"] = op6_simhash_dedup
QUERIES["op7_media_columns"] = op7_media_columns
QUERIES["op8_pii"] = op8_pii
QUERIES["op9_language_id"] = op9_language_id
QUERIES["op10_mix_sources"] = op10_mix_sources
ORACLES["op4_url_filter"] = urls.oracle()
