"""Registered queries of the numbered operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.llm import anchors, decontam, embeddings, langid, mixing, pii, quality, search, simhash, spelling, suffixes, warc, wrappers
from siteweave.llm.oracles import ORACLE_SQL  # noqa: F401
from siteweave.llm.store import scratch


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = suffixes.dedup(_read(spark, sf, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return wrappers.extract(_read(spark, sf, "pages"))


def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(_read(spark, sf, "documents"))


def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    hits = decontam.scan_hits(_read(spark, sf, "documents"), _read(spark, sf, "benchmark"))
    return decontam.judged(hits).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.classes(_read(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings.dedup(_read(spark, sf, "embeddings"))


def op8_pii_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    key = spark.conf.get(pii.KEY_SETTING, "key of the registered query")
    return pii.replace(_read(spark, sf, "documents").select("doc_id", "text"), key)


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.by_position(mixing.mix(_read(spark, sf, "documents")))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op10_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = anchors.dedup(_read(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(spelling.words(_read(spark, sf, "documents")))


def op12_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.rank(_read(spark, sf, "documents"), _read(spark, sf, "benchmark"))


def op13_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(_read(spark, sf, "pages"), path)
    return warc.read(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_suffix_dedup, op2_html_extraction, op3_quality, op4_decontamination, op5_language_id, op6_simhash, op7_embedding_dedup, op8_pii_surrogates, op9_mixing, op10_substring_dedup,
    op11_spelling_variants, op12_ranked_search, op13_warc)}
