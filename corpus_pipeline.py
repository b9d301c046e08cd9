"""The corpus pipeline: each stage is written as Parquet and read again as the next one's documents.

Every stage takes empty tables, null ids, null, empty and very long texts and repeated rows (the operators say what these give); columns beyond
those of ``documents`` come through all stages but the last, also those that share a name with a column of an operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.llm import decontam, langid, mixing, pii, simhash
from siteweave.llm.store import store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _beside(docs: DataFrame, names: list[str], change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply an operator that adds columns of these names; given columns of the same names come through as they were."""
    aside = {n: f"__given_{n}" for n in names if n in docs.columns}
    changed = change(docs.withColumnsRenamed(aside)).drop(*names)
    return changed.withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a null text or one without a letter goes."""
    return _beside(docs, ["lang_pred", "score"], lambda rows: langid.predict(rows, langid.fit(rows)).where("lang_pred <> 'und'"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group linked by SimHash."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; ``n_chars``, where there is one, is counted anew for changed texts."""
    def change(rows: DataFrame) -> DataFrame:
        changed = pii.replace(rows, spark.conf.get(pii.KEY_SETTING, "key of the registered pipeline"))
        if "n_chars" not in rows.columns:
            return changed
        return changed.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))

    return _beside(docs, ["n_entities"], change)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix, range-sorted by position: one row per document with the words taken."""
    mixed = mixing.by_position(mixing.mix(docs))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", "position", "copies")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontamination),
    ("pii_surrogates", private_data), ("mixing", mixture),
]

#: language ID, SimHash and surrogates have no SQL form; tests/llm/test_pipeline.py holds the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
