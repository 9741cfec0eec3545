"""Training corpus from ``documents``: toxicity, near-duplicates, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what one stage
returns is written as Parquet and read again as the next one's ``docs``.  All
stages but the last keep the columns of ``documents``; where a stage changes a
text, ``n_chars`` follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.llm import decontaminate, packing, pii, simhash
from roadpulse.llm import toxicity as tox
from roadpulse.llm.common import stored, table


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    chain = tox.fit(docs, table(spark, sf_dir, "labels"), tox.CATEGORIES)
    return tox.predict(docs, chain, list(tox.CATEGORIES)).where("_tox.toxic < 0.5").drop("_tox")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints linked at two differing bits."""
    return simhash.keep_one(docs, width=3, max_distance=2)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that hold ten consecutive words of a benchmark item."""
    return _counted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), width=10))


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data."""
    return _counted(pii.pseudonymize(docs, pii.DEMO_KEY).drop("_pii"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", simhash_near_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("pii", pii_pseudonyms),
          ("packing", sequence_packing)]

#: Fingerprints, a fitted classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
