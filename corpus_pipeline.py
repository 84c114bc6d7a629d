"""The corpus pipeline: language identification, toxicity, near-dedup, secret
redaction, packing. Each stage works on all that its predecessor kept, returns the
columns of ``documents`` (the last one: pieces), and is written as Parquet and read
again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import langid, near_dedup, packing, secrets, toxicity
from lodestone.llm.common import crc_mod, stored, table
from lodestone.llm.queries import tokenizer_path, toxic_labels


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identifiable language."""
    model = langid.fit(docs.where(crc_mod("doc_id", 5) != 0))
    return langid.keep_identified(docs, model)


def civility(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.7 or more for toxicity."""
    model = toxicity.fit(toxic_labels(docs, table(spark, sf_dir, "labels")))
    return toxicity.keep_civil(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate class."""
    return near_dedup.drop_near_duplicates(docs)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts."""
    return secrets.redact_secrets(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences."""
    path = tokenizer_path("byte_bpe_50k.json")
    return packing.pack(docs, lambda: packing.byte_bpe_encoder(path))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language ID", language),
    ("toxicity", civility),
    ("near-dedup", near_duplicates),
    ("secret scan", redaction),
    ("packing", sequences),
]

#: The stages learn from data, so SQL does not express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs
