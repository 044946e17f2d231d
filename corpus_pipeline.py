"""From raw documents to token ids: filter, deduplicate, mix and encode.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns the rows that it
keeps with the columns of documents; the last one returns the encoded documents. A stage's
rows are written as Parquet and read again as the next one's ``docs``. SQL cannot express the
stages; the tests compare each of them with a plain computation on its own input.

Defined results: a document without text goes in the first stage; a null language and a null source are a
language and a source of their own; of equal texts a row with an id stays before one without; rows that
share an id are one document for near copies; rows without an id stay there; an empty table gives no rows
at any stage. Columns beyond those of documents are carried through, whatever their names, up to the last
stage. A document that the mix takes several times is encoded as often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import exact_dedup, mixing, quality, sentencepiece_scan, simhash
from tabloom.llm.support import load, stage_table

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like trusted text of their language stay."""
    return quality.kept_rows(docs, quality.trusted_ids(load(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.kept_rows(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked SimHash fingerprints (three-word shingles, three bits) the smallest id stays."""
    return simhash.kept_rows(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so that sources come near their targets."""
    return mixing.mixed_rows(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    encoded = sentencepiece_scan.encode(docs.select("doc_id", "lang", "source", "text"))
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
