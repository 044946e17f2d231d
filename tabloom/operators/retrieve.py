"""Hybrid retrieval: index rows, explicit vectors, lookup of hits and payloads.

The index row of a record is ``[unit text vector | w_1 * onehot_1 | ... ]`` scaled to length
one, and so is the query, with its text part weighted. A one-hot block contributes w^2 to the
inner product when both sides hold the same category and 0 otherwise, so the search
(``metric_search``) never materialises the blocks; ``sparse.hybrid`` states them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import vectors as V
from tabloom.operators.metric_search import SCORE_DIGITS

# Category weights of the record index.
RECORD_WEIGHTS = {
    "competition_problem_subtype": 3.0,
    "competition_problem_type": 2.5,
    "evaluation_metrics": 2.0,
    "competition_dataset_type": 1.0,
}
UNKNOWN = "Unknown"


def fill_categories(df: DataFrame, cats: Sequence[str]) -> DataFrame:
    """Absent category columns and null values become ``Unknown``."""
    return df.withColumns(
        {
            c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) if c in df.columns else F.lit(UNKNOWN)
            for c in cats
        }
    )


def index_rows(df: DataFrame, key: str, vector: str, cats: Sequence[str], slug: str | None = None) -> DataFrame:
    """``(id, vec, cats..., slug)`` with unit vectors in double.

    ``key`` identifies a row: collapse repeated records with :func:`first_records` before.
    """
    filled = fill_categories(df, cats)
    return filled.select(
        F.col(key).alias("id"),
        V.unit(V.as_double(F.col(vector))).alias("vec"),
        *cats,
        (F.coalesce(F.col(slug).cast("string"), F.lit("")) if slug else F.lit("")).alias("slug"),
    )


def nearest(index: DataFrame, score: Column, k: int, tie: str = "id") -> DataFrame:
    """Global top-k of one query: a scan with a top-k per task, no shuffle of the table."""
    return index.withColumn("score", F.round(score, SCORE_DIGITS)).orderBy(F.desc("score"), F.asc(tie)).limit(k)


def first_records(records: DataFrame, key: Column, load_order: str) -> DataFrame:
    """One record per normalised id, the first by load order; copies collapse map-side."""
    cols = records.columns
    packed = records.select(key.alias("record_key"), F.struct(*cols).alias("r"), F.col(load_order).alias("__o"))
    return packed.groupBy("record_key").agg(F.min_by("r", "__o").alias("r")).select("record_key", "r.*")


def lookup(hits: DataFrame, records: DataFrame, hit_key: Column) -> DataFrame:
    """Ranked hits with their records; hits without a record are dropped."""
    return hits.withColumn("__k", hit_key).join(records, F.col("__k") == F.col("record_key")).drop("__k", "record_key")


def unmatched(hits: DataFrame, records: DataFrame, hit_key: Column) -> DataFrame:
    """Hits without a record."""
    return (
        hits.withColumn("__k", hit_key)
        .join(records.select("record_key"), F.col("__k") == F.col("record_key"), "left_anti")
        .drop("__k")
    )


def payload(found: DataFrame, by: str, fields: Sequence[str]) -> DataFrame:
    """One JSON list of examples per query, in rank order; at most k entries each."""
    entries = F.array_sort(F.collect_list(F.struct("rank", *[f for f in fields if f != "rank"])))
    return found.groupBy(by).agg(F.to_json(entries).alias("examples"), F.count("*").alias("n_examples"))
