"""Structured records: from replies about notebooks to the table that is indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators import project, replies, windows

# Columns of the record table in their order, and those that a collection adds.
RECORD_COLUMNS = [
    ("competition_slug", "string"),
    ("competition_problem_type", "string"),
    ("competition_problem_subtype", "string"),
    ("competition_problem_description", "string"),
    ("competition_dataset_type", "string"),
    ("evaluation_metrics", "string"),
    ("dataset_metadata", "string"),
    ("target_column", "array<string>"),
    ("preprocessing_steps", "array<string>"),
    ("notebook_model_layers_code", "string"),
    ("used_technique", "string"),
    ("library", "string"),
    ("kernel_ref", "string"),
    ("kernel_link", "string"),
]
COLLECTED_COLUMNS = [
    ("username", "string"),
    ("last_run_date", "timestamp"),
    ("votes", "bigint"),
    ("downloaded_path", "string"),
    ("language", "string"),
    ("dl_keyword", "string"),
]
_KINDS = {"string": T.StringType(), "array<string>": T.ArrayType(T.StringType()), "timestamp": T.TimestampType(), "bigint": T.LongType()}
RECORD = T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in RECORD_COLUMNS])
COLLECTED = T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in RECORD_COLUMNS + COLLECTED_COLUMNS])
LIST_COLUMNS = [name for name, kind in RECORD_COLUMNS if kind == "array<string>"]


def split_replies(df: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) replies; rejected ones keep their state and missing keys."""
    checked = replies.validate(df, raw)
    good = checked.filter("state = 'parsed'")
    for c in replies.REQUIRED:
        value = F.col("args")[c]
        if c in LIST_COLUMNS:
            value = F.coalesce(F.from_json(value, "array<string>"), F.array(value))
        good = good.withColumn(c, value)
    return good.drop("args", "missing", "state", raw), checked.filter("state <> 'parsed'").drop("args")


def keep_best(accepted: DataFrame, tag: str, max_keep: int) -> DataFrame:
    """Deep-learning records of the wanted library, the ``max_keep`` of most votes per slug and tag.

    ``accepted`` has the reply fields, slug, reference, votes and the tag it was searched with.
    The cut counts only records that pass the filter, and a hot slug sends at most
    ``max_keep`` rows per task.
    """
    wanted = project.quality_filter(accepted, "used_technique", "library", F.lower(tag))
    best = windows.top_per_group(wanted, ["competition_slug", tag], "votes", "kernel_ref", max_keep)
    return best.drop("rank")


def as_records(df: DataFrame) -> DataFrame:
    """The record table in its fixed column order."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in RECORD.fields])
