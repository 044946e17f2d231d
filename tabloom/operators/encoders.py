"""Vocabularies and category encoders: fit gives a small table, apply is one join.

A vocabulary is a table ``(value, idx)``. It is joined without a hint: Spark broadcasts it
when its measured size is under the threshold and shuffles both sides otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.running import row_numbers

MAX_ONE_HOT = 50


def sorted_vocabulary(df: DataFrame, col: str, **limits) -> DataFrame:
    """Distinct non-null values with their rank from 0 in sorted order."""
    values = df.select(F.col(col).alias("value")).filter(F.col("value").isNotNull()).distinct()
    return row_numbers(values, ["value"], "idx", **limits).select("value", (F.col("idx") - 1).cast("int").alias("idx"))


def frequency_vocabulary(df: DataFrame, col: str, **limits) -> DataFrame:
    """Distinct values from the most frequent on, ties by value; index from 1, 0 means unknown."""
    counts = df.groupBy(F.col(col).alias("value")).count().filter(F.col("value").isNotNull())
    ordered = counts.withColumn("__neg", -F.col("count"))
    return row_numbers(ordered, ["__neg", "value"], "idx", **limits).select(
        "value", F.col("idx").cast("int").alias("idx"), "count"
    )


def encode(df: DataFrame, col: str, vocabulary: DataFrame, out: str, unknown: int | None = None) -> DataFrame:
    """Index of the value; ``unknown`` (or null) for values outside the vocabulary."""
    vocab = vocabulary.select(F.col("value").alias("__value"), F.col("idx").alias("__idx"))
    joined = df.join(vocab, F.col(col) == F.col("__value"), "left")
    idx = F.col("__idx") if unknown is None else F.coalesce("__idx", F.lit(unknown))
    return joined.withColumn(out, idx).drop("__value", "__idx")


def decode(df: DataFrame, idx: str, vocabulary: DataFrame, out: str) -> DataFrame:
    vocab = vocabulary.select(F.col("value").alias(out), F.col("idx").alias("__idx"))
    return df.join(vocab, F.col(idx) == F.col("__idx"), "left").drop("__idx")


def bounded_values(df: DataFrame, col: str, limit: int = MAX_ONE_HOT) -> list:
    """The sorted distinct values of a column that must have few.

    Duplicates collapse before the shuffle and a top-k keeps limit + 1 values per task, so no
    more than that reaches the driver; more categories than ``limit`` are an error.
    """
    values = df.select(F.col(col).alias("value")).filter(F.col("value").isNotNull()).distinct()
    rows = values.orderBy("value").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{col} has more than {limit} categories")
    return [r["value"] for r in rows]


def literal_array(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def one_hot_columns(col: str, values: Sequence, prefix: str | None = None, weight: float = 1.0) -> list[Column]:
    prefix = prefix or col
    return [
        F.when(F.col(col) == F.lit(v), F.lit(float(weight))).otherwise(F.lit(0.0)).alias(f"{prefix}_{i}")
        for i, v in enumerate(values)
    ]


def dense_target(idx: Column, classes: Column | int) -> Column:
    """One 0/1 element per class."""
    n = F.lit(classes) if isinstance(classes, int) else classes
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i == idx).cast("int"))


def cumulative_target(idx: Column, classes: int) -> Column:
    """Ordinal target: element i says whether the class is above i."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 2)), lambda i: (idx > i).cast("int"))


def most_frequent(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the mode of every column, the smallest value on ties.

    Counts are hash-aggregated per value, so no buffer holds a whole column.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    counts = long.filter(F.col("value").isNotNull()).groupBy("column", "value").count()
    tie = {c: F.col("value").cast(types[c]) for c in cols}
    return counts.agg(
        *[
            F.min_by(
                tie[c], F.when(F.col("column") == c, F.struct((-F.col("count")).alias("n"), tie[c].alias("v")))
            ).alias(c)
            for c in cols
        ]
    )


def binary_encode(df: DataFrame, col: str, mode: Column, vocabulary: DataFrame) -> DataFrame:
    """Mode to 0, the other known value to 1, null and unseen values to 0."""
    known = vocabulary.select(F.col("value").alias("__value"))
    return (
        df.join(known, F.col(col) == F.col("__value"), "left")
        .withColumn(col, F.coalesce((F.col("__value") != mode).cast("int"), F.lit(0)))
        .drop("__value")
    )
