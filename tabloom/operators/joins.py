"""Key-based replacements of positional table operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns side by side; rows are matched by key, since a table has no positions."""
    return left.join(right, key)


def long_cells(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """One row per cell with its column name and its value as text."""
    texts = df.select(key, *[F.col(c).cast("string").alias(c) for c in cols])
    return texts.unpivot([key], list(cols), "column", "value")


def cell_lookup(requests: DataFrame, cell: Column, df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Values for keys ``<row>-<column>``: an equi-join on the row, then the named column."""
    parts = F.split(cell, "-", 2)
    asked = requests.withColumn("__row", F.element_at(parts, 1).try_cast("bigint")).withColumn(
        "__column", F.try_element_at(parts, F.lit(2))
    )
    asked = asked.filter(F.col("__column").isin(list(cols)))
    names = [f"__cell_{i}" for i in range(len(cols))]
    cells = df.select(F.col(key).alias("__key"), *[F.col(c).cast("string").alias(n) for c, n in zip(cols, names)])
    value = F.coalesce(*[F.when(F.col("__column") == c, F.col(n)) for c, n in zip(cols, names)])
    joined = asked.join(cells, F.col("__row") == F.col("__key")).withColumn("value", value)
    return joined.drop("__row", "__column", "__key", *names)


def not_present(requested: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """Requested rows that do not exist yet."""
    return requested.join(present, list(on), "left_anti")


def fill_missing_cells(
    df: DataFrame, predicted: DataFrame, key: str, cols: Sequence[str], mean_std: Column
) -> DataFrame:
    """Originally missing cells take the prediction, scaled back; other cells are kept."""
    guesses = predicted.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__p_{c}") for c in cols])
    filled = {
        c: F.coalesce(F.col(c), F.col(f"__p_{c}") * mean_std[f"{c}_std"] + mean_std[f"{c}_mean"]) for c in cols
    }
    return (
        df.join(guesses, F.col(key) == F.col("__key"), "left")
        .withColumns(filled)
        .drop("__key", *[f"__p_{c}" for c in cols])
    )
