"""Table access and derived inputs shared by the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.session import table


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def with_nulls(df: DataFrame, key: str, *cols: str, every: int = 7) -> DataFrame:
    """Blank the given cells of every ``every``-th key."""
    return df.withColumns({c: F.when(F.col(key) % every != 0, F.col(c)) for c in cols})


def r6(c: Column) -> Column:
    """Rounding far below the data's precision: float sums differ by order in the last bits."""
    return F.round(c, 6)
