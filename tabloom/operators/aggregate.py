"""Column statistics. Every function is one hash aggregate with map-side partials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_std(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row ``<c>_mean, <c>_std``: population deviation, 0 replaced by 1."""
    aggs = []
    for c in cols:
        std = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"{c}_mean"), F.when(std == 0, F.lit(1.0)).otherwise(std).alias(f"{c}_std")]
    return df.agg(*aggs)


def min_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.agg(*aggs)


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact distinct counts as long rows; duplicates collapse before the shuffle."""
    counts = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in cols])
    return counts.unpivot([], list(cols), "column", "n_distinct")


def class_weights(df: DataFrame, col: str, classes: DataFrame) -> DataFrame:
    """n / (2 * count) per class, 1.0 for a class without rows."""
    counts = df.groupBy(F.col(col).alias("class")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total")).scalar()
    return classes.join(counts, "class", "left").select(
        "class", F.coalesce(F.try_divide(total, F.lit(2.0) * F.col("n")), F.lit(1.0)).alias("weight")
    )


def all_non_negative(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.bool_and(F.col(c) >= 0).alias(c) for c in cols])


def kept_counts(df: DataFrame, by: str, tag: str, tags: Sequence[str]) -> DataFrame:
    """Rows per group and tag, one column per given tag."""
    return df.groupBy(by).agg(*[F.count_if(F.col(tag) == t).cast("bigint").alias(t) for t in tags])


def best_epoch(history: DataFrame, run: str, metric: str, watched: Sequence[str]) -> DataFrame:
    """The epoch with the smallest metric per run (the first on ties) and its other values."""
    best = F.min_by(F.struct("epoch", *watched), F.struct(metric, "epoch"))
    return history.groupBy(run).agg(best.alias("b")).select(run, "b.*")


def row_shares(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """Share of each column in the row sum, 0 when the sum is 0."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    return {c: F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0)) for c in cols}
