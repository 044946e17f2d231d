"""Column and row selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.quantiles import exact_quantiles, quantile_name
from tabloom.session import one_row


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns; absent names are ignored."""
    return df.drop(*cols)


def add_missing(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add the absent columns with their default."""
    absent = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def align_to(df: DataFrame, like: DataFrame) -> DataFrame:
    """Columns and order of ``like``."""
    return df.select(*like.columns)


def columns_by_prefix(df: DataFrame, prefixes: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c.startswith(tuple(prefixes))]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def drop_all_null(df: DataFrame) -> DataFrame:
    """One aggregate decides for all columns."""
    seen = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if seen[c] == 0])


def distinct_counts_up_to(df: DataFrame, cols: Sequence[str], limit: int) -> dict[str, int | None]:
    """Exact distinct counts up to ``limit``; None means more.

    A sketch pass sets aside the columns far above the limit, so the exact pass only sees
    columns whose map-side aggregate collapses to a few hundred rows per task.
    """
    if not cols:
        return {}
    rough = df.agg(*[F.approx_count_distinct(F.col(c), 0.02).alias(c) for c in cols]).first()
    near = [c for c in cols if rough[c] <= 2 * limit + 16]
    out: dict[str, int | None] = {c: None for c in cols}
    if near:
        exact = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in near]).first()
        out.update({c: exact[c] if exact[c] <= limit else None for c in near})
    return out


def drop_high_cardinality(df: DataFrame, cols: Sequence[str] | None = None, limit: int = 50) -> DataFrame:
    """Drop the categorical columns with more than ``limit`` distinct values."""
    cols = text_columns(df) if cols is None else list(cols)
    counts = distinct_counts_up_to(df, cols, limit)
    return df.drop(*[c for c in cols if counts[c] is None])


def quality_filter(df: DataFrame, technique: str, library: str, tag: str) -> DataFrame:
    """Deep-learning records of one library; the test ignores case."""
    return df.filter((F.upper(technique) == "DL") & (F.lower(library) == tag))


def iqr_filter(df: DataFrame, col: str, width: float = 1.5) -> DataFrame:
    """Rows inside [q1 - width * iqr, q3 + width * iqr]; the fences are a scalar subquery."""
    q = one_row(exact_quantiles(df, [col], [0.25, 0.75]))
    q1, q3 = q[quantile_name(col, 0)], q[quantile_name(col, 1)]
    iqr = q3 - q1
    return df.filter((F.col(col) >= q1 - F.lit(width) * iqr) & (F.col(col) <= q3 + F.lit(width) * iqr))


def unseen_to(df: DataFrame, col: str, vocabulary: DataFrame, sentinel: str) -> DataFrame:
    """Null or unknown categories become ``sentinel``; ``vocabulary`` has one column ``value``."""
    known = vocabulary.select(F.col("value").alias("__known"))
    return (
        df.join(known, F.col(col) == F.col("__known"), "left")
        .withColumn(col, F.coalesce("__known", F.lit(sentinel)))
        .drop("__known")
    )


def present(df: DataFrame, col: str) -> Column:
    """The cell, with NaN as null."""
    c = F.col(col)
    kind = df.schema[col].dataType
    return F.nanvl(c, F.lit(None).cast(kind)) if isinstance(kind, (T.FloatType, T.DoubleType)) else c


def bad_cells(df: DataFrame) -> DataFrame:
    """Null and NaN counts per column in one pass."""
    counts = df.agg(*[F.count_if(present(df, c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], list(df.columns), "column", "bad")


def require_clean(df: DataFrame) -> DataFrame:
    """The table itself; the job fails when any row holds a null or NaN."""
    bad = None
    for c in df.columns:
        one = present(df, c).isNull()
        bad = one if bad is None else bad | one
    guard = F.when(bad, F.raise_error(F.lit("null or NaN in a required table"))).otherwise(F.lit(True))
    return df.filter(guard)


def missing_cells(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """One row per missing cell (null or NaN): key, column and the label ``<key>-<column>``."""
    gaps = [F.when(present(df, c).isNull(), F.lit(c)) for c in cols]
    long = df.select(key, F.explode(F.array_compact(F.array(*gaps))).alias("column"))
    return long.select(key, "column", F.concat_ws("-", F.col(key).cast("string"), "column").alias("cell"))


def shift(col: Column, by: int) -> Column:
    return col + F.lit(by)
