"""Table profiles: shape, column types, missing share, target summary and their compact forms.

A profile is one aggregate over the table whatever its number of columns. The long form, one
row per column in table order, is the working form of everything after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import scalars as S
from tabloom.operators.quantiles import exact_quantiles, quantile_name
from tabloom.session import one_row

# The compaction gates.
MAX_FEATURES = 50
MAX_CLASSES = 50

SCHEMA_COLUMNS = ["position", "name", "type", "missing_pct", "is_target"]


def _missing(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _type_label(data_type: T.DataType) -> str:
    if isinstance(data_type, T.IntegralType):
        return "int"
    if isinstance(data_type, T.NumericType):
        return "float"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    return "string"


def shape(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).select(
        F.lit(name).alias("file"), "n_rows", F.lit(len(df.columns)).alias("n_cols")
    )


def schema_profile(df: DataFrame, targets: Sequence[str] = ()) -> DataFrame:
    """Long profile: position, name, type, missing_pct (null for an empty table), is_target.

    An integer column with missing cells is labelled float, as a reader without nullable
    integers would load it.
    """
    fields = df.schema.fields
    counts = df.agg(
        F.count("*").alias("__rows"),
        *[F.count_if(_missing(f)).alias(f"__m{i}") for i, f in enumerate(fields)],
    )
    entries = []
    for i, f in enumerate(fields):
        label = _type_label(f.dataType)
        missing = F.col(f"__m{i}")
        kind = F.when(missing > 0, "float").otherwise("int") if label == "int" else F.lit(label)
        entries.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("name"),
                kind.alias("type"),
                F.try_divide(missing * F.lit(100.0), F.col("__rows")).alias("missing_pct"),
                F.lit(f.name in targets).alias("is_target"),
            )
        )
    return counts.select(F.inline(F.array(*entries)))


def missing_pct(df: DataFrame) -> DataFrame:
    return schema_profile(df).select("name", "missing_pct")


def numeric_summary(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """min, median, max per target without nulls; absent targets get an error text."""
    spark = df.sparkSession
    present = [t for t in targets if t in df.columns]
    parts = []
    if present:
        clean = df.select(*[F.nullif(F.col(t).cast("double"), F.lit(float("nan"))).alias(t) for t in present])
        ends = clean.agg(*[F.struct(F.min(t).alias("lo"), F.max(t).alias("hi")).alias(t) for t in present])
        mid = one_row(exact_quantiles(clean, present, [0.5]))
        parts.append(
            ends.select(
                F.inline(
                    F.array(
                        *[
                            F.struct(
                                F.lit(t).alias("target"),
                                F.col(t)["lo"].alias("min"),
                                mid[quantile_name(t, 0)].alias("median"),
                                F.col(t)["hi"].alias("max"),
                                F.lit(None).cast("string").alias("error"),
                            )
                            for t in present
                        ]
                    )
                )
            )
        )
    absent = [(t, None, None, None, "not found") for t in targets if t not in df.columns]
    if absent or not parts:
        parts.append(
            spark.createDataFrame(absent, "target string, min double, median double, max double, error string")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def class_distribution(df: DataFrame, col: str) -> DataFrame:
    """Percent of the non-null rows per class."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("class")).agg(F.count("*").alias("n"))
    total = df.agg(F.count(col).alias("total")).scalar()
    return counts.select("class", (F.col("n") * 100.0 / total).alias("pct"))


def target_summary(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Long summary ``(target, entry, value)``: min, median and max of numeric targets, class
    shares of the others, and the entry ``error: not found`` for absent ones."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numeric = [t for t in targets if t not in kinds or isinstance(kinds[t], T.NumericType)]
    found = numeric_summary(df, numeric)
    entries = [F.struct(F.lit(e).alias("entry"), F.col(e).alias("value")) for e in ("min", "median", "max")]
    error = F.array(F.struct(F.concat(F.lit("error: "), "error").alias("entry"), F.lit(None).cast("double").alias("value")))
    out = found.select("target", F.inline(F.when(F.col("error").isNull(), F.array(*entries)).otherwise(error)))
    for t in targets:
        if t not in numeric:
            shares = class_distribution(df, t)
            out = out.unionByName(
                shares.select(F.lit(t).alias("target"), F.col("class").cast("string").alias("entry"), F.col("pct").alias("value"))
            )
    return out


def numbered_name_ranges(names: DataFrame, col: str = "name", by: Sequence[str] = ()) -> DataFrame:
    """Names that end in digits as (prefix, min_index, max_index, count), within ``by``."""
    parsed = names.select(
        *by, S.name_prefix(F.col(col)).alias("prefix"), S.name_number(F.col(col)).alias("number")
    ).filter(F.col("prefix").isNotNull() & F.col("number").isNotNull())
    return parsed.groupBy(*by, "prefix").agg(
        F.min("number").alias("min_index"), F.max("number").alias("max_index"), F.count("*").alias("count")
    )


CLASS_RUN = r"^\d+-(F_\d+)_(\d+)$"


def class_run_ranges(classes: DataFrame, col: str = "class", by: Sequence[str] = ()) -> DataFrame:
    """Classes named ``<row>-F_<n>_<idx>`` as one label per feature, within ``by``."""
    feature = F.regexp_extract(col, CLASS_RUN, 1)
    parsed = classes.filter(F.col(col).rlike(CLASS_RUN)).select(
        *by, feature.alias("feature"), F.regexp_extract(col, CLASS_RUN, 2).cast("bigint").alias("idx")
    )
    groups = parsed.groupBy(*by, "feature").agg(
        F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count("*").alias("n")
    )
    return groups.select(
        *by, F.format_string("%s_%d–%s_%d (%d classes)", "feature", "lo", "feature", "hi", "n").alias("class"), "n"
    )


def top_classes(shares: DataFrame, limit: int = MAX_CLASSES) -> DataFrame:
    """The ``limit`` largest classes and one row for how many are left out.

    The limit is a top-k, so no sort over all classes takes place.
    """
    ordered = shares.orderBy(F.desc("pct"), F.asc("class")).limit(limit)
    rest = shares.agg((F.count("*") - limit).alias("more")).filter(F.col("more") > 0)
    return ordered.select(F.col("class").cast("string").alias("class"), "pct").unionByName(
        rest.select(F.format_string("... +%d more", "more").alias("class"), F.lit(None).cast("double").alias("pct"))
    )


def collapse_runs(schema: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Merge neighbouring columns of one type whose names differ by a running number.

    ``schema`` is a long profile with ``position``; ``by`` names the profiled file. A group
    is the column list of one table, so its window is bounded by the width of that table.
    """
    by = list(by)
    order = Window.partitionBy(*by).orderBy("position")
    pattern = r"^(.*?)(\d+)$"
    marked = (
        schema.withColumn("__prefix", F.when(F.col("name").rlike(pattern), F.regexp_extract("name", pattern, 1)))
        .withColumn("__number", F.nullif(F.regexp_extract("name", pattern, 2), F.lit("")).try_cast("bigint"))
        .withColumn("__prev", F.lag(F.struct("type", "__prefix", "__number")).over(order))
    )
    joined = (
        (F.col("type") == F.col("__prev.type"))
        & (F.col("__prefix") == F.col("__prev.__prefix"))
        & (F.col("__number") == F.col("__prev.__number") + 1)
    )
    runs = marked.withColumn("__start", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn(
        "run", F.sum("__start").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    merged = runs.groupBy(*by, "run").agg(
        F.min_by("name", "position").alias("first"),
        F.max_by("name", "position").alias("last"),
        F.count("*").alias("n"),
        F.min("type").alias("type"),
        F.avg("missing_pct").alias("missing_pct"),
        F.bool_or("is_target").alias("is_target"),
    )
    label = F.when(F.col("n") == 1, F.col("first")).otherwise(F.format_string("%s–%s (%d cols)", "first", "last", "n"))
    return merged.select(*by, "run", label.alias("name"), "type", "missing_pct", "is_target", "n")


def compact_schema(schema: DataFrame, limit: int = MAX_FEATURES) -> DataFrame:
    """Collapse runs only when the table has more than ``limit`` columns.

    The gate is a scalar over the profile, which has one row per column.
    """
    wide = schema.agg((F.count("*") > limit).alias("wide")).scalar()
    plain = schema.filter(~wide).select(
        (F.col("position") + 1).cast("bigint").alias("run"), "name", "type", "missing_pct", "is_target",
        F.lit(1).cast("bigint").alias("n"),
    )
    return collapse_runs(schema.filter(wide)).unionByName(plain)


def file_summary(profiles: DataFrame, shapes: DataFrame) -> DataFrame:
    """One row per file: shape and target names in table order."""
    targets = (
        profiles.filter("is_target")
        .groupBy("file")
        .agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("t"))
        .select(F.col("file").alias("__file"), F.transform("t", lambda s: s["name"]).alias("targets"))
    )
    return shapes.join(targets, F.col("file") == F.col("__file"), "left").select(
        "file", "n_rows", "n_cols", F.coalesce("targets", F.array().cast("array<string>")).alias("targets")
    )


def size_class(n_features: Column) -> Column:
    """Size label by the number of feature columns."""
    return (
        F.when(n_features < 10, "low_features").when(n_features < 500, "medium_features").otherwise("high_features")
    )


def layer_widths(n_features: Column, factors: Sequence[float] = (2, 1, 0.5, 0.25), cap: int = 1024, floor: int = 16) -> Column:
    """min(n * f, cap) per factor, those under ``floor`` dropped."""
    widths = F.array(*[F.least(F.floor(n_features * F.lit(float(f))), F.lit(cap)).cast("int") for f in factors])
    return F.filter(widths, lambda w: w >= floor)


def embedding_width(n_categories: Column) -> Column:
    return F.least(F.lit(50), F.floor(n_categories / 2) + 1).cast("int")
