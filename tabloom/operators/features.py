"""Fit/apply transformers. ``fit`` gives a one-row parameter table, ``apply`` reads it as scalars.

Fitting is one aggregate over the training table. Applying adds no shuffle and no join: the
parameters enter the scan of the other table as a scalar subquery.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import scalars as S
from tabloom.operators import aggregate, encoders, sparse
from tabloom.operators.project import distinct_counts_up_to, present
from tabloom.operators.quantiles import exact_quantiles, quantile_name
from tabloom.session import one_row


@dataclass
class MedianImputer:
    cols: Sequence[str]
    params: DataFrame | None = None

    def fit(self, df: DataFrame) -> MedianImputer:
        q = exact_quantiles(df, self.cols, [0.5])
        self.params = q.select(*[F.col(quantile_name(c, 0)).alias(c) for c in self.cols])
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        p = one_row(self.params)
        return df.withColumns({c: F.coalesce(present(df, c), p[c]) for c in self.cols})


@dataclass
class ModeImputer:
    cols: Sequence[str]
    params: DataFrame | None = None

    def fit(self, df: DataFrame) -> ModeImputer:
        self.params = encoders.most_frequent(df.withColumns({c: present(df, c) for c in self.cols}), self.cols)
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        p = one_row(self.params)
        return df.withColumns({c: F.coalesce(present(df, c), p[c]) for c in self.cols})


def fill_constant(df: DataFrame, values: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


@dataclass
class StandardScaler:
    cols: Sequence[str]
    params: DataFrame | None = None

    def fit(self, df: DataFrame) -> StandardScaler:
        self.params = aggregate.mean_std(df, self.cols)
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        p = one_row(self.params)
        return df.withColumns({c: (F.col(c) - p[f"{c}_mean"]) / p[f"{c}_std"] for c in self.cols})

    def invert(self, df: DataFrame) -> DataFrame:
        p = one_row(self.params)
        return df.withColumns({c: F.col(c) * p[f"{c}_std"] + p[f"{c}_mean"] for c in self.cols})


@dataclass
class MinMaxScaler:
    cols: Sequence[str]
    params: DataFrame | None = None

    def fit(self, df: DataFrame) -> MinMaxScaler:
        self.params = aggregate.min_max(df, self.cols)
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        """A constant column scales to 0."""
        p = one_row(self.params)
        out = {}
        for c in self.cols:
            span = p[f"{c}_max"] - p[f"{c}_min"]
            scaled = F.try_divide(F.col(c) - p[f"{c}_min"], span)
            out[c] = F.when(F.col(c).isNotNull(), F.coalesce(scaled.cast("double"), F.lit(0.0)))
        return df.withColumns(out)


@dataclass
class OneHot:
    """One column per category, at most 50; unknown and null give all zeros."""

    cols: Sequence[str]
    limit: int = encoders.MAX_ONE_HOT
    values: dict[str, list] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> OneHot:
        for c in self.cols:
            self.values[c] = encoders.bounded_values(df, c, self.limit)
        return self

    def names(self) -> list[str]:
        return [f"{c}_{i}" for c in self.cols for i in range(len(self.values[c]))]

    def apply(self, df: DataFrame) -> DataFrame:
        new = [e for c in self.cols for e in encoders.one_hot_columns(c, self.values[c])]
        return df.select("*", *new).drop(*self.cols)


def _fixed(params: DataFrame) -> DataFrame:
    """A one-row table with its values computed, so that no use of it computes them again."""
    row = params.first()
    return params.sparkSession.range(1).select(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in params.schema.fields])


@dataclass
class ColumnPipeline:
    """Numeric columns: median and standard scaling. Categorical: mode and one-hot. Rest dropped.

    Columns without a value and categorical columns of more than ``limit`` categories are dropped
    by the fit, as the data preparation does.
    """

    numeric: Sequence[str]
    categorical: Sequence[str]
    limit: int = encoders.MAX_ONE_HOT

    def fit(self, df: DataFrame) -> ColumnPipeline:
        cols = [*self.numeric, *self.categorical]
        filled = df.agg(*[F.count(present(df, c)).alias(c) for c in cols]).first() if cols else {}
        few = distinct_counts_up_to(df, list(self.categorical), self.limit)
        self.numeric = [c for c in self.numeric if filled[c]]
        self.categorical = [c for c in self.categorical if filled[c] and few[c] is not None]
        self.median = MedianImputer(self.numeric).fit(df)
        self.median.params = _fixed(self.median.params)
        self.scaler = StandardScaler(self.numeric, _fixed(self._moments(df)))
        kept = self._categories(df)
        modes = [F.lit(max(kept[c], key=lambda x: x[1])[0]).cast(df.schema[c].dataType).alias(c) for c in self.categorical]
        self.mode = ModeImputer(self.categorical, df.sparkSession.range(1).select(*modes))
        self.one_hot = OneHot(self.categorical, self.limit, {c: [v for v, _ in kept[c]] for c in self.categorical})
        return self

    def _moments(self, df: DataFrame) -> DataFrame:
        """Mean and deviation of the filled columns, from those of the present cells and the median: one pass."""
        p = one_row(self.median.params)
        cell = {c: present(df, c).cast("double") for c in self.numeric}
        sums = [F.struct(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v")).alias(c) for c, x in cell.items()]
        found = df.agg(F.count("*").alias("__rows"), *sums)
        out = []
        for c in self.numeric:
            n, m, v = (F.col(c)[k] for k in "nmv")
            gaps = F.col("__rows") - n
            mean = (n * m + gaps * p[c]) / F.col("__rows")
            std = F.sqrt((n * v + n * (m - mean) ** 2 + gaps * (p[c] - mean) ** 2) / F.col("__rows"))
            out += [mean.alias(f"{c}_mean"), F.when(std == 0, F.lit(1.0)).otherwise(std).alias(f"{c}_std")]
        return found.select(*out)

    def _categories(self, df: DataFrame) -> dict[str, list]:
        """Sorted (value, count) of every categorical column, at most ``limit`` each, from one long-form count."""
        if not self.categorical:
            return {}
        cells = [F.struct(F.lit(i).alias("of"), present(df, c).cast("string").alias("value")) for i, c in enumerate(self.categorical)]
        long = df.select(F.explode(F.array(*cells)).alias("e")).select("e.*").filter(F.col("value").isNotNull())
        counts = long.groupBy("of", "value").agg(F.count("*").alias("n"))
        typed = [
            F.sort_array(F.collect_list(F.when(F.col("of") == i, F.struct(F.col("value").cast(df.schema[c].dataType).alias("v"), "n")))).alias(c)
            for i, c in enumerate(self.categorical)
        ]
        row = counts.agg(*typed).first()
        return {c: [(x["v"], x["n"]) for x in row[c]] for c in self.categorical}

    def apply(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        out = df.select(*keep, *self.numeric, *self.categorical)
        return self.one_hot.apply(self.scaler.apply(self.mode.apply(self.median.apply(out))))

    def names(self) -> list[str]:
        return [*self.numeric, *self.one_hot.names()]


# Sub-types by the treatment of their target.
LABEL_TARGETS = ("binary-classification", "multiclass-classification", "multiclass classification", "ordinal-regression")
LOG_TARGETS = ("continuous-regression", "quantile-regression", "multi-output regression", "missing-value-imputation")
MULTI_LABEL = "multi-label-classification"


def transform_target(df: DataFrame, subtype: str, target: str, out: str = "y", flag: str = "log_applied") -> DataFrame:
    """Encoded target by sub-type, with the flag for the way back.

    Label sets become sparse vectors, numbers their logarithm if none is negative.
    """
    raw = df.withColumn(flag, F.lit(False))
    if subtype in LABEL_TARGETS:
        text = raw.withColumn(target, F.col(target).cast("string"))
        return encoders.encode(text, target, encoders.sorted_vocabulary(text, target), out)
    if subtype == MULTI_LABEL:
        return sparse.label_sets(raw, target, sparse.label_vocabulary(raw, target), out)
    if subtype in LOG_TARGETS:
        return transform_targets(df, {target: out}, {target: flag})
    return raw.withColumn(out, F.col(target))


def transform_targets(df: DataFrame, targets: Mapping[str, str], flags: Mapping[str, str], together: bool = False) -> DataFrame:
    """Several numeric targets in one pass, each with its flag: the logarithm of a target without negative values.

    ``together`` takes all logarithms or none. A target without a value is not transformed.
    """
    values = {t: F.col(t).cast("double") for t in targets}
    signs = df.agg(*[F.bool_and(y >= 0).alias(t) for t, y in values.items()])
    if together:
        whole = F.lit(True)
        for t in targets:
            whole = whole & F.coalesce(F.col(f"`{t}`"), F.lit(True))
        some = F.coalesce(*[F.col(f"`{t}`") for t in targets]).isNotNull()
        signs = signs.select(*[(whole & some).alias(t) for t in targets])
    p = one_row(signs)
    df = df.withColumns({flags[t]: F.coalesce(p[t], F.lit(False)) for t in targets})
    logs = {o: F.when(F.col(flags[t]), F.log1p(F.greatest(values[t], F.lit(0.0)))).otherwise(values[t]) for t, o in targets.items()}
    return df.withColumns(logs)


def invert_target(df: DataFrame, prediction: str, cap: float = 20.0, flag: str = "log_applied") -> DataFrame:
    """Predictions back on the scale of the target, by the flag of :func:`transform_target`."""
    p = F.col(prediction)
    return df.withColumn(prediction, F.when(F.col(flag), S.inverse_log1p(p, cap)).otherwise(p))


def date_features(df: DataFrame, col: str) -> DataFrame:
    """Calendar parts and cyclical month and weekday of one date column."""
    d = F.col(col)
    parts = S.date_parts(d)
    month_sin, month_cos = S.cyclical(parts["month"], 12)
    week_sin, week_cos = S.cyclical(parts["weekday"], 7)
    return df.withColumns(
        {**parts, "month_sin": month_sin, "month_cos": month_cos, "weekday_sin": week_sin, "weekday_cos": week_cos}
    )


def trip_features(df: DataFrame, start: str, lon1: str, lat1: str, lon2: str, lat2: str) -> DataFrame:
    d = F.col(start)
    return df.withColumns(
        {
            "hour": F.hour(d),
            "weekday": S.weekday(d),
            "month": F.month(d),
            "distance": S.great_circle(F.col(lon1), F.col(lat1), F.col(lon2), F.col(lat2)),
        }
    )


def array_features(names: Sequence[str]) -> Column:
    return F.array(*[F.col(n).cast("double") for n in names])
