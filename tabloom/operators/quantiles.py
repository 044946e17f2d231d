"""Exact quantiles from counts per value and running counts.

Equal values collapse before the shuffle. Running counts along the values, in blocks (see
``running``), give the rank of every value, and the values at the wanted ranks are picked by one
aggregate with map-side partials. Nothing is sorted in one task or collected, whatever the number of
values, columns or groups and however the rows spread over the groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.running import running_totals


def quantile_name(col: str, i: int) -> str:
    return f"{col}__q{i}"


def _ranked(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per distinct (keys, value): n, upto (rows to its end) and rows (of the keys). Null values count 0."""
    counts = values.groupBy(*keys, "value").agg(F.count("value").alias("n"))
    ranked = running_totals(counts, ["value"], {"upto": F.col("n")}, keys)
    if not keys:
        return ranked.withColumn("rows", counts.agg(F.sum("n").alias("m")).scalar())
    rows = counts.groupBy(*[F.col(k).alias(f"__r_{k}") for k in keys]).agg(F.sum("n").alias("rows"))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return ranked.join(rows, match).drop(*[f"__r_{k}" for k in keys])


def _at_rank(rank: Column, among: Column | None = None) -> Column:
    """The value at a rank from 0, inside an aggregate over ranked values."""
    here = F.col("upto") > rank
    return F.min(F.when(here if among is None else here & among, F.col("value")))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """One row per group with ``<col>__q<i>`` for every column and probability, interpolated.

    NaN counts as missing. A group without values has null quantiles.
    """
    cols, probs, by = list(cols), list(probs), list(by)
    clean = {c: F.col(c).cast("double") for c in cols}
    cells = F.explode(
        F.array(*[F.struct(F.lit(i).alias("__col"), F.nanvl(clean[c], F.lit(None)).alias("value")) for i, c in enumerate(cols)])
    )
    long = df.select(*by, cells.alias("__cell")).select(*by, "__cell.*")
    ranked = _ranked(long, [*by, "__col"])
    out = []
    for i, c in enumerate(cols):
        own = F.col("__col") == i
        for k, p in enumerate(probs):
            pos = F.lit(float(p)) * (F.col("rows") - 1)
            low, high = F.floor(pos), F.ceil(pos)
            # Position, and the values at its two ends.
            at = F.max(F.when(own, pos))
            a, b = _at_rank(low, own), _at_rank(high, own)
            up = F.ceil(at) - at
            value = F.when(F.floor(at) == F.ceil(at), a).otherwise(up * a + (at - F.floor(at)) * b)
            out.append(value.alias(quantile_name(c, k)))
    return ranked.groupBy(*by).agg(*out)


def value_at_rank(df: DataFrame, col: str, rank: Column) -> DataFrame:
    """One row with ``value``: the order statistic at a rank from 0, in the column's own type.

    ``rank`` may use ``rows``, the number of values.
    """
    ranked = _ranked(df.select(F.col(col).alias("value")), [])
    return ranked.agg(_at_rank(rank).alias("value"))
