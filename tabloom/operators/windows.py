"""Window operators; none of them puts an unbounded group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import scalars as S
from tabloom.operators.project import present
from tabloom.operators.quantiles import exact_quantiles, quantile_name, value_at_rank
from tabloom.operators.running import row_numbers, running_totals


def top_per_group(df: DataFrame, by: Sequence[str], votes: str, tie: str, keep: int) -> DataFrame:
    """The ``keep`` rows of most votes per group.

    ``row_number() <= keep`` is planned with a group limit before the shuffle, so a hot group
    sends at most ``keep`` rows per task.
    """
    w = Window.partitionBy(*by).orderBy(F.desc(votes), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def group_median_fill(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Missing values take the median of their group, then the global one."""
    by = list(by)
    # Every row counts for its group and for the whole table: one set of counts, one written stage.
    twice = df.select(F.explode(F.array(F.lit(True), F.lit(False))).alias("__all"), *by, F.col(col))
    twice = twice.withColumns({k: F.when(~F.col("__all"), F.col(k)) for k in by})
    medians = exact_quantiles(twice, [col], [0.5], ["__all", *by])
    median = F.col(quantile_name(col, 0))
    local = medians.filter(~F.col("__all")).select(*[F.col(k).alias(f"__k_{k}") for k in by], median.alias("__median"))
    overall = medians.filter("__all").agg(F.max(median)).scalar()
    match = None
    for k in by:
        same = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        match = same if match is None else match & same
    return (
        df.join(local, match, "left")
        .withColumn(col, F.coalesce(present(df, col), F.col("__median"), overall))
        .drop("__median", *[f"__k_{k}" for k in by])
    )


def ordered_target_statistics(
    df: DataFrame, cat: str, target: str, order: Sequence[str], out: str, prior_weight: float = 1.0, **limits
) -> DataFrame:
    """Category encoded by the target mean of the earlier rows, drawn to the global mean."""
    prior = df.agg(F.avg(target).alias("m")).scalar()
    runs = running_totals(
        df,
        order,
        {"__sum": F.col(target), "__cnt": F.lit(1)},
        [cat],
        inclusive=False,
        **limits,
    )
    value = (F.col("__sum") + prior * F.lit(prior_weight)) / (F.col("__cnt") + F.lit(prior_weight))
    return runs.withColumn(out, value).drop("__sum", "__cnt")


def target_statistics(df: DataFrame, cat: str, target: str, prior_weight: float = 1.0) -> DataFrame:
    """Whole-table statistics per category, for encoding new rows."""
    prior = df.agg(F.avg(target).alias("m")).scalar()
    sums = df.groupBy(F.col(cat).alias("value")).agg(F.sum(target).alias("s"), F.count("*").alias("n"))
    return sums.select(
        "value", ((F.col("s") + prior * F.lit(prior_weight)) / (F.col("n") + F.lit(prior_weight))).alias("stat")
    )


def cut_at_quantile(df: DataFrame, col: Column, share: float, name: str = "part") -> DataFrame:
    """``train`` below the quantile of ``col``, ``valid`` from it on; no global sort.

    A quantile between two values separates them like the upper one, so the cut is a value of
    the column, in its own type.
    """
    keyed = df.withColumn("__cut", col)
    cut = value_at_rank(keyed, "__cut", F.ceil(F.lit(float(share)) * (F.col("rows") - 1))).scalar()
    return keyed.withColumn(name, F.when(F.col("__cut") < cut, "train").otherwise("valid")).drop("__cut")


def tail_split(df: DataFrame, key: str, share: float = 0.2, name: str = "part") -> DataFrame:
    """The last ``floor(share * rows)`` rows by a unique key are ``valid``.

    The boundary is one order statistic of the key, found without sorting the table.
    """
    first = F.col("rows") - F.floor(F.lit(float(share)) * F.col("rows"))
    cut = value_at_rank(df, key, first).scalar()  # null if no row is left for the tail
    return df.withColumn(name, F.when(F.col(key) >= cut, "valid").otherwise("train"))


def stratified_split(
    df: DataFrame, key: str, cls: str, share: float = 0.2, name: str = "part", **limits
) -> DataFrame:
    """``floor(share * size)`` rows of every class, chosen by the hash order of the key."""
    hashed = df.withColumn("__h", F.md5(F.col(key).cast("string")))
    numbered = row_numbers(hashed, ["__h", key], "__rn", [cls], **limits)
    sizes = df.groupBy(F.col(cls).alias("__cls")).agg(F.floor(F.count("*") * F.lit(share)).alias("__take"))
    return (
        numbered.join(sizes, F.col(cls).eqNullSafe(F.col("__cls")))
        .withColumn(name, F.when(F.col("__rn") <= F.col("__take"), "valid").otherwise("train"))
        .drop("__h", "__rn", "__cls", "__take")
    )


def hash_split(df: DataFrame, key: str, percent: int = 80, name: str = "part") -> DataFrame:
    """Random split by a stable hash of the key: same rows in every run, no shuffle."""
    return df.withColumn(name, F.when(S.bucket_of_key(F.col(key)) < percent, "train").otherwise("valid"))


def cumulative_precision(hits: DataFrame, by: str, rank: str, hit: str) -> DataFrame:
    """Precision among the first ranks; a group has at most k rows."""
    w = Window.partitionBy(by).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hits.withColumn("precision", F.sum(hit).over(w) / F.col(rank))
