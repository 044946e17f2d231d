"""Running totals and row numbers over a global or hot order.

A window without partition keys, or with one key that holds a third of the rows, puts its
rows into one task. So the table is range-partitioned by the order into a fixed number of
blocks and written once, so that every later step sees the same blocks. A window then
runs inside each (key, block), and the totals of the earlier blocks, a small table of at most one
row per key and block, are added by an equi-join on the same keys. There is one path for all sizes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.session import cut_lineage


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    inclusive: bool = True,
    blocks: int | None = None,
) -> DataFrame:
    """Add one running sum per entry of ``sums`` along ``order`` within ``by``.

    ``order`` must identify a row within ``by``. With ``inclusive=False`` the sum covers the
    earlier rows only and is 0 for the first one. ``blocks`` is the number of range partitions,
    by default ``spark.sql.shuffle.partitions``.
    """
    order, by = list(order), list(by)
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = Window.currentRow if inclusive else -1
    zero = F.lit(0)

    # Keys follow the order in the range, so equal order values of many keys are split as well.
    df = df.withColumns({f"__v_{n}": e for n, e in sums.items()})
    ranged = df.repartitionByRange(blocks, *order, *by).withColumn("__block", F.spark_partition_id())
    df = cut_lineage(ranged, "blocks")
    totals = df.groupBy(*by, "__block").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    earlier = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in by],
        F.col("__block").alias("__b"),
        *[F.coalesce(F.sum(f"__t_{n}").over(earlier), zero).alias(f"__o_{n}") for n in sums],
    )
    inner = Window.partitionBy(*by, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    local = df.withColumns({f"__l_{n}": F.coalesce(F.sum(f"__v_{n}").over(inner), zero) for n in sums})
    match = F.col("__block") == F.col("__b")
    for k in by:
        match = match & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = local.join(offsets, match).withColumns({n: F.col(f"__l_{n}") + F.col(f"__o_{n}") for n in sums})
    return out.drop(
        "__block", "__b", *[f"__k_{k}" for k in by], *[f"__{x}_{n}" for n in sums for x in "vlo"]
    )


def row_numbers(df: DataFrame, order: Sequence[str], name: str, by: Sequence[str] = (), **limits) -> DataFrame:
    """Row number from 1 along ``order`` within ``by``."""
    return running_totals(df, order, {name: F.lit(1).cast("bigint")}, by, **limits)
