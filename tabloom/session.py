"""Session helpers: table loading, shared folders and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LISTINGS_PER_CORE = 2


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tabloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="tabloom-")
    sc.setCheckpointDir(base)
    return sc.getCheckpointDir().rsplit("/", 1)[0]


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name below the shared checkpoint folder of the cluster."""
    return f"{_checkpoint_base(spark)}/{purpose}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Write a stage to the shared folder and go on from the table.

    The stage is computed once, outlives any executor, and its measured size lets Spark
    choose the joins that follow.
    """
    path = shared_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Spark lists files by one task per path, up to 10,000; here each task takes many paths.

    A stream lists its folder when it starts, and the files of every batch again, one by one.
    """
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), LISTINGS_PER_CORE * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def one_row(params: DataFrame) -> Column:
    """The single row of a parameter table as a struct-valued scalar subquery.

    The subquery runs once, before the main scan, and its value is a constant inside
    whole-stage codegen, so applying fitted parameters needs no join.
    """
    return params.select(F.struct(*[F.col(f"`{c}`") for c in params.columns]).alias("p")).scalar()
