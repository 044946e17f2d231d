"""Incremental ingest: new records are taken once, whatever is delivered again.

The keys seen so far live in the stream's state store, one small row per key: the key and the time of its
first batch, nothing that grows with paths or rows, as every key of a batch is looked up there. The
target is never read, so the work of a batch follows the batch. The state also holds one row per file, from
which a batch learns its own files; only these are opened for the rows of the keys that came first in it.

Output is written under the number of the batch and replaces what an earlier, failed run of the
same batch left there. State is kept by batch as well, so a batch that runs again adds nothing.

Of equal keys the first row counts: the earliest batch, then file time, path and row. Null keys are one key.
A checkpoint holds this form of the state only; one of an earlier form cannot be continued.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.session import shared_path
from tabloom.sources import sinks

STATE = "spark.sql.streaming.stateStore."
# Counting the keys in the store would look up every key once more when it is written.
SETTINGS = {
    f"{STATE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STATE}rocksdb.trackTotalNumberOfRows": "false",
}
SHUFFLE = "spark.sql.shuffle.partitions"
STORES_PER_CORE = 2
_ROW_BITS = 40


@contextmanager
def settings(spark: SparkSession, wanted: Mapping[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def first_seen(stream: DataFrame, key: str) -> DataFrame:
    """The keys and the files (as ``file``, with a null key) that the stream brings for the first time, per batch."""
    path, written = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("written")
    file = F.struct(written, path)
    row = F.struct(F.col(f"`{key}`").alias("key"), F.lit(None).cast("struct<written: timestamp, path: string>").alias("file"))
    mark = F.struct(F.lit(None).cast(stream.schema[key].dataType).alias("key"), file.alias("file"))
    both = F.when(F.col("_metadata.row_index") == 0, F.array(row, mark)).otherwise(F.array(row))
    seen = stream.select(F.inline(both), F.current_timestamp().alias("at"))
    return seen.groupBy("key", "file").agg(F.min("at").alias("first")).filter(F.col("first") == F.current_timestamp())


def new_rows(spark: SparkSession, seen: DataFrame, schema: T.StructType, key: str) -> DataFrame | None:
    """The first rows of the keys that came first in this batch; None if there are none.

    The session of a batch with state plans without measured sizes and cannot rebalance, so all that
    follows the state update runs in the caller's session.
    """
    # Written once: a second evaluation would run the state update again.
    path = shared_path(spark, "new-keys")
    seen.select("key", "file").write.parquet(path)
    seen = spark.read.schema(seen.select("key", "file").schema).parquet(path)
    # At most the files of one batch, in the order in which their rows count.
    files = [r["path"] for r in seen.filter("file is not null").select("file.*").sort("written", "path").collect()]
    if not files:
        return None
    numbers = spark.createDataFrame(list(enumerate(files)), "__file int, __path string")
    rows = spark.read.schema(schema).parquet(*map(unquote, files))
    rows = rows.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row"))
    place = F.shiftleft(F.col("__file").cast("bigint"), _ROW_BITS) + F.col("__row")
    rows = rows.join(F.broadcast(numbers), "__path").withColumn("__place", place).drop("__path", "__file", "__row")
    # Copies collapse before the shuffle. As a struct, the null key equals itself.
    firsts = rows.groupBy(F.struct(F.col(f"`{key}`").alias("key")).alias("k")).agg(F.min("__place").alias("__place"))
    fresh = seen.filter("file is null").select(F.struct("key").alias("k"))
    places = firsts.join(fresh, "k", "left_semi").select("__place")
    return rows.join(places, "__place", "left_semi").select(*[F.col(f"`{c}`") for c in schema.names])


def run_batches(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    checkpoint: str,
    key: str,
    take: Callable[[DataFrame, int], None],
    files_per_batch: int = 1000,
) -> None:
    """Give the new rows of every batch, with its number, to ``take``, then stop.

    ``take`` may see a batch again after a failure and must replace what it wrote for that number.
    """

    def batch(seen: DataFrame, number: int) -> None:
        rows = new_rows(spark, seen, schema, key)
        if rows is not None:
            take(rows, number)

    # Each store costs the same in every batch, however few its keys; a checkpoint keeps their number.
    stores = min(int(spark.conf.get(SHUFFLE)), STORES_PER_CORE * spark.sparkContext.defaultParallelism)
    # The stream takes a copy of the settings when it starts.
    with settings(spark, SETTINGS | {SHUFFLE: str(stores)}):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        query = (
            first_seen(stream, key)
            .writeStream.outputMode("update")
            .foreachBatch(batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()


def write_days(rows: DataFrame, number: int, target: str, day: str) -> None:
    """The rows of a batch below ``target``, by batch and day; large days are split over tasks."""
    dated = rows.withColumn("day", F.date_format(day, "yyyy-MM-dd"))
    dated.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{target}/batch={number}")


def ingest(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    key: str,
    day: str,
    files_per_batch: int = 1000,
) -> None:
    """Take in all files that arrived since the last run, then stop; ``target`` gets the columns batch and day."""
    run_batches(spark, source, schema, checkpoint, key, lambda rows, n: write_days(rows, n, target, day), files_per_batch)


def ingest_index(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    index: str,
    checkpoint: str,
    key: str,
    day: str,
    weights: Mapping[str, float],
    model: str,
    encode: Callable[[DataFrame], DataFrame],
    files_per_batch: int = 1000,
) -> None:
    """One job from delivered files to records and index: new records are stored, encoded and appended."""

    def take(rows: DataFrame, number: int) -> None:
        write_days(rows, number, target, day)
        stored = spark.read.parquet(f"{target}/batch={number}").drop("day")
        sinks.append_index(encode(stored), weights, index, model, number)

    run_batches(spark, source, schema, checkpoint, key, take, files_per_batch)
