"""Sinks: CSV, append with resume, JSON, index tables, submissions and metric files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.running import row_numbers


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def first_copies(df: DataFrame, key: str) -> DataFrame:
    """One row per key: the first by load order, that is by partition and position."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"), F.monotonically_increasing_id().alias("at"))
    return packed.groupBy(F.col(f"r.`{key}`").alias("k")).agg(F.min_by("r", "at").alias("r")).select("r.*")


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the target does not hold yet.

    Only the key column of the target is read, and only the row groups within the key range
    of the new rows.
    """
    spark = df.sparkSession
    fresh = first_copies(df, key)
    try:
        target = spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        fresh.write.parquet(path)
        return
    span = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    present = target.filter(F.col(key).between(span["lo"], span["hi"])).select(key)
    fresh.join(present, key, "left_anti").write.mode("append").parquet(path)


def start_from(df: DataFrame, order: str, start: object) -> DataFrame:
    """Resume at a given key: a filter that reaches the scan."""
    return df.filter(F.col(order) >= F.lit(start))


def write_json(df: DataFrame, path: str, pretty: bool = False) -> None:
    """One JSON document per row, unicode kept."""
    options = {"pretty": "true"} if pretty else {}
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), options)
    df.select(record.alias("value")).write.text(path)


def append_index(fresh: DataFrame, weights: Mapping[str, float], path: str, model: str, batch: int = 0) -> None:
    """Add encoded records to an index: vectors with categories and ids, new vocabulary values, counts and model.

    Everything is written under the number of the batch, and replaces what the same batch left before. New
    values get positions behind those of earlier batches, so vectors encoded earlier stay valid. Earlier
    vectors are not read.
    """
    spark = fresh.sparkSession
    entries = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("value")) for c in weights])
    found = fresh.select(F.inline(entries)).filter(F.col("value").isNotNull()).distinct()
    known = _earlier(spark, f"{path}/index_vocab", batch, "col string, value string, idx int, weight double")
    new = row_numbers(found.join(known, ["col", "value"], "left_anti"), ["value"], "n", by=["col"])
    behind = known.groupBy("col").agg((F.max("idx") + 1).alias("behind"))
    weight = F.element_at(F.create_map(*[F.lit(x) for c, w in weights.items() for x in (c, float(w))]), F.col("col"))
    idx = (F.col("n") - 1 + F.coalesce("behind", F.lit(0))).cast("int")
    vocabulary = new.join(behind, "col", "left").select("col", "value", idx.alias("idx"), weight.alias("weight"))
    vocabulary.write.mode("overwrite").parquet(f"{path}/index_vocab/batch={batch}")
    fresh.write.mode("overwrite").parquet(f"{path}/index_vectors/batch={batch}")
    meta = fresh.agg(F.count("*").alias("n_rows"), F.max(F.size("vec")).alias("dim")).withColumn("model", F.lit(model))
    meta.write.mode("overwrite").parquet(f"{path}/index_meta/batch={batch}")


def write_index(index: DataFrame, weights: Mapping[str, float], path: str, model: str) -> None:
    """A new index; :func:`append_index` with later batch numbers adds to it."""
    append_index(index, weights, path, model)


def _earlier(spark: SparkSession, path: str, batch: int, schema: str) -> DataFrame:
    """The rows of the batches before ``batch``."""
    try:
        rows = spark.read.schema(f"{schema}, batch int").option("basePath", path).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.filter(F.col("batch") < batch).drop("batch")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors, vocabulary and the one-row summary of all batches."""
    vectors, vocabulary, meta = (spark.read.parquet(f"{path}/index_{part}") for part in ("vectors", "vocab", "meta"))
    meta = meta.agg(F.sum("n_rows").alias("n_rows"), F.max("dim").alias("dim"), F.max_by("model", "batch").alias("model"))
    return vectors.drop("batch"), vocabulary.drop("batch"), meta


def submission(df: DataFrame, key: str, columns: Sequence[str], default: float = 0.0) -> DataFrame:
    """Id first, then the target columns of the sample in its order; absent ones are constant."""
    return df.select(key, *[F.col(c) if c in df.columns else F.lit(default).alias(c) for c in columns])


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The one-row metrics table as a JSON file."""
    metrics.coalesce(1).write.json(path)
