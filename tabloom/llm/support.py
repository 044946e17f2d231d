"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.session import shared_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LETTERS_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def query(name: str, sql: str | None = None):
    """Register a corpus query, with its reference SQL where SQL can state it."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def stage_table(df: DataFrame, purpose: str) -> DataFrame:
    """Write a stage below the shared checkpoint folder and continue from the files."""
    path = shared_path(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, LETTERS_UP, LETTERS_UP.lower())


def text_of(c: str | Column) -> Column:
    """A null text counts as the empty one."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; a null id is hashed as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def crc32_sql(text: str) -> str:
    """DuckDB expression of the unsigned crc32 of a text's UTF-8 bytes, four bits at a time."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(f"{c}::BIGINT")
    nibble = f"instr('0123456789ABCDEF', substr(hex({text}), i + 2 - 2 * (i % 2), 1)) - 1"
    nibbles = f"list_transform(range(2 * octet_length(encode({text}))), lambda i: {nibble})"
    step = f"xor(c >> 4, [{', '.join(table)}][1 + (xor(c, b) & 15)])"
    return f"xor(4294967295, list_reduce({nibbles}, lambda c, b: {step}, 4294967295::BIGINT))"


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
