"""Exact duplicates by an extendible-hash index on shared files.

1. ``collapse``: each Arrow batch keeps the text of one carrier row (largest id) per distinct
   text and points the other rows at it, so a group of copies that holds a third of all rows
   sends one text per batch. The result is written once below the shared folder.
2. ``grow_directory``: the directory starts with one bucket. A bucket with more text than its
   capacity splits on the next bit of the hash; when its depth equals the directory's, the
   directory doubles. At MAX_DEPTH a bucket is no longer split; it only grows, which is exact.
3. Owner tasks get whole buckets, ranges of the hash, sorted by hash. Within a hash they keep a
   chain of the different texts met and compare bytes; colliding hashes never merge texts.

A task holds one batch and the chain of one hash. The driver holds at most 2**MAX_DEPTH loads.

Defined results: a null text equals the empty one. The row with the largest id of a group
stays (null ids are smaller than all others); of rows with equal id and text one stays. An empty
table gives no rows. Other columns are carried through ``kept_rows`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.support import load, query, stage_table, text_of

#: Text bytes of different rows that a bucket takes before it splits.
BUCKET_BYTES = 8 << 20
MAX_DEPTH = 16


def _collapse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        text = batch.column("__text")
        group = text.dictionary_encode().indices.to_numpy()
        ids = batch.column("__id")
        known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
        value = pc.fill_null(ids, 0).to_numpy()
        order = np.lexsort((value, known, group))
        last = np.append(group[order][1:] != group[order][:-1], True)
        carrier_of = np.empty(group.max() + 1, dtype=np.int64)
        carrier_of[group[order][last]] = order[last]
        rows = batch.column("__row").to_numpy()
        carrier = carrier_of[group]
        own = carrier == np.arange(batch.num_rows)
        columns = {name: batch.column(name) for name in batch.schema.names}
        columns["__text"] = pc.if_else(pa.array(own), text, pa.scalar(None, text.type))
        columns["__carrier"] = pa.array(rows[carrier])
        yield pa.RecordBatch.from_pydict(columns)


def _nullable(fields: list[T.StructField]) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])


def collapse(df: DataFrame, id_col: str, text_col: str, hash_of=F.xxhash64) -> DataFrame:
    """One row per input row, with the text only on carriers; columns start with ``__``.

    The other columns travel in ``__rest`` as one struct, so their names cannot clash.
    """
    text = text_of(text_col)
    rest = [c for c in df.columns if c != text_col]
    slim = df.select(
        F.col(id_col).cast("bigint").alias("__id"),
        text.alias("__text"),
        F.col(text_col).isNull().alias("__null"),
        hash_of(text).cast("bigint").alias("__hash"),
        F.sha2(text, 256).alias("__sha"),
        F.octet_length(text).cast("bigint").alias("__bytes"),
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__rest"),
        F.monotonically_increasing_id().alias("__row"),
    )
    schema = _nullable([*slim.schema.fields, T.StructField("__carrier", T.LongType())])
    return stage_table(slim.mapInArrow(_collapse_batches, schema), "dedup-rows")


def grow_directory(loads: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and local depth of every directory entry, for loads at MAX_DEPTH leading bits."""
    finest = len(loads).bit_length() - 1
    below = np.concatenate([[0], np.cumsum(loads)])
    directory, depth_of, global_depth = np.array([0]), [0], 0
    open_buckets = [(0, 0, 0)]  # bucket, prefix, depth
    while open_buckets:
        bucket, prefix, depth = open_buckets.pop()
        width = 1 << (finest - depth)
        if below[(prefix + 1) * width] - below[prefix * width] <= capacity or depth == finest:
            continue
        if depth == global_depth:
            directory, global_depth = np.repeat(directory, 2), global_depth + 1
        new, span = len(depth_of), 1 << (global_depth - depth - 1)
        depth_of[bucket] = depth + 1
        depth_of.append(depth + 1)
        directory[(2 * prefix + 1) * span : (2 * prefix + 2) * span] = new
        open_buckets += [(bucket, 2 * prefix, depth + 1), (new, 2 * prefix + 1, depth + 1)]
    return directory, np.array(depth_of)[directory]


def _leading(bits: int, hash_col: str = "__hash") -> Column:
    return F.lit(0) if bits == 0 else F.shiftrightunsigned(hash_col, 64 - bits).cast("int")


def build_directory(rows: DataFrame, capacity: int) -> DataFrame:
    """The directory as a table: prefix, bucket, depth. It has at most 2**MAX_DEPTH entries."""
    carriers = rows.filter("__row = __carrier")
    found = carriers.groupBy(_leading(MAX_DEPTH).alias("p")).agg(F.sum("__bytes").alias("n")).toPandas()
    loads = np.zeros(1 << MAX_DEPTH, dtype=np.int64)
    loads[found["p"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    directory, depth = grow_directory(loads, capacity)
    pairs = list(zip(range(len(directory)), directory.tolist(), depth.tolist(), strict=True))
    return rows.sparkSession.createDataFrame(pairs, "prefix int, bucket int, depth int")


class _Chain:
    """The different texts of the hash at hand, first (largest) id first."""

    def __init__(self):
        self.hash, self.texts, self.heads = None, [], []

    def place(self, hash_: int, text, row: int, id_) -> tuple[int, int | None]:
        if hash_ != self.hash:
            self.hash, self.texts, self.heads = hash_, [], []
        for known, head in zip(self.texts, self.heads, strict=True):
            if known.equals(text):
                return head
        self.texts.append(text)
        self.heads.append((row, id_))
        return self.heads[-1]


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    chain = _Chain()
    for batch in batches:
        text, ids = batch.column("__text").cast(pa.large_binary()), batch.column("__id").to_pylist()
        hashes, rows = batch.column("__hash").to_pylist(), batch.column("__row").to_pylist()
        yield batch, [chain.place(h, text[i].as_buffer(), rows[i], ids[i]) for i, h in enumerate(hashes)]


def _owner_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, heads in _owners(batches):
        yield pa.RecordBatch.from_pydict(
            {
                "__carrier": batch.column("__row"),
                "__head": pa.array([h for h, _ in heads], pa.int64()),
                "keep_id": pa.array([i for _, i in heads], pa.int64()),
            }
        )


def _owner_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, heads in _owners(batches):
        own = [h == r for (h, _), r in zip(heads, batch.column("__row").to_pylist(), strict=True)]
        kept = batch.filter(pa.array(own))
        yield kept.select(["__text", "__null", "__rest"])


def _dealt(rows: DataFrame, capacity: int) -> DataFrame:
    """Carriers at their owners: whole buckets per task, in hash order, largest id first."""
    directory = build_directory(rows, capacity)
    size = directory.count()
    carriers = rows.filter("__row = __carrier").withColumn("prefix", _leading(size.bit_length() - 1))
    located = carriers.join(F.broadcast(directory), "prefix")
    return located.repartition("bucket").sortWithinPartitions("bucket", "__hash", F.col("__id").desc_nulls_last(), "__row")


def duplicate_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_BYTES, hash_of=F.xxhash64
) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    rows = collapse(df, id_col, text_col, hash_of)
    index = stage_table(
        _dealt(rows, capacity)
        .select("__row", "__id", "__hash", "__text")
        .mapInArrow(_owner_links, "__carrier bigint, __head bigint, keep_id bigint"),
        "dedup-index",
    )
    carried = rows.groupBy("__carrier").agg(F.count("*").alias("n"))
    sizes = index.join(carried, "__carrier").groupBy("__head").agg(F.sum("n").alias("group_size"))
    resolved = index.join(sizes, "__head")
    return rows.select("__id", "__sha", "__row", "__carrier").join(resolved, "__carrier").select(
        F.col("__id").alias("doc_id"), "keep_id", "group_size",
        (F.col("__row") == F.col("__head")).alias("kept"), F.col("__sha").alias("text_sha256"),
    )


def kept_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_BYTES) -> DataFrame:
    """The rows that stay, with the columns of the input; owners emit them, so no join follows."""
    rows = collapse(df, id_col, text_col)
    dealt = _dealt(rows, capacity).select("__row", "__id", "__hash", "__text", "__null", "__rest")
    schema = _nullable([f for f in dealt.schema.fields if f.name in ("__text", "__null", "__rest")])
    heads = dealt.mapInArrow(_owner_heads, schema)
    text = F.when(~F.col("__null"), F.col("__text")).alias(text_col)
    return heads.select(*[text if c == text_col else F.col(f"__rest.`{c}`").alias(c) for c in df.columns])


_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
"""


@query("op9_exact_dedup", _SQL)
def op9_exact_dedup(spark, sf_dir):
    return duplicate_groups(load(spark, sf_dir, "documents"))
