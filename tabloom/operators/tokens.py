"""Text to integer sequences with a frequency vocabulary."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.running import row_numbers
from tabloom.session import cut_lineage

# Executors need not have this package installed: what runs in tasks travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Characters removed before splitting, vocabulary size and sequence length.
PUNCTUATION = r"""[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~']"""
MAX_TOKENS = 10_000
SEQUENCE_LENGTH = 100
PAD, UNKNOWN_TOKEN, FIRST_TOKEN = 0, 1, 2


def tokens(text: Column, at_most: int = 0) -> Column:
    """Lower case, punctuation removed, split on white space.

    With ``at_most`` the split stops after so many tokens.
    """
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), PUNCTUATION, ""))
    if not at_most:
        return F.array_remove(F.split(plain, r"\s+"), "")
    # One more element holds the rest of the text, and one may be empty at the start.
    return F.slice(F.array_remove(F.split(plain, r"\s+", at_most + 2), ""), 1, at_most)


def token_vocabulary(df: DataFrame, text: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """The most frequent tokens of the whole texts; the two first places are pad and unknown.

    Counts are combined per task before the shuffle and the cut is a top-k, so no task sorts
    the full vocabulary.
    """
    counts = df.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").count()
    top = counts.orderBy(F.desc("count"), F.asc("token")).limit(max_tokens - FIRST_TOKEN)
    ranked = row_numbers(top.withColumn("__neg", -F.col("count")), ["__neg", "token"], "rank")
    vocabulary = ranked.select("token", (F.col("rank") + FIRST_TOKEN - 1).cast("int").alias("idx"), "count")
    # Written once: encoding a table must not count the training texts again.
    return cut_lineage(vocabulary, "vocabulary")


def _encoder(vocabulary: pa.Table, length: int):
    known = vocabulary["token"].combine_chunks()
    index = np.append(vocabulary["idx"].to_numpy().astype(np.int32), np.int32(UNKNOWN_TOKEN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pc.index_in(batch.column(1).flatten(), value_set=known).fill_null(len(known)).to_numpy()
            sizes = pc.list_value_length(batch.column(1)).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out = np.full((batch.num_rows, length), PAD, dtype=np.int32)
            out[row, place] = index[found]
            offsets = pa.array(np.arange(0, batch.num_rows * length + 1, length, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], batch.schema.names)

    return run


def encode_sequences(
    df: DataFrame, key: str, text: str, vocabulary: DataFrame, length: int = SEQUENCE_LENGTH
) -> DataFrame:
    """``(key, sequence)``: the first ``length`` token indexes, padded with 0.

    The vocabulary is at most MAX_TOKENS rows, so every task holds it and looks a document's tokens up inside
    its row: nothing is shuffled.
    """
    held = vocabulary.select("token", "idx").orderBy("idx").limit(MAX_TOKENS).toArrow()
    rows = df.select(key, tokens(F.col(text), length).alias("sequence"))
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(_encoder(held, length), f"`{key}` {kind}, sequence array<int>")
