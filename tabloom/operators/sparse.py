"""Sparse vectors over vocabularies of any size.

A vocabulary is a table (column, value, idx): the sorted distinct values of some columns, numbered from 0,
column after column. Values are found by joins with it, so neither a task nor the driver ever holds a
vocabulary, and a row holds its own entries only: a vector is a struct of its size and of the indices
and values that are not zero. Sizes are single numbers. Spark measures the vocabulary and broadcasts
it if it is small; otherwise both sides are shuffled and frequent values are split by the adaptive join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import vectors as V
from tabloom.operators.running import row_numbers


def vocabularies(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, idx) of the distinct non-null values; numbers sort as numbers, the rest as text."""
    numeric = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema.fields}
    entries = [
        F.struct(
            F.lit(i).alias("__place"),
            F.lit(c).alias("column"),
            F.col(f"`{c}`").cast("string").alias("value"),
            (F.col(f"`{c}`").cast("double") if numeric[c] else F.lit(0.0)).alias("__number"),
        )
        for i, c in enumerate(cols)
    ]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").filter(F.col("value").isNotNull()).distinct()
    ranked = row_numbers(long, ["__place", "__number", "value"], "idx")
    return ranked.select("column", "value", (F.col("idx") - 1).cast("int").alias("idx"))


def size_of(vocabulary: DataFrame) -> Column:
    """Number of values, as a constant."""
    return vocabulary.agg(F.count("*").cast("int")).scalar()


def vector(size: Column, indices: Column, values: Column) -> Column:
    return F.struct(size.cast("int").alias("size"), indices.alias("indices"), values.alias("values"))


def category_blocks(df: DataFrame, vocabulary: DataFrame, weights: Mapping[str, float], out: str) -> DataFrame:
    """One weighted one-hot block per column side by side, as one vector; unknown and null values have no entry."""
    entries = []
    df = df.withColumn("__size", size_of(vocabulary))
    for i, (c, weight) in enumerate(weights.items()):
        known = vocabulary.filter(F.col("column") == c).select(F.col("value").alias(f"__v{i}"), F.col("idx").alias(f"__i{i}"))
        df = df.join(known, F.col(f"`{c}`").cast("string") == F.col(f"__v{i}"), "left")
        entry = F.struct(F.col(f"__i{i}").alias("i"), F.lit(float(weight)).alias("v"))
        entries.append(F.when(F.col(f"__i{i}").isNotNull(), entry))
    present = F.filter(F.array(*entries), lambda e: e.isNotNull())
    blocks = vector(F.col("__size"), F.transform(present, lambda e: e["i"]), F.transform(present, lambda e: e["v"]))
    helpers = [f"__{p}{i}" for i in range(len(weights)) for p in "vi"]
    return df.withColumn(out, blocks).drop("__size", *helpers)


def label_sets(df: DataFrame, labels: str, vocabulary: DataFrame, out: str, key: str | None = None) -> DataFrame:
    """The rows with ``out``, a vector of ones at the labels of a list column; unknown labels have no entry.

    ``vocabulary`` comes from :func:`label_vocabulary`. With ``key`` (unique) only key and ``out`` are returned, and only the key travels.
    """
    keep = F.struct(F.col(f"`{key}`")) if key else F.struct(*[F.col(f"`{c}`") for c in df.columns])
    row = F.col(f"`{key}`") if key else F.monotonically_increasing_id()
    known = vocabulary.select(F.col("value").alias("__value"), F.col("idx").alias("__idx"))
    # The number is given before the list is taken apart: a row's labels share it.
    rows = df.select(row.alias("__row"), keep.alias("__keep"), F.array_distinct(F.col(labels)).alias("__labels"))
    long = rows.select("__row", "__keep", F.explode_outer("__labels").alias("__label"))
    coded = long.join(known, F.col("__label").cast("string") == F.col("__value"), "left")
    sets = coded.groupBy("__row").agg(F.first("__keep").alias("__keep"), F.sort_array(F.collect_list("__idx")).alias("__at"))
    ones = F.transform(F.col("__at"), lambda i: F.lit(1.0))
    return sets.select("__keep.*", vector(size_of(vocabulary), F.col("__at"), ones).alias(out))


def labels_of(df: DataFrame, vector_col: str, vocabulary: DataFrame, out: str, key: str) -> DataFrame:
    """key and the labels of a vector of ones, in the order of the vocabulary: the way back."""
    known = vocabulary.select(F.col("value").alias("__value"), F.col("idx").alias("__idx"))
    long = df.select(F.col(f"`{key}`"), F.explode_outer(F.col(vector_col)["indices"]).alias("__at"))
    named = long.join(known, F.col("__at") == F.col("__idx"), "left")
    found = F.sort_array(F.collect_list(F.when(F.col("__value").isNotNull(), F.struct("__at", "__value"))))
    return named.groupBy(f"`{key}`").agg(F.transform(found, lambda x: x["__value"]).alias(out))


def label_vocabulary(df: DataFrame, labels: str) -> DataFrame:
    """(column, value, idx) of the entries of a list column."""
    return vocabularies(df.select(F.explode(labels).alias("label")), ["label"])


def value_at(v: Column, at: Column) -> Column:
    """The entry of a vector, 0 where it has none."""
    place = F.array_position(v["indices"], at)
    return F.when(place > 0, F.element_at(v["values"], place.cast("int"))).otherwise(F.lit(0.0))


def product(a: Column, b: Column) -> Column:
    """Inner product; work follows the entries of both, not the sizes."""
    terms = F.zip_with(a["indices"], a["values"], lambda i, x: x * value_at(b, i))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return V.norm(v["values"])


def scaled(v: Column, factor: Column) -> Column:
    return vector(v["size"], v["indices"], F.transform(v["values"], lambda x: x * factor))


def hybrid(text: Column, blocks: Column, text_weight: float = 1.0) -> Column:
    """Struct of the weighted unit text vector and the sparse blocks behind it, of length one together."""
    weighted = F.transform(V.unit(V.as_double(text)), lambda x: x * F.lit(float(text_weight)))

    def divided(parts: Column) -> Column:
        length = F.sqrt(F.pow(V.norm(parts["text"]), F.lit(2.0)) + F.pow(norm(parts["blocks"]), F.lit(2.0)))
        return V.let(
            F.coalesce(F.try_divide(F.lit(1.0), length), F.lit(1.0)),
            lambda f: F.struct(
                F.transform(parts["text"], lambda x: x * f).alias("text"), scaled(parts["blocks"], f).alias("blocks")
            ),
        )

    return V.let(F.struct(weighted.alias("text"), blocks.alias("blocks")), divided)


def hybrid_product(a: Column, b: Column) -> Column:
    return V.dot(a["text"], b["text"]) + product(a["blocks"], b["blocks"])


def dense(v: Column) -> Column:
    """All elements; for output that asks for every position."""
    places = F.when(v["size"] > 0, F.sequence(F.lit(0), v["size"] - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: value_at(v, i))
