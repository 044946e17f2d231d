"""Whole profiles of many files as one JSON document per problem, built bottom-up under a size budget.

The long profile tables (columns, shapes, target entries) are reduced level by level with ``by`` as their key:
runs of columns where a file is wide, numbered classes as ranges, the largest other classes and a count of
the rest, target names as ranges and literals; then nested into one entry per file and one document per
problem. A problem's files, and a file's columns, are few by nature; classes may be many and are cut by a
top-k per target before they meet.

A file's entry is full as long as the full entries up to it and the brief ones behind it fit the
budget, else brief (name, shape, targets).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators import profile

BUDGET = 100_000
NUMBER = "decimal(18,4)"


def target_names(names: DataFrame, by: Sequence[str], col: str = "name") -> DataFrame:
    """Per key the numbered names as ranges and the literal ones, side by side."""
    numbered = F.col(col).rlike(profile.S.NUMBERED_NAME) & profile.S.name_number(F.col(col)).isNotNull()
    ranges = profile.numbered_name_ranges(names.filter(numbered), col, by)
    ranges = ranges.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("prefix", F.col("min_index").alias("min"), F.col("max_index").alias("max"), "count"))).alias("ranges")
    )
    literal = names.filter(~F.coalesce(numbered, F.lit(False))).groupBy(*by).agg(F.sort_array(F.collect_set(col)).alias("names"))
    return ranges.join(literal, list(by), "full")


def class_entries(summary: DataFrame, by: Sequence[str], limit: int = profile.MAX_CLASSES) -> DataFrame:
    """Per key and target the list of (class, value): ranges of numbered classes, the largest others, the count of the rest."""
    keys = [*by, "target"]
    is_run = F.col("entry").rlike(profile.CLASS_RUN)
    ranges = profile.class_run_ranges(summary.filter(is_run), "entry", keys)
    ranges = ranges.select(*keys, F.lit(0).alias("part"), F.col("class").alias("at"), F.lit(None).cast("double").alias("neg"), "class",
                           F.lit(None).cast("double").alias("value"))
    others = summary.filter(~F.coalesce(is_run, F.lit(False)))
    order = Window.partitionBy(*keys).orderBy(F.desc("value"), F.asc("entry"))
    top = others.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= limit)
    top = top.select(*keys, F.lit(1).alias("part"), F.lit("").alias("at"), F.col("__n").cast("double").alias("neg"), F.col("entry").alias("class"), "value")
    rest = others.groupBy(*keys).agg((F.count("*") - limit).alias("more")).filter("more > 0")
    rest = rest.select(*keys, F.lit(2).alias("part"), F.lit("").alias("at"), F.lit(None).cast("double").alias("neg"),
                       F.format_string("... +%d more", "more").alias("class"), F.lit(None).cast("double").alias("value"))
    entries = ranges.unionByName(top).unionByName(rest)
    packed = F.sort_array(F.collect_list(F.struct("part", "neg", "at", "class", F.col("value").cast(NUMBER).alias("value"))))
    listed = entries.groupBy(*keys).agg(packed.alias("c"))
    return listed.select(*keys, F.transform("c", lambda x: F.struct(x["class"].alias("class"), x["value"].alias("value"))).alias("classes"))


def schema_entries(schema: DataFrame, by: Sequence[str], limit: int = profile.MAX_FEATURES) -> DataFrame:
    """Per key the list of columns; runs are merged in files of more than ``limit`` columns."""
    width = F.count("*").over(Window.partitionBy(*by))
    gated = schema.withColumn("__width", width)
    plain = gated.filter(F.col("__width") <= limit).select(*by, (F.col("position") + 1).cast("bigint").alias("run"), "name", "type", "missing_pct", "is_target")
    merged = profile.collapse_runs(gated.filter(F.col("__width") > limit).drop("__width"), by).select(*plain.columns)
    entry = F.struct("name", "type", F.col("missing_pct").cast(NUMBER).alias("missing_pct"), "is_target")
    packed = F.sort_array(F.collect_list(F.struct("run", entry.alias("entry"))))
    listed = plain.unionByName(merged).groupBy(*by).agg(packed.alias("s"))
    return listed.select(*by, F.transform("s", lambda x: x["entry"]).alias("dataset_schema"))


def _listed(c: str, kind: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(kind))


def documents(
    schema: DataFrame, shapes: DataFrame, summary: DataFrame, by: Sequence[str] = ("problem",), budget: int = BUDGET,
    max_features: int = profile.MAX_FEATURES, max_classes: int = profile.MAX_CLASSES,
) -> DataFrame:
    """One JSON document per key of ``by``, with the number of files in full.

    ``schema`` has position, name, type, missing_pct and is_target per file; ``shapes`` n_rows and n_cols;
    ``summary`` target, entry and value. All have the columns of ``by`` and file.
    """
    by = list(by)
    keys = [*by, "file"]
    names = target_names(schema.filter("is_target"), keys)
    classes = class_entries(summary, keys, max_classes)
    targets = classes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("target", "classes"))).alias("target_summary"))
    joined = shapes.join(schema_entries(schema, keys, max_features), keys, "left").join(targets, keys, "left").join(names, keys, "left")
    shape = F.struct(F.col("n_rows").alias("rows"), F.col("n_cols").alias("cols")).alias("shape")
    ranges = _listed("ranges", "array<struct<prefix:string,min:bigint,max:bigint,count:bigint>>").alias("ranges")
    wanted = F.struct(ranges, _listed("names", "array<string>").alias("names")).alias("targets")
    number = NUMBER
    columns = _listed("dataset_schema", f"array<struct<name:string,type:string,missing_pct:{number},is_target:boolean>>").alias("dataset_schema")
    summaries = _listed("target_summary", f"array<struct<target:string,classes:array<struct<class:string,value:{number}>>>>").alias("target_summary")
    file = F.col("file").alias("file_name")
    both = joined.select(
        *keys, F.to_json(F.struct(file, shape, columns, summaries, wanted)).alias("full"), F.to_json(F.struct(file, shape, wanted)).alias("brief")
    )
    # Files of one problem, in name order.
    order = Window.partitionBy(*by).orderBy("file")
    upto = F.sum(F.length("full")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    behind = F.coalesce(F.sum(F.length("brief")).over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    chosen = both.withColumn("fits", upto + behind <= budget)
    entry = F.struct("file", F.when(F.col("fits"), F.col("full")).otherwise(F.col("brief")).alias("entry"))
    found = chosen.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("f"), F.count_if("fits").alias("n_full"))
    text = F.concat(F.lit('{"files":['), F.array_join(F.transform("f", lambda x: x["entry"]), ","), F.lit("]}"))
    return found.select(*by, text.alias("document"), "n_full")
