"""Delimited files: dialect detection, tolerant scans, header probes and file routing."""

from __future__ import annotations

import codecs
import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.session import cut_lineage

# Candidate separators, sample size, and the texts read as missing.
SEPARATORS = [",", "\t", ";"]
SAMPLE_CHARS = 2048
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
CORRUPT = "_corrupt_record"


def sniff_separator(sample: str, path: str) -> str:
    try:
        return csv.Sniffer().sniff(sample, delimiters="".join(SEPARATORS)).delimiter
    except csv.Error:
        return "\t" if path.lower().endswith(".tsv") else ","


def sniff_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless some line is not valid UTF-8; one narrow pass, no Python."""
    bad = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1).count()
    return "ISO-8859-1" if bad else "UTF-8"


def first_lines(spark: SparkSession, path: str, n: int, encoding: str = "UTF-8") -> list[str]:
    """The first lines of the first file, from a limit that stops after one partition."""
    raw = spark.read.text(path).select(F.decode(F.col("value").cast("binary"), encoding).alias("v"))
    return [r["v"] for r in raw.limit(n).collect()]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Filled lines as bytes with their file, the start of their block and a number that grows along each block."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").cast("binary").alias("line"),
        F.is_valid_utf8("value").alias("valid"),
    )
    return raw.filter(F.length(F.trim(F.decode("line", "ISO-8859-1"))) > 0)


def _files(lines: DataFrame) -> DataFrame:
    """(of, first, valid): per file the number of its first line, and whether all its lines are UTF-8.

    Only the narrow columns of the written lines are read.
    """
    found = lines.groupBy(F.col("file").alias("of")).agg(F.min(F.struct("block", "at")).alias("f"), F.bool_and("valid").alias("valid"))
    return found.select("of", F.col("f.at").alias("first"), "valid")


def _text(line: Column, valid: Column) -> Column:
    return F.when(valid, F.decode(line, "UTF-8")).otherwise(F.decode(line, "ISO-8859-1"))


def _literal_pattern(sep: str) -> str:
    return "\\t" if sep == "\t" else f"[{sep}]"


def _type_tests(v: Column) -> list[Column]:
    """Aggregates of a text column: whether cells are missing, and whether all filled ones are int, float or boolean."""

    def every(test: Column) -> Column:
        return F.coalesce(F.bool_and(F.when(v.isNotNull(), test)), F.lit(False))

    return [
        F.count(v) == F.count("*"),
        every(v.rlike(r"^\s*[+-]?\d+\s*$") & F.trim(v).try_cast("bigint").isNotNull()),
        every(v.try_cast("double").isNotNull()),
        every(v.isin("True", "False", "TRUE", "FALSE", "true", "false")),
    ]


def _kind(full: bool, whole: bool, number: bool, boolean: bool) -> str:
    """An integer column with missing cells becomes float."""
    if whole and full:
        return "bigint"
    if whole or number:
        return "double"
    return "boolean" if boolean and full else "string"


def _typed(v: Column, kind: str) -> Column:
    return F.trim(v).cast(kind) if kind != "string" else v


def _scanned(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], list[str]]:
    """(table, names, kinds) of a headed file whose quotes are ordinary characters.

    The file is read once: its lines are written below the shared folder, and one aggregate over them takes
    the type tests of every column together with the encoding test. Types follow from ASCII, whatever
    the encoding. A folder's files have one header and are of one dialect.
    """
    head = [x for x in first_lines(spark, path, 40, "ISO-8859-1") if x.strip()]
    bom = codecs.BOM_UTF8.decode("latin-1")
    sep = sniff_separator("\n".join(head).removeprefix(bom)[:SAMPLE_CHARS], path)
    width = len(head[0].removeprefix(bom).split(sep))
    lines = cut_lineage(_lines(spark, path), "lines")
    files = cut_lineage(_files(lines), "files")
    rows = lines.join(files.select("first"), F.col("at") == F.col("first"), "left_anti")

    def fields(text: Column) -> DataFrame:
        return rows.select("valid", F.split(text, _literal_pattern(sep), -1).alias("f"))

    cells = [F.get("f", F.lit(i)) for i in range(width)]
    cells = [F.when(~c.isin(MISSING), c) for c in cells]
    kept = F.size("f") <= width
    tests = [F.array(*_type_tests(c)).alias(f"c{i}") for i, c in enumerate(cells)]
    found = fields(F.decode("line", "ISO-8859-1")).filter(kept).agg(*tests).first()
    utf8 = files.agg(F.bool_and("valid")).first()[0]
    encoding = "ISO-8859-1" if utf8 is False else "UTF-8"
    kinds = [_kind(*found[f"c{i}"]) for i in range(width)]
    names = head[0].encode("latin-1").decode(encoding, "replace").lstrip("\ufeff").removeprefix(bom).split(sep)
    table = fields(F.decode("line", encoding)).filter(kept).select(*[c.alias(n) for c, n in zip(cells, names, strict=True)])
    return table, names, kinds


def read_unquoted(spark: SparkSession, path: str) -> DataFrame:
    """Dialect-detecting scan of a headed file, every column as text.

    Quotes are ordinary characters. Short rows are padded with null and rows with more fields than the
    header are skipped.
    """
    return _scanned(spark, path)[0]


def read_typed(spark: SparkSession, path: str) -> DataFrame:
    """Like :func:`read_unquoted`, with int, float and boolean columns where every filled cell allows it."""
    rows, names, kinds = _scanned(spark, path)
    return rows.select(*[_typed(F.col(f"`{n}`"), kind).alias(n) for n, kind in zip(names, kinds, strict=True)])


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns as int, float or boolean where every filled cell allows it; one aggregate.

    An integer column with missing cells becomes float.
    """
    found = df.agg(*[F.array(*_type_tests(F.col(f"`{c}`"))).alias(c) for c in df.columns]).first()
    return df.select(*[_typed(F.col(f"`{c}`"), _kind(*found[c])).alias(c) for c in df.columns])


def read_by_name(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """Headed files with a given schema, whose columns are found by name in each file.

    The files are read once and their lines written. The header of a file is the first of its lines; its
    names give the place of every wanted column, and that row, with the file's encoding (latin-1 when a line is
    not UTF-8), meets the file's lines by a join. One number, the widest header, reaches the driver.
    Columns that a file lacks are null; columns that the schema lacks are left out. ``file_path`` is added.
    """
    schema = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
    lines = cut_lineage(_lines(spark, path), "lines")
    files = _files(lines)
    options = {"sep": sep, "escape": '"'}
    heads = lines.drop("valid").join(files, (F.col("file") == F.col("of")) & (F.col("at") == F.col("first")))
    head = F.regexp_replace(_text(F.col("line"), F.col("valid")), "^\ufeff", "")
    heads = cut_lineage(heads.select("of", "first", "valid", head.alias("head")), "heads")
    widest = heads.agg(F.max(F.size(F.split("head", _literal_pattern(sep), -1)))).first()[0] or 1
    wide = ", ".join(f"c{i} string" for i in range(widest))

    def fields(text: Column) -> Column:
        parsed = F.from_csv(text, wide, options)
        return F.array(*[parsed[f"c{i}"] for i in range(widest)])

    names = heads.select("of", "first", "valid", fields(F.col("head")).alias("names"))
    places = names.select("of", "first", "valid", *[F.array_position("names", f.name).cast("int").alias(f"p{i}") for i, f in enumerate(schema.fields)])
    rows = lines.drop("valid").join(places, F.col("file") == F.col("of")).filter(F.col("at") != F.col("first"))
    rows = rows.select("file", fields(_text(F.col("line"), F.col("valid"))).alias("f"), *[f"p{i}" for i in range(len(schema.fields))])
    wanted = [
        F.when(F.col(f"p{i}") > 0, F.try_element_at("f", F.col(f"p{i}"))).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)
    ]
    return rows.select(*wanted, F.col("file").alias("file_path"))


def read_headed(spark: SparkSession, path: str, schema: T.StructType | str, sep: str | None = None) -> DataFrame:
    """Quoted scan with a given schema, by header name; tab for ``.tsv``; latin-1 for a file that is not UTF-8."""
    sep = sep or ("\t" if path.lower().endswith(".tsv") else ",")
    return read_by_name(spark, path, schema, sep).drop("file_path")


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Latin-1 scan that keeps malformed lines in ``_corrupt_record`` beside what could be read."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(full)
        .option("header", True)
        .option("encoding", "ISO-8859-1")
        .option("mode", "PERMISSIVE")
        .option("columnPruning", False)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )


def header_probe(df: DataFrame) -> DataFrame:
    """Id column, target columns and the first row as JSON; a limit of one row."""
    first, *rest = df.columns
    return df.limit(1).select(
        F.lit(first).alias("id_column"),
        F.lit(",".join(rest)).alias("target_columns"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("sample_row"),
    )


def route_files(
    spark: SparkSession, path: str, schema: T.StructType | str, suffix: str = "test.csv"
) -> tuple[DataFrame, DataFrame]:
    """(training rows, test rows), told apart by the end of the file name.

    A table written by Spark is a folder, so the name of the folder counts as well.
    """
    df = read_by_name(spark, path, schema)
    parts = F.split("file_path", "/")
    is_test = F.endswith(F.element_at(parts, -1), F.lit(suffix)) | F.endswith(F.element_at(parts, -2), F.lit(suffix))
    return df.filter(~is_test), df.filter(is_test)
