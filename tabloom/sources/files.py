"""File listings, archives, documents and notebooks."""

from __future__ import annotations

import io
import re
import sys
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.session import few_listing_tasks, shared_path

# Executors need not have this package installed: the reader travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Leading bytes of the archive formats, and the members that count as tables.
MAGIC = {"zip": "504B0304", "7z": "377ABCAF271C", "gzip": "1F8B"}
TABLE_SUFFIXES = (".csv", ".tsv")
LINES_PER_BATCH = 20_000
MAX_CONTENT = 2_147_483_647
HEAD_BYTES = 64 << 20
# Suffixes by which Spark's reader finds a decoder, and kinds without a reader.
SUFFIX = {"gzip": ".gz", "bzip2": ".bz2"}
UNREAD = {"7z": MAGIC["7z"], "empty zip": "504B0506", "xz": "FD377A585A00", "zstd": "28B52FFD", "lz4": "04224D18", "rar": "526172211A07"}
UNREAD |= {"parquet": "50415231"}
CODED = (".deflate", ".snappy", ".lz4", ".zst")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Name, path and size of every file; the contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("bytes"))


def archive_kind(content: Column, path: Column) -> Column:
    """zip, 7z, gzip or plain, by leading bytes, then by suffix."""
    head = F.hex(F.substring(content, 1, 6))
    name = F.lower(path)
    return (
        F.when(F.startswith(head, F.lit(MAGIC["zip"])) | F.endswith(name, F.lit(".zip")), "zip")
        .when(F.startswith(head, F.lit(MAGIC["7z"])) | F.endswith(name, F.lit(".7z")), "7z")
        .when(F.startswith(head, F.lit(MAGIC["gzip"])), "gzip")
        .otherwise("plain")
    )


def first_table_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of the first table member per archive, streamed in bounded batches."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                members = [n for n in archive.namelist() if n.lower().endswith(TABLE_SUFFIXES)]
                if not members:
                    raise ValueError(f"no table in {path}")
                with archive.open(members[0]) as member:
                    text = io.TextIOWrapper(member, encoding="utf-8", errors="replace", newline=None)
                    lines, start = [], 0
                    for line in text:
                        lines.append(line.rstrip("\n"))
                        if len(lines) == LINES_PER_BATCH:
                            yield _frame(path, members[0], start, lines)
                            start += len(lines)
                            lines = []
                    if lines:
                        yield _frame(path, members[0], start, lines)


def _frame(path: str, member: str, start: int, lines: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"path": path, "member": member, "line_no": range(start, start + len(lines)), "line": lines})


def expand_archives(archives: DataFrame) -> DataFrame:
    """Lines of the first table in each ``(path, content)`` zip archive."""
    return archives.mapInPandas(first_table_lines, "path string, member string, line_no bigint, line string")


def _head(spark: SparkSession, path: str) -> str:
    """Leading bytes of one file in hex, by the driver; the rest is not read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(where)
    try:
        found = [stream.read() for _ in range(6)]
    finally:
        stream.close()
    return bytes(b for b in found if b >= 0).hex().upper()


def file_kinds(spark: SparkSession, path: str) -> list[tuple[str, str, int, str]]:
    """Name, path, size and kind of every file.

    The kind is told by the leading bytes, else by the suffix. Small files are opened by tasks; of those
    above HEAD_BYTES, however large, the driver reads six bytes.
    """
    listed = list_files(spark, path)
    small = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = small.filter(F.col("length") <= HEAD_BYTES).select("path", F.hex(F.substring("content", 1, 6)).alias("head"))
    heads = {r["path"]: r["head"] for r in small.collect()}
    out = []
    for r in listed.collect():
        head = heads.get(r["path"])
        head = _head(spark, r["path"]) if head is None else head
        name = r["name"].lower()
        by_head = [kind for kind, magic in (MAGIC | UNREAD | {"bzip2": "425A68"}).items() if head.startswith(magic)]
        by_name = [kind for kind in ("zip", "7z") if name.endswith(f".{kind}")]
        kind = (by_head + by_name + ["plain"])[0]
        out.append((r["name"], r["path"], r["bytes"], kind))
    return sorted(out)


def _text_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    escaped = [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths]
    return spark.read.option("recursiveFileLookup", True).text(escaped)


def _renamed_copies(spark: SparkSession, wrong: list[tuple[str, str, str]]) -> DataFrame:
    """Lines of (name, path, kind) files whose suffix hides their kind from Spark's reader.

    The reader chooses the decoder by the suffix, so the files are copied, stream by stream, to the shared
    folder under a name that fits.
    """
    jvm, conf, base = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf(), shared_path(spark, "renamed")
    names = []
    for i, (name, path, kind) in enumerate(wrong):
        source = jvm.org.apache.hadoop.fs.Path(path)
        copy = f"{i}{SUFFIX.get(kind, '.txt')}"
        target = jvm.org.apache.hadoop.fs.Path(f"{base}/{copy}")
        jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)
        names.append((copy, source.toUri().toString(), name))
    known = spark.createDataFrame(names, "copy string, path string, member string")
    lines = _text_lines(spark, [base]).select(F.col("_metadata.file_name").alias("copy"), F.col("value").alias("line"))
    return lines.join(F.broadcast(known), "copy").select("path", "member", F.lit(None).cast("bigint").alias("line_no"), "line")


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, member, line_no, line)`` of zip archives, gzip and plain tables below ``path``.

    Zip members are expanded in Python, one archive per row, which limits an archive to 2 GiB.
    Gzip, bzip2 and plain tables of any size and under any suffix go through Spark's own reader. A file of
    another kind or a larger archive is an error that names it; no file is left out, but those that Spark
    hides (names with a leading dot or underscore).
    """
    found = file_kinds(spark, path)
    bad = [f"{p} ({kind}, {n} bytes)" for _, p, n, kind in found if kind in UNREAD or (kind == "zip" and n > MAX_CONTENT)]
    if bad:
        raise ValueError(f"no reader for {len(bad)} files below {path}: {', '.join(bad[:20])}")
    archives, tables, wrong = [], [], []
    for name, p, _, kind in found:
        if kind == "zip":
            archives.append(re.sub(r"([\\\[\]{}*?])", r"\\\1", p))
        elif name.endswith((".gz", ".bz2", *CODED)) == (kind in ("gzip", "bzip2")) and SUFFIX.get(kind, "") in name[-4:]:
            tables.append(p)
        else:
            wrong.append((name, p, kind))
    out = spark.createDataFrame([], "path string, member string, line_no bigint, line string")
    if archives:
        out = out.unionByName(expand_archives(spark.read.format("binaryFile").load(archives).select("path", "content")))
    if tables:
        text = _text_lines(spark, tables).select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_name").alias("member"),
            F.lit(None).cast("bigint").alias("line_no"),
            F.col("value").alias("line"),
        )
        out = out.unionByName(text)
    return out.unionByName(_renamed_copies(spark, wrong)) if wrong else out


def read_json_documents(spark: SparkSession, path: str, schema: str, per_file: bool = False) -> DataFrame:
    """One JSON document per line (splittable) or per file."""
    return spark.read.schema(schema).option("multiLine", per_file).json(path)


CELLS = "struct<cells:array<struct<cell_type:string,source:{}>>>"


def notebook_cells(document: Column) -> Column:
    """Texts of the cells in order; prose becomes comment lines.

    A cell's source is a list of lines or one text, so it is read as either.
    """
    listed = F.from_json(document, CELLS.format("array<string>"))["cells"]
    whole = F.from_json(document, CELLS.format("string"))["cells"]
    cells = F.arrays_zip(listed.alias("l"), whole.alias("w"))
    filled = F.filter(cells, lambda c: c["w"]["cell_type"].isin("code", "markdown") & c["w"]["source"].isNotNull())

    def text(cell: Column) -> Column:
        source = F.coalesce(F.array_join(cell["l"]["source"], ""), cell["w"]["source"])
        return F.when(cell["w"]["cell_type"] == "code", source).otherwise(F.regexp_replace(source, r"(?m)^", "# "))

    return F.transform(filled, text)


NOTEBOOK = ".ipynb"


def flattened(raw: DataFrame) -> DataFrame:
    """(path, name, language, text) of whole files in ``value``, one row per file; broken notebooks have null text.

    A file written by Spark lies in a folder, whose name then counts. Texts never leave their row, so no shuffle
    keeps their order, and files of one name in several folders stay apart by their path.
    """
    parts = F.split("_metadata.file_path", "/")
    folder = F.regexp_replace(F.element_at(parts, -2), "^[^=/]*=", "")
    name = F.when(F.endswith(folder, F.lit(NOTEBOOK)), folder).otherwise(F.col("_metadata.file_name"))
    named = raw.select(F.col("_metadata.file_path").alias("path"), name.alias("name"), "value")
    is_notebook = F.endswith("name", F.lit(NOTEBOOK))
    return named.select(
        "path",
        "name",
        F.when(is_notebook, "ipynb").otherwise("py").alias("language"),
        F.when(is_notebook, F.array_join(notebook_cells(F.col("value")), "\n\n"))
        .otherwise(F.make_valid_utf8("value"))
        .alias("text"),
    )


def flatten_notebooks(spark: SparkSession, path: str) -> DataFrame:
    """Notebook cells joined to one text in order; other scripts as they are."""
    return flattened(spark.read.option("recursiveFileLookup", True).text(path, wholetext=True))


def stream_notebooks(spark: SparkSession, path: str, target: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Append the texts of the files that arrived since the last run to ``target``, then stop; broken notebooks are skipped."""
    with few_listing_tasks(spark):
        source = spark.readStream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch)
        texts = flattened(source.text(path, wholetext=True)).filter("text IS NOT NULL")
        query = texts.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def ordered_text(df: DataFrame, by: str, position: str, text: str, sep: str = "\n\n") -> DataFrame:
    """Cells of one notebook, given as rows, joined in order."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(position).alias("pos"), F.col(text).alias("text"))))
    return df.groupBy(by).agg(F.array_join(F.transform(packed, lambda s: s["text"]), sep).alias("text"))


def stand_in(df: DataFrame, letters: str = "ABCDE", seed: int = 42, high: int = 100) -> DataFrame:
    """Fixture with the columns and row count of ``df`` and invented values.

    Values come from a hash of row number, column and seed, so they are the same in every run.
    """
    n = df.count()
    cols = []
    for f in df.schema.fields:
        h = F.xxhash64("id", F.lit(f.name), F.lit(seed))
        kind = f.dataType.simpleString()
        if kind in ("string",):
            value = F.substring(F.lit(letters), F.pmod(h, F.lit(len(letters))).cast("int") + 1, F.lit(1))
        elif kind in ("double", "float"):
            value = (F.pmod(h, F.lit(1_000_000)) / 1_000_000).cast(kind)
        elif kind in ("int", "bigint", "smallint", "tinyint"):
            value = F.pmod(h, F.lit(high)).cast(kind)
        else:
            value = F.lit(None).cast(f.dataType)
        cols.append(value.alias(f.name))
    return df.sparkSession.range(n).select(*cols)
