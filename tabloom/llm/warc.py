"""WARC archives and a globally ordered capture index.

``write_archives`` writes one WARC/1.1 record per row. Of rows with equal payloads the one with the
smallest id is a response, the others are revisits that refer to it. Tasks join records into
archives of about ARCHIVE_BYTES; Spark's text writer stores them (its line separator is the record
separator), so any shared file system works and a lost task is simply repeated.

``read_archives`` takes the records back by their Content-Length and gives, for each archive, its
captures sorted by URL key and time: a locally sorted run.

``capture_history`` merges the runs: the runs' rows are dealt to ranges of (URL key, time, id), and
each range merges its slices of the k runs by a loser tree. A URL with a third of all captures
covers several ranges. A task holds one range, about RANGE_ROWS captures.

Defined results: a null payload is the empty one; a null url writes no target and has the empty
URL key; rows with the same smallest id and equal payloads are all responses; rows whose id is null
revisit the smallest id, or are responses if their payload has none. An empty table gives no
archives and no rows. Extra columns are ignored. Times come from the caller.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.support import load, query
from tabloom.session import shared_path

ARCHIVE_BYTES = 8 << 20
RANGE_ROWS = 200_000
RECORD_END = b"\r\n\r\n"
URN = "urn:x-capture:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = (
    "page_id bigint, url string, capture_time string, record_type string, refers_to bigint, "
    "payload_bytes bigint, payload_digest string, intact boolean, url_key string, run string, run_pos bigint, "
    "offset bigint, length bigint"
)


def url_key(url: str | None) -> str:
    """Reversed host and the rest of the url, in lower case, for ordering."""
    if not url or "://" not in url:
        return (url or "").lower()
    rest = url.split("://", 1)[1].lower()
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].split("."))) + ")" + rest[cut:]


def _header_url(url: str) -> str:
    """Control characters and line ends cannot stand in a header line."""
    return quote(url, safe=";/?:@&=+$,#[]!*'()~-_. <>\"\\^`{|}") if any(ord(c) < 33 for c in url) or "%" in url else url


def record(page_id, url, when: str, payload: bytes, first) -> bytes:
    """One record without the separator that ends it."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = first is not None and first != page_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}"]
    lines += [f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Date: {when}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_url(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{URN}{first}>"]
    body = http if revisit else http + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(["WARC/1.1", *lines]).encode() + RECORD_END + body


def _archives(limit: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([RECORD_END.join(held)], pa.binary())], ["value"])

        for batch in batches:
            for row in zip(*[batch.column(c) for c in ("page_id", "url", "when", "payload", "first")], strict=True):
                held.append(record(*[x.as_py() for x in row]))
                size += len(held[-1])
                if size >= limit:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return build


def write_archives(
    df: DataFrame, path: str, when: Column, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write every row as a record below ``path``; ``when`` is the capture time as WARC text."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), when.alias("when"),
        payload.alias("payload"), F.sha2(payload, 256).alias("same"), F.sha1(payload).alias("same1"),
    )
    firsts = rows.groupBy("same", "same1").agg(F.min("page_id").alias("first"))
    rows = rows.join(firsts, ["same", "same1"])
    # The separator after the last record comes from the writer; the cast keeps the bytes as they are.
    archives = rows.mapInArrow(_archives(archive_bytes), "value binary").select(F.col("value").cast("string"))
    archives.write.option("lineSep", RECORD_END.decode()).option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def _lines(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b": ")
        found[name.decode().lower()] = value.decode()
    return found


def _urn_id(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<" + URN).removesuffix(">")
    return int(digits) if digits else None


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of an uncompressed archive, by their stated lengths."""
    at = 0
    while at < len(data):
        end = data.index(RECORD_END, at)
        head = _lines(data[at:end])
        start = end + len(RECORD_END)
        stop = start + int(head["content-length"])
        http_end = data.index(RECORD_END, start, stop)
        http, payload = _lines(data[start:http_end]), memoryview(data)[http_end + len(RECORD_END) : stop]
        digest, stated = head["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
        whole = head["warc-type"] == "response"
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        url = head.get("warc-target-uri")
        if url is not None and "%" in url:
            url = unquote(url)
        yield {
            "page_id": _urn_id(head["warc-record-id"]), "url": url, "capture_time": head["warc-date"],
            "record_type": head["warc-type"], "refers_to": _urn_id(head.get("warc-refers-to")),
            "payload_bytes": len(payload) if whole else stated, "payload_digest": own if whole else digest,
            "intact": not whole or (own == digest and len(payload) == stated), "url_key": url_key(url),
            "offset": at, "length": stop - at,
        }
        at = stop + len(RECORD_END)


def _capture_order(r: dict) -> tuple:
    return r["url_key"], r["capture_time"], r["page_id"] is None, r["page_id"] or 0


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            run = path.as_py().rsplit("/", 1)[-1]
            found = sorted(parse_archive(gzip.decompress(content.as_py())), key=_capture_order)
            for i, r in enumerate(found):
                r |= {"run": run, "run_pos": i}
            if found:
                names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in found], schema=_ARROW)


_ARROW = pa.schema(
    [
        (c.split()[0], {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]])
        for c in RECORD_SCHEMA.split(", ")
    ]
)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``; within a run rows are in capture order."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_runs, RECORD_SCHEMA)


class LoserTree:
    """Merge of k sorted runs: a replay after each output costs about log2 k comparisons."""

    def __init__(self, runs: Iterable[Iterator[tuple]]):
        self.runs = list(runs)
        self.heads = [next(r, None) for r in self.runs]
        k = max(1, len(self.runs))
        self.loser = [-1] * k
        for i in range(len(self.runs)):
            self._replay(i, k)
        self.k = k

    def _beats(self, a: int, b: int) -> bool:
        """An open slot (-1) wins while the tree is built; an exhausted run loses."""
        if a == -1 or b == -1:
            return a == -1
        x, y = self.heads[a], self.heads[b]
        return y is None if x is None or y is None else (x, a) < (y, b)

    def _replay(self, i: int, k: int) -> None:
        at = (i + k) // 2
        while at > 0:
            if self._beats(self.loser[at], i):
                self.loser[at], i = i, self.loser[at]
            if i == -1:
                return
            at //= 2
        self.loser[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and (head := self.heads[winner := self.loser[0]]) is not None:
            yield head
            self.heads[winner] = next(self.runs[winner], None)
            self._replay(winner, self.k)


def _merge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    run = table.column("run").to_pylist()
    keys = [table.column(c).to_pylist() for c in ("url_key", "capture_time", "page_id")]
    starts = [i for i in range(len(run)) if i == 0 or run[i] != run[i - 1]] + [len(run)]

    def slice_of(s: int, e: int) -> Iterator[tuple]:
        return ((u, t, p is None, p or 0, i) for i, (u, t, p) in enumerate(zip(*[k[s:e] for k in keys], strict=True), s))

    order = [x[-1] for x in LoserTree(slice_of(s, e) for s, e in zip(starts, starts[1:], strict=False))]
    merged = table.take(pa.array(order)).append_column("range_pos", pa.array(range(len(order)), pa.int64()))
    yield from merged.to_batches()


def capture_history(runs: DataFrame, rows: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures in global order of url_key, time and id: by merge_range, then range_pos."""
    ranges = -(-rows // range_rows) or 1
    order = ["url_key", "capture_time", F.col("page_id").asc_nulls_last()]
    dealt = runs.repartitionByRange(ranges, *order).sortWithinPartitions("run", "run_pos")
    merged = dealt.mapInArrow(_merge_range, RECORD_SCHEMA + ", range_pos bigint")
    return merged.withColumn("merge_range", F.spark_partition_id())


# Base 32 takes 20 bits, five hex digits, to four letters.
_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (
  SELECT page_id, url, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS f,
    lower(substr(url, instr(url, '://') + 3)) AS rest FROM p),
k AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS host FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((('0x' || substr(x, CAST(i // 4 * 5 + 1 AS BIGINT), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to,
  array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || substr(rest, length(host) + 1) AS url_key,
  strftime(make_timestamp((page_id % 1000000000 + 1600000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS capture_time, true AS intact
FROM k
"""


@query("op5_warc", _SQL)
def op5_warc(spark, sf_dir):
    """Pages have no capture time; one second per id stands for it. Rows come in capture order."""
    pages = load(spark, sf_dir, "pages")
    path = shared_path(spark, "warc")
    seconds = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000)) + 1_600_000_000
    write_archives(pages, path, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    runs = read_archives(spark, path)
    index = shared_path(spark, "captures")
    runs.write.parquet(index)
    runs = spark.read.schema(runs.schema).parquet(index)
    return capture_history(runs, runs.count()).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_time", "intact"
    )
