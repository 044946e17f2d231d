import base64
import gzip
import hashlib
import random

from pyspark.sql import functions as F

from tabloom.llm import warc
from tabloom.session import shared_path

ROWS = [
    (3, "http://b.example.org/x?q=1", "<p>one</p>\r\n\r\nWARC/1.1\r\n\r\nno header"),
    (1, "http://a.example.org/", "<p>two</p>"),
    (2, "http://b.example.org/x?q=1", "<p>two</p>"),
    (4, None, None),
    (5, "no scheme", ""),
    (6, "http://a.example.org/line\nend %41 é", "ü" * 70_000),
    (7, "http://a.example.org/", "<p>two</p>"),
    (None, "http://a.example.org/", "<p>two</p>"),
    (7, "http://a.example.org/", "<p>two</p>"),
]


def _history(spark, rows, archive_bytes, range_rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, payload int")
    path = shared_path(spark, "warc")
    warc.write_archives(df, path, F.lit("2020-01-01T00:00:00Z"), archive_bytes=archive_bytes)
    runs = warc.read_archives(spark, path).cache()
    return path, warc.capture_history(runs, runs.count(), range_rows).collect()


def test_round_trip_and_order(spark):
    for archive_bytes, range_rows in ((1, 2), (1 << 20, 1000)):
        _, got = _history(spark, ROWS, archive_bytes, range_rows)
        assert len(got) == len(ROWS) and all(r["intact"] for r in got)
        first = {}
        for i, _, h in ROWS:
            if i is not None:
                first[h or ""] = min(i, first.get(h or "", i))
        html = {i: h or "" for i, _, h in ROWS}
        url = {i: u for i, u, _ in ROWS}
        for r in got:
            data = html[r["page_id"]].encode()
            assert r["payload_bytes"] == len(data)
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
            own = first[html[r["page_id"]]] == r["page_id"]
            assert r["record_type"] == ("response" if own else "revisit")
            assert r["refers_to"] == (None if own else first[html[r["page_id"]]])
            assert r["url"] == url[r["page_id"]]
        order = sorted(got, key=lambda r: (r["merge_range"], r["range_pos"]))
        keys = [(r["url_key"], r["capture_time"], r["page_id"] is None, r["page_id"] or 0) for r in order]
        assert keys == sorted(keys)


def test_archives_are_plain_warc(spark):
    path, _ = _history(spark, ROWS[:3], 1 << 20, 10)
    for row in spark.read.format("binaryFile").load(path).collect():
        data = gzip.decompress(row["content"])
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")


def test_no_rows(spark):
    _, got = _history(spark, [], 1 << 20, 10)
    assert got == []


def test_loser_tree():
    rnd = random.Random(5)
    for _ in range(300):
        runs = [sorted((rnd.randrange(5), rnd.random()) for _ in range(rnd.randrange(7))) for _ in range(rnd.randrange(10))]
        assert list(warc.LoserTree(iter(r) for r in runs)) == sorted(sum(runs, []))


def test_url_keys():
    assert warc.url_key("HTTP://WWW.Example.org/A?b") == "org,example,www)/a?b"
    assert warc.url_key(None) == "" and warc.url_key("plain") == "plain"
