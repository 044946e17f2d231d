"""Files with bad rows, odd encodings, archives, notebooks and repeated deliveries."""

import io
import json
import zipfile

import pytest

from tabloom.operators import pages, replies
from tabloom.sources import delimited, files, sinks
from tabloom.streaming import ingest


@pytest.mark.parametrize("sep,name", [(",", "a.csv"), (";", "a.csv"), ("\t", "a.tsv")])
def test_unquoted_scan(spark, tmp_path, sep, name):
    lines = ["id,name,x", '1,"q",2.5', "2,b", "3,c,4,extra", "4,NA,", "", "5,é,7"]
    path = tmp_path / name
    path.write_text("\n".join(lines).replace(",", sep), encoding="utf-8")
    rows = delimited.infer_types(delimited.read_unquoted(spark, str(path))).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, '"q"', 2.5), (2, "b", None), (4, None, None), (5, "é", 7.0)]


def test_rows_that_read_like_the_header(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("1,2\n1,2\n3,4\n")
    df = delimited.read_typed(spark, str(path))
    assert sorted(tuple(r) for r in df.collect()) == [(1, 2), (3, 4)] and set(dict(df.dtypes).values()) == {"bigint"}
    path.write_text("a,b\na,b\n3,4\n")
    df = delimited.read_typed(spark, str(path))
    assert sorted(tuple(r) for r in df.collect()) == [("3", "4"), ("a", "b")]


def test_folder_of_unquoted_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("\n\nid;v\n1;2\n")
    (tmp_path / "y.csv").write_text("id;v\n3;\n")
    df = delimited.read_typed(spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.collect()) == [(1, 2.0), (3, None)]


def test_encodings_and_quotes_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('name,id\n"caf\u00e9, ""x""",1\n'.encode("latin-1"))
    (tmp_path / "b.csv").write_bytes('\ufeffid,"name"\n2,\u00e9\nbad,z\n'.encode())
    got = delimited.read_by_name(spark, str(tmp_path), "id int, name string, gone date").collect()
    assert sorted((r["id"] or 0, r["name"], r["gone"]) for r in got) == [(0, "z", None), (1, 'caf\u00e9, "x"', None), (2, "\u00e9", None)]


def test_latin1_file(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_bytes("id,name\n1,café\n2,x\n".encode("latin-1"))
    assert delimited.sniff_encoding(spark, str(path)) == "ISO-8859-1"
    assert delimited.read_unquoted(spark, str(path)).collect()[0]["name"] == "café"
    assert delimited.read_headed(spark, str(path), "id int, name string").collect()[0]["name"] == "café"


def test_type_inference(spark):
    df = spark.createDataFrame([("1", "1", "True", "x"), ("2", None, "False", "1")], "a string, b string, c string, d string")
    types = dict(delimited.infer_types(df).dtypes)
    assert types == {"a": "bigint", "b": "double", "c": "boolean", "d": "string"}


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("notes.txt", "no")
        z.writestr("d/t.csv", "h\n1\n2\n")
        z.writestr("later.csv", "no")
    import gzip

    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("h\n3\n")
    (tmp_path / "c.csv").write_text("h\n4\n")
    rows = files.archive_lines(spark, str(tmp_path)).collect()
    got = sorted((r.member, r.line) for r in rows)
    assert got == [("b.csv.gz", "3"), ("b.csv.gz", "h"), ("c.csv", "4"), ("c.csv", "h"), ("d/t.csv", "1"), ("d/t.csv", "2"), ("d/t.csv", "h")]


def test_archives_under_any_name(spark, tmp_path, monkeypatch):
    import bz2
    import gzip

    monkeypatch.setattr(files, "HEAD_BYTES", 12)  # most heads by the driver
    with zipfile.ZipFile(tmp_path / "zipped.csv", "w") as z:
        z.writestr("t.csv", "z\n")
    (tmp_path / "plain.txt").write_text("p\n")
    (tmp_path / "odd [1] name").write_text("o\n")
    (tmp_path / "mislead.gz").write_text("m\n")
    (tmp_path / "b.csv.bz2").write_bytes(bz2.compress(b"b\n"))
    (tmp_path / "c.bz2.csv").write_bytes(bz2.compress(b"c\n"))
    (tmp_path / "packed").write_bytes(gzip.compress(b"g\n"))
    (tmp_path / "packed.GZ").write_bytes(gzip.compress(b"G\n"))
    rows = files.archive_lines(spark, str(tmp_path)).collect()
    assert sorted(r.line for r in rows) == ["G", "b", "c", "g", "m", "o", "p", "z"]
    assert {r.line: r.path.rsplit("/", 1)[1] for r in rows}["g"] == "packed"


def test_archives_without_a_reader_are_named(spark, tmp_path, monkeypatch):
    (tmp_path / "c.csv").write_text("h\n")
    (tmp_path / "x.dat").write_bytes(bytes.fromhex(files.MAGIC["7z"]) + b"0" * 20)
    with pytest.raises(ValueError, match="x.dat"):
        files.archive_lines(spark, str(tmp_path))
    (tmp_path / "other").mkdir()
    with zipfile.ZipFile(tmp_path / "other" / "large.bin", "w") as z:
        z.writestr("t.csv", "z\n")
    monkeypatch.setattr(files, "MAX_CONTENT", 50)
    monkeypatch.setattr(files, "HEAD_BYTES", 50)
    with pytest.raises(ValueError, match="large.bin"):
        files.archive_lines(spark, str(tmp_path / "other"))


def test_archive_without_table(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("notes.txt", "no")
    df = spark.createDataFrame([("a.zip", bytearray(buffer.getvalue()))], "path string, content binary")
    with pytest.raises(Exception, match="no table"):
        files.expand_archives(df).collect()


def test_notebooks(spark, tmp_path):
    cells = [("markdown", ["# t"]), ("code", ["a = 1\n", "b"]), ("code", ["c"])]
    doc = {"cells": [{"cell_type": t, "source": s} for t, s in cells]}
    (tmp_path / "n.ipynb").write_text(json.dumps(doc, indent=1))
    (tmp_path / "s.py").write_text("x = 1\n")
    got = {r["name"]: (r.language, r.text) for r in files.flatten_notebooks(spark, str(tmp_path)).collect()}
    assert got == {"n.ipynb": ("ipynb", "# # t\n\na = 1\nb\n\nc"), "s.py": ("py", "x = 1\n")}


def test_notebook_sources_as_one_text(spark, tmp_path):
    cells = [{"cell_type": "markdown", "source": "one\ntwo"}, {"cell_type": "code", "source": "[1, 2]\nx = 1"}, {"cell_type": "raw", "source": "r"}]
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": cells}))
    row = files.flatten_notebooks(spark, str(tmp_path)).first()
    assert row["text"] == "# one\n# two\n\n[1, 2]\nx = 1" and row["path"].endswith("n.ipynb")


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "train_a.csv").write_text("id,x\n1,10\n")
    (tmp_path / "train_b.csv").write_text("x,id,more\n20,2,z\n")
    (tmp_path / "my_test.csv").write_text("id\n3\n")
    train, test = delimited.route_files(spark, str(tmp_path / "*.csv"), "id int, x int")
    assert sorted((r["id"], r["x"]) for r in train.collect()) == [(1, 10), (2, 20)]
    assert [(r["id"], r["x"]) for r in test.collect()] == [(3, None)]
    assert [(r["x"], r["id"]) for r in delimited.read_headed(spark, str(tmp_path / "train_b.csv"), "x int, id int").collect()] == [(20, 2)]


def test_long_ids_stay_whole(spark):
    df = spark.createDataFrame([("1234567890123456789", "99999999999999999999")], "a string, b string")
    row = delimited.infer_types(df).first()
    assert row["a"] == 1234567890123456789 and isinstance(row["b"], float)


def test_entities_and_angle_brackets(spark):
    from tabloom.functions import markup

    html = "<p>It&rsquo;s 5 &#8211; 7, a < b and c > d &#x41;&#65;&amp;#65; &#xZZ; &bogus; R&D</p>"
    df = spark.createDataFrame([(html,), (None,), ("plain",)], "h string")
    got = [r[0] for r in df.select(markup.strip_tags(df["h"])).collect()]
    assert got == ["It’s 5 – 7, a < b and c > d AA&#65; &#xZZ; &bogus; R&D", None, "plain"]


def test_python_words_only_outside_quotes(spark):
    text = "{'a': 'yes, None of it', 'b':\n            None, \"c\": [True, False], 'd': 'it\\'s True'}"
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(replies.parsed_reply(df["t"]).alias("p")).first()["p"]
    assert row["a"] == "yes, None of it" and row["b"] is None and row["c"] == "[true,false]" and row["d"] == "it's True"


def test_pretty_json_keeps_unicode(spark, tmp_path):
    path = str(tmp_path / "j")
    sinks.write_json(spark.createDataFrame([(1, "é")], "a int, b string"), path, pretty=True)
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    assert "é" in text and "\n" in text


def test_ingest_takes_each_key_once(spark, tmp_path):
    schema = "id long, ts timestamp, v int"
    row = lambda i, v: (i, __import__("datetime").datetime(2024, 1, 1 + i % 2), v)
    df = lambda rows: spark.createDataFrame(rows, schema)
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df([row(1, 1), row(2, 1), row(2, 1)]).coalesce(1).write.parquet(f"{src}/a")
    ingest.ingest(spark, f"{src}/*", df([]).schema, out, state, "id", "ts")
    df([row(2, 9), row(3, 1)]).coalesce(1).write.parquet(f"{src}/b")
    ingest.ingest(spark, f"{src}/*", df([]).schema, out, state, "id", "ts")
    ingest.ingest(spark, f"{src}/*", df([]).schema, out, state, "id", "ts")
    assert sorted((r.id, r.v) for r in spark.read.parquet(out).collect()) == [(1, 1), (2, 1), (3, 1)]


def _deliver(spark, path, ids, v):
    spark.createDataFrame([(i, v, f"c{i % 3}") for i in ids], "id long, v int, c string").coalesce(1).write.parquet(path)


def _state_dirs(tmp_path):
    return tuple(str(tmp_path / n) for n in ("in", "out", "state"))


def test_replayed_batch_adds_nothing(spark, tmp_path):
    """A batch whose commit was lost runs again over the same state and replaces its own output."""
    src, out, state = _state_dirs(tmp_path)
    schema = spark.createDataFrame([], "id long, v int, c string").schema
    run = lambda: ingest.run_batches(
        spark, f"{src}/*", schema, state, "id", lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}")
    )
    _deliver(spark, f"{src}/a", [1, 2, 3], 1)
    run()
    _deliver(spark, f"{src}/b", [3, 4, 5], 2)
    run()
    want = [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2)]
    read = lambda: sorted((r.id, r.v) for r in spark.read.parquet(out).collect())
    assert read() == want
    last = max(int(p.name) for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit())
    (tmp_path / "state" / "commits" / str(last)).unlink()
    (tmp_path / "state" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    run()
    assert read() == want
    _deliver(spark, f"{src}/c", [5, 6], 3)
    run()
    assert read() == [*want, (6, 3)]


def test_a_batch_does_not_read_the_target(spark, tmp_path):
    """The rows of earlier batches may be anywhere: only the state and the new files are opened."""
    src, out, state = _state_dirs(tmp_path)
    schema = spark.createDataFrame([], "id long, v int, c string").schema
    taken = []
    run = lambda: ingest.run_batches(
        spark, f"{src}/*", schema, state, "id", lambda rows, n: taken.append(sorted((r.id, r.v) for r in rows.collect()))
    )
    _deliver(spark, f"{src}/a", [1, 2], 1)
    run()
    for f in (tmp_path / "in" / "a").glob("*.parquet"):
        f.write_bytes(b"gone")
    _deliver(spark, f"{src}/b", [2, 2, 7, 7], 2)
    run()
    assert taken == [[(1, 1), (2, 1)], [(7, 2)]]


def test_a_batch_writes_few_files_and_small_state(spark, tmp_path):
    """Neither files nor stores follow the shuffle partitions, and the state holds no path per key."""
    src, out, state = _state_dirs(tmp_path)
    day = "timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 3 as int))"
    rows = spark.range(3000).selectExpr("id", f"{day} AS ts")
    rows.repartition(3).write.parquet(f"{src}/a")
    with ingest.settings(spark, {"spark.sql.shuffle.partitions": "60"}):
        ingest.ingest(spark, f"{src}/*", rows.schema, out, state, "id", "ts")
    assert spark.read.parquet(out).select("id").distinct().count() == spark.read.parquet(out).count() == 3000
    assert len(list((tmp_path / "out").rglob("*.parquet"))) <= 12
    stores = [p for p in (tmp_path / "state" / "state" / "0").iterdir() if p.name.isdigit()]
    assert len(stores) <= ingest.STORES_PER_CORE * spark.sparkContext.defaultParallelism


def test_first_copy_by_file_time_path_and_row(spark, tmp_path):
    """Null keys are one key; of equal keys in a batch the older file counts, then the row."""
    src, out, state = _state_dirs(tmp_path)
    df = lambda rows: spark.createDataFrame(rows, "id long, v int").coalesce(1)
    for name, rows in (("z", [(1, 1), (None, 2), (1, 3)]), ("a", [(None, 4), (2, 5), (1, 6), (2, 7)])):
        df(rows).write.parquet(f"{src}/{name} x")
    for f in (tmp_path / "in").glob("*/*.parquet"):
        written = f.stat().st_mtime - (200 if f.parent.name == "z x" else 100)
        __import__("os").utime(f, (written, written))
    run = lambda: ingest.run_batches(
        spark, f"{src}/*", df([]).schema, state, "id", lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}")
    )
    run()
    df([(None, 8), (3, 9)]).write.parquet(f"{src}/b")
    run()
    assert sorted(r.v for r in spark.read.parquet(out).collect()) == [1, 2, 5, 9]


def test_index_grows_by_batches(spark, tmp_path):
    path = str(tmp_path / "index")
    df = lambda ids: spark.createDataFrame([(i, f"c{i}", [1.0, 0.0]) for i in ids], "id long, c string, vec array<double>")
    sinks.write_index(df([2, 3]), {"c": 2.0}, path, "m")
    sinks.append_index(df([1, 3, 4]), {"c": 2.0}, path, "m", 5)
    sinks.append_index(df([1, 4]), {"c": 2.0}, path, "m", 5)  # the same batch again
    vectors, vocabulary, meta = sinks.read_index(spark, path)
    assert sorted(r.id for r in vectors.collect()) == [1, 2, 3, 4]
    assert {r.value: r.idx for r in vocabulary.collect()} == {"c2": 0, "c3": 1, "c1": 2, "c4": 3}
    assert meta.first().asDict() == {"n_rows": 4, "dim": 2, "model": "m"}


def section(html):
    return {s["heading"]: (s["text"], s["block"]) for s in pages.page_sections(html)}


def test_sections_follow_nesting():
    html = (
        "<div><h2>Evaluation</h2>bare <b>bold</b><script>no()</script><div>in <h3>Inner</h3> deep</div><h2>Next</h2></div><p>out</p>"
    )
    got = section(html)
    assert got["Evaluation"][0] == "bare bold in Inner deep"
    assert got["Inner"] == ("deep", "out")
    assert got["Next"] == ("", "out")


def test_blocks_skip_empty_ones():
    got = section("<h2>Files</h2><div> </div><div><p></p><p>3 <i>files</i></p>x</div><h2>Size</h2><span>no</span>")
    assert got["Files"][1] == "3filesx"
    assert got["Size"][1] is None


def test_next_block_of_every_kind():
    html = (
        "<h2>Dataset Description</h2><span>no</span><ul><li>a <b>b</b></li><li>c</li></ul><p>later</p>"
        "<h2>Data Explorer</h2><ul> </ul><div><ul><li>x</li><li><div><p>one</p></div><p> t<i>wo</i></p></li></ul></div><ul><li><p>no</p></li></ul>"
    )
    found = {s["heading"]: s for s in pages.page_sections(html)}
    first, second = found["Dataset Description"], found["Data Explorer"]
    assert (first["body"], first["block"], first["items"]) == ("a\nb\nc", "later", [])
    assert second["items"] == ["one", "two"] and second["body"] == "x\none\nt\nwo"
    assert pages.page_sections("<h2>Data Explorer</h2><p>none</p>")[0]["items"] == []


def test_standard_names_with_and_without_semicolon(spark):
    from html import unescape

    from tabloom.functions import markup

    texts = ["&notin;&not;in &notit; &AMP;lt; &ampx &copy2 &hellip;&CounterClockwiseContourIntegral;", "&lt;&#60;&amp;lt;&", "&&lt", "&fjlig;&nosuch;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(markup.decode_entities(df["t"])).collect()] == [unescape(t) for t in texts]


def test_broken_markup_does_not_fail():
    assert pages.page_sections(None) == []
    assert pages.page_sections("<h1>a<p></h1></div><b>x")[0]["heading"] == "a"


def test_reply_states(spark):
    raw = ['{"k": 1}', 'text {"k": 1} more', "{'k': None}", '{"x": 1}', "none", '{"k": 1', '{"a": {"b": 1}, "k": [1, 2]}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    states = [r.state for r in replies.validate(df, "raw", ["k"]).orderBy("i").collect()]
    assert states == ["parsed", "parsed", "parsed", "missing keys", "unreadable", "unreadable", "parsed"]


def test_pages_are_parsed_a_few_at_a_time():
    """The Python objects of a batch do not follow its number of pages; before, all of them stood side by side."""
    import tracemalloc

    import pyarrow as pa

    html = [None, "", *[f"<h1>Page {i}</h1><p>{'word ' * 400}{i}</p><ul><li><p>a</p></li></ul>" for i in range(3000)]]
    batch = pa.array(html, pa.string())
    tracemalloc.start()
    try:
        got = pages.parsed(batch)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.to_pylist() == [pages.page_sections(h) for h in html]
    assert peak < 4_000_000
    assert pages.parsed(pa.array([], pa.string())).to_pylist() == []


def test_listing_takes_few_tasks(spark, tmp_path):
    """A batch of files was listed by one task per file."""
    from tabloom.session import LISTINGS_PER_CORE, few_listing_tasks

    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    rows = spark.createDataFrame([(i, f"{i}.py", f"x = {i}") for i in range(60)], "owner int, notebook string, value string")
    rows.coalesce(1).write.partitionBy("owner", "notebook").text(str(tmp_path / "in"))
    most = LISTINGS_PER_CORE * spark.sparkContext.defaultParallelism
    seen = []
    inside = lambda batch: seen.append(int(spark.conf.get(key))) or batch
    with pytest.MonkeyPatch.context() as patch:
        real = files.flattened
        patch.setattr(files, "flattened", lambda raw: real(inside(raw)))
        files.stream_notebooks(spark, *[str(tmp_path / n) for n in ("in", "out", "state")])
    assert seen == [most] and spark.conf.get(key) == before
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
    with pytest.raises(ZeroDivisionError), few_listing_tasks(spark):
        1 / 0  # noqa: B018
    assert spark.conf.get(key) == before
