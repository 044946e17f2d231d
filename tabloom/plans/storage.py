"""Sources, sinks and incremental ingest (S, K, X). Files are written from the given tables."""

from __future__ import annotations

import io
import sys
import zipfile

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tabloom.functions import vectors as V
from tabloom.operators import joins, profile, replies, retrieve
from tabloom.operators import records as rec
from tabloom.plans.common import load
from tabloom.plans.registry import query
from tabloom.plans.retrieval import CATS, WEIGHTS, records
from tabloom.session import one_row, shared_path
from tabloom.sources import delimited, files, sinks
from tabloom.streaming import ingest

# Executors need not have this package installed: the zip writer travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _order_lines(spark, d, sep):
    """Orders as text lines: every 7th has a field too many, every 11th lacks its last one."""
    orders = load(spark, d, "orders")
    fields = [F.col(c).cast("string") for c in _ORDER_COLS]
    quoted = F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"'))
    line = F.concat_ws(sep, *fields[:-1], quoted)
    line = F.when(F.col("o_orderkey") % 7 == 0, F.concat(line, F.lit(f"{sep}extra"))).when(
        F.col("o_orderkey") % 11 == 0, F.concat_ws(sep, *fields[:-1])
    ).otherwise(line)
    return orders.select(line.alias(sep.join(_ORDER_COLS)))


@query(
    "s1_sniffed_scan",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 11 <> 0 THEN '"' || o_orderpriority || '"' END AS o_orderpriority
       FROM orders WHERE o_orderkey % 7 <> 0""",
)
def s1(spark, d):
    path = shared_path(spark, "s1")
    # Written with a separator that never occurs, so that the lines keep their own.
    _order_lines(spark, d, ";").write.option("header", True).option("quote", "").option("sep", "\u0001").csv(path)
    return delimited.read_typed(spark, path)


@query(
    "s1_file_profile",
    """WITH t AS (SELECT * FROM orders WHERE o_orderkey % 7 <> 0), n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (o_orderkey % 11 = 0) AS m FROM t)
       SELECT CAST(0 AS INT) AS position, 'o_orderkey' AS name, 'int' AS type, 0.0::DOUBLE AS missing_pct, false AS is_target FROM n
       UNION ALL SELECT 1, 'o_custkey', 'int', 0.0, false FROM n UNION ALL SELECT 2, 'o_orderstatus', 'string', 0.0, true FROM n
       UNION ALL SELECT 3, 'o_totalprice', 'float', 0.0, false FROM n
       UNION ALL SELECT 4, 'o_orderpriority', 'string', round(m * 100 / n, 6), false FROM n""",
)
def s1_profile(spark, d):
    path = shared_path(spark, "s1")
    _order_lines(spark, d, "\t").write.option("header", True).option("quote", "").option("sep", "\u0001").csv(path)
    df = delimited.read_typed(spark, path)
    return profile.schema_profile(df, ["o_orderstatus"]).withColumn("missing_pct", F.round("missing_pct", 6))


@query("s2_headed_csv", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment || ', \"quoted\"' AS c_mktsegment FROM customer")
def s2(spark, d):
    path = shared_path(spark, "s2")
    df = load(spark, d, "customer").select(
        "c_custkey", "c_name", "c_acctbal", F.concat("c_mktsegment", F.lit(', "quoted"')).alias("c_mktsegment")
    )
    sinks.write_csv(df, path)
    return delimited.read_headed(spark, path, df.schema)


@query(
    "s3_tolerant_scan",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 THEN 'ok' ELSE 'corrupt' END AS state FROM orders""",
)
def s3(spark, d):
    path = shared_path(spark, "s3")
    _order_lines(spark, d, ",").write.option("header", True).option("quote", "").option("sep", "\u0001").csv(path)
    schema = load(spark, d, "orders").select(*_ORDER_COLS).schema
    rows = delimited.read_tolerant(spark, path, schema)
    state = F.when(F.col(delimited.CORRUPT).isNull(), "ok").otherwise("corrupt")
    return rows.select("o_orderkey", state.alias("state"))


@query(
    "s4_header_probe",
    """SELECT 'n_nationkey' AS id_column, 'n_name,n_regionkey' AS target_columns, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS sample_row FROM nation ORDER BY n_nationkey LIMIT 1""",
)
def s4(spark, d):
    return delimited.header_probe(load(spark, d, "nation").orderBy("n_nationkey"))


@query(
    "s5_routed_files",
    "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 'test' ELSE 'train' END AS part FROM orders",
)
def s5(spark, d):
    base = shared_path(spark, "s5")
    orders = load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    sinks.write_csv(orders.filter("o_orderstatus = 'O'"), f"{base}/train_1.csv")
    # Another order of columns, and one more.
    moved = orders.filter("o_orderstatus NOT IN ('O', 'F')").select("o_totalprice", F.lit("x, y").alias("note"), "o_orderstatus", "o_orderkey")
    sinks.write_csv(moved, f"{base}/train_2.csv")
    sinks.write_csv(orders.filter("o_orderstatus = 'F'"), f"{base}/shop_test.csv")
    train, test = delimited.route_files(spark, f"{base}/*.csv", orders.schema)
    return train.select("o_orderkey", "o_totalprice", F.lit("train").alias("part")).unionByName(
        test.select("o_orderkey", "o_totalprice", F.lit("test").alias("part"))
    )


def _zip_group(rows: pd.DataFrame) -> pd.DataFrame:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("readme.txt", "no table")
        archive.writestr("data/part.csv", "\n".join(rows["line"]))
        archive.writestr("later.tsv", "ignored")
    return pd.DataFrame({"path": [f"{rows['bucket'].iloc[0]}.zip"], "content": [buffer.getvalue()]})


@query(
    "s6_archive_lines",
    """WITH l AS (SELECT o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority AS line FROM orders)
       SELECT kind, line FROM l, (VALUES ('zip'), ('gzip'), ('plain')) k(kind)""",
)
def s6(spark, d):
    base = shared_path(spark, "s6")
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    orders.write.csv(f"{base}/plain")
    orders.write.option("compression", "gzip").csv(f"{base}/gz")
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in orders.columns])
    # About 500 lines per archive, however large the table is.
    packed = (
        orders.select(F.floor(F.col("o_orderkey") / 500).alias("bucket"), line.alias("line"))
        .groupBy("bucket")
        .applyInPandas(_zip_group, "path string, content binary")
    )
    kind = F.when(files.archive_kind(F.col("content"), F.col("path")) == "zip", F.col("path")).alias("path")
    zipped = files.expand_archives(packed.select(kind, "content")).select(F.lit("zip").alias("kind"), "line")
    found = files.archive_lines(spark, base)
    return zipped.unionByName(
        found.select(F.when(F.endswith("path", F.lit(".gz")), "gzip").otherwise("plain").alias("kind"), "line")
    )


@query(
    "s7_json_documents",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events",
)
def s7(spark, d):
    path = shared_path(spark, "s7")
    events = load(spark, d, "events")
    doc = F.struct("event_id", "event_type", F.from_json("props", "k bigint").alias("props"))
    sinks.write_json(events.select(doc.alias("doc")).select("doc.*"), path)
    df = files.read_json_documents(spark, path, "event_id bigint, event_type string, props struct<k:bigint>")
    return df.select("event_id", "props.k", "event_type")


@query("s8_file_listing", "SELECT count(DISTINCT o_orderstatus) AS n_files, true AS all_filled FROM orders")
def s8(spark, d):
    path = shared_path(spark, "s8")
    orders = load(spark, d, "orders")
    # A status goes to one file each, or to several where it holds much.
    orders.hint("rebalance", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    listed = files.list_files(spark, path).filter(F.endswith("name", F.lit(".parquet")))
    return listed.agg(F.count("*").alias("n_files"), F.bool_and(F.col("bytes") > 0).alias("all_filled"))


@query("s9_pages_source", "SELECT page_id, url, md5(html) AS digest FROM pages")
def s9(spark, d):
    return load(spark, d, "pages").select("page_id", "url", F.md5("html").alias("digest"))


@query(
    "s10_flattened_notebooks",
    "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest, count(*) AS n FROM conversations GROUP BY conv_id",
)
def s10(spark, d):
    turns = load(spark, d, "conversations")
    texts = files.ordered_text(turns, "conv_id", "turn", "text").select("conv_id", F.md5("text").alias("digest"))
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    return texts.join(counts, "conv_id")


@query(
    "s10_notebook_files",
    """SELECT count(*) AS n_cells, CAST(sum(length(text) + CASE WHEN role = 'user' THEN 2 * (1 + length(text) - length(replace(text, chr(10), ''))) ELSE 0 END) AS BIGINT) AS chars
       FROM conversations""",
)
def s10_files(spark, d):
    path = shared_path(spark, "s10")
    cell = F.struct(
        F.when(F.col("role") == "user", "markdown").otherwise("code").alias("cell_type"), F.array("text").alias("source")
    )
    cells = F.transform(
        F.array_sort(F.collect_list(F.struct("turn", cell.alias("cell")))), lambda s: s["cell"]
    )
    notebooks = load(spark, d, "conversations").groupBy("conv_id").agg(cells.alias("cells"))
    # One notebook per line of text files; each line is read as one document.
    sinks.write_json(notebooks, path)
    parsed = spark.read.text(path).select(files.notebook_cells(F.col("value")).alias("c"))
    code = parsed.select(F.explode("c").alias("text"))
    return code.agg(F.count("*").alias("n_cells"), F.sum(F.length("text")).alias("chars"))


_NOTEBOOK_CELL = """CASE WHEN role = 'user' THEN '# ' || replace(text, chr(10), chr(10) || '# ') ELSE text END"""


@query(
    "s10_notebook_stream",
    f"""SELECT conv_id, (conv_id % 5) || '.ipynb' AS name, md5(string_agg({_NOTEBOOK_CELL}, chr(10) || chr(10) ORDER BY turn)) AS digest
        FROM conversations WHERE conv_id % 7 <> 0 GROUP BY conv_id""",
)
def s10_stream(spark, d):
    """One notebook file per conversation, in two deliveries; names repeat between folders, every seventh file is broken."""
    base = shared_path(spark, "s10s")
    text = F.col("text")
    # Sources are lists of lines, or one text.
    lines = F.to_json(F.transform(F.split(text, "\n", -1), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("\n"), x))))
    whole = F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    source = F.when(F.col("turn") % 2 == 0, lines).otherwise(whole)
    kind = F.when(F.col("role") == "user", "markdown").otherwise("code")
    cell = F.concat(F.lit('{"cell_type":"'), kind, F.lit('","metadata":{},"source":'), source, F.lit("}"))
    turns = load(spark, d, "conversations").select("conv_id", F.struct("turn", cell.alias("cell")).alias("c"))
    # One file per row takes time, not bytes, so the configured parallelism is kept.
    turns = turns.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    cells = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["cell"]), ",")
    document = F.concat(F.lit('{"nbformat":4,"cells":['), cells, F.when(F.col("conv_id") % 7 == 0, F.lit("")).otherwise(F.lit("]}")))
    books = turns.groupBy("conv_id").agg(document.alias("value"))
    books = books.select(F.col("conv_id").alias("owner"), F.concat((F.col("conv_id") % 5).cast("string"), F.lit(".ipynb")).alias("notebook"), "value")
    for part in (0, 1):
        books.filter(F.col("owner") % 2 == part).write.mode("append").partitionBy("owner", "notebook").text(f"{base}/in")
        files.stream_notebooks(spark, f"{base}/in", f"{base}/out", f"{base}/state")
    found = spark.read.parquet(f"{base}/out")
    owner = F.regexp_extract("path", "/owner=([0-9]+)/", 1).cast("bigint")
    return found.select(owner.alias("conv_id"), "name", F.md5("text").alias("digest"))


@query(
    "s11_download_skip",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def s11(spark, d):
    wanted = load(spark, d, "documents").select("doc_id", "source")
    return joins.not_present(wanted, load(spark, d, "labels").select("doc_id"), ["doc_id"])


@query(
    "s12_stand_in",
    "SELECT count(*) AS n, true AS in_bounds, 5 AS n_letters FROM customer",
)
def s12(spark, d):
    fake = files.stand_in(load(spark, d, "customer"))
    inside = F.col("c_custkey").between(0, 99) & F.col("c_acctbal").between(0, 1) & F.col("c_nationkey").isNotNull()
    return fake.agg(
        F.count("*").alias("n"),
        F.bool_and(inside).alias("in_bounds"),
        F.count_distinct("c_mktsegment").cast("int").alias("n_letters"),
    )


@query("k1_csv_sink", "SELECT p_partkey, p_name, p_retailprice FROM part")
def k1(spark, d):
    path = shared_path(spark, "k1")
    df = load(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    sinks.write_csv(df, path)
    return delimited.read_headed(spark, path, df.schema)


@query("k2_append_resume", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def k2(spark, d):
    path = shared_path(spark, "k2")
    df = load(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    sinks.append_new(df.filter("o_orderdate < '1997-01-01'"), path, "o_orderkey")
    # The second run starts earlier than the first one ended.
    sinks.append_new(sinks.start_from(df, "o_orderdate", "1996-01-01"), path, "o_orderkey")
    return spark.read.parquet(path)


@query(
    "k2_rows_to_append",
    "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'",
)
def k2_anti(spark, d):
    df = load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    done = df.filter("o_orderdate < '1997-01-01'").select("o_orderkey")
    resumed = sinks.start_from(df, "o_orderdate", "1996-01-01").select("o_orderkey")
    return joins.not_present(resumed, done, ["o_orderkey"])


@query("k3_json_sink", "SELECT doc_id, lang, md5(text) AS digest FROM documents")
def k3(spark, d):
    path = shared_path(spark, "k3")
    sinks.write_json(load(spark, d, "documents").select("doc_id", "lang", "text"), path)
    back = spark.read.schema("doc_id bigint, lang string, text string").json(path)
    return back.select("doc_id", "lang", F.md5("text").alias("digest"))


@query(
    "k4_index_store",
    """WITH c AS (SELECT 's' || label AS v, 'subtype' AS col, 3.0::DOUBLE AS weight FROM embeddings UNION SELECT 't' || (vec_id % 2), 'type', 2.5 FROM embeddings
                  UNION SELECT CASE WHEN vec_id % 5 = 4 THEN 'Unknown' ELSE 'm' || (vec_id % 5) END, 'metric', 2.0 FROM embeddings UNION SELECT 'd' || (vec_id % 3), 'dataset', 1.0 FROM embeddings)
       SELECT col, v AS value, CAST(row_number() OVER (PARTITION BY col ORDER BY v) - 1 AS INT) AS idx, weight, (SELECT count(*) FROM embeddings) AS n_rows, 64 AS dim FROM c""",
)
def k4(spark, d):
    path = shared_path(spark, "k4")
    index = retrieve.index_rows(records(spark, d), "vec_id", "embedding", CATS, "slug")
    sinks.write_index(index, WEIGHTS, path, "given vectors")
    vectors, vocab, meta = sinks.read_index(spark, path)
    size = vectors.agg(F.count("*").alias("n")).scalar()
    dim = meta.select("dim").scalar()
    return vocab.select("col", "value", "idx", "weight", size.alias("n_rows"), dim.alias("dim"))


@query(
    "k5_submission",
    "SELECT doc_id, 0.0::DOUBLE AS w1, toxic, quality, 0.0::DOUBLE AS k15 FROM labels",
)
def k5(spark, d):
    return sinks.submission(load(spark, d, "labels"), "doc_id", ["w1", "toxic", "quality", "k15"])


@query(
    "k6_metrics_sink",
    """SELECT event_id AS epoch, value AS val_loss, value * 2 AS loss FROM events ORDER BY value, event_id LIMIT 1""",
)
def k6(spark, d):
    path = shared_path(spark, "k6")
    best = load(spark, d, "events").agg(F.min_by(F.struct("event_id", "value"), F.struct("value", "event_id")).alias("b"))
    result = best.select(
        F.col("b.event_id").alias("epoch"), F.col("b.value").alias("val_loss"), (F.col("b.value") * 2).alias("loss")
    )
    sinks.write_metrics(result, path)
    return spark.read.schema(result.schema).json(path)


@query("x1_incremental_ingest", "SELECT event_id, event_type, value FROM events")
def x1(spark, d):
    base = shared_path(spark, "x1")
    events = load(spark, d, "events")
    third = F.col("event_id") % 3
    events.filter(third == 0).write.parquet(f"{base}/in/first")
    events.filter(third <= 1).write.parquet(f"{base}/in/second")
    run = lambda: ingest.ingest(
        spark, f"{base}/in/*", events.schema, f"{base}/out", f"{base}/state", "event_id", "ts", 2
    )
    run()
    # The next delivery holds the rest and some rows again.
    events.filter(third != 1).write.parquet(f"{base}/in/third")
    run()
    return spark.read.parquet(f"{base}/out").select("event_id", "event_type", "value")


@query(
    "x1_index_refresh",
    """SELECT (SELECT count(*) FROM embeddings) AS n_rows, CAST(len(first(embedding)) AS INT) AS dim, 'm' AS model,
              count(DISTINCT label) AS n_values, 0::BIGINT AS lowest, count(DISTINCT label) - 1 AS highest FROM embeddings""",
)
def x1_index(spark, d):
    """Three deliveries, the last one a repeat with another day; only new records enter the index."""
    base = shared_path(spark, "x1i")
    records = load(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))
    day = F.to_timestamp(F.lit("2024-01-01"))
    deliveries = [records.filter("vec_id % 3 = 0"), records.filter("vec_id % 3 <= 1"), records]
    for n, rows in enumerate(deliveries):
        rows.withColumn("ts", F.date_add(day, n).cast("timestamp")).write.parquet(f"{base}/in/{n}")
        schema = spark.read.parquet(f"{base}/in/{n}").schema
        ingest.ingest_index(
            spark, f"{base}/in/*", schema, f"{base}/records", f"{base}/index", f"{base}/state", "vec_id", "ts", {"label": 2.0}, "m",
            lambda stored: stored.select("vec_id", "label", V.unit(V.as_double(F.col("vec"))).alias("vec")),
        )
    _, vocab, meta = sinks.read_index(spark, f"{base}/index")
    ends = vocab.agg(F.count("*").alias("n_values"), F.min("idx").cast("bigint").alias("lowest"), F.max("idx").cast("bigint").alias("highest"))
    one = one_row(ends)
    return meta.select("*", *[one[c].alias(c) for c in ends.columns])


_REPLIED = """WITH r AS (SELECT event_id, user_id % 20 AS slug, event_id % 11 AS k, CAST(value * 100 AS BIGINT) AS votes, event_type FROM events),
 ok AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 'tensorflow' ELSE 'pytorch' END AS tag FROM r WHERE k NOT IN (0, 1, 2)),
 best AS (SELECT *, row_number() OVER (PARTITION BY slug, tag ORDER BY votes DESC, 'u/' || lpad(event_id::VARCHAR, 9, '0')) AS n FROM ok)"""


@query(
    "x1_collected_records",
    _REPLIED
    + """ SELECT 's' || slug AS competition_slug, 'u/' || lpad(event_id::VARCHAR, 9, '0') AS kernel_ref, 'scale|' || k AS steps, tag AS library, 14 AS n_columns,
          (SELECT count(DISTINCT slug) FROM best WHERE n <= 3) AS n_slugs FROM best WHERE n <= 3""",
)
def x1_records(spark, d):
    """Collect, record and index in one run: replies are checked, the best kept, shaped, stored and indexed."""
    base = shared_path(spark, "x1r")
    k = F.col("event_id") % 11
    tag = F.when(F.col("event_type").isin("click", "view"), "tensorflow").otherwise("pytorch")
    fields = {c: F.lit("x") for c in replies.REQUIRED}
    fields |= {"used_technique": F.when(k == 1, "ML").otherwise("dl"), "library": F.initcap(tag), "target_column": F.array(F.lit("y"))}
    fields |= {"preprocessing_steps": F.array(F.lit("scale"), k.cast("string"))}
    reply = F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()]))
    raw = F.when(k == 0, F.lit("no reply")).when(k == 2, F.lit('{"library": "x"}')).when(k % 2 == 1, F.concat(F.lit("Sure: "), reply)).otherwise(reply)
    ref = F.concat(F.lit("u/"), F.lpad(F.col("event_id").cast("string"), 9, "0"))
    collected = load(spark, d, "events").select(
        F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string")).alias("competition_slug"), ref.alias("kernel_ref"),
        (F.col("value") * 100).cast("bigint").alias("votes"), raw.alias("raw"), tag.alias("tag"), F.lit("RMSE").alias("evaluation_metrics"),
        F.concat(F.lit("https://records.example/"), ref).alias("kernel_link"),
    )
    accepted, _ = rec.split_replies(collected)
    table = rec.as_records(rec.keep_best(accepted, "tag", 3))
    sinks.append_new(table, f"{base}/records", "kernel_ref")
    sinks.append_new(table, f"{base}/records", "kernel_ref")  # a second run adds nothing
    stored = spark.read.parquet(f"{base}/records")
    index = stored.select("kernel_ref", "competition_slug", "library", F.array(F.lit(1.0), F.lit(0.0)).alias("vec"))
    sinks.write_index(index, {"competition_slug": 1.0, "library": 2.0}, f"{base}/index", "m")
    _, vocabulary, _ = sinks.read_index(spark, f"{base}/index")
    slugs = vocabulary.filter("col = 'competition_slug'").agg(F.count("*")).scalar()
    steps = F.array_join("preprocessing_steps", "|")
    return stored.select("competition_slug", "kernel_ref", steps.alias("steps"), F.lower("library").alias("library"), F.lit(len(stored.columns)).alias("n_columns"),
                         slugs.alias("n_slugs"))


@query(
    "k2_first_copy",
    "SELECT o_orderkey, 'first' AS copy FROM orders",
)
def k2_first(spark, d):
    path = shared_path(spark, "k2f")
    orders = load(spark, d, "orders").select("o_orderkey")
    both = orders.withColumn("copy", F.lit("first")).union(orders.withColumn("copy", F.lit("second")))
    sinks.append_new(both, path, "o_orderkey")
    sinks.append_new(orders.withColumn("copy", F.lit("later")), path, "o_orderkey")
    return spark.read.parquet(path)
