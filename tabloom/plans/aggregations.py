"""Aggregations and profiles (A)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tabloom.operators import aggregate, compaction, encoders, profile
from tabloom.operators.quantiles import exact_quantiles, quantile_name
from tabloom.plans.common import load, r6, with_nulls
from tabloom.plans.registry import query

_TABLES = {
    "lineitem": 11, "orders": 6, "customer": 5, "supplier": 4, "part": 6, "nation": 3, "region": 2, "events": 6,
    "documents": 5, "labels": 3, "embeddings": 3, "pages": 3, "benchmark": 2, "conversations": 4,
}


@query(
    "a1_shape",
    " UNION ALL ".join(
        f"SELECT '{t}' AS file, count(*) AS n_rows, (SELECT CAST(count(*) AS INT) FROM (DESCRIBE SELECT * FROM {t})) AS n_cols FROM {t}"
        for t in _TABLES
    ),
)
def a1(spark, d):
    return reduce(lambda a, b: a.unionByName(b), [profile.shape(load(spark, d, t), t) for t in _TABLES])


def _sparse_orders(spark, d):
    df = with_nulls(load(spark, d, "orders"), "o_orderkey", "o_custkey", "o_totalprice")
    return with_nulls(df, "o_orderkey", "o_orderpriority", every=4)


_SPARSE_ORDERS = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS o_custkey, o_orderstatus,
      CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice, o_orderdate,
      CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders"""

_ORDER_TYPES = [
    ("o_orderkey", "int"), ("o_custkey", "float"), ("o_orderstatus", "string"),
    ("o_totalprice", "float"), ("o_orderdate", "datetime"), ("o_orderpriority", "string"),
]


@query(
    "a2_missing_pct",
    f"WITH t AS ({_SPARSE_ORDERS}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS missing_pct FROM t"
        for c, _ in _ORDER_TYPES
    ),
)
def a2(spark, d):
    return profile.missing_pct(_sparse_orders(spark, d)).withColumn("missing_pct", r6(F.col("missing_pct")))


@query(
    "a3_schema_profile",
    f"WITH t AS ({_SPARSE_ORDERS}) "
    + " UNION ALL ".join(
        f"""SELECT CAST({i} AS INT) AS position, '{c}' AS name, '{t}' AS type,
            round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS missing_pct,
            {str(c == "o_totalprice").lower()} AS is_target FROM t"""
        for i, (c, t) in enumerate(_ORDER_TYPES)
    ),
)
def a3(spark, d):
    return profile.schema_profile(_sparse_orders(spark, d), ["o_totalprice"]).withColumn(
        "missing_pct", r6(F.col("missing_pct"))
    )


@query(
    "a4_target_summary",
    f"""WITH t AS ({_SPARSE_ORDERS})
        SELECT 'o_totalprice' AS target, min(o_totalprice) AS min, round(median(o_totalprice), 6) AS median,
               max(o_totalprice) AS max, NULL::VARCHAR AS error FROM t
        UNION ALL SELECT 'o_rank', NULL, NULL, NULL, 'not found'""",
)
def a4(spark, d):
    return profile.numeric_summary(_sparse_orders(spark, d), ["o_totalprice", "o_rank"]).withColumn(
        "median", r6(F.col("median"))
    )


@query(
    "a4_all_targets",
    f"""WITH t AS ({_SPARSE_ORDERS})
        SELECT 'o_totalprice' AS target, 'min' AS entry, min(o_totalprice) AS value FROM t
        UNION ALL SELECT 'o_totalprice', 'median', round(median(o_totalprice), 6) FROM t
        UNION ALL SELECT 'o_totalprice', 'max', max(o_totalprice) FROM t
        UNION ALL SELECT 'o_rank', 'error: not found', NULL
        UNION ALL SELECT 'o_orderpriority', o_orderpriority, round(count(*) * 100.0::DOUBLE / (SELECT count(o_orderpriority) FROM t), 6) FROM t
                  WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""",
)
def a4_all(spark, d):
    out = profile.target_summary(_sparse_orders(spark, d), ["o_totalprice", "o_orderpriority", "o_rank"])
    return out.withColumn("value", r6(F.col("value")))


@query(
    "a5_class_distribution",
    """SELECT event_type AS class, round(count(*) * 100.0::DOUBLE / (SELECT count(event_type) FROM events), 6) AS pct
       FROM events WHERE event_type IS NOT NULL GROUP BY event_type""",
)
def a5(spark, d):
    return profile.class_distribution(load(spark, d, "events"), "event_type").withColumn("pct", r6(F.col("pct")))


@query(
    "a6_numbered_name_ranges",
    """WITH n AS (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier
                  UNION ALL SELECT p_name FROM part)
       SELECT regexp_extract(name, '^(.+?)(\\d+)$', 1) AS prefix,
              min(CAST(regexp_extract(name, '^(.+?)(\\d+)$', 2) AS BIGINT)) AS min_index,
              max(CAST(regexp_extract(name, '^(.+?)(\\d+)$', 2) AS BIGINT)) AS max_index, count(*) AS count
       FROM n WHERE regexp_matches(name, '^(.+?)(\\d+)$') GROUP BY 1""",
)
def a6(spark, d):
    names = load(spark, d, "customer").select(F.col("c_name").alias("name"))
    names = names.unionByName(load(spark, d, "supplier").select(F.col("s_name").alias("name")))
    names = names.unionByName(load(spark, d, "part").select(F.col("p_name").alias("name")))
    return profile.numbered_name_ranges(names)


@query(
    "a6_ranges_and_literals",
    """WITH n AS (SELECT 'customer' AS file, c_name AS name FROM customer UNION ALL SELECT 'part', p_name FROM part UNION ALL SELECT 'nation', n_name FROM nation),
            p AS (SELECT *, regexp_matches(name, '^(.+?)(\\d+)$') AS numbered, regexp_extract(name, '^(.+?)(\\d+)$', 1) AS prefix,
                         try_cast(regexp_extract(name, '^(.+?)(\\d+)$', 2) AS BIGINT) AS number FROM n),
            r AS (SELECT file, prefix, min(number) AS lo, max(number) AS hi, count(*) AS c FROM p WHERE numbered GROUP BY file, prefix),
            l AS (SELECT file, string_agg(DISTINCT name, '|' ORDER BY name) AS names FROM p WHERE NOT numbered GROUP BY file)
       SELECT f.file, (SELECT string_agg(prefix || ':' || lo || '-' || hi || ' ' || c, '|' ORDER BY prefix) FROM r WHERE r.file = f.file) AS ranges, l.names
       FROM (SELECT DISTINCT file FROM n) f LEFT JOIN l ON l.file = f.file""",
)
def a6_both(spark, d):
    """Range specifications and literal names in one result."""
    parts = [load(spark, d, t).select(F.lit(t).alias("file"), F.col(c).alias("name")) for t, c in (("customer", "c_name"), ("part", "p_name"), ("nation", "n_name"))]
    found = compaction.target_names(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["file"])
    text = F.transform("ranges", lambda r: F.format_string("%s:%d-%d %d", r["prefix"], r["min"], r["max"], r["count"]))
    return found.select("file", F.array_join(text, "|").alias("ranges"), F.array_join("names", "|").alias("names"))


_PROFILED = ("lines", "orders", "parts")
_C = [f"c_{i}" for i in range(60)]


def _profiled(spark, d):
    """Three files of one problem: a wide one, one of many classes, one of numbered classes and targets."""
    lines = load(spark, d, "lineitem").select("l_quantity", *[(F.col("l_discount") * i).alias(c) for i, c in enumerate(_C)])
    orders = load(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("customer"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("o_totalprice"),
    )
    klass = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(
        F.concat_ws("", F.col("p_partkey").cast("string"), F.lit("-F_"), (F.col("p_size") % 2).cast("string"), F.lit("_"), F.floor(F.col("p_partkey") / 4).cast("string"))
    )
    parts = load(spark, d, "part").select("p_partkey", klass.alias("klass"), *[F.col("p_size").alias(f"T_{i}") for i in (2, 3, 5)])
    yield "lines", lines, ["l_quantity"]
    yield "orders", orders, ["customer"]
    yield "parts", parts, ["klass", "T_2", "T_3", "T_5"]


def _entry_sql(name: str, kind: str, missing: str = "'0.0000'", target: bool = False) -> str:
    return f"""'{{"name":"{name}","type":"{kind}","missing_pct":' || {missing} || ',"is_target":{str(target).lower()}}}'"""


def _value_sql(e: str) -> str:
    return f"CAST(CAST({e} AS DECIMAL(18,4)) AS VARCHAR)"


def _ends_sql(col: str, table: str) -> str:
    """max, median and min, largest first; equal values by name."""
    return f"""(SELECT string_agg('{{"class":"' || e || '","value":' || {_value_sql("v")} || '}}', ',' ORDER BY v DESC, e)
      FROM (SELECT unnest(['min', 'median', 'max']) AS e, unnest([min({col})::DOUBLE, median({col})::DOUBLE, max({col})::DOUBLE]) AS v FROM {table}))"""


def _number_target_sql(name: str, col: str, table: str) -> str:
    return f"""'{{"target":"{name}","classes":[' || {_ends_sql(col, table)} || ']}}'"""


_DOCUMENT = f"""
WITH o AS (SELECT 'c' || o_custkey AS customer, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS price FROM orders),
p AS (SELECT p_size, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_partkey || '-F_' || (p_size % 2) || '_' || (p_partkey // 4) END AS klass, p_partkey, p_partkey % 3 = 0 AS other FROM part),
oc AS (SELECT customer, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM o) AS pct FROM o GROUP BY customer),
ot AS (SELECT *, row_number() OVER (ORDER BY pct DESC, customer) AS n FROM oc),
pc AS (SELECT klass, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM p) AS pct FROM p WHERE other GROUP BY klass),
pt AS (SELECT *, row_number() OVER (ORDER BY pct DESC, klass) AS n FROM pc),
pr AS (SELECT 'F_' || (p_size % 2) AS f, min(p_partkey // 4) AS lo, max(p_partkey // 4) AS hi, count(DISTINCT klass) AS c FROM p WHERE NOT other GROUP BY 1),
heads AS (
  SELECT 'lines' AS file, '{{"file_name":"lines","shape":{{"rows":' || (SELECT count(*) FROM lineitem) || ',"cols":61}}' AS head, '"targets":{{"ranges":[],"names":["l_quantity"]}}}}' AS tail,
    '"dataset_schema":[' || {_entry_sql("l_quantity", "float", target=True)} || ',' || {_entry_sql("c_0–c_59 (60 cols)", "float")} || '],"target_summary":[{{"target":"l_quantity","classes":['
    || {_ends_sql("l_quantity", "lineitem")} || ']}}]' AS body
  UNION ALL SELECT 'orders', '{{"file_name":"orders","shape":{{"rows":' || (SELECT count(*) FROM o) || ',"cols":3}}', '"targets":{{"ranges":[],"names":["customer"]}}}}',
    '"dataset_schema":[' || {_entry_sql("o_orderkey", "int")} || ',' || {_entry_sql("customer", "string", target=True)} || ','
    || {_entry_sql("o_totalprice", "float", _value_sql("(SELECT (count(*) - count(price)) * 100.0::DOUBLE / count(*) FROM o)"))} || '],"target_summary":[{{"target":"customer","classes":['
    || (SELECT string_agg('{{"class":"' || customer || '","value":' || {_value_sql("pct")} || '}}', ',' ORDER BY n) FROM ot WHERE n <= 50)
    || (SELECT CASE WHEN count(*) > 50 THEN ',{{"class":"... +' || (count(*) - 50) || ' more"}}' ELSE '' END FROM oc) || ']}}]'
  UNION ALL SELECT 'parts', '{{"file_name":"parts","shape":{{"rows":' || (SELECT count(*) FROM p) || ',"cols":5}}', '"targets":{{"ranges":[{{"prefix":"T_","min":2,"max":5,"count":3}}],"names":["klass"]}}}}',
    '"dataset_schema":[' || {_entry_sql("p_partkey", "int")} || ',' || {_entry_sql("klass", "string", target=True)} || ',' || {" || ',' || ".join(_entry_sql(f"T_{i}", "int", target=True) for i in (2, 3, 5))}
    || '],"target_summary":[' || {" || ',' || ".join(_number_target_sql(f"T_{i}", "p_size", "p") for i in (2, 3, 5))}
    || ',{{"target":"klass","classes":[' || (SELECT string_agg('{{"class":"' || f || '_' || lo || '–' || f || '_' || hi || ' (' || c || ' classes)"}}', ',' ORDER BY f) FROM pr) || ','
    || (SELECT string_agg('{{"class":"' || klass || '","value":' || {_value_sql("pct")} || '}}', ',' ORDER BY n) FROM pt WHERE n <= 50) || (SELECT CASE WHEN count(*) > 50 THEN ',{{"class":"... +' || (count(*) - 50) || ' more"}}' ELSE '' END FROM pc) || ']}}]'),
both_ AS (SELECT file, head || ',' || body || ',' || tail AS full_, head || ',' || tail AS brief FROM heads),
fits AS (SELECT *, sum(length(full_)) OVER (ORDER BY file) + coalesce(sum(length(brief)) OVER (ORDER BY file ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) <= {{budget}} AS fits FROM both_)
SELECT 'shop' AS problem, '{{"files":[' || string_agg(CASE WHEN fits THEN full_ ELSE brief END, ',' ORDER BY file) || ']}}' AS document, count(*) FILTER (fits) AS n_full FROM fits
"""


def _documents(spark, d, budget):
    schema = shapes = summary = None
    for file, df, targets in _profiled(spark, d):
        named = lambda x, file=file: x.withColumns({"problem": F.lit("shop"), "file": F.lit(file)})
        own = named(profile.schema_profile(df, targets)), named(profile.shape(df, file)), named(profile.target_summary(df, targets))
        schema, shapes, summary = own if schema is None else [a.unionByName(b) for a, b in zip((schema, shapes, summary), own)]
    return compaction.documents(schema, shapes, summary, budget=budget)


@query("w3_profile_document", _DOCUMENT.replace("{budget}", "1000000"))
def w3_document(spark, d):
    """Whole profiles of three files as one JSON document."""
    return _documents(spark, d, 1_000_000)


@query("w3_profile_under_budget", _DOCUMENT.replace("{budget}", "3000"))
def w3_budget(spark, d):
    """The same files under a budget that holds some of them in brief."""
    return _documents(spark, d, 3000)


@query(
    "a7_class_run_ranges",
    """WITH g AS (SELECT 'F_' || (p_size % 4 + 1) AS f, p_partkey // 4 AS idx FROM part)
       SELECT f || '_' || min(idx) || '–' || f || '_' || max(idx) || ' (' || count(*) || ' classes)' AS class,
              count(*) AS n FROM g GROUP BY f""",
)
def a7(spark, d):
    classes = load(spark, d, "part").select(
        F.concat(
            F.col("p_partkey").cast("string"), F.lit("-F_"), (F.col("p_size") % 4 + 1).cast("string"),
            F.lit("_"), F.floor(F.col("p_partkey") / 4).cast("string"),
        ).alias("class")
    )
    return profile.class_run_ranges(classes.unionByName(load(spark, d, "nation").select(F.col("n_name").alias("class"))))


@query(
    "a8_file_summary",
    """SELECT 'orders' AS file, count(*) AS n_rows, CAST(6 AS INT) AS n_cols, 'o_totalprice' AS targets FROM orders
       UNION ALL SELECT 'labels', count(*), 3, 'quality,toxic' FROM labels
       UNION ALL SELECT 'nation', count(*), 3, '' FROM nation""",
)
def a8(spark, d):
    targets = {"orders": ["o_totalprice"], "labels": ["quality", "toxic"], "nation": []}
    profiles = [
        profile.schema_profile(load(spark, d, t), cols).withColumn("file", F.lit(t)) for t, cols in targets.items()
    ]
    shapes = [profile.shape(load(spark, d, t), t) for t in targets]
    union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    return profile.file_summary(union(profiles), union(shapes)).withColumn("targets", F.array_join("targets", ","))


@query(
    "a9_median",
    """SELECT round(median(l_quantity), 6) AS l_quantity, round(median(l_extendedprice), 6) AS l_extendedprice
       FROM lineitem""",
)
def a9(spark, d):
    q = exact_quantiles(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], [0.5])
    return q.select(*[r6(F.col(quantile_name(c, 0))).alias(c) for c in ("l_quantity", "l_extendedprice")])


@query(
    "a10_mode",
    """SELECT (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS o_orderpriority,
              (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS o_orderstatus,
              (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS o_custkey""",
)
def a10(spark, d):
    return encoders.most_frequent(load(spark, d, "orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"])


@query(
    "a11_mean_std",
    """SELECT round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_pop(l_quantity), 6) AS l_quantity_std,
              round(avg(l_extendedprice), 6) AS l_extendedprice_mean,
              round(stddev_pop(l_extendedprice), 6) AS l_extendedprice_std,
              1.0::DOUBLE AS one_mean, 1.0::DOUBLE AS one_std FROM lineitem""",
)
def a11(spark, d):
    df = load(spark, d, "lineitem").withColumn("one", F.lit(1.0))
    stats = aggregate.mean_std(df, ["l_quantity", "l_extendedprice", "one"])
    return stats.select(*[r6(F.col(c)).alias(c) for c in stats.columns])


@query(
    "a12_distinct_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM part"
        for c in ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    ),
)
def a12(spark, d):
    return aggregate.distinct_counts(load(spark, d, "part"), ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"])


@query(
    "a13_sorted_vocabulary",
    """SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS idx
       FROM (SELECT DISTINCT c_name AS value FROM customer)""",
)
def a13(spark, d):
    return encoders.sorted_vocabulary(load(spark, d, "customer"), "c_name")


@query(
    "a14_class_weights",
    """SELECT c.class, round(coalesce((SELECT count(*) FROM labels) / (2.0::DOUBLE * nullif(count(l.doc_id), 0)), 1.0), 6) AS weight
       FROM (SELECT 0 AS class UNION ALL SELECT 1 UNION ALL SELECT 2) c LEFT JOIN labels l ON l.toxic = c.class
       GROUP BY c.class""",
)
def a14(spark, d):
    labels = load(spark, d, "labels").withColumn("toxic", F.col("toxic").cast("int"))
    classes = spark.range(3).select(F.col("id").cast("int").alias("class"))
    return aggregate.class_weights(labels, "toxic", classes).withColumn("weight", r6(F.col("weight")))


@query(
    "a15_all_non_negative",
    "SELECT bool_and(c_acctbal >= 0) AS c_acctbal, bool_and(c_custkey >= 0) AS c_custkey FROM customer",
)
def a15(spark, d):
    return aggregate.all_non_negative(load(spark, d, "customer"), ["c_acctbal", "c_custkey"])


@query(
    "a16_quantile",
    """SELECT round(quantile_cont(epoch_us(o_orderdate)::DOUBLE, 0.8), 0) AS cutoff_us,
              round(quantile_cont(o_totalprice, 0.2), 6) AS price_20 FROM orders""",
)
def a16(spark, d):
    df = load(spark, d, "orders").select(F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"), "o_totalprice")
    q = exact_quantiles(df, ["us", "o_totalprice"], [0.8, 0.2])
    return q.select(
        F.round(quantile_name("us", 0), 0).alias("cutoff_us"), r6(F.col(quantile_name("o_totalprice", 1))).alias("price_20")
    )


@query(
    "a17_kept_counts",
    """SELECT user_id, count(*) FILTER (event_type = 'click') AS click,
              count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'error') AS error
       FROM events GROUP BY user_id""",
)
def a17(spark, d):
    return aggregate.kept_counts(load(spark, d, "events"), "user_id", "event_type", ["click", "purchase", "error"])


@query(
    "a18_best_epoch",
    """WITH h AS (SELECT user_id, event_id AS epoch, value AS val_loss, value * 2 AS loss FROM events)
       SELECT user_id, epoch, loss, val_loss FROM h
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY val_loss, epoch) = 1""",
)
def a18(spark, d):
    history = load(spark, d, "events").select(
        "user_id", F.col("event_id").alias("epoch"), F.col("value").alias("val_loss"), (F.col("value") * 2).alias("loss")
    )
    return aggregate.best_epoch(history, "user_id", "val_loss", ["loss", "val_loss"])


@query(
    "a19_row_shares",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_discount, l_tax, l_discount + l_tax AS s FROM lineitem)
       SELECT l_orderkey, l_linenumber, round(coalesce(l_discount / nullif(s, 0), 0), 6) AS discount_share,
              round(coalesce(l_tax / nullif(s, 0), 0), 6) AS tax_share FROM t""",
)
def a19(spark, d):
    df = load(spark, d, "lineitem")
    shares = aggregate.row_shares(df, ["l_discount", "l_tax"])
    return df.select(
        "l_orderkey",
        "l_linenumber",
        r6(shares["l_discount"]).alias("discount_share"),
        r6(shares["l_tax"]).alias("tax_share"),
    )


@query(
    "a20_min_max",
    """SELECT min(p_retailprice) AS p_retailprice_min, max(p_retailprice) AS p_retailprice_max,
              min(p_size) AS p_size_min, max(p_size) AS p_size_max FROM part""",
)
def a20(spark, d):
    return aggregate.min_max(load(spark, d, "part"), ["p_retailprice", "p_size"])
