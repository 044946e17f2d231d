"""Windows and splits (W, T19, T20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import profile, windows
from tabloom.plans.common import load, r6, with_nulls
from tabloom.plans.registry import query


@query(
    "w1_top_per_group",
    """SELECT user_id, event_type, event_id, value, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS INT) AS rank
       FROM events WHERE upper(CASE WHEN value > 1 THEN 'dl' ELSE 'ml' END) = 'DL'
       QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) <= 3""",
)
def w1(spark, d):
    df = load(spark, d, "events").filter(F.upper(F.when(F.col("value") > 1, "dl").otherwise("ml")) == "DL")
    top = windows.top_per_group(df, ["user_id", "event_type"], "value", "event_id", 3)
    return top.select("user_id", "event_type", "event_id", "value", "rank")


_RUNS = """WITH s AS (SELECT o.l_orderkey, o.l_linenumber * 100000000000000000 + o.l_partkey * 1000000000000 + o.l_suppkey * 100000000 + CAST(round(o.l_extendedprice * 100) AS BIGINT) AS position, 'F_' || o.l_linenumber AS name,
                             CASE WHEN o.l_returnflag = 'A' THEN 'int' ELSE 'float' END AS type, o.l_discount * 100 AS missing_pct,
                             o.l_tax > 0.06 AS is_target FROM lineitem o),
   p AS (SELECT *, CAST(substr(name, 3) AS INT) AS n,
                lag(type) OVER w AS pt, lag(CAST(substr(name, 3) AS INT)) OVER w AS pn FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY position)),
   g AS (SELECT *, sum(CASE WHEN type = pt AND n = pn + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY position) AS run FROM p)
   SELECT l_orderkey, CAST(run AS BIGINT) AS run, CASE WHEN count(*) = 1 THEN min(name) ELSE arg_min(name, position) || '–' || arg_max(name, position) || ' (' || count(*) || ' cols)' END AS name,
          min(type) AS type, round(avg(missing_pct), 6) AS missing_pct, bool_or(is_target) AS is_target, count(*) AS n
   FROM g GROUP BY l_orderkey, run"""


@query("w3_schema_runs", _RUNS)
def w3(spark, d):
    schema = load(spark, d, "lineitem").select(
        "l_orderkey",
        (
            F.col("l_linenumber") * 100000000000000000
            + F.col("l_partkey") * 1000000000000
            + F.col("l_suppkey") * 100000000
            + F.round(F.col("l_extendedprice") * 100).cast("bigint")
        ).alias("position"),
        F.concat(F.lit("F_"), F.col("l_linenumber").cast("string")).alias("name"),
        F.when(F.col("l_returnflag") == "A", "int").otherwise("float").alias("type"),
        (F.col("l_discount") * 100).alias("missing_pct"),
        (F.col("l_tax") > 0.06).alias("is_target"),
    )
    return profile.collapse_runs(schema, ["l_orderkey"]).withColumn("missing_pct", r6(F.col("missing_pct")))


_WIDE = [f"c_{i}" for i in range(60)]


@query(
    "w3_compact_schema",
    """SELECT * FROM (VALUES (1::BIGINT, 'l_quantity', 'float', 0.0::DOUBLE, true, 1::BIGINT),
                             (2::BIGINT, 'c_0–c_59 (60 cols)', 'float', 0.0::DOUBLE, false, 60::BIGINT))
       t(run, name, type, missing_pct, is_target, n)""",
)
def w3_compact(spark, d):
    df = load(spark, d, "lineitem")
    wide = df.select("l_quantity", *[(F.col("l_discount") * i).alias(c) for i, c in enumerate(_WIDE)])
    return profile.compact_schema(profile.schema_profile(wide, ["l_quantity"]))


@query(
    "w4_top_classes",
    """WITH s AS (SELECT o_custkey AS class, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders) AS pct FROM orders GROUP BY 1),
            r AS (SELECT *, row_number() OVER (ORDER BY pct DESC, class) AS rn FROM s)
       SELECT CAST(class AS VARCHAR) AS class, round(pct, 6) AS pct FROM r WHERE rn <= 50
       UNION ALL SELECT '... +' || (count(*) - 50) || ' more', NULL FROM s HAVING count(*) > 50""",
)
def w4(spark, d):
    shares = profile.class_distribution(load(spark, d, "orders"), "o_custkey")
    return profile.top_classes(shares).withColumn("pct", r6(F.col("pct")))


@query(
    "w5_group_median_fill",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS q FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(q, median(q) OVER (PARTITION BY l_returnflag, l_linestatus), (SELECT median(q) FROM t)) AS l_quantity FROM t""",
)
def w5(spark, d):
    df = with_nulls(load(spark, d, "lineitem"), "l_orderkey", "l_quantity")
    return windows.group_median_fill(df, ["l_returnflag", "l_linestatus"], "l_quantity").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"
    )


@query(
    "w6_ordered_target_statistics",
    """WITH t AS (SELECT o_orderkey, o_orderpriority, o_totalprice / 1000 AS y, (SELECT avg(o_totalprice / 1000) FROM orders) AS prior FROM orders)
       SELECT o_orderkey, round((coalesce(sum(y) OVER w, 0) + prior) / (count(*) OVER w + 1), 6) AS encoded FROM t
       WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def w6(spark, d):
    df = load(spark, d, "orders").withColumn("y", F.col("o_totalprice") / 1000)
    return windows.ordered_target_statistics(df, "o_orderpriority", "y", ["o_orderkey"], "encoded").select(
        "o_orderkey", r6(F.col("encoded")).alias("encoded")
    )


@query(
    "w7_tail_split",
    """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey DESC) <= floor(0.2 * count(*) OVER ()) THEN 'valid' ELSE 'train' END AS part
       FROM orders""",
)
def w7(spark, d):
    return windows.tail_split(load(spark, d, "orders"), "o_orderkey").select("o_orderkey", "part")


@query(
    "w8_chronological_split",
    """WITH q AS (SELECT quantile_cont(epoch_us(o_orderdate)::DOUBLE, 0.8) AS cut FROM orders)
       SELECT o_orderkey, CASE WHEN epoch_us(o_orderdate)::DOUBLE < cut THEN 'train' ELSE 'valid' END AS part FROM orders, q""",
)
def w8(spark, d):
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return windows.cut_at_quantile(load(spark, d, "orders"), us, 0.8).select("o_orderkey", "part")


@query(
    "t19_hash_split",
    """SELECT o_orderkey, CASE WHEN ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 100 < 80 THEN 'train' ELSE 'valid' END AS part
       FROM orders""",
)
def t19(spark, d):
    return windows.hash_split(load(spark, d, "orders"), "o_orderkey").select("o_orderkey", "part")


@query(
    "t20_stratified_split",
    """SELECT event_id, event_type, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR), event_id)
                 <= floor(0.2 * count(*) OVER (PARTITION BY event_type)) THEN 'valid' ELSE 'train' END AS part FROM events""",
)
def t20(spark, d):
    return windows.stratified_split(load(spark, d, "events"), "event_id", "event_type").select(
        "event_id", "event_type", "part"
    )
