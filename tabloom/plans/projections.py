"""Projections, filters and predicates (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import scalars as S
from tabloom.operators import encoders, project
from tabloom.plans.common import load, r6, with_nulls
from tabloom.plans.registry import query


@query("p1_drop_columns", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def p1(spark, d):
    return project.drop_columns(load(spark, d, "customer"), ["c_name", "c_acctbal", "absent"])


@query("p2_add_missing", "SELECT *, 0 AS p_tax, 0 AS p_stock FROM part")
def p2(spark, d):
    return project.add_missing(load(spark, d, "part"), {"p_tax": 0, "p_stock": 0, "p_size": 0})


@query(
    "p3_align_columns",
    "SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer",
)
def p3(spark, d):
    train = load(spark, d, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    test = load(spark, d, "customer").select(
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_name").alias("name"),
        F.col("c_custkey").alias("key"),
    )
    return project.align_to(test, train)


@query("p4_columns_by_prefix", "SELECT l_extendedprice, l_discount, l_linenumber, l_linestatus FROM lineitem")
def p4(spark, d):
    df = load(spark, d, "lineitem")
    return df.select(*project.columns_by_prefix(df, ("l_ext", "l_disc", "l_line")))


@query(
    "p5_columns_by_type",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax
       FROM lineitem""",
)
def p5(spark, d):
    df = load(spark, d, "lineitem")
    return df.select(*project.numeric_columns(df))


@query("p6_drop_all_null", "SELECT * FROM orders")
def p6(spark, d):
    df = load(spark, d, "orders").withColumn("o_clerk", F.lit(None).cast("double"))
    return project.drop_all_null(df)


@query("p7_drop_high_cardinality", "SELECT p_partkey, p_brand, p_type, p_size, p_retailprice FROM part")
def p7(spark, d):
    df = load(spark, d, "part").drop("p_name").withColumn("p_label", F.concat("p_type", F.lit(" "), F.col("p_partkey").cast("string")))
    return project.drop_high_cardinality(df)


@query(
    "p8_quality_filter",
    """SELECT event_id, user_id, event_type FROM events
       WHERE upper(CASE WHEN value > 5 THEN 'dl' ELSE 'ML' END) = 'DL' AND lower(upper(event_type)) = 'click'""",
)
def p8(spark, d):
    df = load(spark, d, "events").withColumns(
        {
            "technique": F.when(F.col("value") > 5, "dl").otherwise("ML"),
            "library": F.upper("event_type"),
        }
    )
    return project.quality_filter(df, "technique", "library", "click").select("event_id", "user_id", "event_type")


@query(
    "p9_iqr_filter",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice * l_extendedprice AS y FROM lineitem),
            q AS (SELECT quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM p)
       SELECT p.l_orderkey, p.l_linenumber, p.y FROM p, q
       WHERE y BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
)
def p9(spark, d):
    df = load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") * F.col("l_extendedprice")).alias("y")
    )
    return project.iqr_filter(df, "y")


@query(
    "p10_unseen_to_sentinel",
    """SELECT c_custkey,
              CASE WHEN c_custkey % 7 = 0 OR c_mktsegment NOT IN
                   (SELECT c_mktsegment FROM customer WHERE c_mktsegment < 'H') THEN 'Missing'
                   ELSE c_mktsegment END AS c_mktsegment
       FROM customer""",
)
def p10(spark, d):
    df = with_nulls(load(spark, d, "customer"), "c_custkey", "c_mktsegment")
    seen = load(spark, d, "customer").filter(F.col("c_mktsegment") < "H")
    vocabulary = encoders.sorted_vocabulary(seen, "c_mktsegment").select("value")
    return project.unseen_to(df.select("c_custkey", "c_mktsegment"), "c_mktsegment", vocabulary, "Missing")


@query("p11_threshold", "SELECT l_orderkey, l_linenumber, CAST(l_discount * 10 > 0.5 AS INT) AS flag FROM lineitem")
def p11(spark, d):
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", S.threshold(F.col("l_discount") * 10).alias("flag")
    )


@query(
    "p12_flags",
    """SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INT) AS is_returned,
              CAST(l_linenumber IN (5, 6) AS INT) AS is_late FROM lineitem""",
)
def p12(spark, d):
    return load(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_returnflag") == "R").cast("int").alias("is_returned"),
        F.col("l_linenumber").isin(5, 6).cast("int").alias("is_late"),
    )


@query("p13_insert_id", "SELECT doc_id AS id, quality AS target FROM labels")
def p13(spark, d):
    return load(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("target"))


@query(
    "p14_bare_reference",
    """SELECT page_id, split_part(substr(url, strpos(url, '://') + 3 + length(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) + 1), '?', 1) AS ref
       FROM pages""",
)
def p14(spark, d):
    url = F.col("url")
    return load(spark, d, "pages").select("page_id", S.bare_reference(url, S.url_host(url)).alias("ref"))


@query("p15_shift_labels", "SELECT vec_id, label - 1 AS shifted, label - 1 + 1 AS restored FROM embeddings")
def p15(spark, d):
    down = project.shift(F.col("label"), -1)
    return load(spark, d, "embeddings").select(
        "vec_id", down.alias("shifted"), project.shift(down, 1).alias("restored")
    )


_P16_COLS = ["l_orderkey", "l_quantity", "l_tax", "l_returnflag"]


@query(
    "p16_quality_gate",
    """WITH t AS (SELECT l_orderkey, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity,
                         CASE WHEN l_linenumber = 3 THEN 'NaN'::DOUBLE ELSE l_tax END AS l_tax, l_returnflag FROM lineitem)
       SELECT 'l_orderkey' AS "column", count(*) FILTER (l_orderkey IS NULL) AS bad FROM t
       UNION ALL SELECT 'l_quantity', count(*) FILTER (l_quantity IS NULL OR isnan(l_quantity)) FROM t
       UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax IS NULL OR isnan(l_tax)) FROM t
       UNION ALL SELECT 'l_returnflag', count(*) FILTER (l_returnflag IS NULL) FROM t""",
)
def p16(spark, d):
    df = with_nulls(load(spark, d, "lineitem"), "l_orderkey", "l_quantity").withColumn(
        "l_tax", F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    )
    return project.bad_cells(df.select(*_P16_COLS))


@query("p16_require_clean", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem")
def p16_clean(spark, d):
    return project.require_clean(load(spark, d, "lineitem").select(*_P16_COLS)).agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@query(
    "p17_missing_cells",
    """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS VARCHAR) END AS p_size,
                         CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS p_brand FROM part)
       SELECT p_partkey, 'p_size' AS "column", p_partkey || '-p_size' AS cell FROM t WHERE p_size IS NULL
       UNION ALL SELECT p_partkey, 'p_brand', p_partkey || '-p_brand' FROM t WHERE p_brand IS NULL""",
)
def p17(spark, d):
    df = with_nulls(load(spark, d, "part"), "p_partkey", "p_size")
    df = with_nulls(df, "p_partkey", "p_brand", every=5)
    return project.missing_cells(df, "p_partkey", ["p_size", "p_brand"])
