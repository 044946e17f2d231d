"""Joins J4 to J7, sorts (O) and set operations (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import scalars as S
from tabloom.functions import vectors as V
from tabloom.operators import encoders, joins, profile, tags, windows
from tabloom.plans.common import load, r6, with_nulls
from tabloom.plans.registry import query


@query(
    "j4_vocabulary_lookup",
    """WITH v AS (SELECT c_mktsegment AS value, row_number() OVER (ORDER BY c_mktsegment) - 1 AS idx FROM (SELECT DISTINCT c_mktsegment FROM customer))
       SELECT c_custkey, CAST(idx AS INT) AS segment FROM customer LEFT JOIN v ON value = c_mktsegment""",
)
def j4(spark, d):
    df = load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    vocabulary = encoders.sorted_vocabulary(df, "c_mktsegment")
    return encoders.encode(df, "c_mktsegment", vocabulary, "segment").select("c_custkey", "segment")


@query(
    "j5_bind_columns",
    "SELECT o_orderkey, o_totalprice / 1000 AS price, o_custkey * 2 AS cust FROM orders",
)
def j5(spark, d):
    orders = load(spark, d, "orders")
    left = orders.select("o_orderkey", (F.col("o_totalprice") / 1000).alias("price"))
    return joins.bind_columns(left, orders.select("o_orderkey", (F.col("o_custkey") * 2).alias("cust")), "o_orderkey")


@query(
    "j6_cell_lookup",
    """SELECT s_suppkey, cell, CASE s_suppkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_brand ELSE p_type END AS value
       FROM (SELECT s_suppkey, s_suppkey || '-' || CASE s_suppkey % 3 WHEN 0 THEN 'p_size' WHEN 1 THEN 'p_brand' ELSE 'p_type' END AS cell FROM supplier)
       JOIN part ON p_partkey = s_suppkey""",
)
def j6(spark, d):
    column = (
        F.when(F.col("s_suppkey") % 3 == 0, "p_size").when(F.col("s_suppkey") % 3 == 1, "p_brand").otherwise("p_type")
    )
    asked = load(spark, d, "supplier").select(
        "s_suppkey", F.concat_ws("-", F.col("s_suppkey").cast("string"), column).alias("cell")
    )
    return joins.cell_lookup(asked, F.col("cell"), load(spark, d, "part"), "p_partkey", ["p_size", "p_brand", "p_type"])


def _part_tags(spark, d):
    subtype = (
        F.when(F.col("p_size") < 20, "binary-classification")
        .when(F.col("p_size") < 35, "continuous-regression")
        .otherwise("time-series-forecasting")
    )
    kind = F.when(F.col("p_size") < 20, "classification").otherwise("regression")
    return load(spark, d, "part").select(
        "p_partkey",
        tags.problem_tags(
            kind,
            subtype,
            F.col("p_type") == "PROMO",
            F.col("p_size") >= 40,
            F.col("p_size") * 2,
            F.col("p_partkey") % 7 == 0,
        ).alias("tags"),
    )


_TAGS = """SELECT p_partkey, list_distinct(list_filter([
        CASE WHEN p_size < 20 THEN 'classification' ELSE 'regression' END,
        CASE WHEN p_size < 20 THEN 'binary' WHEN p_size < 35 THEN 'continuous' ELSE 'time' END,
        CASE WHEN p_size < 20 THEN 'classification' WHEN p_size < 35 THEN 'regression' ELSE 'series' END,
        CASE WHEN p_size >= 35 THEN 'forecasting' END,
        CASE WHEN p_type = 'PROMO' THEN 'text' WHEN p_size >= 40 THEN 'time-series' ELSE 'tabular' END,
        CASE WHEN p_size * 2 < 10 THEN 'low_features' WHEN p_size * 2 < 500 THEN 'medium_features' ELSE 'high_features' END,
        CASE WHEN p_partkey % 7 = 0 THEN 'missing-values' END], lambda x: x IS NOT NULL)) AS tags FROM part"""

_BANK = """SELECT * FROM (VALUES
   (0, 'synthetic_mlp', ['classification', 'multiclass', 'tabular', 'low_features', 'multi-label']),
   (1, 'tabular_classification', ['classification', 'multiclass', 'tabular', 'low_features', 'multi-label']),
   (2, 'ts_lstm_forecasting', ['time-series', 'forecasting', 'sequence']),
   (3, 'regression_mlp', ['regression', 'tabular', 'low_features', 'medium_features', 'missing-values'])) b(ord, name, tags)"""


@query(
    "j7_best_profile",
    f"""WITH t AS ({_TAGS}), b AS ({_BANK})
        SELECT p_partkey, arg_min(name, -len(list_intersect(t.tags, b.tags)) * 10 + ord) AS profile FROM t, b GROUP BY p_partkey""",
)
def j7(spark, d):
    return _part_tags(spark, d).select("p_partkey", tags.best_profile(F.col("tags")).alias("profile"))


@query(
    "u3_tag_overlap",
    f"WITH t AS ({_TAGS}), b AS ({_BANK}) SELECT p_partkey, CAST(len(list_intersect(t.tags, b.tags)) AS INT) AS shared FROM t JOIN b ON b.ord = 3",
)
def u3(spark, d):
    wanted = F.lit(tags.BANK[3]["tags"])
    return _part_tags(spark, d).select("p_partkey", F.size(F.array_intersect("tags", wanted)).alias("shared"))


@query(
    "u5_tag_set",
    f"SELECT p_partkey, array_to_string(list_sort(tags), ',') AS tags FROM ({_TAGS})",
)
def u5(spark, d):
    return _part_tags(spark, d).select("p_partkey", F.array_join(F.sort_array("tags"), ",").alias("tags"))


@query("o1_sort_by_date", "SELECT event_id, ts, value FROM events ORDER BY ts, event_id")
def o1(spark, d):
    return load(spark, d, "events").select("event_id", "ts", "value").orderBy("ts", "event_id")


@query(
    "o2_largest_shares",
    """SELECT p_brand AS class, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM part), 6) AS pct FROM part
       GROUP BY 1 ORDER BY count(*) DESC, class LIMIT 10""",
)
def o2(spark, d):
    shares = profile.class_distribution(load(spark, d, "part"), "p_brand")
    return shares.orderBy(F.desc("pct"), F.asc("class")).limit(10).withColumn("pct", r6(F.col("pct")))


_SCORES = "list_transform(embedding, lambda x: x::DOUBLE)"


def scores():
    """The components as class scores."""
    return V.as_double(F.col("embedding"))


@query(
    "o4_top3_classes",
    f"""SELECT vec_id, string_agg('c' || pos, ' ' ORDER BY s DESC, pos) AS top3 FROM (
          SELECT vec_id, s, pos FROM (SELECT vec_id, unnest({_SCORES}) AS s, unnest(range(len(embedding))) AS pos FROM embeddings)
          QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, pos) <= 3) GROUP BY vec_id""",
)
def o4(spark, d):
    top = F.transform(S.top_positions(scores(), 3), lambda i: F.concat(F.lit("c"), i.cast("string")))
    return load(spark, d, "embeddings").select("vec_id", F.array_join(top, " ").alias("top3"))


@query(
    "o5_argmax_class",
    f"SELECT vec_id, 'c' || (list_position({_SCORES}, list_max({_SCORES})) - 1) AS class FROM embeddings",
)
def o5(spark, d):
    classes = F.lit([f"c{i}" for i in range(64)])
    return load(spark, d, "embeddings").select("vec_id", F.element_at(classes, S.argmax(scores()) + 1).alias("class"))


@query(
    "o6_votes_page",
    """SELECT user_id, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INT) AS rank FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 50""",
)
def o6(spark, d):
    return windows.top_per_group(load(spark, d, "events"), ["user_id"], "value", "event_id", 50).select(
        "user_id", "event_id", "value", "rank"
    )


@query(
    "u1_union_all",
    "SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier",
)
def u1(spark, d):
    a = load(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    b = load(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return a.unionByName(b)


@query(
    "u2_joint_vocabulary",
    """SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS idx
       FROM (SELECT p_type AS value FROM part UNION SELECT c_mktsegment FROM customer)""",
)
def u2(spark, d):
    a = load(spark, d, "part").select(F.col("p_type").alias("v"))
    b = load(spark, d, "customer").select(F.col("c_mktsegment").alias("v"))
    return encoders.sorted_vocabulary(a.unionByName(b), "v")


@query(
    "u4_unseen_values",
    """SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000""",
)
def u4(spark, d):
    seen = load(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return joins.not_present(load(spark, d, "nation").select("n_nationkey").distinct(), seen, ["n_nationkey"])


@query(
    "t22_size_rules",
    """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'low_features' WHEN p_size < 500 THEN 'medium_features' ELSE 'high_features' END AS size,
              array_to_string(list_filter([least(p_size * 2, 1024), least(p_size, 1024), least(CAST(floor(p_size * 0.5) AS INT), 1024),
                                           least(CAST(floor(p_size * 0.25) AS INT), 1024)], lambda x: x >= 16), ',') AS widths FROM part""",
)
def t22(spark, d):
    n = F.col("p_size")
    widths = F.array_join(profile.layer_widths(n).cast("array<string>"), ",")
    return load(spark, d, "part").select("p_partkey", profile.size_class(n).alias("size"), widths.alias("widths"))


@query(
    "t23_fill_missing_cells",
    """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS p_retailprice,
                         CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS p_size FROM part),
            m AS (SELECT avg(p_retailprice) AS pm, stddev_pop(p_retailprice) AS ps, avg(p_size) AS zm, stddev_pop(p_size) AS zs FROM t)
       SELECT p_partkey, round(coalesce(p_retailprice, (p_partkey % 3 - 1) * ps + pm), 6) AS p_retailprice,
              round(coalesce(p_size, (p_partkey % 3 - 1) * zs + zm), 6) AS p_size FROM t, m""",
)
def t23(spark, d):
    from tabloom.operators.aggregate import mean_std
    from tabloom.session import one_row

    df = load(spark, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    df = with_nulls(with_nulls(df, "p_partkey", "p_retailprice"), "p_partkey", "p_size", every=5)
    cols = ["p_retailprice", "p_size"]
    guess = (F.col("p_partkey") % 3 - 1).cast("double")
    predicted = df.select("p_partkey", *[guess.alias(c) for c in cols])
    filled = joins.fill_missing_cells(df, predicted, "p_partkey", cols, one_row(mean_std(df, cols)))
    return filled.withColumns({c: r6(F.col(c)) for c in cols})


@query(
    "t24_embedding_width",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(least(50, count(DISTINCT {c}) // 2 + 1) AS INT) AS width FROM part"
        for c in ("p_name", "p_brand", "p_type")
    ),
)
def t24(spark, d):
    from tabloom.operators.aggregate import distinct_counts

    counts = distinct_counts(load(spark, d, "part"), ["p_name", "p_brand", "p_type"])
    return counts.select("column", profile.embedding_width(F.col("n_distinct")).alias("width"))
