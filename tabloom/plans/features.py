"""Feature transformers (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import scalars as S
from tabloom.operators import encoders, features, sparse, tokens, windows
from tabloom.plans.common import load, r6, with_nulls
from tabloom.plans.registry import query

_SPLIT = "('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 100 < 80"
_ORDERS = f"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority, o_orderstatus, {_SPLIT} AS train FROM orders"""


def _orders(spark, d):
    """Sparse orders with the hash split; transformers are fitted on the training part."""
    df = with_nulls(load(spark, d, "orders"), "o_orderkey", "o_totalprice")
    df = with_nulls(df, "o_orderkey", "o_orderpriority", every=5)
    return windows.hash_split(df, "o_orderkey").select(
        "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", (F.col("part") == "train").alias("train")
    )


@query(
    "t1_median_imputer",
    f"""WITH t AS ({_ORDERS}) SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM t WHERE train)), 6) AS o_totalprice FROM t""",
)
def t1(spark, d):
    df = _orders(spark, d)
    out = features.MedianImputer(["o_totalprice"]).fit(df.filter("train")).apply(df)
    return out.select("o_orderkey", r6(F.col("o_totalprice")).alias("o_totalprice"))


@query(
    "t2_mode_imputer",
    f"""WITH t AS ({_ORDERS}) SELECT o_orderkey, coalesce(o_orderpriority, (SELECT o_orderpriority FROM t WHERE train AND o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM t""",
)
def t2(spark, d):
    df = _orders(spark, d)
    return features.ModeImputer(["o_orderpriority"]).fit(df.filter("train")).apply(df).select("o_orderkey", "o_orderpriority")


@query(
    "t3_constant_imputer",
    f"""WITH t AS ({_ORDERS}) SELECT o_orderkey, coalesce(o_totalprice, 0) AS o_totalprice, coalesce(o_orderpriority, 'Missing') AS o_orderpriority FROM t""",
)
def t3(spark, d):
    out = features.fill_constant(_orders(spark, d), {"o_totalprice": 0.0, "o_orderpriority": "Missing"})
    return out.select("o_orderkey", "o_totalprice", "o_orderpriority")


@query(
    "t4_standard_scaler",
    """WITH p AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_suppkey, round((l_quantity - m) / s, 6) AS scaled, l_quantity AS restored, 0.0::DOUBLE AS constant FROM lineitem, p""",
)
def t4(spark, d):
    df = load(spark, d, "lineitem").withColumn("constant", F.lit(3.0))
    scaler = features.StandardScaler(["l_quantity", "constant"]).fit(df)
    scaled = scaler.apply(df).withColumn("scaled", F.col("l_quantity"))
    return scaler.invert(scaled).select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        r6(F.col("scaled")).alias("scaled"),
        r6(F.col("l_quantity")).alias("restored"),
        (F.col("constant") - 3.0).alias("constant"),
    )


@query(
    "t5_min_max_scaler",
    """WITH p AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, min(p_size) AS slo, max(p_size) AS shi FROM part)
       SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 6) AS p_retailprice, round((p_size - slo)::DOUBLE / (shi - slo), 6) AS p_size FROM part, p""",
)
def t5(spark, d):
    df = load(spark, d, "part")
    out = features.MinMaxScaler(["p_retailprice", "p_size"]).fit(df).apply(df)
    return out.select("p_partkey", r6(F.col("p_retailprice")).alias("p_retailprice"), r6(F.col("p_size")).alias("p_size"))


@query(
    "t6_one_hot",
    """WITH v AS (SELECT list(c_mktsegment ORDER BY c_mktsegment) AS v FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_custkey % 3 = 0)),
            t AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'NEW' ELSE c_mktsegment END AS s FROM customer)
       SELECT c_custkey, (s = v[1])::INT::DOUBLE AS seg_0, (s = v[2])::INT::DOUBLE AS seg_1, (s = v[3])::INT::DOUBLE AS seg_2,
              (s = v[4])::INT::DOUBLE AS seg_3, (s = v[5])::INT::DOUBLE AS seg_4 FROM t, v""",
)
def t6(spark, d):
    df = load(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    enc = features.OneHot(["seg"]).fit(df.filter("c_custkey % 3 = 0"))
    return enc.apply(df.withColumn("seg", F.when(F.col("c_custkey") % 7 == 0, "NEW").otherwise(F.col("seg"))))


@query(
    "t7_weighted_blocks",
    """WITH v AS (SELECT list(label ORDER BY label) AS v FROM (SELECT DISTINCT label FROM embeddings))
       SELECT vec_id, array_to_string(list_transform(v, lambda x: CASE WHEN x = label THEN '3.0' ELSE '0.0' END)
              || list_transform([0, 1], lambda x: CASE WHEN x = vec_id % 2 THEN '2.5' ELSE '0.0' END), ' ') AS block FROM embeddings, v""",
)
def t7(spark, d):
    coded = _weighted(spark, d)
    return coded.select("vec_id", F.array_join(sparse.dense(F.col("b")).cast("array<string>"), " ").alias("block"))


def _weighted(spark, d):
    df = load(spark, d, "embeddings").select("vec_id", "label", (F.col("vec_id") % 2).alias("kind"))
    return sparse.category_blocks(df, sparse.vocabularies(df, ["label", "kind"]), {"label": 3.0, "kind": 2.5}, "b")


@query(
    "t7_sparse_blocks",
    """WITH v AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS i, CAST(count(*) OVER () AS INT) AS n FROM (SELECT DISTINCT label FROM embeddings)),
            t AS (SELECT vec_id, i, n FROM embeddings JOIN v USING (label))
       SELECT vec_id, n + 2 AS size, i AS idx, 3.0::DOUBLE AS value FROM t UNION ALL SELECT vec_id, n + 2, CAST(n + vec_id % 2 AS INT), 2.5::DOUBLE FROM t""",
)
def t7_sparse(spark, d):
    b = F.col("b")
    entries = F.arrays_zip(b["indices"].alias("idx"), b["values"].alias("value"))
    return _weighted(spark, d).select("vec_id", b["size"].alias("size"), F.explode(entries).alias("e")).select("vec_id", "size", "e.*")


@query(
    "t8_label_encoder",
    """SELECT n_nationkey, CAST(dense_rank() OVER (ORDER BY n_name) - 1 AS INT) AS code, n_name AS decoded FROM nation""",
)
def t8(spark, d):
    df = load(spark, d, "nation").select("n_nationkey", "n_name")
    vocabulary = encoders.sorted_vocabulary(df, "n_name")
    coded = encoders.encode(df, "n_name", vocabulary, "code").select("n_nationkey", "code")
    return encoders.decode(coded, "code", vocabulary, "decoded")


@query(
    "t9_ordinal_encoder",
    f"""WITH t AS ({_ORDERS}), v AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i FROM (SELECT DISTINCT coalesce(o_orderpriority, 'missing') AS p FROM t WHERE o_orderkey % 2 = 0 AND coalesce(o_orderpriority, 'x') <> '5-LOW'))
        SELECT o_orderkey, CAST(coalesce(i, -1) AS INT) AS code FROM t LEFT JOIN v ON p = coalesce(o_orderpriority, 'missing')""",
)
def t9(spark, d):
    df = features.fill_constant(_orders(spark, d), {"o_orderpriority": "missing"})
    seen = df.filter("o_orderkey % 2 = 0 AND o_orderpriority <> '5-LOW'")
    vocabulary = encoders.sorted_vocabulary(seen, "o_orderpriority")
    return encoders.encode(df, "o_orderpriority", vocabulary, "code", unknown=-1).select("o_orderkey", "code")


@query(
    "t10_binary_encoder",
    """WITH m AS (SELECT l_linestatus AS m FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
            t AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_orderkey % 7 = 0 THEN 'X' WHEN l_orderkey % 11 <> 0 THEN l_linestatus END AS s FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_suppkey, CAST(coalesce(s IN (SELECT l_linestatus FROM lineitem) AND s <> m, false) AS INT) AS l_linestatus FROM t, m""",
)
def t10(spark, d):
    df = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_linestatus")
    mode = encoders.most_frequent(df, ["l_linestatus"]).scalar()
    vocabulary = encoders.sorted_vocabulary(df, "l_linestatus")
    dirty = df.withColumn(
        "l_linestatus",
        F.when(F.col("l_orderkey") % 7 == 0, "X").when(F.col("l_orderkey") % 11 != 0, F.col("l_linestatus")),
    )
    return encoders.binary_encode(dirty, "l_linestatus", mode, vocabulary)


@query(
    "t11_multi_label",
    """WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), v AS (SELECT list(x ORDER BY x) AS v FROM (SELECT DISTINCT unnest(w) AS x FROM w))
       SELECT p_partkey, array_to_string(list_transform(v, lambda x: CAST(list_contains(w, x) AS INT)::VARCHAR), '') AS flags,
              array_to_string(list_filter(v, lambda x: list_contains(w, x)), ' ') AS labels FROM w, v""",
)
def t11(spark, d):
    df = load(spark, d, "part").select("p_partkey", S.words(F.col("p_name")).alias("w"))
    vocabulary = sparse.label_vocabulary(df, "w")
    sets = sparse.label_sets(df, "w", vocabulary, "f", "p_partkey")
    named = sparse.labels_of(sets, "f", vocabulary, "labels", "p_partkey")
    flags = F.array_join(sparse.dense(F.col("f")).cast("array<int>").cast("array<string>"), "")
    return sets.select("p_partkey", flags.alias("flags")).join(named, "p_partkey").withColumn("labels", F.array_join("labels", " "))


@query(
    "t11_sparse_labels",
    """WITH w AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS x FROM part WHERE p_partkey % 3 <> 0),
            v AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, CAST(count(*) OVER () AS INT) AS n FROM (SELECT DISTINCT x FROM w))
       SELECT p_partkey, (SELECT any_value(n) FROM v) AS size, coalesce(string_agg(i::VARCHAR, ' ' ORDER BY i), '') AS places
       FROM (SELECT p_partkey FROM part) LEFT JOIN w USING (p_partkey) LEFT JOIN v USING (x) GROUP BY p_partkey""",
)
def t11_sparse(spark, d):
    """Every third part has no labels."""
    words = F.when(F.col("p_partkey") % 3 != 0, S.words(F.col("p_name")))
    df = load(spark, d, "part").select("p_partkey", words.alias("w"))
    sets = sparse.label_sets(df, "w", sparse.label_vocabulary(df, "w"), "f", "p_partkey")
    return sets.select("p_partkey", F.col("f.size").alias("size"), F.array_join(F.col("f.indices").cast("array<string>"), " ").alias("places"))


@query(
    "t11_many_labels",
    """WITH t AS (SELECT p_partkey, p_brand || '/' || p_size AS w FROM part),
            v AS (SELECT w, row_number() OVER (ORDER BY w) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT w FROM t))
       SELECT p_partkey, CAST(i AS INT) AS place, 1 AS hits, CAST(n AS INT) AS width FROM t JOIN v USING (w)""",
)
def t11_many(spark, d):
    """More than a thousand labels: all pairs of brand and size."""
    label = F.concat_ws("/", "p_brand", F.col("p_size").cast("string"))
    df = load(spark, d, "part").select("p_partkey", F.array(label).alias("w"))
    sets = sparse.label_sets(df, "w", sparse.label_vocabulary(df, "w"), "f", "p_partkey")
    return sets.select(
        "p_partkey", (F.element_at("f.indices", 1) + 1).alias("place"),
        F.size("f.indices").alias("hits"), F.col("f.size").alias("width"),
    )


@query(
    "t18_wide_categories",
    """WITH t AS (SELECT c_custkey, c_mktsegment AS s, c_acctbal AS x FROM customer), z AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM t),
            v AS (SELECT list(s ORDER BY s) AS v FROM (SELECT DISTINCT s FROM t))
       SELECT c_custkey, round((x - m) / sd, 6) AS c_acctbal, (s = v[1])::INT::DOUBLE AS c_mktsegment_0, (s = v[2])::INT::DOUBLE AS c_mktsegment_1,
              (s = v[3])::INT::DOUBLE AS c_mktsegment_2, (s = v[4])::INT::DOUBLE AS c_mktsegment_3, (s = v[5])::INT::DOUBLE AS c_mktsegment_4 FROM t, z, v""",
)
def t18_wide(spark, d):
    """A category per row and an empty column are dropped by the fit."""
    df = load(spark, d, "customer").withColumn("nothing", F.lit(None).cast("double"))
    pipe = features.ColumnPipeline(["c_acctbal", "nothing"], ["c_name", "c_mktsegment"]).fit(df)
    return pipe.apply(df, keep=["c_custkey"]).withColumn("c_acctbal", r6(F.col("c_acctbal")))


@query(
    "t12_dense_target",
    """SELECT vec_id, array_to_string(list_transform(range((SELECT count(DISTINCT label) FROM embeddings)), lambda i: CAST(i = label AS INT)::VARCHAR), '') AS target FROM embeddings""",
)
def t12(spark, d):
    df = load(spark, d, "embeddings").select("vec_id", "label")
    vocabulary = encoders.sorted_vocabulary(df, "label")
    classes = vocabulary.count()
    coded = encoders.encode(df, "label", vocabulary, "y")
    return coded.select(
        "vec_id", F.array_join(encoders.dense_target(F.col("y"), classes).cast("array<string>"), "").alias("target")
    )


@query(
    "t13_cumulative_target",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey, list_transform(range(9), lambda i: CAST(l_linenumber > i AS INT)) AS c FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_suppkey, array_to_string(list_transform(c, lambda x: x::VARCHAR), '') AS target, CAST(list_sum(c) AS INT) AS decoded FROM t""",
)
def t13(spark, d):
    target = encoders.cumulative_target(F.col("l_linenumber"), 10)
    return load(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        F.array_join(target.cast("array<string>"), "").alias("target"),
        S.count_at_least(target).alias("decoded"),
    )


@query(
    "t14_target_encoder",
    """WITH p AS (SELECT avg(l_discount) AS prior FROM lineitem), s AS (SELECT l_suppkey, sum(l_discount) AS s, count(*) AS n FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1)
       SELECT l_orderkey, l_linenumber, l.l_suppkey, round(coalesce((s.s + p2.m) / (s.n + 1), p2.m), 6) AS encoded
       FROM lineitem l LEFT JOIN s ON s.l_suppkey = l.l_suppkey, (SELECT avg(l_discount) AS m FROM lineitem WHERE l_suppkey % 5 <> 0) p2""",
)
def t14(spark, d):
    df = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_discount")
    train = df.filter("l_suppkey % 5 <> 0")
    stats = windows.target_statistics(train, "l_suppkey", "l_discount")
    prior = train.agg(F.avg("l_discount")).scalar()
    return df.join(stats, F.col("l_suppkey") == F.col("value"), "left").select(
        "l_orderkey", "l_linenumber", "l_suppkey", r6(F.coalesce("stat", prior)).alias("encoded")
    )


_PUNCT = """[!"#$%&()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~'']"""
_TOKENS = f"list_filter(regexp_split_to_array(regexp_replace(lower(text), '{_PUNCT}', '', 'g'), '\\s+'), lambda t: t <> '')"


@query(
    "t15_text_sequences",
    f"""WITH w AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
            c AS (SELECT t, count(*) AS n FROM (SELECT unnest(w) AS t FROM w) GROUP BY t),
            v AS (SELECT t, row_number() OVER (ORDER BY n DESC, t) + 1 AS i FROM c QUALIFY row_number() OVER (ORDER BY n DESC, t) <= 9998),
            p AS (SELECT doc_id, unnest(w[1:100]) AS t, unnest(range(len(w[1:100]))) AS pos FROM w),
            e AS (SELECT doc_id, string_agg(coalesce(i, 1)::VARCHAR, ' ' ORDER BY pos) AS s, count(*) AS n FROM p LEFT JOIN v USING (t) GROUP BY doc_id)
       SELECT w.doc_id, ltrim(coalesce(s, '') || repeat(' 0', CAST(100 - coalesce(n, 0) AS INT)), ' ') AS sequence FROM w LEFT JOIN e USING (doc_id)""",
)
def t15(spark, d):
    df = load(spark, d, "documents").select("doc_id", "text")
    encoded = tokens.encode_sequences(df, "doc_id", "text", tokens.token_vocabulary(df, "text"))
    return encoded.select("doc_id", F.array_join(F.col("sequence").cast("array<string>"), " ").alias("sequence"))


@query(
    "t16_string_lookup",
    """WITH v AS (SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) AS i FROM documents WHERE lang <> 'en' GROUP BY source)
       SELECT doc_id, CAST(coalesce(i, 0) AS INT) AS code FROM documents LEFT JOIN v USING (source)""",
)
def t16(spark, d):
    df = load(spark, d, "documents").select("doc_id", "source", "lang")
    vocabulary = encoders.frequency_vocabulary(df.filter("lang <> 'en'"), "source")
    return encoders.encode(df, "source", vocabulary, "code", unknown=0).select("doc_id", "code")


@query(
    "t17_target_by_subtype",
    """SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS y_log, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INT) AS y_label,
              o_totalprice - 200000 AS y_raw, round(o_totalprice, 2) AS restored FROM orders""",
)
def t17(spark, d):
    df = load(spark, d, "orders").withColumn("centred", F.col("o_totalprice") - 200000)
    logged = features.transform_target(df, "continuous-regression", "o_totalprice", "y_log")
    restored = features.invert_target(logged.withColumn("restored", F.col("y_log")), "restored")
    raw = features.transform_target(restored.drop("log_applied"), "quantile-regression", "centred", "y_raw")
    label = features.transform_target(raw, "binary-classification", "o_orderstatus", "y_label")
    return label.select(
        "o_orderkey", r6(F.col("y_log")).alias("y_log"), "y_label", "y_raw", F.round("restored", 2).alias("restored")
    )


@query(
    "t17_several_targets",
    """SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS y_price, true AS price_log, o_totalprice - 200000 AS y_centred, false AS centred_log,
              round(o_totalprice, 2) AS price_back, round(o_totalprice - 200000, 2) AS centred_back, false AS joint_log FROM orders""",
)
def t17_several(spark, d):
    """One pass over several targets: each its own flag, or all one flag."""
    df = load(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), (F.col("o_totalprice") - 200000).alias("centred"))
    targets, flags = {"price": "y_price", "centred": "y_centred"}, {"price": "price_log", "centred": "centred_log"}
    out = features.transform_targets(df, targets, flags)
    for t in targets:
        out = features.invert_target(out.withColumn(f"{t}_back", F.col(f"y_{t}")), f"{t}_back", flag=f"{t}_log")
    joint = {"price": "j_price", "centred": "j_centred"}
    out = features.transform_targets(out, joint, {"price": "joint_log", "centred": "joint_too"}, together=True)
    return out.select(
        "o_orderkey", r6(F.col("y_price")).alias("y_price"), "price_log", "y_centred", "centred_log",
        F.round("price_back", 2).alias("price_back"), F.round("centred_back", 2).alias("centred_back"), "joint_log",
    )


@query(
    "t17_label_sets",
    """WITH w AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS x FROM part),
            v AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM (SELECT DISTINCT x FROM w))
       SELECT p_partkey, string_agg(i::VARCHAR, ' ' ORDER BY i) AS places, false AS log_applied FROM w JOIN v USING (x) GROUP BY p_partkey""",
)
def t17_labels(spark, d):
    df = load(spark, d, "part").select("p_partkey", S.words(F.col("p_name")).alias("w"))
    out = features.transform_target(df, features.MULTI_LABEL, "w")
    return out.select("p_partkey", F.array_join(F.col("y.indices").cast("array<string>"), " ").alias("places"), "log_applied")


@query(
    "t18_column_pipeline",
    f"""WITH t AS ({_ORDERS}), m AS (SELECT median(o_totalprice) AS med FROM t WHERE train),
            o AS (SELECT o_orderpriority AS mode FROM t WHERE train AND o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
            f AS (SELECT o_orderkey, train, coalesce(o_totalprice, med) AS x, coalesce(o_orderpriority, mode) AS p, o_orderstatus AS s FROM t, m, o),
            z AS (SELECT avg(x) AS mean, stddev_pop(x) AS std FROM f WHERE train),
            vp AS (SELECT list(p ORDER BY p) AS v FROM (SELECT DISTINCT p FROM f WHERE train)), vs AS (SELECT list(s ORDER BY s) AS w FROM (SELECT DISTINCT s FROM f WHERE train))
        SELECT o_orderkey, round((x - mean) / std, 6) AS o_totalprice, (p = v[1])::INT::DOUBLE AS o_orderpriority_0, (p = v[2])::INT::DOUBLE AS o_orderpriority_1,
               (p = v[3])::INT::DOUBLE AS o_orderpriority_2, (p = v[4])::INT::DOUBLE AS o_orderpriority_3, (p = v[5])::INT::DOUBLE AS o_orderpriority_4,
               (s = w[1])::INT::DOUBLE AS o_orderstatus_0, (s = w[2])::INT::DOUBLE AS o_orderstatus_1, (s = w[3])::INT::DOUBLE AS o_orderstatus_2 FROM f, z, vp, vs""",
)
def t18(spark, d):
    df = _orders(spark, d)
    pipe = features.ColumnPipeline(["o_totalprice"], ["o_orderpriority", "o_orderstatus"]).fit(df.filter("train"))
    return pipe.apply(df, keep=["o_orderkey"]).withColumn("o_totalprice", r6(F.col("o_totalprice")))


@query(
    "t21_calendar_features",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, CAST(day(o_orderdate) AS INT) AS day,
              CAST(dayofyear(o_orderdate) AS INT) AS dayofyear, CAST(isodow(o_orderdate) - 1 AS INT) AS weekday, CAST(isodow(o_orderdate) >= 6 AS INT) AS is_weekend,
              round(sin(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_cos,
              round(sin(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) + 0.0 AS weekday_sin, round(cos(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) + 0.0 AS weekday_cos FROM orders""",
)
def t21_calendar(spark, d):
    out = features.date_features(load(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")
    waves = {c: r6(F.col(c)) + 0.0 for c in ("month_sin", "month_cos", "weekday_sin", "weekday_cos")}
    return out.withColumns(waves).drop("o_orderdate", "hour")


@query(
    "t21_date_and_distance",
    """SELECT event_id, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS weekday, CAST(month(ts) AS INT) AS month,
              round(2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians((user_id % 180 - 89.5) - (event_id % 180 - 89.5)) / 2), 2)
                + cos(radians(event_id % 180 - 89.5)) * cos(radians(user_id % 180 - 89.5)) * pow(sin(radians((user_id % 360) - (event_id % 360))  / 2), 2))), 6) AS distance FROM events""",
)
def t21(spark, d):
    df = load(spark, d, "events").withColumns(
        {
            "lon1": (F.col("event_id") % 360 - 180).cast("double"),
            "lat1": (F.col("event_id") % 180 - 90 + 0.5).cast("double"),
            "lon2": (F.col("user_id") % 360 - 180).cast("double"),
            "lat2": (F.col("user_id") % 180 - 90 + 0.5).cast("double"),
        }
    )
    out = features.trip_features(df, "ts", "lon1", "lat1", "lon2", "lat2")
    return out.select("event_id", "hour", "weekday", "month", r6(F.col("distance")).alias("distance"))
