"""Scalar functions (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import scalars as S
from tabloom.plans.common import load, r6
from tabloom.plans.registry import query


@query(
    "f1_joined_text",
    "SELECT conv_id, turn, trim(coalesce(CASE WHEN turn % 2 = 0 THEN role END, '')) || '  ' || trim('  ' || role || ' ') AS joined FROM conversations",
)
def f1(spark, d):
    a = F.when(F.col("turn") % 2 == 0, F.col("role"))
    b = F.concat(F.lit("  "), F.col("role"), F.lit(" "))
    return load(spark, d, "conversations").select("conv_id", "turn", S.joined_text(a, b).alias("joined"))


@query(
    "f2_case_and_affix",
    """SELECT c_custkey, lower(c_mktsegment) AS lo, upper(c_name) AS up, starts_with(c_mktsegment, 'B') AS b, suffix(c_name, '7') AS seven FROM customer""",
)
def f2(spark, d):
    seg, name = F.col("c_mktsegment"), F.col("c_name")
    return load(spark, d, "customer").select(
        "c_custkey",
        F.lower(seg).alias("lo"),
        F.upper(name).alias("up"),
        F.startswith(seg, F.lit("B")).alias("b"),
        F.endswith(name, F.lit("7")).alias("seven"),
    )


@query(
    "f3_split",
    """SELECT doc_id, CAST(len(regexp_split_to_array(regexp_replace(text, '^ +| +$', '', 'g'), '\\s+')) AS INT) AS n_words,
              CAST(len(string_split(text, '-')) AS INT) AS n_parts FROM documents""",
)
def f3(spark, d):
    text = F.col("text")
    return load(spark, d, "documents").select(
        "doc_id", F.size(S.words(text)).alias("n_words"), F.size(F.split(text, "-")).alias("n_parts")
    )


@query("f4_join", "SELECT p_partkey, array_to_string([p_brand, p_type, p_name], ' | ') AS label FROM part")
def f4(spark, d):
    return load(spark, d, "part").select(
        "p_partkey", F.array_join(F.array("p_brand", "p_type", "p_name"), " | ").alias("label")
    )


@query(
    "f5_engine_numbers",
    """SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size || '.5' AS DOUBLE) END AS litres, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size % 8 + 4 AS DOUBLE) END AS cylinders FROM part""",
)
def f5(spark, d):
    engine = F.when(
        F.col("p_partkey") % 7 != 0,
        F.concat(F.col("p_size").cast("string"), F.lit(".5L V"), (F.col("p_size") % 8 + 4).cast("string"), F.lit(" Cyl")),
    ).otherwise("Electric Motor")
    return load(spark, d, "part").select(
        "p_partkey", S.first_decimal(engine).alias("litres"), S.cylinder_count(engine).cast("double").alias("cylinders")
    )


@query(
    "f6_trailing_number",
    """SELECT c_custkey, regexp_extract(c_name, '^(.+?)(\\d+)$', 1) AS prefix, CAST(regexp_extract(c_name, '^(.+?)(\\d+)$', 2) AS BIGINT) AS number FROM customer""",
)
def f6(spark, d):
    return load(spark, d, "customer").select(
        "c_custkey", S.name_prefix(F.col("c_name")).alias("prefix"), S.name_number(F.col("c_name")).alias("number")
    )


@query("f7_squeeze_spaces", "SELECT doc_id, md5(regexp_replace(text, '\\s{2,}', ' ', 'g')) AS digest FROM documents")
def f7(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(S.squeeze_spaces(F.col("text"))).alias("digest"))


_MARKED = """SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN text ELSE '<Code> ' || text || chr(10) || '</Code><Error>' || role || '</Error>' END AS t, text, role FROM conversations"""


def marked(spark, d):
    """Turns wrapped in code and error markers; every fifth has none."""
    wrapped = F.concat(
        F.lit("<Code> "), F.col("text"), F.lit("\n</Code><Error>"), F.col("role"), F.lit("</Error>")
    )
    return load(spark, d, "conversations").withColumn("t", F.when(F.col("turn") % 5 == 4, F.col("text")).otherwise(wrapped))


@query(
    "f8_between_tags",
    f"""WITH t AS ({_MARKED}) SELECT conv_id, turn, md5(CASE WHEN turn % 5 <> 4 THEN regexp_replace(text, '(^\\s+)|(\\s+$)', '', 'g') END) AS digest FROM t""",
)
def f8(spark, d):
    return marked(spark, d).select("conv_id", "turn", F.md5(S.between_tags(F.col("t"), "Code")).alias("digest"))


@query(
    "f9_outer_braces",
    """SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'no object' ELSE props END AS part FROM events""",
)
def f9(spark, d):
    raw = F.when(F.col("event_id") % 6 == 0, "no object").otherwise(
        F.concat(F.lit("Sure:\n"), F.col("props"), F.lit("\ndone"))
    )
    return load(spark, d, "events").select("event_id", S.outer_braces(raw).alias("part"))


@query(
    "f10_cell_keys",
    """SELECT p_partkey, p_partkey || '-F_1_' || p_size AS cell, p_size || '–' || (p_size + 5) || ' (6 cols)' AS span FROM part""",
)
def f10(spark, d):
    size = F.col("p_size")
    return load(spark, d, "part").select(
        "p_partkey",
        F.concat_ws("-", F.col("p_partkey").cast("string"), F.concat(F.lit("F_1_"), size.cast("string"))).alias("cell"),
        F.format_string("%d–%d (%d cols)", size, size + 5, F.lit(6)).alias("span"),
    )


@query(
    "f11_url_parts",
    """SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) AS host, split_part(url, '?', 1) AS no_query FROM pages""",
)
def f11(spark, d):
    return load(spark, d, "pages").select(
        "page_id", S.url_host(F.col("url")).alias("host"), F.substring_index("url", "?", 1).alias("no_query")
    )


@query(
    "f12_parse_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""",
)
def f12(spark, d):
    text = F.when(F.col("o_orderkey") % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("n/a")
    return load(spark, d, "orders").select(
        "o_orderkey", F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd").alias("day")
    )


@query("f13_clock_hour", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(hour(ts) AS DOUBLE) END AS hour FROM events")
def f13(spark, d):
    clock = F.when(F.col("event_id") % 7 != 0, F.date_format("ts", "HH:mm:ss")).otherwise("soon")
    return load(spark, d, "events").select("event_id", S.hour_of_clock(clock).cast("double").alias("hour"))


@query(
    "f14_date_parts",
    """SELECT event_id, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day, CAST(hour(ts) AS INT) AS hour, CAST(dayofyear(ts) AS INT) AS dayofyear FROM events""",
)
def f14(spark, d):
    parts = S.date_parts(F.col("ts"))
    names = ["year", "month", "day", "hour", "dayofyear"]
    return load(spark, d, "events").select("event_id", *[parts[n].alias(n) for n in names])


@query(
    "f15_weekday",
    "SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INT) AS weekday, CAST(isodow(o_orderdate) >= 6 AS INT) AS is_weekend FROM orders",
)
def f15(spark, d):
    when = F.col("o_orderdate")
    return load(spark, d, "orders").select(
        "o_orderkey", S.weekday(when).alias("weekday"), S.is_weekend(when).alias("is_weekend")
    )


@query(
    "f16_cyclical",
    " UNION ALL ".join(
        f"SELECT o_orderkey, {p} AS period, round(sin(2 * pi() * {e} / {p}), 6) AS s, round(cos(2 * pi() * {e} / {p}), 6) AS c FROM orders"
        for e, p in (("month(o_orderdate)", 12), ("(isodow(o_orderdate) - 1)", 7), ("day(o_orderdate)", 31))
    ),
)
def f16(spark, d):
    when = F.col("o_orderdate")
    entries = []
    for expr, period in ((F.month(when), 12), (S.weekday(when), 7), (F.day(when), 31)):
        s, c = S.cyclical(expr, period)
        # Adding 0.0 turns a rounded -0.0 into 0.0.
        entries.append(F.struct(F.lit(period).alias("period"), (r6(s) + 0.0).alias("s"), (r6(c) + 0.0).alias("c")))
    return load(spark, d, "orders").select("o_orderkey", F.inline(F.array(*entries)))


@query(
    "f17_great_circle",
    """WITH t AS (SELECT p_partkey, p_partkey % 180 - 89.5 AS a, p_partkey % 360 - 180 AS o, p_size * 1.7 - 40 AS a2, p_size * 3.1 - 70 AS o2 FROM part)
       SELECT p_partkey, round(12742.0::DOUBLE * asin(sqrt(pow(sin((radians(a2) - radians(a)) / 2), 2) + cos(radians(a)) * cos(radians(a2)) * pow(sin((radians(o2) - radians(o)) / 2), 2))), 6) AS km FROM t""",
)
def f17(spark, d):
    lat1 = (F.col("p_partkey") % 180).cast("double") - 89.5
    lon1 = (F.col("p_partkey") % 360).cast("double") - 180
    lat2, lon2 = F.col("p_size") * 1.7 - 40, F.col("p_size") * 3.1 - 70
    return load(spark, d, "part").select("p_partkey", r6(S.great_circle(lon1, lat1, lon2, lat2)).alias("km"))


@query(
    "f18_log_and_inverse",
    """SELECT l_orderkey, l_linenumber, l_suppkey, round(ln(1 + l_quantity), 6) AS logged, round(exp(least(l_quantity, 20)) - 1, 2) AS inverse FROM lineitem""",
)
def f18(spark, d):
    q = F.col("l_quantity")
    return load(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        r6(F.log1p(q)).alias("logged"),
        F.round(S.inverse_log1p(q), 2).alias("inverse"),
    )


@query(
    "f19_clip",
    """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS b FROM customer)
       SELECT c_custkey, CASE WHEN b IS NOT NULL THEN greatest(least(b, 255), 0) END AS byte, CASE WHEN b IS NOT NULL THEN greatest(b, 0) END AS positive FROM t""",
)
def f19(spark, d):
    b = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal"))
    return load(spark, d, "customer").select(
        "c_custkey", S.clip(b, 0.0, 255.0).alias("byte"), S.clip(b, low=0.0).alias("positive")
    )


@query(
    "f20_nan_to_value",
    "SELECT p_partkey, CASE WHEN p_size % 3 IN (0, 1) THEN 0.5 ELSE p_retailprice END AS price FROM part",
)
def f20(spark, d):
    x = F.when(F.col("p_size") % 3 == 0, F.lit(float("nan"))).when(F.col("p_size") % 3 == 2, F.col("p_retailprice"))
    return load(spark, d, "part").select("p_partkey", S.nan_to(x, 0.5).alias("price"))


@query(
    "f21_lenient_number",
    "SELECT p_partkey, coalesce(try_cast(CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE p_size || '.25' END AS DOUBLE), 0) AS number FROM part",
)
def f21(spark, d):
    text = F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(
        F.concat(F.col("p_size").cast("string"), F.lit(".25"))
    )
    return load(spark, d, "part").select("p_partkey", S.lenient_number(text).alias("number"))


@query(
    "f22_round",
    "SELECT l_orderkey, l_linenumber, l_suppkey, round(l_extendedprice / 7, 2) AS price FROM lineitem",
)
def f22(spark, d):
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.round(F.col("l_extendedprice") / 7, 2).alias("price")
    )


@query(
    "f23_value_map",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0.0::DOUBLE WHEN 'O' THEN 1.0::DOUBLE END AS code FROM orders",
)
def f23(spark, d):
    return load(spark, d, "orders").select(
        "o_orderkey", S.value_map(F.col("o_orderstatus"), {"F": 0.0, "O": 1.0}).alias("code")
    )


@query(
    "f24_value_map_default",
    "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE -1 END AS code FROM orders",
)
def f24(spark, d):
    mapping = {"1-URGENT": 0, "2-HIGH": 1}
    return load(spark, d, "orders").select(
        "o_orderkey", S.value_map(F.col("o_orderpriority"), mapping, -1).alias("code")
    )


@query(
    "f25_text_of_null",
    "SELECT o_orderkey, coalesce(CAST(CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS VARCHAR), '') AS customer FROM orders",
)
def f25(spark, d):
    customer = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey"))
    return load(spark, d, "orders").select("o_orderkey", F.coalesce(customer.cast("string"), F.lit("")).alias("customer"))


@query(
    "f26_json",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, array_to_string(json_keys(props), ',') AS keys, list_contains(json_keys(props), 'k') AS has_k,
              '{"id":' || event_id || ',"type":"' || event_type || '"}' AS encoded FROM events""",
)
def f26(spark, d):
    keys = F.json_object_keys("props")
    return load(spark, d, "events").select(
        "event_id",
        F.from_json("props", "k int")["k"].alias("k"),
        F.array_join(keys, ",").alias("keys"),
        F.array_contains(keys, "k").alias("has_k"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("encoded"),
    )


@query(
    "f27_scalar_or_list",
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type || '+' || p_brand ELSE p_type END AS items, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM part",
)
def f27(spark, d):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.array("p_type", "p_brand"))).otherwise(F.col("p_type"))
    items = S.as_list(raw)
    return load(spark, d, "part").select("p_partkey", F.array_join(items, "+").alias("items"), F.size(items).alias("n"))


@query(
    "f28_arrays",
    """WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
       SELECT vec_id, CAST(len(v) AS INT) AS n, v[3] AS third, round(list_sum(v[2:4]), 6) AS middle, list_sort(v)[1] AS smallest, list_contains(v, v[5]) AS found FROM t""",
)
def f28(spark, d):
    v = F.col("embedding").cast("array<double>")
    return load(spark, d, "embeddings").select(
        "vec_id",
        F.size(v).alias("n"),
        F.element_at(v, 3).alias("third"),
        r6(F.aggregate(F.slice(v, 2, 3), F.lit(0.0), lambda a, x: a + x)).alias("middle"),
        F.element_at(F.array_sort(v), 1).alias("smallest"),
        F.array_contains(v, F.element_at(v, 5)).alias("found"),
    )


@query(
    "f29_grid",
    "SELECT vec_id, embedding[8 * 2 + 3 + 1]::DOUBLE AS cell, embedding[8 * 7 + 7 + 1]::DOUBLE AS corner, 8 AS height FROM embeddings",
)
def f29(spark, d):
    cells = [F.element_at("embedding", i + 1) for i in range(64)]
    g = load(spark, d, "embeddings").select("vec_id", S.grid(cells, 8).alias("g"))
    return g.select(
        "vec_id",
        S.grid_cell(F.col("g"), 2, 3).cast("double").alias("cell"),
        S.grid_cell(F.col("g"), 7, 7).cast("double").alias("corner"),
        F.size("g").alias("height"),
    )


@query(
    "f30_count_above",
    "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x >= 0.1)) AS INT) AS n FROM embeddings",
)
def f30(spark, d):
    v = F.col("embedding").cast("array<double>")
    return load(spark, d, "embeddings").select("vec_id", S.count_at_least(v, 0.1).alias("n"))
