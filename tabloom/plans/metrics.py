"""Evaluation metrics (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import scalars as S
from tabloom.functions import vectors as V
from tabloom.operators import metrics as M
from tabloom.plans.common import load, r6
from tabloom.plans.registry import query

# Regression: price per piece predicted from the discounted price, in both engines alike.
_REG = """SELECT l_extendedprice / 1000 AS y, l_extendedprice * (1 - l_discount) * (1 + l_tax) / 1000 AS p FROM lineitem"""


def _reg(spark, d):
    price = F.col("l_extendedprice")
    return load(spark, d, "lineitem").select(
        (price / 1000).alias("y"), (price * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) / 1000).alias("p")
    )



def _regression(name, expr, fn):
    @query(name, f"WITH t AS ({_REG}) SELECT round({expr}, 6) AS value FROM t")
    def run(spark, d):
        return _reg(spark, d).agg(r6(fn(F.col("y"), F.col("p"))).alias("value"))

    return run


_regression("m2_rmsle", "sqrt(avg(pow(ln(1 + y) - ln(1 + p), 2)))", lambda y, p: M.rmsle(y, p))
_regression("m3_rmse", "sqrt(avg(pow(y - p, 2)))", lambda y, p: M.rmse(y, p))
_regression(
    "m3_rmse_from_log",
    "sqrt(avg(pow((exp(least(ln(1 + y), 20)) - 1) - (exp(least(ln(1 + p), 20)) - 1), 2)))",
    lambda y, p: M.rmse_from_log(F.log1p(y), F.log1p(p)),
)
_regression("m5_mape", "avg(abs((y - p) / nullif(y, 0)))", lambda y, p: M.mape(y, p))
_regression("m8_r2", "1 - sum(pow(y - p, 2)) / (count(y) * var_pop(y))", lambda y, p: M.r2(y, p))
_regression("m12_smape", "avg(coalesce(2 * abs(y - p) / nullif(abs(y) + abs(p), 0), 0))", lambda y, p: M.smape(y, p))
_regression("m13_mae", "avg(abs(y - p))", lambda y, p: M.mae(y, p))


@query("m10_median_absolute_error", f"WITH t AS ({_REG}) SELECT round(median(abs(y - p)), 6) AS medae FROM t")
def m10(spark, d):
    return M.median_absolute_error(_reg(spark, d), F.col("y"), F.col("p")).select(r6(F.col("medae")).alias("medae"))


# Multi-class: the first ten vector components as scores of the ten labels.
_ARR = "list_transform(embedding, lambda x: x::DOUBLE)"
_CLS = f"""SELECT vec_id, label, {_ARR} AS s, CAST(list_position({_ARR}, list_max({_ARR})) - 1 AS INT) AS p,
    list_transform(list_reverse_sort(list_transform(range(len(embedding)), lambda i: {{'s': ({_ARR})[i + 1], 'n': -i}})), lambda z: -z.n) AS ranked FROM embeddings"""


def _cls(spark, d):
    s = V.as_double(F.col("embedding"))
    return load(spark, d, "embeddings").select("vec_id", "label", s.alias("s"), S.argmax(s).alias("p"))


@query(
    "m1_map_at_3",
    f"""WITH t AS ({_CLS}), a AS (SELECT list_position(ranked[1:3], label) AS place FROM t)
        SELECT round(avg(CASE WHEN place > 0 THEN 1.0::DOUBLE / place ELSE 0 END), 6) AS map3 FROM a""",
)
def m1(spark, d):
    return _cls(spark, d).agg(r6(M.map_at(F.col("label"), S.top_positions(F.col("s"), 3))).alias("map3"))


@query("m6_accuracy", f"WITH t AS ({_CLS}) SELECT round(avg((label = p)::INT), 6) AS accuracy FROM t")
def m6(spark, d):
    return _cls(spark, d).agg(r6(M.accuracy(F.col("label"), F.col("p"))).alias("accuracy"))


_SOFT = f"""SELECT label, exp(({_ARR})[label + 1]) / list_sum(list_transform({_ARR}, lambda x: exp(x))) AS q FROM embeddings"""


@query("m9_multiclass_log_loss", f"WITH t AS ({_SOFT}) SELECT round(-avg(ln(q)), 6) AS loss FROM t")
def m9_multi(spark, d):
    df = _cls(spark, d).withColumn("e", F.transform("s", lambda x: F.exp(x)))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    df = df.withColumn("total", total).withColumn(
        "q", F.zip_with("e", F.array_repeat("total", F.size("e")), lambda x, t: x / t)
    )
    return df.agg(r6(M.multiclass_log_loss(F.col("label"), F.col("q"))).alias("loss"))


@query(
    "m11_f1_micro_macro",
    f"""WITH t AS ({_CLS}), c AS (SELECT label AS class FROM t UNION SELECT p FROM t),
            k AS (SELECT class, count(*) FILTER (label = class AND p = class) AS tp, count(*) FILTER (label = class) AS a, count(*) FILTER (p = class) AS b FROM c, t GROUP BY class)
        SELECT round(sum(tp) * 2.0::DOUBLE / (sum(a) + sum(b)), 6) AS micro_f1, round(avg(2.0::DOUBLE * tp / (a + b)), 6) AS macro_f1 FROM k""",
)
def m11(spark, d):
    out = M.f1_scores(_cls(spark, d), F.col("label"), F.col("p"))
    return out.select(r6(F.col("micro_f1")).alias("micro_f1"), r6(F.col("macro_f1")).alias("macro_f1"))


@query(
    "m14_quadratic_kappa",
    f"""WITH t AS ({_CLS}), n AS (SELECT count(*)::DOUBLE AS n FROM t), a AS (SELECT label AS i, count(*) AS ai FROM t GROUP BY 1), b AS (SELECT p AS j, count(*) AS bj FROM t GROUP BY 1)
        SELECT round(1 - (SELECT sum(pow(label - p, 2)) FROM t) / (SELECT sum(ai * bj * pow(i - j, 2)) / (SELECT n FROM n) FROM a, b), 6) AS kappa""",
)
def m14(spark, d):
    return M.quadratic_kappa(_cls(spark, d), F.col("label"), F.col("p")).select(r6(F.col("kappa")).alias("kappa"))


@query(
    "m15_adjusted_rand",
    f"""WITH t AS ({_CLS}), c AS (SELECT count(*)::DOUBLE AS n FROM t GROUP BY label, p), a AS (SELECT count(*)::DOUBLE AS n FROM t GROUP BY label), b AS (SELECT count(*)::DOUBLE AS n FROM t GROUP BY p),
            s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS i, (SELECT sum(n * (n - 1) / 2) FROM a) AS a, (SELECT sum(n * (n - 1) / 2) FROM b) AS b, (SELECT count(*)::DOUBLE * (count(*) - 1) / 2 FROM t) AS n2)
        SELECT round((i - a * b / n2) / ((a + b) / 2 - a * b / n2), 6) AS ari FROM s""",
)
def m15(spark, d):
    return M.adjusted_rand(_cls(spark, d), F.col("label"), F.col("p")).select(r6(F.col("ari")).alias("ari"))


@query(
    "m18_top_k_accuracy",
    f"WITH t AS ({_CLS}) SELECT round(avg(list_contains(ranked[1:5], label)::INT), 6) AS top5 FROM t",
)
def m18(spark, d):
    return _cls(spark, d).agg(r6(M.top_k_accuracy(F.col("label"), S.top_positions(F.col("s"), 5))).alias("top5"))


# Binary: quality of a document against a score from its length.
_BIN = """SELECT l.doc_id, l.quality AS y, round(n_chars / (SELECT max(n_chars)::DOUBLE FROM documents), 3) AS s FROM labels l JOIN documents USING (doc_id)"""


def _bin(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "n_chars")
    top = docs.agg(F.max("n_chars").cast("double").alias("m")).scalar()
    return load(spark, d, "labels").join(docs, "doc_id").select(
        "doc_id", F.col("quality").alias("y"), F.round(F.col("n_chars") / top, 3).alias("s")
    )


@query(
    "m4_roc_curve",
    f"""WITH t AS ({_BIN}), g AS (SELECT s AS score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM t GROUP BY s)
        SELECT score, round(sum(pos) OVER w / (SELECT sum(pos) FROM g)::DOUBLE, 6) AS tpr, round(sum(neg) OVER w / (SELECT sum(neg) FROM g)::DOUBLE, 6) AS fpr
        FROM g WINDOW w AS (ORDER BY score DESC)""",
)
def m4(spark, d):
    curve = M.roc_curve(_bin(spark, d), F.col("y"), F.col("s"))
    return curve.select("score", r6(F.col("tpr")).alias("tpr"), r6(F.col("fpr")).alias("fpr"))


_COUNTS = """c AS (SELECT (count(*) FILTER (y = 1 AND s > 0.02))::DOUBLE AS tp, (count(*) FILTER (y = 0 AND s > 0.02))::DOUBLE AS fp,
                          (count(*) FILTER (y = 1 AND s <= 0.02))::DOUBLE AS fn, (count(*) FILTER (y = 0 AND s <= 0.02))::DOUBLE AS tn FROM t)"""


def _scores(spark, d):
    return M.binary_scores(_bin(spark, d), F.col("y"), S.threshold(F.col("s"), 0.02))


@query(
    "m7_matthews",
    f"WITH t AS ({_BIN}), {_COUNTS} SELECT round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM c",
)
def m7(spark, d):
    return _scores(spark, d).select(r6(F.col("mcc")).alias("mcc"))


@query(
    "m9_log_loss",
    f"WITH t AS ({_BIN}) SELECT round(-avg(CASE WHEN y = 1 THEN ln(greatest(s, 1e-15)) ELSE ln(1 - least(s, 1 - 1e-15::DOUBLE)) END), 6) AS loss FROM t",
)
def m9(spark, d):
    return _bin(spark, d).agg(r6(M.log_loss(F.col("y"), F.col("s"))).alias("loss"))


@query(
    "m11_f1_binary",
    f"WITH t AS ({_BIN}), {_COUNTS} SELECT round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c",
)
def m11_binary(spark, d):
    return _scores(spark, d).select(r6(F.col("f1")).alias("f1"))


@query(
    "m16_auc",
    f"""WITH t AS ({_BIN}), r AS (SELECT y, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0)::DOUBLE AS r FROM t),
            n AS (SELECT (count(*) FILTER (y = 1))::DOUBLE AS p, (count(*) FILTER (y = 0))::DOUBLE AS n FROM t)
        SELECT round(((SELECT sum(r) FROM r WHERE y = 1) - p * (p + 1) / 2) / (p * n), 6) AS auc FROM n""",
)
def m16(spark, d):
    return M.auc(_bin(spark, d), F.col("y"), F.col("s")).select(r6(F.col("auc")).alias("auc"))


@query(
    "m17_precision_recall",
    f"WITH t AS ({_BIN}), {_COUNTS} SELECT round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM c",
)
def m17(spark, d):
    return _scores(spark, d).select(r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


# Label sets: the words of a part's name, predicted by two of them, its maker's digit and a fixed one.
_SETS = """SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a,
  list_distinct([string_split(p_name, ' ')[2], 'blue', string_split(p_name, ' ')[1]]) AS p FROM part"""


def _sets(spark, d):
    words = F.split("p_name", " ")
    predicted = F.array(F.try_element_at(words, F.lit(2)), F.lit("blue"), F.try_element_at(words, F.lit(1)))
    return load(spark, d, "part").select(
        "p_partkey", F.array_distinct(words).alias("a"), F.array_compact(F.array_distinct(predicted)).alias("p"),
        F.array_compact(predicted).alias("ranked"),
    )


@query(
    "m11_f1_multi_label",
    f"""WITH s AS (SELECT p_partkey, a, list_filter(p, lambda x: x IS NOT NULL) AS p FROM ({_SETS})),
       r AS (SELECT unnest(list_distinct(list_concat(a, p))) AS label, a, p FROM s),
       c AS (SELECT label, count(*) FILTER (list_contains(a, label) AND list_contains(p, label)) AS hit, count(*) FILTER (list_contains(a, label)) AS n, count(*) FILTER (list_contains(p, label)) AS m FROM r GROUP BY label)
       SELECT round(sum(hit) * 2.0::DOUBLE / (sum(n) + sum(m)), 6) AS micro_f1, round(avg(hit * 2.0::DOUBLE / (n + m)), 6) AS macro_f1 FROM c""",
)
def m11_sets(spark, d):
    s = M.set_scores(_sets(spark, d), "a", "p")
    return s.select(r6(F.col("micro_f1")).alias("micro_f1"), r6(F.col("macro_f1")).alias("macro_f1"))


@query(
    "m17_precision_recall_multi_label",
    f"""WITH s AS (SELECT p_partkey, a, list_filter(p, lambda x: x IS NOT NULL) AS p FROM ({_SETS})),
       r AS (SELECT unnest(list_distinct(list_concat(a, p))) AS label, a, p FROM s),
       c AS (SELECT label, count(*) FILTER (list_contains(a, label) AND list_contains(p, label))::DOUBLE AS hit, count(*) FILTER (list_contains(a, label)) AS n, count(*) FILTER (list_contains(p, label)) AS m FROM r GROUP BY label)
       SELECT round(sum(hit) / sum(m), 6) AS micro_precision, round(sum(hit) / sum(n), 6) AS micro_recall,
              round(avg(CASE WHEN m > 0 THEN hit / m ELSE 0 END), 6) AS macro_precision, round(avg(CASE WHEN n > 0 THEN hit / n ELSE 0 END), 6) AS macro_recall FROM c""",
)
def m17_sets(spark, d):
    s = M.set_scores(_sets(spark, d), "a", "p")
    names = ["micro_precision", "micro_recall", "macro_precision", "macro_recall"]
    return s.select(*[r6(F.col(n)).alias(n) for n in names])


@query(
    "m1_map_at_3_multi_label",
    """WITH t AS (SELECT list_distinct(string_split(p_name, ' ')) AS a, list_filter([string_split(p_name, ' ')[2], 'blue', string_split(p_name, ' ')[1]], lambda x: x IS NOT NULL) AS r FROM part),
       h AS (SELECT a, list_contains(a, r[1])::INT AS h1, list_contains(a, r[2])::INT AS h2, coalesce(list_contains(a, r[3])::INT, 0) AS h3 FROM t)
       SELECT round(avg((h1 + h2 * (h1 + h2) / 2.0::DOUBLE + h3 * (h1 + h2 + h3) / 3.0::DOUBLE) / least(len(a), 3)), 6) AS map3 FROM h""",
)
def m1_sets(spark, d):
    ap = M.average_precision_of_set(F.col("a"), F.col("ranked"), 3)
    return _sets(spark, d).agg(r6(F.avg(ap)).alias("map3"))
