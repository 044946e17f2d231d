"""Evaluation metrics over a table of labels and predictions.

Each is an aggregate with map-side partials. Rank-based ones first collapse the rows to
distinct scores, so ties and hot scores cost nothing, and then use blocked running totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.quantiles import exact_quantiles, quantile_name
from tabloom.operators.running import running_totals

# The closed vocabulary of metric names.
METRICS = [
    "MAP@N – Mean Average Precision",
    "RMSLE – Root Mean Squared Logarithmic Error",
    "RMSE – Root Mean Squared Error",
    "ROC Curve",
    "MAPE – Mean Absolute Percentage Error",
    "Accuracy",
    "MCC – Matthews Correlation Coefficient",
    "R2 – Coefficient of Determination",
    "Log Loss",
    "MedAE – Median Absolute Error",
    "Micro-averaged F1-Score",
    "SMAPE – Symmetric Mean Absolute Percentage Error",
    "MAE – Mean Absolute Error",
    "Quadratic Weighted Kappa",
    "Adjusted Rand Index",
    "AUCROC",
    "Multi-class Log Loss",
    "Macro F1 Score",
    "F1 Score",
    "Multi-class classification accuracy",
    "Categorization accuracy",
    "Classification accuracy",
]

EPSILON = 1e-15


# ---- regression -------------------------------------------------------------


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(F.pow(y - p, F.lit(2.0))))


def rmsle(y: Column, p: Column) -> Column:
    return rmse(F.log1p(y), F.log1p(p))


def rmse_from_log(y_log: Column, p_log: Column, cap: float = 20.0) -> Column:
    """Error on the raw scale of values kept as log1p."""
    return rmse(F.expm1(F.least(y_log, F.lit(cap))), F.expm1(F.least(p_log, F.lit(cap))))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mape(y: Column, p: Column) -> Column:
    """Rows with y = 0 are left out."""
    return F.avg(F.abs(F.try_divide(y - p, y)))


def smape(y: Column, p: Column) -> Column:
    """A row with both values 0 counts as 0."""
    return F.avg(F.coalesce(F.try_divide(F.abs(y - p) * 2, F.abs(y) + F.abs(p)), F.lit(0.0)))


def r2(y: Column, p: Column) -> Column:
    return F.lit(1.0) - F.try_divide(F.sum(F.pow(y - p, F.lit(2.0))), F.count(y) * F.var_pop(y))


def median_absolute_error(df: DataFrame, y: Column, p: Column) -> DataFrame:
    q = exact_quantiles(df.select(F.abs(y - p).alias("e")), ["e"], [0.5])
    return q.select(F.col(quantile_name("e", 0)).alias("medae"))


# ---- classification ---------------------------------------------------------


def accuracy(y: Column, p: Column) -> Column:
    return F.avg((y == p).cast("double"))


def top_k_accuracy(y: Column, top: Column) -> Column:
    return F.avg(F.array_contains(top, y).cast("double"))


def average_precision_at(y: Column, ranked: Column) -> Column:
    """AP at the length of ``ranked`` for one relevant class: 1 / its place, 0 when absent."""
    place = F.array_position(ranked, y)
    return F.when(place > 0, F.lit(1.0) / place).otherwise(F.lit(0.0))


def map_at(y: Column, ranked: Column) -> Column:
    return F.avg(average_precision_at(y, ranked))


def average_precision_of_set(relevant: Column, ranked: Column, k: int) -> Column:
    """AP@k with several relevant classes: precision at each hit, over min(relevant, k)."""
    top = F.slice(ranked, 1, k)
    hits = F.transform(top, lambda c: F.array_contains(relevant, c).cast("double"))
    gains = F.transform(
        hits, lambda h, i: h * F.aggregate(F.slice(hits, 1, i + 1), F.lit(0.0), lambda a, x: a + x) / (i + 1)
    )
    best = F.least(F.size(F.array_distinct(relevant)), F.lit(k))
    return F.coalesce(F.try_divide(F.aggregate(gains, F.lit(0.0), lambda a, x: a + x), best), F.lit(0.0))


def set_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Micro and macro precision, recall and F1 over the labels of label sets; 0 where undefined."""
    both = F.array_union(actual, predicted)
    rows = df.select(F.explode(both).alias("label"), actual, predicted).select(
        "label", F.array_contains(actual, F.col("label")).alias("a"), F.array_contains(predicted, F.col("label")).alias("p")
    )
    per = rows.groupBy("label").agg(
        F.count_if(F.col("a") & F.col("p")).alias("hit"), F.count_if("a").alias("a"), F.count_if("p").alias("p")
    )

    def ratio(top: Column, below: Column) -> Column:
        return F.coalesce(F.try_divide(top, below), F.lit(0.0))

    hit, a, p = (F.col(c).cast("double") for c in ("hit", "a", "p"))
    return per.agg(
        ratio(F.sum(hit), F.sum(p)).alias("micro_precision"), ratio(F.sum(hit), F.sum(a)).alias("micro_recall"),
        ratio(F.sum(hit) * 2, F.sum(a) + F.sum(p)).alias("micro_f1"), F.avg(ratio(hit, p)).alias("macro_precision"),
        F.avg(ratio(hit, a)).alias("macro_recall"), F.avg(ratio(hit * 2, a + p)).alias("macro_f1"),
    )


def log_loss(y: Column, p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - EPSILON)), F.lit(EPSILON))
    return -F.avg(F.when(y == 1, F.ln(q)).otherwise(F.ln(F.lit(1.0) - q)))


def multiclass_log_loss(y: Column, probabilities: Column) -> Column:
    """``y`` is the class position from 0."""
    q = F.greatest(F.least(F.element_at(probabilities, y + 1), F.lit(1 - EPSILON)), F.lit(EPSILON))
    return -F.avg(F.ln(q))


def binary_counts(y: Column, p: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if((y == 1) & (p == 1)),
        "fp": F.count_if((y == 0) & (p == 1)),
        "fn": F.count_if((y == 1) & (p == 0)),
        "tn": F.count_if((y == 0) & (p == 0)),
    }


def binary_scores(df: DataFrame, y: Column, p: Column) -> DataFrame:
    """Precision, recall, F1 and Matthews correlation of 0/1 predictions; 0 where undefined."""
    c = df.agg(*[e.cast("double").alias(n) for n, e in binary_counts(y, p).items()])
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    mcc = F.try_divide(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))
    return c.select(
        F.coalesce(F.try_divide(tp, tp + fp), zero).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), zero).alias("recall"),
        F.coalesce(F.try_divide(tp * 2, tp * 2 + fp + fn), zero).alias("f1"),
        F.coalesce(mcc, zero).alias("mcc"),
    )


def confusion(df: DataFrame, y: Column, p: Column) -> DataFrame:
    """Counts per (label, prediction): the only pass over the rows."""
    return df.select(y.alias("y"), p.alias("p")).groupBy("y", "p").agg(F.count("*").alias("n"))


def _marginals(cells: DataFrame) -> DataFrame:
    """Per class: rows with the label, rows with the prediction, rows with both."""
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("y").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted"),
                         F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted"),
                         F.lit(0).cast("bigint").alias("hit")),
            )
        ).alias("s")
    ).select("s.*")
    return sides.groupBy("class").agg(F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))


def f1_scores(df: DataFrame, y: Column, p: Column) -> DataFrame:
    """Micro and macro F1 over the classes seen on either side."""
    per_class = _marginals(confusion(df, y, p))
    f1 = F.coalesce(F.try_divide(F.col("hit") * 2.0, F.col("actual") + F.col("predicted")), F.lit(0.0))
    return per_class.agg(
        F.try_divide(F.sum("hit") * 2.0, F.sum("actual") + F.sum("predicted")).alias("micro_f1"), F.avg(f1).alias("macro_f1")
    )


def quadratic_kappa(df: DataFrame, y: Column, p: Column) -> DataFrame:
    """1 - observed / expected squared distance.

    The expected part only needs the moments of both marginals, since
    sum_ij a_i b_j (i - j)^2 = B * sum a_i i^2 - 2 * sum a_i i * sum b_j j + A * sum b_j j^2,
    so no product of the class lists is built.
    """
    a, b = y.cast("double"), p.cast("double")
    m = df.agg(
        F.count("*").cast("double").alias("n"),
        F.sum(F.pow(a - b, F.lit(2.0))).alias("observed"),
        F.sum(a).alias("sa"),
        F.sum(b).alias("sb"),
        F.sum(a * a).alias("saa"),
        F.sum(b * b).alias("sbb"),
    )
    expected = (F.col("n") * F.col("saa") - F.col("sa") * F.col("sb") * 2 + F.col("n") * F.col("sbb")) / F.col("n")
    return m.select((F.lit(1.0) - F.try_divide(F.col("observed"), expected)).alias("kappa"))


def adjusted_rand(df: DataFrame, y: Column, p: Column) -> DataFrame:
    cells = confusion(df, y, p)
    pairs = lambda c: c.cast("double") * (c.cast("double") - 1) / 2
    inner = cells.agg(F.sum(pairs(F.col("n"))).alias("cells"), F.sum("n").alias("n"))
    sides = _marginals(cells).agg(
        F.sum(pairs(F.col("actual"))).alias("a"), F.sum(pairs(F.col("predicted"))).alias("b")
    )
    s = inner.select("cells", "n", sides.select(F.struct("a", "b")).scalar().alias("s"))
    expected = F.try_divide(F.col("s.a") * F.col("s.b"), pairs(F.col("n")))
    top = (F.col("s.a") + F.col("s.b")) / 2
    return s.select(
        F.coalesce(F.try_divide(F.col("cells") - expected, top - expected), F.lit(1.0)).alias("ari")
    )


# ---- ranking ----------------------------------------------------------------


def score_table(df: DataFrame, y: Column, score: Column) -> DataFrame:
    """Positives and negatives per distinct score."""
    return (
        df.select(y.alias("y"), score.alias("score"))
        .groupBy("score")
        .agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    )


def roc_curve(df: DataFrame, y: Column, score: Column, **limits) -> DataFrame:
    """One point per distinct score, from the highest on: rates of rows at or above it."""
    s = score_table(df, y, score).withColumn("__neg_score", -F.col("score"))
    totals = s.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    t = totals.select(F.struct("p", "n")).scalar()
    runs = running_totals(s, ["__neg_score"], {"tp": F.col("pos"), "fp": F.col("neg")}, **limits)
    return runs.select(
        "score", F.try_divide(F.col("tp"), t["p"]).alias("tpr"), F.try_divide(F.col("fp"), t["n"]).alias("fpr")
    )


def auc(df: DataFrame, y: Column, score: Column, **limits) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half."""
    s = score_table(df, y, score)
    runs = running_totals(s, ["score"], {"below": F.col("neg")}, inclusive=False, **limits)
    won = F.sum(F.col("pos").cast("double") * (F.col("below") + F.col("neg") / 2))
    return runs.agg(F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))
