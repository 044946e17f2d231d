"""Baseline models (B), with results that only a right model gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import baseline, features, windows
from tabloom.plans.common import load
from tabloom.plans.registry import query
from tabloom.session import cut_lineage


def _classes(spark, d):
    """Quality of labelled documents from their length, language and source."""
    docs = load(spark, d, "documents").select(
        "doc_id", F.log1p("n_chars").alias("size"), "lang", "source", F.length("text").alias("length")
    )
    df = windows.hash_split(load(spark, d, "labels").join(docs, "doc_id"), "doc_id")
    pipe = features.ColumnPipeline(["size", "length"], ["lang", "source"]).fit(df.filter("part = 'train'"))
    out = pipe.apply(df, keep=["doc_id", "part", "quality"])
    # Training passes over its input many times; the prepared table is written once.
    ready = cut_lineage(baseline.assemble(out, pipe.names(), "quality", ["doc_id", "part"]), "features")
    return ready.filter("part = 'train'"), ready.filter("part = 'valid'")


def _lines(spark, d, *targets):
    """Line items with prepared features next to the given targets, and the names of the features."""
    df = windows.hash_split(load(spark, d, "lineitem"), "l_orderkey").withColumn(
        "key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    )
    df = df.withColumns({n: e for n, e in targets})
    pipe = features.ColumnPipeline(["l_quantity", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"]).fit(df.filter("part = 'train'"))
    return pipe.apply(df, keep=["key", "part", *[n for n, _ in targets]]), pipe.names()


_VALID = "('0x' || substr(md5({}), 1, 8))::BIGINT % 100 >= 80"


@query(
    "b1_baseline_classifier",
    f"""SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys, true AS classes_known
        FROM labels JOIN documents USING (doc_id) WHERE {_VALID.format("doc_id::VARCHAR")}""",
)
def b1(spark, d):
    """What every run must satisfy: one prediction per held-out key, of a known class."""
    train, valid = _classes(spark, d)
    model = baseline.head("binary-classification").fit(train)
    out = baseline.predict(model, valid, "binary-classification", "doc_id", "quality")
    return out.agg(
        F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_keys"),
        F.bool_and(F.col("quality").isin(0, 1)).alias("classes_known"),
    )


_HELD = f"SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS key FROM lineitem WHERE {_VALID.format('l_orderkey::VARCHAR')}"


@query(
    "b1_baseline_regressor",
    f"SELECT count(*) AS n_rows, count(DISTINCT key) AS n_keys, true AS positive, true AS no_worse FROM ({_HELD})",
)
def b1_regressor(spark, d):
    """One positive price per held-out key, at most 5 % further from the truth (on the log scale) than the mean is."""
    df, names = _lines(spark, d, ("price", F.col("l_extendedprice")))
    out = baseline.Regressor(names, ["price"]).fit(df.filter("part = 'train'")).apply(df.filter("part = 'valid'"))
    mean = df.filter("part = 'train'").agg(F.avg(F.log1p("price"))).scalar()
    error = F.avg((F.log1p("price_pred") - F.log1p("price")) ** 2)
    return out.agg(
        F.count("*").alias("n_rows"), F.count_distinct("key").alias("n_keys"), F.bool_and(F.col("price_pred") > 0).alias("positive"),
        (error <= F.avg((mean - F.log1p("price")) ** 2) * 1.05).alias("no_worse"),
    )


# Three targets that follow from the features: a signed one, one that is linear on the log scale, one with noise.
_TARGETS = {
    "signed": "l_quantity * 3 - l_discount * 400 + IF(l_returnflag = 'R', 50.0D, 0.0D) - 60",
    "growing": "expm1(l_quantity * 0.05D + l_tax * 10)",
    "noisy": "l_quantity * 1000 + l_extendedprice / 10",
}
_TRUTH = """l_quantity * 3 - l_discount * 400 + CASE WHEN l_returnflag = 'R' THEN 50.0::DOUBLE ELSE 0.0 END - 60 AS signed,
     exp(l_quantity * 0.05 + l_tax * 10) - 1 AS growing"""


def _several(spark, d):
    df, names = _lines(spark, d, *[(n, F.expr(e)) for n, e in _TARGETS.items()])
    return baseline.Regressor(names, list(_TARGETS)).fit(df.filter("part = 'train'")).apply(df.filter("part = 'valid'"))


@query(
    "b1_several_targets",
    f"""SELECT key, round(signed, 4) AS signed, false AS signed_log, round(growing, 4) AS growing, true AS growing_log, true AS noisy_log
        FROM (SELECT key, {_TRUTH} FROM ({_HELD}))""",
)
def b1_several(spark, d):
    """All heads from one pass: held-out values that the features determine are found to four digits."""
    return _several(spark, d).select(
        "key", F.round("signed_pred", 4).alias("signed"), "signed_log", F.round("growing_pred", 4).alias("growing"), "growing_log", "noisy_log"
    )


@query(
    "b1_explained_share",
    f"SELECT 'signed' AS target, count(*) AS n, true AS exact, true AS better FROM ({_HELD}) UNION ALL SELECT 'growing', count(*), true, true FROM ({_HELD}) "
    f"UNION ALL SELECT 'noisy', count(*), false, true FROM ({_HELD})",
)
def b1_explained(spark, d):
    """Every head leaves at most two thirds of the squared error of the constant prediction; exact heads leave none."""
    out = _several(spark, d)
    entries = []
    for t in _TARGETS:
        log = lambda c, t=t: F.when(F.col(f"{t}_log"), F.log1p(c)).otherwise(F.col(c))
        left = F.try_divide(F.avg((log(f"{t}_pred") - log(t)) ** 2), F.var_pop(log(t)))
        entries.append(F.struct(F.lit(t).alias("target"), F.count("*").alias("n"), (left < 1e-9).alias("exact"), (left < 2 / 3).alias("better")))
    return out.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def _label_sets(spark, d):
    """The flag, the status, and for a large line the word large."""
    large = F.when(F.col("l_quantity") > 25, F.lit("large"))
    sets = F.array_compact(F.array("l_returnflag", "l_linestatus", large))
    df, names = _lines(spark, d, ("sets", sets))
    return baseline.LabelSets(names, "sets").fit(df.filter("part = 'train'")).apply(df.filter("part = 'valid'"), "found")


@query(
    "b1_label_sets",
    f"SELECT key, array_to_string(list_sort([l_returnflag, l_linestatus]), ' ') AS labels FROM ({_HELD})",
)
def b1_labels(spark, d):
    """Labels that the features determine are found for every held-out key."""
    sure = F.filter("found", lambda x: x != "large")
    return _label_sets(spark, d).select("key", F.array_join(sure, " ").alias("labels"))


@query(
    "b1_uncertain_label",
    f"SELECT count(*) AS n, true AS better FROM ({_HELD})",
)
def b1_uncertain(spark, d):
    """A label that no head separates by itself: errors are under a tenth of those of the constant prediction."""
    has = lambda c: F.array_contains(c, "large")
    wrong = F.count_if(has("found") != has("sets"))
    constant = F.least(F.count_if(has("sets")), F.count_if(~has("sets")))
    return _label_sets(spark, d).agg(F.count("*").alias("n"), (wrong * 10 < constant).alias("better"))


def _problems(spark, d):
    """One feature, two problems on it: a number and a class."""
    x = load(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") / 50).alias("x"))
    number = x.withColumn("y", F.col("x") * F.col("x") * 10)
    label = x.withColumn("y", (F.col("x") > 0.5).cast("double"))
    yield "number", number, "regression", "continuous-regression"
    yield "class", label, "classification", "binary-classification"


@query("b2_bounded_search", "SELECT count(DISTINCT doc_id) > 0 AS searched, 10::BIGINT AS n_trials, 1::BIGINT AS n_best, true AS in_bounds FROM labels")
def b2(spark, d):
    docs = load(spark, d, "labels").join(load(spark, d, "documents"), "doc_id").select("doc_id", F.log1p("n_chars").alias("size"), "quality")
    space = baseline.problem_profile(docs.drop("doc_id"), "classification", "binary-classification", ["quality"])["params"]
    trials = baseline.bounded_search(docs, ["size"], ["quality"], space, F.col("doc_id") % 5)
    rate, mix = space["learning_rate"], space["dropout"]
    inside = F.col("strength").between(rate["min"], rate["max"]) & F.col("mix").between(mix["min"] - 1e-9, mix["max"] + 1e-9)
    return trials.agg(
        (F.count("*") > 0).alias("searched"), F.count("*").alias("n_trials"), F.count_if("is_best").alias("n_best"),
        F.bool_and(inside & (F.col("rmse") > 0)).alias("in_bounds"),
    )


def _drawn(profile: str) -> str:
    space = next(p for p in baseline.tags.BANK if p["name"] == profile)["params"]
    settings = baseline.sampled_settings(space)
    return ", ".join(f"({i}, {s['learning_rate']!r}::DOUBLE, {s['dropout']!r}::DOUBLE)" for i, s in enumerate(settings))


def _scores_sql(problem: str, profile: str) -> str:
    """The elastic net of one feature in closed form, from sums per fold."""
    return f"""SELECT '{problem}' AS problem, '{profile}' AS profile, trial, round(sqrt(sum(
        syy_f - 2 * (b * sy_f + w * sxy_f) + b * b * n_f + 2 * b * w * sx_f + w * w * sxx_f) / sum(n_f)), 9) AS rmse
      FROM (
        SELECT *, sy / n - w * sx / n AS b FROM (
          SELECT *, sign(c) * greatest(abs(c) - strength * mix, 0) / (sxx / n - (sx / n) * (sx / n) + strength * (1 - mix)) AS w FROM (
            SELECT *, sxy / n - (sx / n) * (sy / n) AS c FROM (
              SELECT t.trial, t.strength, t.mix, f.n AS n_f, f.sx AS sx_f, f.sy AS sy_f, f.sxx AS sxx_f, f.sxy AS sxy_f, f.syy AS syy_f,
                a.n - f.n AS n, a.sx - f.sx AS sx, a.sy - f.sy AS sy, a.sxx - f.sxx AS sxx, a.sxy - f.sxy AS sxy
              FROM (VALUES {_drawn(profile)}) t(trial, strength, mix), {problem}_folds f,
                (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM {problem}_folds) a))))
      GROUP BY trial"""


def _folds_sql(problem: str, y: str) -> str:
    return f"""{problem}_folds AS (SELECT l_orderkey % 5 AS fold, count(*) AS n, sum(x) AS sx, sum({y}) AS sy, sum(x * x) AS sxx,
        sum(x * {y}) AS sxy, sum({y} * {y}) AS syy FROM x GROUP BY 1)"""


_NUMBER, _CLASS = "(x * x * 10)", "(x > 0.5)::INT::DOUBLE"


@query(
    "b2_trial_scores",
    f"""WITH x AS (SELECT l_orderkey, l_quantity / 50 AS x FROM lineitem), {_folds_sql("number", _NUMBER)}, {_folds_sql("class", _CLASS)},
        s AS ({_scores_sql("number", "regression_mlp")} UNION ALL {_scores_sql("class", "synthetic_mlp")})
        SELECT problem, profile, trial, rmse FROM s""",
)
def b2_scores(spark, d):
    """Ten trials each for two problems; their tags lead to different profiles."""
    out = None
    for name, df, kind, subtype in _problems(spark, d):
        entry = baseline.problem_profile(df.select("x", "y"), kind, subtype, ["y"])
        found = baseline.bounded_search(df, ["x"], ["y"], entry["params"], F.col("l_orderkey") % 5)
        found = found.select(F.lit(name).alias("problem"), F.lit(entry["name"]).alias("profile"), "trial", F.round("rmse", 9).alias("rmse"))
        out = found if out is None else out.unionByName(found)
    return out


@query(
    "b3_predict_and_submit",
    f"SELECT key, true AS priced, 0.0::DOUBLE AS margin FROM ({_HELD})",
)
def b3(spark, d):
    """A submission of the held-out keys; the price is given back on its own scale."""
    from tabloom.sources import sinks

    df, names = _lines(spark, d, ("price", F.col("l_extendedprice")))
    out = baseline.Regressor(names, ["price"]).fit(df.filter("part = 'train'")).apply(df.filter("part = 'valid'"))
    shaped = sinks.submission(out.select("key", F.col("price_pred").alias("price")), "key", ["price", "margin"])
    return shaped.select("key", (F.col("price") > 0).alias("priced"), "margin")


@query(
    "b3_submission_values",
    f"SELECT key, round(signed, 4) AS signed, round(growing, 4) AS growing, 0.0::DOUBLE AS margin FROM (SELECT key, {_TRUTH} FROM ({_HELD}))",
)
def b3_values(spark, d):
    """Predictions on the targets' own scales, by the flags of the training targets, in submission shape."""
    from tabloom.sources import sinks

    out = _several(spark, d).select("key", F.col("signed_pred").alias("signed"), F.col("growing_pred").alias("growing"))
    shaped = sinks.submission(out, "key", ["signed", "growing", "margin"])
    return shaped.select("key", F.round("signed", 4).alias("signed"), F.round("growing", 4).alias("growing"), "margin")
