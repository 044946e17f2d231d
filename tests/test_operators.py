"""Edge cases: empty tables, nulls, ties, limits, unseen values and the large-table paths."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions import scalars as S
from tabloom.operators import encoders, features, metrics, profile, project, sparse, tags, windows
from tabloom.operators.quantiles import exact_quantiles
from tabloom.operators.running import row_numbers, running_totals


def _interpolated(values, p):
    values = sorted(values)
    pos = p * (len(values) - 1)
    low, high = math.floor(pos), math.ceil(pos)
    return values[low] if low == high else (high - pos) * values[low] + (pos - low) * values[high]


def test_quantiles_against_sorting(spark):
    rng = np.random.default_rng(5)
    nan, inf = float("nan"), float("inf")
    # Group 0 holds 90 % of the rows.
    rows = [(float(x), float(y), int(g == 9)) for x, y, g in zip(rng.normal(size=4000) * 1e6, rng.integers(0, 4, 4000), rng.integers(0, 10, 4000))]
    rows += [(None, 1.0, 7), (1e300, 2.0, 0), (-1e300, 3.0, 1), (nan, nan, 0), (inf, 5.0, 0), (-inf, -inf, 1), (nan, 2.0, None)]
    df = spark.createDataFrame(rows, "x double, y double, g int")
    probs = [0.0, 0.25, 0.5, 0.8, 1.0]

    def known(i, of):
        return [r[i] for r in rows if r[i] is not None and not math.isnan(r[i]) and of(r)]

    got = exact_quantiles(df, ["x", "y"], probs).first()
    assert list(got) == [_interpolated(known(i, lambda r: True), p) for i in (0, 1) for p in probs]
    by = {r["g"]: (r["x__q0"], r["y__q0"]) for r in exact_quantiles(df, ["x", "y"], [0.3], ["g"]).collect()}
    assert by.keys() == {0, 1, 7, None} and by[7] == (None, 1.0) and by[None] == (None, 2.0)
    for g in (0, 1):
        assert by[g] == tuple(_interpolated(known(i, lambda r: r[2] == g), 0.3) for i in (0, 1))


def test_quantile_of_empty_and_all_null(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]).first()[0] is None
    assert exact_quantiles(df.limit(0), ["x"], [0.5]).first()[0] is None


def test_splits_keep_large_keys_apart(spark):
    df = spark.range(10).select((F.col("id") + (1 << 53)).alias("id"))
    got = {r.id - (1 << 53): r.part for r in windows.tail_split(df, "id").collect()}
    assert [i for i, p in got.items() if p == "valid"] == [8, 9]
    got = {r.id - (1 << 53): r.part for r in windows.cut_at_quantile(df, F.col("id"), 0.75).collect()}
    assert sorted(i for i, p in got.items() if p == "valid") == [7, 8, 9]


def test_imputers_treat_nan_as_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, "a"), (nan, "a"), (None, None), (5.0, "b")], "x double, c string")
    filled = features.MedianImputer(["x"]).fit(df).apply(df)
    assert sorted(r.x for r in filled.collect()) == [1.0, 3.0, 3.0, 5.0]
    modes = spark.createDataFrame([(nan,), (nan,), (2.0,), (None,)], "x double")
    assert {r.x for r in features.ModeImputer(["x"]).fit(modes).apply(modes).collect()} == {2.0}
    cells = project.missing_cells(df.withColumn("id", F.monotonically_increasing_id()), "id", ["x", "c"]).collect()
    assert sorted(r["column"] for r in cells) == ["c", "x", "x"]


def test_running_totals_blocks_equal_window(spark):
    # One key holds most rows and all of them share one order value.
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 10 < 8, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        F.lit(1).alias("day"), (F.col("id") % 7).alias("v"),
    )
    for inclusive in (True, False):
        args = (["day", "id"], {"s": F.col("v")}, ["k"], inclusive)
        small = running_totals(df, *args)
        large = running_totals(df, *args, blocks=13)
        assert sorted(small.collect()) == sorted(large.select(small.columns).collect())
    a = row_numbers(df, ["id"], "n")
    b = row_numbers(df, ["id"], "n", blocks=13)
    assert sorted(a.collect()) == sorted(b.select(a.columns).collect())


def test_profile_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, 1.5, True), (2, 3, float("nan"), False)], "a int, b int, c double, d boolean")
    got = {r["name"]: (r["type"], r["missing_pct"]) for r in profile.schema_profile(df).collect()}
    assert got == {"a": ("int", 0.0), "b": ("float", 50.0), "c": ("float", 50.0), "d": ("boolean", 0.0)}
    assert all(r["missing_pct"] is None for r in profile.schema_profile(df.limit(0)).collect())


def test_summary_skips_nan_and_reports_absent(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (4.0,), (None,)], "y double")
    rows = {r["target"]: r for r in profile.numeric_summary(df, ["y", "z"]).collect()}
    assert (rows["y"]["min"], rows["y"]["median"], rows["y"]["max"]) == (1.0, 2.5, 4.0)
    assert rows["z"]["error"] == "not found"


@pytest.mark.parametrize("n,names", [(50, 50), (51, 1)])
def test_schema_collapse_gate(spark, n, names):
    df = spark.range(3).select(*[F.col("id").alias(f"f{i}") for i in range(n)])
    assert profile.compact_schema(profile.schema_profile(df)).count() == names


@pytest.mark.parametrize("n,more", [(50, []), (51, ["... +1 more"])])
def test_class_gate(spark, n, more):
    shares = spark.range(n).select(F.col("id").cast("string").alias("class"), F.lit(1.0).alias("pct"))
    classes = [r["class"] for r in profile.top_classes(shares).collect()]
    assert len(classes) == 50 + len(more) and classes[50:] == more


def test_mode_takes_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", 10), ("a", 9), ("b", 9), ("a", 10), (None, None)], "s string, n int")
    assert encoders.most_frequent(df, ["s", "n"]).first().asDict() == {"s": "a", "n": 9}


def test_constant_column_scales_without_error(spark):
    df = spark.createDataFrame([(2.0, 5.0), (2.0, None)], "x double, y double")
    assert {r.x for r in features.StandardScaler(["x"]).fit(df).apply(df).collect()} == {0.0}
    out = features.MinMaxScaler(["x", "y"]).fit(df).apply(df).collect()
    assert out[0].y == 0.0 and out[1].y is None and out[0].x == 0.0


def test_one_hot_unknown_and_limit(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    enc = features.OneHot(["s"]).fit(df)
    got = enc.apply(spark.createDataFrame([("b",), ("z",), (None,)], "s string")).collect()
    assert [tuple(r) for r in got] == [(0.0, 1.0), (0.0, 0.0), (0.0, 0.0)]
    with pytest.raises(ValueError):
        features.OneHot(["s"]).fit(spark.range(51).select(F.col("id").cast("string").alias("s")))


def test_cardinality_gate(spark):
    df = spark.range(400).select(
        (F.col("id") % 50).cast("string").alias("fifty"), (F.col("id") % 51).cast("string").alias("more")
    )
    assert project.drop_high_cardinality(df).columns == ["fifty"]


def test_require_clean_fails_on_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    with pytest.raises(Exception, match="null or NaN"):
        project.require_clean(df).collect()


def test_negative_target_is_not_logged(spark):
    df = spark.createDataFrame([(-1.0,), (3.0,)], "y double")
    out = features.transform_target(df, "continuous-regression", "y", "t")
    assert sorted(r.t for r in out.collect()) == [-1.0, 3.0] and not out.first().log_applied
    back = features.invert_target(out, "t")
    assert sorted(r.t for r in back.collect()) == [-1.0, 3.0]


def test_multi_label_target(spark):
    df = spark.createDataFrame([(["b", "a"],), (["c"],)], "y array<string>")
    out = features.transform_target(df, features.MULTI_LABEL, "y", "t")
    assert sorted(r[0] for r in out.select(sparse.dense(F.col("t"))).collect()) == [[0.0, 0.0, 1.0], [1.0, 1.0, 0.0]]
    assert sorted((r.t.size, r.t.indices) for r in out.collect()) == [(3, [0, 1]), (3, [2])]


def test_targets_have_one_flag_each(spark):
    df = spark.createDataFrame([(1.0, -1.0, None), (3.0, 2.0, None)], "a double, b double, c double")
    targets, flags = {"a": "ya", "b": "yb", "c": "yc"}, {"a": "fa", "b": "fb", "c": "fc"}
    got = features.transform_targets(df, targets, flags).orderBy("a").collect()
    assert [(r.fa, r.fb, r.fc) for r in got] == [(True, False, False)] * 2
    assert got[0].ya == pytest.approx(math.log(2)) and got[0].yb == -1.0 and got[0].yc is None
    joint = features.transform_targets(df, targets, flags, together=True).first()
    assert not (joint.fa or joint.fb or joint.fc)


def test_hundred_thousand_categories(spark):
    """A row holds its own entries; the vocabulary stays a table."""
    n = 100_000
    df = spark.range(n).select("id", F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("c"), (F.col("id") % 3).alias("k"))
    vocabulary = sparse.vocabularies(df, ["c", "k"])
    coded = sparse.category_blocks(df.withColumn("c", F.when(F.col("id") % 10 != 0, F.col("c"))), vocabulary, {"c": 2.0, "k": 1.0}, "v")
    v = F.col("v")
    checked = coded.agg(
        F.bool_and(v["size"] == n + 3).alias("size"), F.max(F.size(v["indices"])).alias("most"), F.min(F.size(v["indices"])).alias("least"),
        F.bool_and(sparse.value_at(v, F.col("id").cast("int")) == F.when(F.col("id") % 10 != 0, 2.0).otherwise(0.0)).alias("first"),
        F.bool_and(sparse.value_at(v, (F.lit(n) + F.col("id") % 3).cast("int")) == 1.0).alias("second"),
        F.bool_and(F.abs(sparse.norm(v) ** 2 - sparse.product(v, v)) < 1e-9).alias("norm"),
    ).first()
    assert checked.asDict() == {"size": True, "most": 2, "least": 1, "first": True, "second": True, "norm": True}
    sets = sparse.label_sets(df.withColumn("w", F.array("c", F.lit("unknown"))), "w", vocabulary.filter("column = 'c'"), "v", "id")
    assert sets.filter("v.size = 100000 AND size(v.indices) = 1 AND v.indices[0] = id").count() == n
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and plan.count("collect_list") == 1  # a row's own labels


def test_hybrid_product_is_the_score(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], "a"), (2, [0.0, 1.0], "a"), (3, [0.0, 0.0], None)], "id long, v array<double>, c string")
    coded = sparse.category_blocks(df, sparse.vocabularies(df, ["c"]), {"c": 2.0}, "b").select("id", sparse.hybrid(F.col("v"), F.col("b")).alias("h"))
    pairs = coded.alias("x").join(coded.alias("y"), F.col("x.id") <= F.col("y.id"))
    got = {(r[0], r[1]): r[2] for r in pairs.select("x.id", "y.id", sparse.hybrid_product(F.col("x.h"), F.col("y.h"))).collect()}
    assert got[1, 1] == pytest.approx(1) and got[1, 2] == pytest.approx((0.8 + 4) / 5) and got[1, 3] == got[3, 3] == 0


def test_group_median_of_empty_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, None), (None, 9.0)], "g string, x double")
    got = sorted((str(r.g), r.x) for r in windows.group_median_fill(df, ["g"], "x").collect())
    assert got == [("None", 9.0), ("None", 9.0), ("a", 1.0), ("a", 3.0), ("b", 3.0)]


def test_single_class_metrics(spark):
    df = spark.createDataFrame([(1, 0.2, 1), (1, 0.4, 1)], "y int, s double, p int")
    assert metrics.auc(df, F.col("y"), F.col("s")).first()[0] is None
    assert metrics.binary_scores(df, F.col("y"), F.col("p")).first()["mcc"] == 0.0
    assert metrics.adjusted_rand(df, F.col("y"), F.col("p")).first()["ari"] == 1.0


def test_auc_large_path(spark):
    df = spark.range(500).select((F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") * 37 % 101 / 10).alias("s"))
    a = metrics.auc(df, F.col("y"), F.col("s")).first()[0]
    b = metrics.auc(df, F.col("y"), F.col("s"), blocks=3).first()[0]
    rows = df.collect()
    pos, neg = [r.s for r in rows if r.y], [r.s for r in rows if not r.y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert a == pytest.approx(want) and b == pytest.approx(want)


def test_stratified_split_sizes(spark):
    df = spark.range(1000).withColumn("c", F.when(F.col("id") < 900, 0).otherwise(1))
    a = windows.stratified_split(df, "id", "c")
    b = windows.stratified_split(df, "id", "c", blocks=5)
    assert sorted(a.select("id", "part").collect()) == sorted(b.select("id", "part").collect())
    sizes = {(r["c"], r["part"]): r["count"] for r in a.groupBy("c", "part").count().collect()}
    assert sizes == {(0, "valid"): 180, (0, "train"): 720, (1, "valid"): 20, (1, "train"): 80}


def test_tail_split_of_tiny_table(spark):
    assert {r.part for r in windows.tail_split(spark.range(3), "id").collect()} == {"train"}
    got = {r.id: r.part for r in windows.tail_split(spark.range(10), "id").collect()}
    assert [i for i, p in got.items() if p == "valid"] == [8, 9]


def test_profile_bank_ties_and_minimum(spark):
    df = spark.createDataFrame([(["nothing"],), (["regression", "tabular"],), (["time-series"],)], "t array<string>")
    got = [r[0] for r in df.select(tags.best_profile(F.col("t"))).collect()]
    assert got == ["synthetic_mlp", "regression_mlp", "ts_lstm_forecasting"]
    bank = tags.bank_table(spark).orderBy("ord").collect()
    assert len(bank) == 4 and bank[2]["params"]["dense_units"]["max"] == 128.0


def test_scalar_edges(spark):
    df = spark.createDataFrame([(None, "x"), (float("nan"), '["a", "b"]'), (400.0, "{")], "x double, s string")
    got = df.select(S.clip(F.col("x"), 0.0, 255.0).alias("c"), S.nan_to(F.col("x"), 0.5).alias("n"), S.as_list(F.col("s")).alias("l"), S.outer_braces(F.col("s")).alias("b")).collect()
    assert got[0].c is None and got[0].n == 0.5 and got[1].n == 0.5 and got[2].c == 255.0
    assert [r.l for r in got] == [["x"], ["a", "b"], ["{"]] and got[2].b == "{"
    ref = spark.createDataFrame([("https://www.host.org/u/k?x=1",), ("u/k",), ("http://other/u",)], "r string")
    assert [r[0] for r in ref.select(S.bare_reference(F.col("r"), "www.host.org")).collect()] == ["u/k", "u/k", "other/u"]


def test_distance_of_antipodes(spark):
    d = spark.range(1).select(S.great_circle(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0))).first()[0]
    assert d == pytest.approx(math.pi * 6371)
