import random

import numpy as np
from pyspark.sql import functions as F

from tabloom.llm import toxicity
from tests.llm.fixtures import awkward, awkward_rows, empty

GROUPS = (("women", "men"),)


def _biased(seed=4):
    """Toxic texts mostly name one group, other texts the other one."""
    rnd = random.Random(seed)
    filler = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(600):
        label = i % 3 == 0
        words = rnd.choices(filler, k=12) + (["awful"] if label and rnd.random() < 0.9 else [])
        words.append("women" if (rnd.random() < 0.9) == label else "men")
        rnd.shuffle(words)
        rows.append((" ".join(words) + ".", int(label)))
    return rows


def _score(model, text):
    weights, intercept = model
    return 1 / (1 + np.exp(-(intercept + sum(weights.get(f, 0) for f in toxicity.features(text)))))


def test_penalty_removes_the_group_from_the_score(spark):
    df = spark.createDataFrame(_biased(), "text string, label int")
    free, fair = toxicity.fit(df, GROUPS, 0.0), toxicity.fit(df, GROUPS, 10.0)
    gap = lambda m: abs(_score(m, "women word1 word2") - _score(m, "men word1 word2"))
    assert gap(free) > 0.2
    assert gap(fair) < 0.05
    assert _score(fair, "awful word1") > 0.5 > _score(fair, "word1 women")


def test_swaps_are_formed_per_sentence():
    found = toxicity.swaps("The women ran. Men and men slept! Nobody.", GROUPS)
    assert found[("women",), ("men",)] == 1 and found[("men",), ("women",)] == 1


def test_held_out_toxic_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.op10_toxicity(spark, sf).join(labels, "doc_id").filter("held_out")
    r = found.agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("hit"), F.sum("toxic").alias("toxic"),
        F.sum(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("false"), F.count("*").alias("n"),
    ).first()
    assert r["hit"] / r["toxic"] > 0.7
    assert r["false"] / (r["n"] - r["toxic"]) < 0.01


def test_awkward_rows(spark):
    df = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (8, 0, 1), (8, 0, 0), (None, 1, 1), (99, 1, 1)], "doc_id bigint, toxic int, text int")
    model = toxicity.fit(toxicity.labelled_sample(df, labels, F.lit(True)), GROUPS)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(awkward_rows())
    empties = {r["score"] for r in got if r["doc_id"] in (4, 5, 6, 7)}
    assert len(empties) == 1 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.fit(toxicity.labelled_sample(empty(spark), labels, F.lit(True))) is None
    assert {r["score"] for r in toxicity.score(df, None).collect()} == {0.0}
    assert toxicity.score(empty(spark), model).count() == 0
