"""Baseline models on prepared features, a bounded search, and predictions in submission shape.

Classes have a logistic head; numbers, several targets and label sets have linear heads, fitted together
from one pass (``linear_heads``). The search answers all its trials from the same sums.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import scalars as S
from tabloom.operators import features, profile, sparse, tags
from tabloom.operators.linear_heads import LinearHeads, moments, trial_scores

CLASSIFIERS = features.LABEL_TARGETS
TRIALS = 10
MAX_LABELS = 500


def assemble(df: DataFrame, names: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    vector = array_to_vector(features.array_features(names)).alias("features")
    return df.select(*keep, F.col(label).cast("double").alias("label"), vector)


def head(subtype: str, max_iter: int = 20):
    """Estimator of a class target."""
    if subtype not in CLASSIFIERS:
        raise ValueError(f"{subtype} has linear heads")
    return LogisticRegression(maxIter=max_iter, standardization=False)


def predict(model, df: DataFrame, subtype: str, key: str, target: str) -> DataFrame:
    """``(key, target)``: a class above 0.5, or the class of largest probability."""
    out = model.transform(df)
    if subtype == "binary-classification":
        value = S.threshold(F.element_at(vector_to_array("probability"), 2))
    else:
        value = S.argmax(vector_to_array("probability"))
    return out.select(key, value.alias(target))


@dataclass
class Regressor:
    """Linear heads for one or more numeric targets, each on the scale that its values allow."""

    names: Sequence[str]
    targets: Sequence[str]
    strength: float = 0.0
    mix: float = 0.0

    def fit(self, df: DataFrame) -> Regressor:
        coded = {t: f"__y_{i}" for i, t in enumerate(self.targets)}
        flags = {t: f"__log_{i}" for i, t in enumerate(self.targets)}
        ready = features.transform_targets(df, coded, flags)
        self.heads = LinearHeads.fit(ready, self.names, list(coded.values()), self.strength, self.mix)
        # One row: the flags that the training targets set decide the way back.
        found = ready.agg(*[F.max(f).alias(t) for t, f in flags.items()]).first()
        self.log_applied = {t: bool(found[t]) for t in self.targets}
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        """Adds ``<target>_pred`` on the target's own scale and ``<target>_log``, its flag."""
        for (_, value), t in zip(self.heads.predictions().items(), self.targets, strict=True):
            df = df.withColumns({f"{t}_pred": value, f"{t}_log": F.lit(self.log_applied[t])})
            df = features.invert_target(df, f"{t}_pred", flag=f"{t}_log")
        return df


@dataclass
class LabelSets:
    """One linear head per label of a list column; a label is predicted above one half.

    The labels, at most MAX_LABELS, are those of the training table; more are an error.
    """

    names: Sequence[str]
    target: str

    def fit(self, df: DataFrame) -> LabelSets:
        vocabulary = sparse.label_vocabulary(df, self.target)
        self.labels = [r["value"] for r in vocabulary.orderBy("idx").limit(MAX_LABELS + 1).collect()]
        if len(self.labels) > MAX_LABELS:
            raise ValueError(f"{self.target} has more than {MAX_LABELS} labels")
        known = F.coalesce(F.col(self.target), F.array().cast("array<string>"))
        heads = {f"__l{i}": F.array_contains(known, label).cast("double") for i, label in enumerate(self.labels)}
        self.heads = LinearHeads.fit(df.withColumns(heads), self.names, list(heads))
        return self

    def apply(self, df: DataFrame, out: str) -> DataFrame:
        """Adds the predicted labels in sorted order."""
        chosen = [F.when(S.threshold(score) == 1, F.lit(label)) for label, score in zip(self.labels, self.heads.predictions().values(), strict=True)]
        return df.withColumn(out, F.array_compact(F.array(*chosen)))


def problem_profile(df: DataFrame, problem_type: str, subtype: str, targets: Sequence[str]) -> dict:
    """The entry of the bank whose tags fit the problem and the profile of its table best."""
    schema = profile.schema_profile(df, targets)
    n_features = F.count("*") - F.count_if("is_target")
    facts = schema.agg(
        F.bool_or(tags.is_text_column(F.col("name"), F.col("type"), string_type=True)).alias("text"),
        F.bool_or(F.col("type") == "datetime").alias("dates"), n_features.alias("n"), F.bool_or(F.col("missing_pct") > 0).alias("missing"),
    )
    found = tags.problem_tags(F.lit(problem_type), F.lit(subtype), F.col("text"), F.col("dates"), F.col("n"), F.col("missing"))
    name = facts.select(tags.best_profile(found).alias("name")).first()["name"]
    return next(p for p in tags.BANK if p["name"] == name)


def sampled_settings(space: Mapping[str, Mapping], trials: int = TRIALS, seed: int = 42) -> list[dict]:
    """``trials`` settings drawn from every range and choice of a profile's space."""
    rng = random.Random(seed)

    def draw(p: Mapping):
        if p["type"] == "choice":
            return rng.choice(p["values"])
        if p.get("sampling") == "log":
            return p["min"] * (p["max"] / p["min"]) ** rng.random()
        value = p["min"] + p["step"] * rng.randint(0, round((p["max"] - p["min"]) / p["step"]))
        return int(value) if p["type"] == "int" else value

    return [{name: draw(p) for name, p in space.items()} for _ in range(trials)]


def bounded_search(
    df: DataFrame, names: Sequence[str], targets: Sequence[str], space: Mapping[str, Mapping], fold: Column, trials: int = TRIALS, seed: int = 42
) -> DataFrame:
    """(trial, strength, mix, rmse, is_best) of settings drawn from the space, by cross-validation over the folds.

    The learning-rate range bounds the strength of the linear heads' penalty and the dropout range its mix.
    The rows are read once, whatever the number of trials and folds. The first of equal scores is the best.
    """
    settings = [(s["learning_rate"], s["dropout"]) for s in sampled_settings(space, trials, seed)]
    scores = trial_scores(moments(df, names, targets, fold), settings)
    best = scores.index(min(scores))
    rows = [(i, float(s), float(m), score, i == best) for i, ((s, m), score) in enumerate(zip(settings, scores, strict=True))]
    return df.sparkSession.createDataFrame(rows, "trial int, strength double, mix double, rmse double, is_best boolean")
