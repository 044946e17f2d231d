"""Toxicity by a counterfactually regularised linear classifier.

Features are the presence of lower-case words and of word beginnings of STEM characters. The
FEATURES most telling ones (by the likelihood ratio of their counts in toxic and other texts) and
all identity terms met get a weight, fitted by penalised logistic regression.

For each sentence of the sample that names an identity term, copies with the term swapped for
the other terms of its group are formed. The fit adds STRENGTH * (score change) ** 2 for each
distinct swap, weighted by its share of all swaps, so a neutral mention of a group cannot carry
weight that the mention of another group does not carry.

Sample (the bound of the fit): the SAMPLE_TEXTS labelled texts with the smallest hash of their id
among those of at most SAMPLE_CHARS characters. Scoring reads all texts whole.

Defined results: a null or empty text has no features and gets the score of the intercept. Rows
without a label, or with a null label, are not learned from; of several labels of an id the
largest counts. Without labelled texts of both kinds all scores are 0. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.support import fold, load, query

SAMPLE_TEXTS, SAMPLE_CHARS = 20_000, 50_000
FEATURES = 4096
STEM = 5
STRENGTH = 10.0
RIDGE = 1e-3
ROUNDS = 300
RATE = 0.1

# Groups of terms that may be swapped for one another.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("black", "white", "asian", "latino"),
    ("immigrants", "refugees", "natives"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def features(text: str) -> set[str]:
    """Words, and as ``^stem`` the beginnings of longer words."""
    words = set(_WORD.findall(text.lower()))
    return words | {"^" + w[:STEM] for w in words if len(w) > STEM}


def swaps(text: str, groups: Sequence[Sequence[str]]) -> Counter:
    """Feature changes of all single swaps in the sentences: (features lost, features won) -> times."""
    group_of = {t: g for g in groups for t in g}
    found: Counter = Counter()
    for sentence in _SENTENCE.findall(text.lower()):
        words = _WORD.findall(sentence)
        named = {w for w in words if w in group_of}
        if not named:
            continue
        own = features(sentence)
        for term in named:
            for other in group_of[term]:
                if other != term:
                    new = features(" ".join(other if w == term else w for w in words))
                    found[tuple(sorted(own - new)), tuple(sorted(new - own))] += 1
    return found


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic, other = Counter(), Counter()
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            (toxic if label else other).update(features(text.as_py()))
        names = list(toxic.keys() | other.keys())
        columns = [pa.array(names, pa.string()), *[pa.array([c[n] for n in names], pa.int64()) for c in (toxic, other)]]
        yield pa.RecordBatch.from_arrays(columns, names=["feature", "toxic", "other"])


def _examples(index: dict[str, int], groups):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, swapped, times = [], [], Counter()
            for text in batch.column(0):
                at.append(sorted(index[f] for f in features(text.as_py()) if f in index))
                for (lost, won), n in swaps(text.as_py(), groups).items():
                    times[tuple(index[f] for f in lost if f in index), tuple(index[f] for f in won if f in index)] += n
                swapped.append([])
            if at and times:
                swapped[0] = [{"lost": list(k[0]), "won": list(k[1]), "n": n} for k, n in times.items()]
            kind = pa.list_(pa.struct([("lost", pa.list_(pa.int32())), ("won", pa.list_(pa.int32())), ("n", pa.int64())]))
            columns = [pa.array(at, pa.list_(pa.int32())), batch.column(1), pa.array(swapped, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "label", "swaps"])

    return run


def train(rows: list[np.ndarray], labels: np.ndarray, changes: list[tuple], size: int, strength: float = STRENGTH):
    """Weights and intercept by gradient steps with momentum estimates.

    ``changes`` has (features lost, features won, times).
    """
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    lost = [(i, k, -1.0) for i, (a, _, _) in enumerate(changes) for k in a]
    won = [(i, k, 1.0) for i, (_, b, _) in enumerate(changes) for k in b]
    c_row, c_at, c_sign = (np.array(x) for x in zip(*(lost + won), strict=True)) if lost + won else (np.zeros(0, int),) * 3
    times = np.array([float(n) for _, _, n in changes])
    share = times / times.sum() if len(times) else times
    balance = np.where(labels > 0, 0.5 / max(1, (labels > 0).sum()), 0.5 / max(1, (labels == 0).sum()))
    # Half way between equal weight of both kinds and equal weight of all rows.
    weight = 0.5 * balance + 0.5 / len(labels)
    w, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, ROUNDS + 1):
        margin = w[size] + np.bincount(row, w[flat], len(rows))
        gap = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels)
        grad = np.append(np.bincount(flat, gap[row], size) + RIDGE * w[:size] / 10, gap.sum())
        if len(c_at):
            change = np.bincount(c_row, c_sign * w[c_at], len(changes))
            grad[:size] += 2 * strength * np.bincount(c_at, c_sign * (share * change)[c_row], size)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w[:size], float(w[size])


def fit(texts: DataFrame, groups: Sequence[Sequence[str]] = IDENTITY_TERMS, strength: float = STRENGTH) -> tuple[dict, float] | None:
    """Weights by feature and the intercept from (text, label); null without both kinds."""
    kinds = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not kinds.get(0) or not kinds.get(1):
        return None
    counted = texts.mapInArrow(_count_features, "feature string, toxic bigint, other bigint")
    counted = counted.groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    share = kinds[1] / (kinds[0] + kinds[1])
    n = F.col("a") + F.col("b")
    ratio = F.col("a") * F.log((F.col("a") + 0.1) / (n * share + 0.1)) + F.col("b") * F.log(
        (F.col("b") + 0.1) / (n * (1 - share) + 0.1)
    )
    named = sorted({t for g in groups for t in g} | {"^" + t[:STEM] for g in groups for t in g if len(t) > STEM})
    telling = counted.filter("a + b > 1").orderBy(ratio.desc(), "feature").limit(FEATURES).select("feature").collect()
    present = counted.filter(F.col("feature").isin(named)).select("feature").collect() if named else []
    names = sorted({r["feature"] for r in telling} | {r["feature"] for r in present} | set(named))
    index = {f: i for i, f in enumerate(names)}
    schema = "at array<int>, label int, swaps array<struct<lost: array<int>, won: array<int>, n: bigint>>"
    found = texts.mapInArrow(_examples(index, groups), schema).toArrow()
    rows = [np.array(x.as_py()) for x in found.column("at")]
    changes: Counter = Counter()
    for part in found.column("swaps").to_pylist():
        for s in part:
            changes[tuple(s["lost"]), tuple(s["won"])] += s["n"]
    order = sorted((a, b, n) for (a, b), n in changes.items())
    labels = found.column("label").to_numpy().astype(np.float64)
    w, b = train(rows, labels, order, len(names), strength)
    return {f: float(w[i]) for f, i in index.items() if w[i]}, b


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if model is None:
                score = np.zeros(batch.num_rows)
            else:
                weights, intercept = model
                known = weights.keys()
                margin = [
                    intercept + sum(map(weights.__getitem__, sorted(features(t.as_py() or "") & known))) for t in batch.column(1)
                ]
                score = 1 / (1 + np.exp(-np.clip(np.array(margin, dtype=np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return run


def score(df: DataFrame, model: tuple[dict, float] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # FEATURES weights
    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t"))
    return slim.mapInArrow(_scorer(shared), "doc_id bigint, score double")


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic") -> DataFrame:
    """(text, label) of the sampled rows."""
    known = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    able = docs.filter(usable & F.col("doc_id").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    chosen = able.select("doc_id").join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_TEXTS)
    return able.select("doc_id", "text").join(F.broadcast(chosen.distinct()), "doc_id").select("text", "label")


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = fit(labelled_sample(docs, load(spark, sf_dir, "labels"), ~held_out))
    found = score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
