"""Linear heads for many targets from one pass of sufficient statistics.

With z = (1, features, targets), every task sums z z' per fold over its rows. The sums hold all that least
squares needs: the Gram matrix, its products with every target, and the squares of the targets. So all
heads are solved at once, any setting of an elastic net is fitted and scored on any fold without reading
a row again, and what leaves the tasks is a matrix of bounded size (MAX_COLUMNS) per fold.

    minimise  |y - b - x w|^2 / 2n + strength * (mix * |w|_1 + (1 - mix) / 2 * |w|_2^2)

Rows with a missing feature or target do not count.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import vectors as V

# Executors need not have this package installed: what runs in tasks travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_COLUMNS = 2000
SWEEPS, CLOSE = 2000, 1e-12
ROWS = 8192


@dataclass
class Moments:
    """Sums of z z' per fold, for z = (1, features, targets)."""

    features: list[str]
    targets: list[str]
    folds: dict[int, np.ndarray]

    def total(self, without: int | None = None) -> np.ndarray:
        width = 1 + len(self.features) + len(self.targets)
        return sum((m for f, m in self.folds.items() if f != without), np.zeros((width, width)))


def _accumulate(width: int):
    top = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                fold = part.column("fold").to_numpy()
                z = np.asarray(part.column("z").flatten()).reshape(part.num_rows, width)
                whole = np.isfinite(z).all(axis=1)
                for f in np.unique(fold[whole]).tolist():
                    own = z[whole & (fold == f)]
                    sums[f] = sums.get(f, 0) + own.T @ own
        for f, m in sums.items():
            cells = np.arange(len(top[0]), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), f, dtype=np.int32)), pa.array(cells), pa.array(m[top])], ["fold", "cell", "s"])

    return run


def moments(df: DataFrame, features: Sequence[str], targets: Sequence[str], fold: Column | None = None) -> Moments:
    """One pass over the rows; ``fold`` is a small number per row, by default one fold."""
    width = 1 + len(features) + len(targets)
    if width > MAX_COLUMNS:
        raise ValueError(f"{width} columns are more than {MAX_COLUMNS}")
    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan")))
    z = F.array(F.lit(1.0), *[cell(c) for c in [*features, *targets]])
    rows = df.select((F.lit(0) if fold is None else fold).cast("int").alias("fold"), z.alias("z"))
    found = rows.mapInArrow(_accumulate(width), "fold int, cell int, s double").groupBy("fold", "cell").agg(F.sum("s").alias("s")).toArrow()
    top = np.triu_indices(width)
    folds: dict[int, np.ndarray] = {}
    for f in np.unique(found["fold"].to_numpy()).tolist():
        own = found["fold"].to_numpy() == f
        m = np.zeros((width, width))
        at = found["cell"].to_numpy()[own]
        m[top[0][at], top[1][at]] = found["s"].to_numpy()[own]
        folds[f] = np.triu(m) + np.triu(m, 1).T
    return Moments(list(features), list(targets), folds)


def solve(m: np.ndarray, n_features: int, strength: float = 0.0, mix: float = 0.0) -> np.ndarray:
    """Weights of all heads, one column per target, the intercept in the first row."""
    p, n = n_features, m[0, 0]
    if n == 0:
        raise ValueError("no complete row")
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    gram, cross = cov[:p, :p], cov[:p, p:]
    ridge = gram + strength * (1 - mix) * np.eye(p)
    if strength * mix == 0:
        w = np.linalg.solve(ridge, cross) if strength > 0 else np.linalg.lstsq(gram, cross, rcond=1e-10)[0]
    else:  # coordinate descent, all heads side by side
        w, lasso = np.zeros_like(cross), strength * mix
        scale = np.diag(ridge)
        for _ in range(SWEEPS):
            before = w.copy()
            for j in range(p):
                rest = cross[j] - gram[j] @ w + gram[j, j] * w[j]
                w[j] = np.sign(rest) * np.maximum(np.abs(rest) - lasso, 0) / scale[j] if scale[j] > 0 else 0.0
            if np.abs(w - before).max(initial=0.0) < CLOSE:
                break
    intercept = mean[p:] - mean[:p] @ w
    return np.vstack([intercept, w])


def squared_error(m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of squared errors per target over the rows behind the moments."""
    q = len(weights)
    return np.diag(m[q:, q:]) - 2 * (weights * m[:q, q:]).sum(axis=0) + ((m[:q, :q] @ weights) * weights).sum(axis=0)


@dataclass
class LinearHeads:
    """One linear head per target."""

    features: list[str]
    targets: list[str]
    weights: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], targets: Sequence[str], strength: float = 0.0, mix: float = 0.0) -> LinearHeads:
        m = moments(df, features, targets)
        return cls(m.features, m.targets, solve(m.total(), len(m.features), strength, mix))

    def predictions(self) -> dict[str, Column]:
        """One expression per target; a missing feature gives null."""
        x = F.array(F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in self.features])
        return {t: V.dot(x, F.lit(self.weights[:, i].tolist())) for i, t in enumerate(self.targets)}

    def apply(self, df: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
        """Adds the predictions, under ``names[target]`` or ``<target>_pred``."""
        return df.withColumns({(names or {}).get(t, f"{t}_pred"): e for t, e in self.predictions().items()})


def trial_scores(m: Moments, settings: Sequence[tuple[float, float]]) -> list[float]:
    """Root mean squared error over all targets on the held-out folds, for every (strength, mix)."""
    scores = []
    for strength, mix in settings:
        error = rows = 0.0
        for f, held in m.folds.items():
            weights = solve(m.total(f), len(m.features), strength, mix)
            error += float(squared_error(held, weights).sum())
            rows += held[0, 0] * len(m.targets)
        scores.append(float((max(error, 0.0) / rows) ** 0.5))
    return scores
