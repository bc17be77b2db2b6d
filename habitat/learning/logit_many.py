"""Many logistic regressions on the same rows, one pass over the rows per step of all of them.

Each is fitted to the optimum of the mean loss plus penalty of ``logit.fit_logit`` by proximal Newton
steps. A pass sums loss, gradient and second derivatives of every open model; these sums, whose size
is fixed by the number of features, are all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Numbers that a pass may hold per slice of rows, and that may pass the driver at once.
SLICE, PASS = 2_000_000, 4_000_000
#: A fit ends where a step promises less than this of the loss.
TOLERANCE = 1e-11


@dataclass
class Fit:
    """One model: rows outside ``fold``, weights of the classes 0 and 1, penalties on the mean loss.

    ``stops`` are iteration limits; ``at`` holds the coefficients (intercept last) at each of them.
    """

    fold: int
    weights: tuple[float, float]
    l1: float
    l2: float
    stops: list[int]
    at: dict[int, np.ndarray] = field(default_factory=dict)
    iterations: int = 0

    def start(self, size: int) -> None:
        self.beta = self.trial = np.zeros(size)
        self.value, self.step, self.shrink, self.promise = np.inf, np.zeros(size), 1.0, 0.0

    def penalty(self, beta: np.ndarray) -> float:
        return self.l1 * np.abs(beta[:-1]).sum() + 0.5 * self.l2 * (beta[:-1] ** 2).sum()

    def close(self) -> None:
        self.at.update({s: self.beta for s in self.stops if s not in self.at})

    @property
    def open(self) -> bool:
        return any(s not in self.at for s in self.stops)

    def take(self, sums: np.ndarray) -> bool:
        """Judge the trial point by its sums; true if it is accepted and a new step is due."""
        size, total = len(self.beta), sums[0]
        value = sums[1] / total + self.penalty(self.trial)
        if np.isfinite(self.value) and not value <= self.value + 1e-4 * self.shrink * self.promise + 1e-15:
            self.shrink /= 2
            if self.shrink < 1e-10:
                self.close()
            self.trial = self.beta + self.shrink * self.step
            return False
        self.iterations += np.isfinite(self.value)
        self.beta, self.value, self.shrink = self.trial, value, 1.0
        self.at.update({s: self.beta for s in self.stops if s == self.iterations})
        ridge = np.append(np.full(size - 1, self.l2), 0.0)
        self.slope = sums[2 : 2 + size] / total + ridge * self.beta
        upper = np.zeros((size, size))
        upper[np.triu_indices(size)] = sums[2 + size :] / total
        self.curve = upper + np.triu(upper, 1).T + np.diag(ridge)
        # Keeps steps finite along directions without curvature.
        self.curve += np.eye(size) * (1e-10 * max(1e-6, np.trace(self.curve)))
        return True

    def aim(self, step: np.ndarray) -> None:
        self.step, self.trial = step, self.beta + step
        gone = self.l1 * (np.abs(self.trial[:-1]).sum() - np.abs(self.beta[:-1]).sum())
        self.promise = float(self.slope @ step + gone)
        if self.promise > -TOLERANCE * max(1.0, abs(self.value)):
            self.close()


def _steps(fits: list[Fit]) -> np.ndarray:
    """Minimum of each quadratic model plus its l1 term, by coordinate descent on all fits at once."""
    slope, curve = np.stack([f.slope for f in fits]), np.stack([f.curve for f in fits])
    beta, l1 = np.stack([f.beta for f in fits]), np.array([f.l1 for f in fits])
    # A good start, and the answer where there is no l1 term.
    step = np.linalg.solve(curve, -slope[..., None])[..., 0]
    rest = np.flatnonzero(l1 > 0)
    if not len(rest):
        return step
    slope, curve, beta, l1 = slope[rest], curve[rest], beta[rest], l1[rest]
    d = step[rest]
    for _ in range(2000):
        before = d.copy()
        for j in range(d.shape[1]):
            own = curve[:, j, j]
            pull = own * (beta[:, j] + d[:, j]) - (slope[:, j] + (curve[:, j] * d).sum(1))
            limit = l1 if j < d.shape[1] - 1 else 0.0
            d[:, j] = np.sign(pull) * np.maximum(np.abs(pull) - limit, 0.0) / own - beta[:, j]
        if np.abs(d - before).max() < 1e-12 * max(1.0, np.abs(d).max()):
            break
    step[rest] = d
    return step


def _sums(data: DataFrame, features: list[str], label: str, fits: list[Fit]) -> np.ndarray:
    """Per fit: weight, loss, gradient and upper triangle of the second derivatives over its rows."""
    size = len(features) + 1
    left, right = np.triu_indices(size)
    width = 2 + size + len(left)
    betas = np.stack([f.trial for f in fits])
    folds = np.array([f.fold for f in fits])
    weights = np.array([f.weights for f in fits])
    rows = max(1, SLICE // max(len(left), len(fits)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(fits), width))
        for pdf in parts:
            table = pdf.to_numpy(dtype=float)
            for i in range(0, len(table), rows):
                y, fold, x = table[i : i + rows, 0], table[i : i + rows, 1], table[i : i + rows, 2:]
                x = np.hstack([x, np.ones((len(x), 1))])
                z = x @ betas.T
                w = np.where(fold[:, None] != folds, np.where(y[:, None] == 1, weights[:, 1], weights[:, 0]), 0.0)
                p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
                total[:, 0] += w.sum(0)
                total[:, 1] += (w * (np.maximum(z, 0) - z * y[:, None] + np.log1p(np.exp(-np.abs(z))))).sum(0)
                total[:, 2 : 2 + size] += (w * (p - y[:, None])).T @ x
                total[:, 2 + size :] += (w * p * (1 - p)).T @ (x[:, left] * x[:, right])
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        yield pd.DataFrame({"fit": np.arange(len(fits)), "part": part, "sums": [t.tobytes() for t in total]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = np.sum([np.frombuffer(b) for b in pdf.sort_values("part")["sums"]], axis=0)
        return pdf.iloc[:1].assign(sums=[sums.tobytes()])

    schema = "fit int, part int, sums binary"
    columns = [F.col(label).cast("double").alias("_y"), F.col("fold").cast("double").alias("_f")]
    local = data.select(*columns, *[F.col(f"`{f}`").cast("double") for f in features]).mapInPandas(run, schema)
    # One row per fit, the size of which the features fix.
    found = local.groupBy("fit").applyInPandas(add, schema).collect()
    out = np.zeros((len(fits), width))
    for r in found:
        out[r["fit"]] = np.frombuffer(r["sums"])
    return out


def fit_many(data: DataFrame, features: list[str], label: str, fits: list[Fit]) -> None:
    """Fill ``at`` of every fit; ``data`` has a column ``fold`` and is read once per step."""
    size = len(features) + 1
    most = max(1, PASS // (size * (size + 3)))
    for i in range(0, len(fits), most):
        group = fits[i : i + most]
        for f in group:
            f.start(size)
        while live := [f for f in group if f.open]:
            due = [f for f, sums in zip(live, _sums(data, features, label, live)) if f.take(sums) and f.open]
            if due:
                for f, step in zip(due, _steps(due)):
                    f.aim(step)
