"""Networks with one hidden layer on the same rows, one pass over the rows per step of all of them.

Hidden units are sigmoids, outputs a softmax. Each network is trained on its mean cross entropy by steps from its last
``MEMORY`` gradients (limited-memory BFGS). A pass sums loss and gradient of every open network at its trial point; these
sums, whose size the architecture fixes, are all that reaches the driver.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEMORY = 10
#: A fit ends where its loss fell by less than ``TOLERANCE`` of the first loss over the last ``LOOK`` steps.
TOLERANCE, LOOK = 1e-6, 20
#: Rows of a stored block, and rows whose hidden units are worked out at a time.
BLOCK, SLICE = 8192, 256
#: Partitions whose sums may go to the driver one by one.
DIRECT = 16


@dataclass
class OneHidden:
    """Weights of both layers; the last row of each is the bias."""

    first: np.ndarray
    second: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([self.first.ravel(), self.second.ravel()])


@dataclass
class Shape:
    inputs: int
    hidden: int
    outputs: int

    @property
    def size(self) -> int:
        return (self.inputs + 1) * self.hidden + (self.hidden + 1) * self.outputs

    def network(self, flat: np.ndarray) -> OneHidden:
        cut = (self.inputs + 1) * self.hidden
        return OneHidden(flat[:cut].reshape(-1, self.hidden), flat[cut:].reshape(-1, self.outputs))

    def start(self, seed: int) -> np.ndarray:
        """Uniform weights by the size of the layers, no biases."""
        rng, layers = np.random.default_rng(seed), []
        for rows, columns in ((self.inputs, self.hidden), (self.hidden, self.outputs)):
            limit = np.sqrt(6.0 / (rows + columns))
            layers += [rng.uniform(-limit, limit, rows * columns), np.zeros(columns)]
        return np.concatenate(layers)


@dataclass
class Descent:
    """One fit: its point, the trial point that the next pass judges, and its last steps."""

    at: np.ndarray
    limit: int
    steps: int = 0
    open: bool = True
    value: float = np.inf
    shrink: float = 1.0
    values: list[float] = field(default_factory=list)
    pairs: deque = field(default_factory=lambda: deque(maxlen=MEMORY))

    def __post_init__(self) -> None:
        self.trial, self.step, self.slope = self.at, np.zeros_like(self.at), np.zeros_like(self.at)

    def take(self, value: float, slope: np.ndarray) -> None:
        if np.isfinite(self.value):
            if not value <= self.value + 1e-4 * self.shrink * float(self.step @ self.slope):
                self.shrink /= 2
                if self.shrink < 1e-8:
                    self.open = False
                self.trial = self.at + self.shrink * self.step
                return
            moved, turned = self.trial - self.at, slope - self.slope
            if moved @ turned > 1e-12 * (turned @ turned):
                self.pairs.append((moved, turned))
            self.steps += 1
        self.at, self.value, self.slope, self.shrink = self.trial, value, slope, 1.0
        self.values.append(value)
        fell = max(self.values[-LOOK - 1 :]) - value
        if self.steps >= self.limit or not np.any(slope) or (self.steps and fell <= TOLERANCE * self.values[0]):
            self.open = False
            return
        self.step = self._direction()
        self.trial = self.at + self.step

    def _direction(self) -> np.ndarray:
        q, used = self.slope.copy(), []
        for moved, turned in reversed(self.pairs):
            share = float(moved @ q) / float(moved @ turned)
            used.append(share)
            q -= share * turned
        if not self.pairs:
            return -q / max(1.0, float(np.linalg.norm(q)))
        moved, turned = self.pairs[-1]
        q *= float(moved @ turned) / float(turned @ turned)
        for (moved, turned), share in zip(self.pairs, reversed(used)):
            q += (share - float(turned @ q) / float(moved @ turned)) * moved
        return -q


def _packed(df: DataFrame, features: list[str], label: str) -> RDD:
    """The rows as blocks of 32-bit floats, label last."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for batch in parts:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float32)
            if np.isnan(rows).any():
                raise ValueError("null or NaN in a feature or a label")
            rest.append(rows)
            if sum(map(len, rest)) >= BLOCK:
                yield pa.record_batch([pa.array([np.concatenate(rest).tobytes()], pa.binary())], ["rows"])
                rest = []
        if sum(map(len, rest)):
            yield pa.record_batch([pa.array([np.concatenate(rest).tobytes()], pa.binary())], ["rows"])

    columns = [F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate([*features, label])]
    dealt = df.select(*columns).repartition(df.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(pack, "rows binary").rdd.map(lambda r: bytes(r["rows"]))


def loss_and_gradient(shape: Shape, flats: list[np.ndarray], ones: list[int | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed loss and gradient of each network over the rows of ``table``, label last.

    A network with a class in ``ones`` tells that class (1) from the rest (0); the others have an output for each class.
    """
    nets = [shape.network(f.astype(np.float32)) for f in flats]
    first = np.hstack([n.first for n in nets])
    cut, hidden = first.size // len(nets), shape.hidden
    losses, slopes = np.zeros(len(nets)), np.zeros((len(nets), shape.size))
    for i in range(0, len(table), SLICE):
        x, y = table[i : i + SLICE, :-1], table[i : i + SLICE, -1].astype(np.int64)
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        rows = np.arange(len(x))
        h = x @ first
        np.clip(h, -80, 80, out=h)
        np.negative(h, out=h)
        np.exp(h, out=h)
        h += 1
        np.reciprocal(h, out=h)
        back = np.empty_like(h)
        for k, (net, one) in enumerate(zip(nets, ones)):
            own = h[:, k * hidden : (k + 1) * hidden]
            z = (own @ net.second[:-1] + net.second[-1]).astype(np.float64)
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            total = p.sum(axis=1)
            target = y if one is None else (y == one).astype(np.int64)
            losses[k] += (np.log(total) - z[rows, target]).sum()
            p /= total[:, None]
            p[rows, target] -= 1
            slopes[k, cut:] += np.vstack([own.T @ p.astype(np.float32), p.sum(axis=0)]).ravel()
            back[:, k * hidden : (k + 1) * hidden] = p.astype(np.float32) @ net.second[:-1].T
        back *= h
        h -= 1
        back *= h
        steep = -(x.T @ back)
        for k in range(len(nets)):
            slopes[k, :cut] += steep[:, k * hidden : (k + 1) * hidden].ravel()
    return losses, slopes


def in_order(parts: RDD) -> list[tuple[int, np.ndarray]]:
    """(rows, sums) of the partitions for the driver, always added in the same order.

    Of many partitions, groups of neighbours are added first, so that the driver sees the square root of their number.
    """
    most = parts.getNumPartitions()
    if most > DIRECT:
        wide = -(-most // math.isqrt(most))
        lanes = parts.mapPartitionsWithIndex(lambda i, found: [(i // wide, (i, n, total)) for n, total in found])

        def add(found) -> tuple[int, np.ndarray]:
            found = sorted(found, key=lambda f: f[0])
            return sum(f[1] for f in found), sum(f[2] for f in found)

        parts = lanes.groupByKey(math.isqrt(most)).mapValues(add).sortByKey(numPartitions=1).values()
    return parts.collect()


def _sums(data: RDD, shape: Shape, fits: list[Descent], ones: list[int | None]) -> tuple[np.ndarray, np.ndarray, int]:
    """Loss and gradient of each fit at its trial point over all rows, and the number of rows."""
    flats = [f.trial for f in fits]

    def run(blocks: Iterator[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        total, n = np.zeros((len(flats), 1 + shape.size)), 0
        for block in blocks:
            table = np.frombuffer(block, np.float32).reshape(-1, shape.inputs + 1)
            losses, slopes = loss_and_gradient(shape, flats, ones, table)
            total += np.column_stack([losses, slopes])
            n += len(table)
        if n:
            yield n, total

    found = in_order(data.mapPartitions(run))
    if not found:
        raise ValueError("no rows to learn from")
    out = sum(total for _, total in found)
    return out[:, 0], out[:, 1:], sum(n for n, _ in found)


def fit_many(
    df: DataFrame, features: list[str], label: str, outputs: int, ones: list[int | None], hidden: int, max_iter: int, seed: int
) -> list[OneHidden]:
    """One network for each entry of ``ones``, in that order; see ``loss_and_gradient``."""
    shape = Shape(len(features), hidden, outputs)
    fits = [Descent(shape.start(seed), max_iter) for _ in ones]
    data = _packed(df, features, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        while live := [k for k, f in enumerate(fits) if f.open]:
            losses, slopes, n = _sums(data, shape, [fits[k] for k in live], [ones[k] for k in live])
            for k, value, slope in zip(live, losses / n, slopes / n):
                fits[k].take(float(value), slope)
    finally:
        data.unpersist()
    return [shape.network(f.at) for f in fits]


def probabilities(nets: list[OneHidden], features: list[str], output: int | None = None) -> Column:
    """All outputs of the only network, or one output of each network, as an array of doubles."""

    @F.pandas_udf("array<double>")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        if np.isnan(x).any():
            raise ValueError("null or NaN in a feature")
        found = []
        for net in nets:
            h = 1.0 / (1.0 + np.exp(-np.clip(x @ net.first[:-1] + net.first[-1], -500, 500)))
            z = h @ net.second[:-1] + net.second[-1]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            found.append(p / p.sum(axis=1, keepdims=True))
        return pd.Series(list(found[0] if output is None else np.column_stack([p[:, output] for p in found])))

    return score(*[F.col(f"`{f}`").cast("double") for f in features])
