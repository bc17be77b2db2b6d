"""Residual network: d -> hidden, residual ReLU layers, -> 1 logit.

Scoring is an Arrow UDF over plain feature columns. Training is data-parallel:
in each round every partition runs mini-batch Adam from the shared state over
its packed rows and returns its state and row count. The states of few partitions
are averaged on the driver, so a round is one stage and writes no shuffle files; those of
many are added in groups of neighbours first. A state's size is fixed by the
architecture. With one partition this is ordinary mini-batch Adam.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from habitat.learning.mlp_many import in_order

HIDDEN, RESIDUAL_LAYERS = 250, 2
LOSSES = ("bce", "eps")
# A state of more numbers than this is refused: it has to pass the driver.
MAX_STATE = 20_000_000
# Rows that are packed into one block.
BLOCK = 1 << 15
# Numbers of the state that a step of Adam handles at a time.
STRIP = 1 << 13


@dataclass
class Network:
    """Weights as a list of (matrix [in, out], bias [out])."""

    layers: list[tuple[np.ndarray, np.ndarray]]

    @property
    def shapes(self) -> list[tuple[int, int]]:
        return [w.shape for w, _ in self.layers]

    def flat(self) -> np.ndarray:
        return np.concatenate([np.concatenate([w.ravel(), b]) for w, b in self.layers])


def unflatten(state: np.ndarray, shapes: list[tuple[int, int]]) -> Network:
    layers, at = [], 0
    for rows, cols in shapes:
        w = state[at : at + rows * cols].reshape(rows, cols)
        at += rows * cols
        layers.append((w, state[at : at + cols]))
        at += cols
    return Network(layers)


def new_network(inputs: int, hidden: int = HIDDEN, residual: int = RESIDUAL_LAYERS, seed: int = 42) -> Network:
    """Uniform start in +/- 1/sqrt(fan-in)."""
    rng = np.random.default_rng(seed)
    shapes = [(inputs, hidden)] + [(hidden, hidden)] * residual + [(hidden, 1)]
    layers = []
    for rows, cols in shapes:
        limit = 1.0 / np.sqrt(rows)
        layers.append((rng.uniform(-limit, limit, (rows, cols)), rng.uniform(-limit, limit, cols)))
    return Network(layers)


def _activations(net: Network, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Layer inputs, their ReLU outputs, and the logits."""
    inputs, outs = [x], []
    h = np.maximum(x @ net.layers[0][0] + net.layers[0][1], 0.0)
    outs.append(h)
    for w, b in net.layers[1:-1]:
        inputs.append(h)
        out = np.maximum(h @ w + b, 0.0)
        outs.append(out)
        h = out + h
    inputs.append(h)
    w, b = net.layers[-1]
    return inputs, outs, (h @ w + b).ravel()


def logits(net: Network, x: np.ndarray) -> np.ndarray:
    return _activations(net, x)[2]


def _loss_and_slope(z: np.ndarray, y: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """Loss per row and its derivative by the logit."""
    p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
    if loss == "bce":
        return np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z))), p - y
    eps = 1e-8
    value = -(y * np.log(p + eps) + (1 - y) * np.log(1 - p + eps))
    return value, (-y / (p + eps) + (1 - y) / (1 - p + eps)) * p * (1 - p)


def gradient(net: Network, x: np.ndarray, y: np.ndarray, loss: str) -> tuple[float, np.ndarray]:
    """Summed loss over the batch and the gradient of the mean loss, as precise as the weights; losses are double."""
    inputs, outs, z = _activations(net, x)
    values, slope = _loss_and_slope(z.astype(float), y, loss)
    kind = net.layers[0][0].dtype
    out = np.empty(sum(w.size + b.size for w, b in net.layers), dtype=kind)
    at = len(out)
    back = (slope / len(y)).astype(kind)[:, None]
    for k in range(len(net.layers) - 1, -1, -1):
        w, b = net.layers[k]
        through = back if k == len(net.layers) - 1 else back * (outs[k] > 0)
        at -= w.size + b.size
        np.matmul(inputs[k].T, through, out=out[at : at + w.size].reshape(w.shape))
        np.sum(through, axis=0, out=out[at + w.size : at + w.size + b.size])
        if k:
            # The middle layers are residual.
            back = through @ w.T if through is back else through @ w.T + back
    return float(values.sum()), out


def _local_epoch(
    state: np.ndarray, shapes, steps: int, batches: Iterator[tuple[np.ndarray, np.ndarray]], loss: str, lr: float, decay: float
) -> tuple[np.ndarray, float, int]:
    """Mini-batch Adam over the rows of one partition; state is weights, m, v."""
    size = len(state) // 3
    theta, m, v = (state[i * size : (i + 1) * size].copy() for i in range(3))
    net, total, rows, wide = unflatten(theta, shapes), 0.0, 0, np.empty(STRIP, dtype=state.dtype)
    for x, y in batches:
        steps += 1
        value, grads = gradient(net, x.astype(state.dtype, copy=False), y, loss)
        slow, fast = lr / (1 - 0.9**steps), (1 - 0.999**steps) ** -0.5
        # In place and strip by strip: the state is far larger than a batch and than the nearest cache.
        for i in range(0, size, STRIP):
            t, g, a, b = (each[i : i + STRIP] for each in (theta, grads, m, v))
            w = wide[: len(t)]
            g += np.multiply(t, decay, out=w)
            a *= 0.9
            a += np.multiply(g, 0.1, out=w)
            b *= 0.999
            g *= g
            g *= 0.001
            b += g
            np.sqrt(b, out=w)
            w *= fast
            w += 1e-8
            np.multiply(a, slow, out=g)
            g /= w
            t -= g
        total, rows = total + value, rows + len(y)
    return np.concatenate([theta, m, v]), total, rows


@dataclass
class Training:
    network: Network
    epochs: int
    loss: float
    history: list[float]


def fit_residual_mlp(
    df: DataFrame,
    features: list[str],
    label: str = "label",
    loss: str = "bce",
    hidden: int = HIDDEN,
    residual: int = RESIDUAL_LAYERS,
    epochs: int = 1000,
    patience: int = 15,
    batch: int = 32,
    lr: float = 1e-3,
    decay: float = 1e-4,
    seed: int = 42,
    key: str = "row_id",
    partitions: int | None = None,
    select_by: Callable[[Network], float] | None = None,
) -> Training:
    """Train and return the best network.

    Best is the lowest mean training loss, and training ends after ``patience``
    rounds without a lower one; ``select_by`` (network -> score, higher is better)
    picks the returned network by a metric instead.
    """
    if loss not in LOSSES:
        raise ValueError(f"unknown loss: {loss}")
    net = new_network(len(features), hidden, residual, seed)
    shapes = net.shapes
    # Single precision, as the study trains its networks; states of partitions are averaged in double.
    state = np.concatenate([net.flat(), np.zeros(2 * len(net.flat()))]).astype(np.float32)
    if len(state) > MAX_STATE:
        raise ValueError("network too large to average through the driver")

    partitions = partitions or df.sparkSession.sparkContext.defaultParallelism
    order = F.xxhash64(F.lit(seed), F.col(key))
    rows = (
        df.select(order.alias("_o"), F.col(label).cast("double").alias("_y"), *[F.col(f"`{f}`").cast("double").alias(f"_{i}") for i, f in enumerate(features)])
        .repartition(partitions, "_o")
        .sortWithinPartitions("_o")
        .drop("_o")
    )
    data = _packed(rows).persist(StorageLevel.MEMORY_AND_DISK)
    best, best_score, stale, history, steps = (state, np.inf, -np.inf), -np.inf, 0, [], 0
    lowest = np.inf
    try:
        taken = _most_steps(data, len(features) + 1, batch)
        for epoch in range(epochs):
            state, value = _round(data, len(features), shapes, state, steps, loss, lr, decay, batch)
            steps += taken
            history.append(value)
            score = select_by(unflatten(state[: len(state) // 3], shapes)) if select_by else -value
            if score > best_score:
                best, best_score = (state, value, score), score
            if value < lowest:
                lowest, stale = value, 0
            else:
                stale += 1
                if stale >= patience:
                    break
    finally:
        data.unpersist()
    kept = unflatten(best[0][: len(best[0]) // 3].astype(float), shapes)
    return Training(kept, len(history), best[1], history)


def _packed(rows: DataFrame) -> RDD:
    """The rows, label first, as blocks of numbers in the order of each partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            blocks = [table[i : i + BLOCK].tobytes() for i in range(0, len(table), BLOCK)]
            yield pa.record_batch([pa.array(blocks, pa.binary())], ["rows"])

    return rows.mapInArrow(pack, "rows binary").rdd.map(lambda r: bytes(r["rows"]))


def _most_steps(data: RDD, width: int, batch: int) -> int:
    """Batches of the partition that has the most."""
    rows = data.mapPartitions(lambda blocks: [sum(len(b) // (8 * width) for b in blocks)])
    return -(-rows.max() // batch)


def _batches(blocks: Iterator[bytes], width: int, batch: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of ``batch`` rows at a time, across blocks; fewer at the end."""
    rest = np.empty((0, width))
    for block in blocks:
        rest = np.vstack([rest, np.frombuffer(block).reshape(-1, width)])
        whole = len(rest) // batch * batch
        for i in range(0, whole, batch):
            yield rest[i : i + batch, 1:], rest[i : i + batch, 0]
        rest = rest[whole:]
    if len(rest):
        yield rest[:, 1:], rest[:, 0]


def _round(data, inputs, shapes, state, steps, loss, lr, decay, batch):
    """One pass over the data: local epochs, then a weighted mean of their states."""
    shared = data.context.broadcast(state)

    def run(blocks: Iterator[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        out, total, rows = _local_epoch(shared.value, shapes, steps, _batches(blocks, inputs + 1, batch), loss, lr, decay)
        if rows:
            yield rows, np.append(out.astype(float) * rows, total)

    found = in_order(data.mapPartitions(run))
    shared.unpersist()
    if not found:
        raise ValueError("no rows to learn from")
    n = sum(rows for rows, _ in found)
    sums = sum(total for _, total in found)
    return (sums[:-1] / n).astype(state.dtype), sums[-1] / n


def score_column(net: Network, features: list[str], output: str = "probability") -> Column:
    """Probability (or logit) of a network as one Arrow UDF over feature columns."""
    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        z = logits(net, np.column_stack([c.to_numpy(dtype=float) for c in columns]))
        return pd.Series(z if output == "logit" else 1.0 / (1.0 + np.exp(-z)))

    return score(*[F.col(f"`{f}`").cast("double") for f in features])


def score_residual_mlp(df: DataFrame, net: Network, features: list[str], name: str = "p") -> DataFrame:
    return df.withColumn(name, score_column(net, features))


def score_models(df: DataFrame, nets: dict[str, Network], features: list[str], keep: list[str]) -> DataFrame:
    """Every model on every row in one pass: one column per model, no shuffle.

    The models run in one UDF call, so features cross to Python once.
    """
    names = list(nets)

    @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
    def score(*columns: pd.Series) -> pd.DataFrame:
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        return pd.DataFrame({n: 1.0 / (1.0 + np.exp(-logits(nets[n], x))) for n in names})

    scored = df.select(*keep, score(*[F.col(f"`{f}`").cast("double") for f in features]).alias("_s"))
    return scored.select(*keep, *[F.col("_s")[n].alias(n) for n in names])


def weights_table(spark: SparkSession, nets: dict[str, Network]) -> DataFrame:
    """Long weight table; row ``i = -1`` of a layer is the bias."""
    rows = [
        (model, layer, i, j, float(w))
        for model, net in nets.items()
        for layer, (matrix, bias) in enumerate(net.layers)
        for i, row in [*enumerate(matrix), (-1, bias)]
        for j, w in enumerate(row)
    ]
    return spark.createDataFrame(rows, "model_id string, layer int, i int, j int, w double")


def networks_from_table(weights: DataFrame) -> dict[str, Network]:
    """Read networks back; refuses a table beyond the size a task can hold."""
    if weights.limit(MAX_STATE + 1).count() > MAX_STATE:
        raise ValueError("weight table too large")
    pdf = weights.toPandas()
    nets = {}
    for model, part in pdf.groupby("model_id"):
        layers = []
        for _, cells in sorted(part.groupby("layer")):
            rows, cols = cells["i"].max() + 1, cells["j"].max() + 1
            dense = np.zeros((rows + 1, cols))
            dense[cells["i"], cells["j"]] = cells["w"]
            layers.append((dense[:-1], dense[-1]))
        nets[model] = Network(layers)
    return nets
