"""Toxicity classifier with a counterfactual penalty.

A document is the set of its words and word beginnings. Those that are clearly more frequent in toxic training
documents carry weights, fitted by logistic regression. Each training document that names a group is also read with
the name swapped for another of its kind, and a change of its score is penalised, so that neutral
mentions of a group do not count as toxic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitat.llm.common import cut, fold, map_slices, whole_text

#: Labelled rows that the model is fitted on at most (those of least id hash), and features that it keeps at most.
SAMPLE, FEATURES = 20_000, 4096
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
#: A feature is kept from so many documents and so many standard deviations above chance.
LEAST_DOCUMENTS, LEAST_Z = 5, 5.0
BEGINNINGS = range(3, 8)
RIDGE, COUNTERFACTUAL, ROUNDS, RATE = 1e-4, 1.0, 300, 0.3
#: Terms for groups of people, by kind; a term is swapped for the next of its kind.
IDENTITY_TERMS = (
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino"), ("africans", "europeans", "asians", "americans"),
    ("immigrants", "refugees", "natives"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "flüchtlinge", "einheimische"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("immigrés", "réfugiés"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "refugiados"),
)
SWAP = {term: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, term in enumerate(kind)}
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features_of(word: str) -> list[int]:
    """Hashes of a word and its beginnings."""
    parts = [word + "\0"] + [word[:k] for k in BEGINNINGS if k < len(word)]
    return np.array([xxhash.xxh3_64_intdigest(p) for p in parts], dtype=np.uint64).astype(np.int64).tolist()


class _Known(dict):
    """Features of a word, only those that ``kept`` numbers if it is given; forgotten beyond a million words."""

    def __init__(self, kept: dict[int, int] | None) -> None:
        super().__init__()
        self.kept = kept

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 1_000_000:
            self.clear()
        found = features_of(word)
        self[word] = found = tuple(found if self.kept is None else [self.kept[f] for f in found if f in self.kept])
        return found


def _set_of(words: set[str], known: _Known) -> list[int]:
    out: set[int] = set()
    for w in words:
        found = known[w]
        if found:
            out.update(found)
    return sorted(out)


def fit(x: list, other: list, y: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights and intercept. ``other`` has the swapped sets, or None where a document names no group.

    Minimises the log loss, a ridge on the weights and COUNTERFACTUAL times the mean squared change of the
    log odds under the swap, by full gradients with steps scaled per weight.
    """
    n, share = len(y), (float(y.sum()) + 0.5) / (len(y) + 1.0)
    w, b, w2, b2 = np.zeros(size), float(np.log(share / (1 - share))), np.full(size, 1e-8), 1e-8
    if n == 0 or y.min() == y.max() or size == 0:
        return w, b
    flat = lambda sets: (np.array([f for s in sets for f in s], dtype=np.int64), np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    at, row = flat(x)
    named = [i for i, s in enumerate(other) if s is not None]
    a_at, a_row = flat([x[i] for i in named])
    b_at, b_row = flat([other[i] for i in named])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[at], minlength=n) + b, -60, 60)))
        d = (p - y) / n
        g = np.bincount(at, weights=d[row], minlength=size) + RIDGE * w
        if named:
            change = np.bincount(a_row, weights=w[a_at], minlength=len(named)) - np.bincount(b_row, weights=w[b_at], minlength=len(named))
            change *= 2 * COUNTERFACTUAL / len(named)
            g += np.bincount(a_at, weights=change[a_row], minlength=size) - np.bincount(b_at, weights=change[b_row], minlength=size)
        w2 += g * g
        w -= RATE * g / np.sqrt(w2)
        b2 += d.sum() ** 2
        b -= RATE * d.sum() / np.sqrt(b2)
    return w, b


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[int, int], np.ndarray, float]:
    """Numbers of the kept features, their weights and the intercept.

    Counts of features are grouped by Spark; the fit runs in one task on the sample, whose
    rows then hold kept features only. A doc_id labelled more than once is toxic if any label says so.
    """
    chosen = (
        labels.select("doc_id", F.col("toxic").cast("double").alias("y")).filter("doc_id is not null and y is not null")
        .filter(fold("doc_id", FOLDS) != HELD_OUT)
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # At most ``sample`` ids, so they are broadcast.
    texts = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, x, other = _Known(None), [], []
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            x.append(_set_of(words, known))
            other.append(_set_of({SWAP.get(w, w) for w in words}, known) if words & SWAP.keys() else None)
        return pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(x, pa.list_(pa.int64())), pa.array(other, pa.list_(pa.int64()))], ["doc_id", "y", "x", "other"])

    # A repeated doc_id is one row of the sample, so that its bound holds; x and other stay those of one text.
    measured = map_slices(texts, measure, "doc_id long, y double, x array<long>, other array<long>")
    one = measured.groupBy("doc_id").agg(F.max("y").alias("y"), F.max(F.struct("x", "other")).alias("s"))
    rows = cut(one.select("doc_id", "y", "s.x", "s.other"))
    total = rows.agg(F.sum("y").alias("toxic"), F.count("*").alias("n")).first()
    share = (total.toxic or 0.0) / max(total.n, 1)
    if not 0 < share < 1:
        w, b = fit([], [], np.full(total.n, share), 0)
        return {}, w, b
    z = (F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)))
    kept_rows = (
        rows.select("y", F.explode("x").alias("f")).groupBy("f").agg(F.sum("y").alias("toxic"), F.count("*").alias("n"))
        .filter((F.col("n") >= LEAST_DOCUMENTS) & (z >= LEAST_Z)).orderBy(z.desc(), "f").limit(FEATURES).collect()
    )
    kept = {r.f: i for i, r in enumerate(sorted(kept_rows, key=lambda r: r.f))}

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few = [[None if s is None else [kept[f] for f in s if f in kept] for s in batch.column(c).to_pylist()] for c in ("x", "other")]
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"), *(pa.array(c, pa.list_(pa.int64())) for c in few)], ["doc_id", "y", "x", "other"])

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id", kind="stable")
        w, b = fit(part["x"].tolist(), [None if s is None else list(s) for s in part["other"]], part["y"].to_numpy(), len(kept))
        return pd.DataFrame({"at": np.arange(-1, len(w)), "w": np.concatenate([[b], w])})

    small = rows.mapInArrow(narrow, rows.schema).withColumn("all", F.lit(0))
    made = small.groupBy("all").applyInPandas(train, "at int, w double").toPandas().sort_values("at")["w"].to_numpy()
    return kept, made[1:], float(made[0])


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Null texts are empty; texts without kept features share one score. Repeated rows give repeated results, a null
    doc_id is kept. Without labels, or with one kind only, all scores are equal. Other columns are not read.
    """
    kept, weights, intercept = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(kept)
        for batch in batches:
            raw = np.array([intercept + weights[_set_of(words_of(t), known)].sum() for t in batch.column("text").to_pylist()], dtype=np.float64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(raw, -60, 60))))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
