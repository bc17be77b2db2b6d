"""Quality classifier: boosted trees over statistics of whole documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitat.llm.boosting import Forest, fit
from habitat.llm.common import fold, map_slices, whole_text

#: Labelled rows that the forest is fitted on at most: those of least id hash.
SAMPLE = 20_000
FOLDS, HELD_OUT, ACCEPT = 4, 2, 0.7

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "std_word", "log_longest_word", "distinct_words", "top_word", "repeats",
    "short_words", "symbol_end", "upper_words", "bare_symbols", "upper", "digits", "punctuation", "symbols", "wide",
    "stops", "commas", "log_line", "lines_per_word", "distinct_lines", "entropy", "distinct_pairs",
)
_CLASS = np.zeros((256, 7), dtype=np.float64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"()-", b"#$%&*|<>=+/\\^_~@[]{}!", bytes(range(128, 256)), b".", b",")):
    _CLASS[list(_chars), _i] = 1
_SYMBOLS = tuple("#$%&*|<>=+/\\^_~@!")


def statistics(text: str) -> list[float]:
    """The statistics of one whole text, in the order of ``STATISTICS``; all zero without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = np.zeros(256)
    for a in range(0, len(data), 1 << 20):
        counts += np.bincount(data[a:a + (1 << 20)], minlength=256)
    size = float(len(data))
    share = counts @ _CLASS / size
    p = counts[counts > 0] / size
    length = np.fromiter(map(len, words), dtype=np.float64, count=n)
    often: dict[str, int] = {}
    for w in words:
        often[w] = often.get(w, 0) + 1
    repeats = sum(map(str.__eq__, words, words[1:]))
    lines = text.split("\n")
    return [
        np.log1p(size), np.log1p(n), length.mean(), length.std(), np.log1p(length.max()), len(often) / n, max(often.values()) / n, repeats / n,
        float((length <= 3).mean()), sum(w.endswith(_SYMBOLS) for w in words) / n, sum(map(str.isupper, words)) / n,
        float(sum(k for w, k in often.items() if not any(map(str.isalnum, w)))) / n,
        *share[:5], counts[46] / n, counts[44] / n, np.log1p(size / len(lines)), len(lines) / n, len(set(lines)) / len(lines),
        float(-(p * np.log2(p)).sum()), len(set(zip(words, words[1:]))) / n,
    ]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Fit on the ``sample`` labelled training rows whose id has the least hash.

    A doc_id labelled more than once counts once, as 1 if any of its labels is 1. The chosen
    ids are at most ``sample`` rows, so they are broadcast; the fit runs in one task on them.
    """
    chosen = (
        labels.select("doc_id", F.col("quality").cast("double").alias("y")).filter("doc_id is not null and y is not null")
        .filter(fold("doc_id", FOLDS) != HELD_OUT)
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    texts = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [statistics(t) for t in batch.column("text").to_pylist()]
        return pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    # A repeated doc_id is one row of the sample, so that its bound holds.
    rows = map_slices(texts, measure, "doc_id long, y double, x array<double>").groupBy("doc_id").agg(F.max("y").alias("y"), F.max("x").alias("x"))

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id")
        forest = fit(np.array(part["x"].tolist()), part["y"].to_numpy())
        root = np.isin(np.arange(len(forest.feature)), forest.roots)
        out = pd.DataFrame({"node": np.arange(len(forest.feature)), "root": root, "feature": forest.feature, "threshold": forest.threshold,
                            "l": forest.left, "r": forest.right, "value": forest.value})
        return pd.concat([out, pd.DataFrame([[-1, False, forest.depth, forest.base, 0, 0, 0.0]], columns=out.columns)])

    schema = "node long, root boolean, feature long, threshold double, l long, r long, value double"
    made = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(train, schema).toPandas().sort_values("node")
    if made.empty:
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    head, body = made.iloc[0], made.iloc[1:]
    arrays = [body[c].to_numpy() for c in ("feature", "threshold", "l", "r", "value")]
    return Forest(body["node"].to_numpy()[body["root"].to_numpy(dtype=bool)], *arrays, float(head["threshold"]), int(head["feature"]))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Null texts are empty; texts without words share one score. Repeated rows give repeated
    results, a null doc_id is kept. Without labels every score is 0.5. Other columns are not read.
    """
    forest = learn(docs, labels)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(STATISTICS))
        return pa.record_batch([batch.column("doc_id"), pa.array(forest.scores(x))], ["doc_id", "score"])

    scored = map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")), run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    forest = learn(docs, labels)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, len(STATISTICS))
        return batch.filter(pa.array(forest.scores(x) >= ACCEPT))

    return map_slices(docs, run, docs.schema)
