"""Find personal data: fixed base patterns, and a skip-chain conditional random field over tokens with digits or an at sign.

Tokens are words that hold a digit or ``@``. Each has a label: none, email, ip, card or phone. Node potentials come from
the token's shape and surroundings. Neighbouring tokens are tied by a chain potential; tokens of one document that are
equal, or end in the same seven digits, are tied by a skip potential for agreeing labels, each to the one before it, so
links grow with the tokens. Loopy message passing over a whole document then lets a clear mention decide an unclear one.

The base matches label a bounded sample of documents. Weights follow the gradient of the likelihood with the messages' own
beliefs as expectations. A third of the sample's tokens is shown without its telling features, so that chain and skip weights learn to carry a label.
Tokens outside of base matches whose belief in one label is high become added spans; base spans stay as they are.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitat.llm.common import map_slices, whole_text

KINDS = ("email", "ip", "card", "phone")
#: Labelled documents at most, of the least hashes of ids, and tokens of one of them at most (longer ones do not teach).
SAMPLE, TEACHING = 8_000, 2_000
#: Sweeps of message passing, steps of the fit, its rate, and the weights of the priors of features, chain and skip links.
SWEEPS, STEPS, RATE, PRIOR, PAIR_PRIOR = 10, 80, 0.3, 0.02, np.array([0.1, 5.0])
#: Prior mean of the skip weight of agreeing labels, in nats; the prior is strong, as many samples hold few repeats.
AGREE = 4.0
#: Least belief in a label for an added span.
BELIEF = 0.9
BUCKETS = 4096

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Symbols that ips, cards and phones consist of; every match lies inside one such stretch.
AREA = re.compile(r"[0-9+][0-9\x20().+-]*")
#: A match can only start where a run of digits does, as all starts inside the run go on alike.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
BLANK = frozenset("\x20\x09\x0a\x0b\x0c\x0d")
EDGE = ",.;:!?\"'<>[]{}|"
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    values = np.frombuffer(digits.encode(), dtype=np.uint8)[::-1].astype(np.int64) - 48
    twice = values[1::2] * 2
    return int(values[::2].sum() + (twice - 9 * (twice > 9)).sum()) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base matches by start and then kind; code points, end exclusive. Linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((0, start, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    for area in AREA.finditer(text):
        a, b = area.span()
        if b - a < 7:
            continue
        piece = area[0]
        if "." in piece:
            out += [(1, a + m.start(), a + m.end()) for m in IP.finditer(piece) if all(map(_small, m[0].split(".")))]
        for m in CARD.finditer(piece):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, a + m.start(), a + m.end()))
        if "+" in piece:
            out += [(3, a + m.start(), a + m.end()) for m in PHONE.finditer(piece) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0]))


def tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of words with a digit or an at sign, without stops and quotes at their edges."""
    out = []
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while a and text[a - 1] not in BLANK:
            a -= 1
        word = text[a:b]
        left = len(word) - len(word.lstrip(EDGE))
        b = a + len(word.rstrip(EDGE))
        if a + left < b:
            out.append((a + left, b))
    return out


def _shape(word: str) -> tuple[str, str]:
    """Runs of digits and letters with their lengths (bounded), and without."""
    kinds = re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", word[:64]))
    fine = re.sub(r"(.)\1*", lambda m: m[1] + str(min(len(m[0]), 20)), kinds)
    return fine, re.sub(r"(.)\1+", r"\1", kinds)


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


#: Features of a token in order; the first three tell little of the label alone, the others are hidden from some teaching tokens.
PLAIN, FEATURES = 3, 10
HIDDEN = _bucket("hidden")


class Graph:
    """Tokens of several documents with features, chain links and skip links."""

    def __init__(self) -> None:
        self.features: list[list[int]] = []
        self.links: list[tuple[int, int, int]] = []

    def add(self, text: str, spans: list[tuple[int, int]]) -> None:
        first = len(self.features)
        last_seen: dict[str, int] = {}
        runs, run = [], []
        for k, (a, b) in enumerate(spans):
            if run and (a - spans[k - 1][1] > 2 or text[spans[k - 1][1] : a].strip()):
                runs.append(run)
                run = []
            run.append(k)
        runs.append(run)
        for run in runs:
            if not run:
                continue
            words = [text[spans[k][0] : spans[k][1]] for k in run]
            own = [re.sub(r"[^0-9]", "", w) for w in words]
            whole = sum(map(len, own))
            check = "none"
            if 12 <= whole <= 19:
                check = "valid" if luhn("".join(own)) else "not"
            plus = words[0].startswith("+") or words[0].startswith("(+")
            a = spans[run[0]][0]
            before = text[max(0, a - 24) : a].split()
            for n, (k, word, digits) in enumerate(zip(run, words, own)):
                fine, coarse = _shape(word)
                parts = word.split(".")
                octets = len(parts) == 4 and all(p.isascii() and p.isdigit() and _small(p) for p in parts)
                mail = "@" in word and ("dotted" if "." in word.rpartition("@")[2] else "plain")
                names = ["bias", f"n{min(len(digits), 20)}", f"run{min(whole, 32)}", f"f{fine}", f"c{coarse}", f"luhn{check}", f"ip{octets}", f"at{mail}",
                         f"plus{plus and min(n, 3)}", f"w{before[-1].lower()[:16] if before and n == 0 else ''}"]
                self.features.append([_bucket(x) for x in names])
                if n:
                    self.links.append((first + k - 1, first + k, 0))
                if len(digits) >= 4 or len(word) >= 6:
                    key = digits[-7:] if len(digits) >= 7 and "@" not in word else word.lower()
                    if key in last_seen:
                        self.links.append((last_seen[key], first + k, 1))
                    last_seen[key] = first + k

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.features, dtype=np.int32).reshape(-1, FEATURES), np.array(self.links, dtype=np.int64).reshape(-1, 3)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def beliefs(nodes: np.ndarray, links: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loopy message passing: log beliefs of the tokens (n, labels) and of the links (m, labels, labels).

    ``nodes`` are log potentials, ``pair`` those of chain and skip links (2, labels, labels), ``links`` (from, to, which).
    """
    u, v, kind = links.T
    psi = pair[kind]
    labels = nodes.shape[1]
    right, left = np.zeros((len(u), labels)), np.zeros((len(u), labels))
    now = nodes.copy()
    for _ in range(SWEEPS if len(u) else 0):
        for source, target, forth, back, table in ((u, v, right, left, psi), (v, u, left, right, psi.transpose(0, 2, 1))):
            new = _log_sum((now[source] - back)[:, :, None] + table, 1)
            new = 0.5 * forth + 0.5 * (new - _log_sum(new, 1)[:, None])
            np.add.at(now, target, new - forth)
            forth[:] = new
    joint = (now[u] - left)[:, :, None] + psi + (now[v] - right)[:, None, :]
    flat = _log_sum(joint.reshape(len(u), -1), 1) if len(u) else np.zeros(0)
    return now - _log_sum(now, 1)[:, None], joint - flat[:, None, None]


class Field:
    """Weights of the features for each label and of the two kinds of links."""

    def __init__(self, weights: np.ndarray, pair: np.ndarray) -> None:
        self.weights, self.pair = weights, pair

    @staticmethod
    def blank() -> Field:
        labels = len(KINDS) + 1
        return Field(np.zeros((BUCKETS, labels)), np.stack([np.zeros((labels, labels)), AGREE * np.eye(labels)]))

    def score(self, features: np.ndarray, links: np.ndarray) -> np.ndarray:
        """Beliefs in each label."""
        if not len(features):
            return np.zeros((0, len(KINDS) + 1))
        return np.exp(beliefs(self.weights[features].sum(axis=1), links, self.pair)[0])


def fit(features: np.ndarray, links: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Field:
    """Ascend the likelihood of ``labels``, with beliefs in place of exact expectations, by steps scaled to past gradients.

    Every third token (by a hash of its number) hides its telling features. Labels are those of the base, so a token without one that is
    tied to a labelled token may be just what the base has missed: its label counts as unknown. Without tokens the prior stays.
    """
    field, start = Field.blank(), Field.blank()
    if not len(features):
        return field
    shown = features.copy()
    shown[(np.arange(len(shown)) * 2654435761 >> 7) % 3 == 0, PLAIN:] = HIDDEN
    count = field.weights.shape[1]
    hot = np.eye(count)[labels]
    u, v, kind = links.T
    seen = [np.zeros_like(field.weights), np.zeros_like(field.pair)]
    unknown = np.zeros(len(labels), dtype=bool)
    for one, other in ((u, v), (v, u)):
        unknown[one[(kind == 1) & (labels[one] == 0) & (labels[other] > 0)]] = True
    sure = ~(unknown[u] | unknown[v])
    truth = np.zeros_like(field.pair)
    np.add.at(truth, (kind[sure], labels[u][sure], labels[v][sure]), 1.0)
    for _ in range(steps):
        single, joint = beliefs(field.weights[shown].sum(axis=1), links, field.pair)
        gap = np.where(unknown[:, None], 0.0, hot - np.exp(single))
        step = -PRIOR * (field.weights - start.weights)
        for k in range(shown.shape[1]):
            np.add.at(step, shown[:, k], gap)
        expected = np.zeros_like(field.pair)
        np.add.at(expected, kind[sure], np.exp(joint[sure]))
        both = truth - expected - PAIR_PRIOR[:, None, None] * (field.pair - start.pair)
        for part, grad, past in ((field.weights, step, seen[0]), (field.pair, both, seen[1])):
            past += grad * grad
            part += RATE * grad / np.sqrt(past + 1e-8)
    return field


def _labels(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int]:
    """The label of each token: the kind of the first base match that overlaps it, or 0."""
    out, i = [], 0
    for a, b in spans:
        while i < len(base) and base[i][2] <= a:
            i += 1
        found = [k for k, x, y in base[i : i + 4] if x < b and y > a]
        out.append(found[0] + 1 if found else 0)
    return out


def learn(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on at most ``sample`` documents, one row for each id; the weights that reach the driver have a fixed size."""
    ids = docs.filter("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # Bounded by ``sample`` ids.
    taken = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            spans = tokens(text)
            if spans and len(spans) <= TEACHING:
                graph = Graph()
                graph.add(text, spans)
                features, links = graph.arrays()
                rows.append((doc, features.ravel().tolist(), links.ravel().tolist(), _labels(spans, base_spans(text))))
        columns = list(zip(*rows)) if rows else [[]] * 4
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "features", "links", "labels"])

    found = map_slices(taken, run, "doc_id long, features array<int>, links array<long>, labels array<int>")

    def teach(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        sizes = [len(x) for x in rows["labels"]]
        first = np.cumsum([0, *sizes[:-1]])
        links = [np.asarray(x, dtype=np.int64).reshape(-1, 3) + np.array([at, at, 0]) for at, x in zip(first, rows["links"])]
        field = fit(np.concatenate(rows["features"].to_list()).reshape(-1, FEATURES), np.concatenate(links), np.concatenate(rows["labels"].to_list()))
        return pd.DataFrame({"part": [0, 1], "values": [field.weights.ravel().tolist(), field.pair.ravel().tolist()]})

    parts = {r.part: np.array(r["values"]) for r in found.groupBy(F.lit("all")).applyInPandas(teach, "part int, values array<double>").collect()}
    blank = Field.blank()
    return Field(parts[0].reshape(blank.weights.shape), parts[1].reshape(blank.pair.shape)) if parts else blank


#: What an added span of each kind must consist of, and how many digits it may have.
FORMS = [re.compile(p) for p in (r"[^\s@]+@[^\s@]*[A-Za-z0-9]", r"[0-9]+(?:[^0-9A-Za-z\s]+[0-9]+){3}", r"[0-9](?:[^0-9A-Za-z]?[0-9])*", r"\(?\+?[0-9 ().+/-]*[0-9]")]
DIGITS = [(0, 10**9), (4, 12), (12, 19), (7, 15)]


def _plausible(kind: int, value: str) -> bool:
    least, most = DIGITS[kind]
    return bool(FORMS[kind].fullmatch(value)) and least <= len(DIGIT.findall(value)) <= most


def added_spans(text: str, spans: list[tuple[int, int]], belief: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of neighbouring tokens of one believed label that no base match touches and whose symbols fit the kind."""
    label = np.where(belief[:, 1:].max(axis=1) >= BELIEF, belief[:, 1:].argmax(axis=1), -1).tolist()
    label = [-1 if own else k for k, own in zip(label, _labels(spans, base))]
    edges = [0, *(k for k in range(1, len(spans)) if label[k] != label[k - 1] or text[spans[k - 1][1] : spans[k][0]] != " "), len(spans)]
    runs = [(label[x], spans[x][0], spans[y - 1][1]) for x, y in pairwise(edges) if x < y and label[x] >= 0]
    return [r for r in runs if _plausible(r[0], text[r[1] : r[2]])]


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts of the base matches, their digest, all spans, and how many were added.

    A null text is empty and has no spans; the digest is then that of the empty string. Repeated rows give repeated
    results. Without labelled tokens the field adds nothing but what the prior carries, which needs a match to start from.
    An empty table gives no rows; other columns are not read. Memory follows the tokens with digits of one document or slice.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    field = learn(docs)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        graph, spans, base = Graph(), [], []
        for text in texts:
            spans.append(tokens(text))
            base.append(base_spans(text))
            if spans[-1]:
                graph.add(text, spans[-1])
        belief, at, rows = field.score(*graph.arrays()), 0, []
        for text, own, known in zip(texts, spans, base):
            more = added_spans(text, own, belief[at : at + len(own)], known) if own else []
            at += len(own)
            fixed = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in known)
            every = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(known + more, key=lambda s: (s[1], s[0])))
            rows.append([*(sum(s[0] == k for s in known) for k in range(4)), hashlib.sha256(fixed.encode()).hexdigest(), every, len(more)])
        columns = list(zip(*rows)) if rows else [[]] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        return pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                               ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return map_slices(docs, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
