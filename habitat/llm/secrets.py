"""Find secrets: fixed base patterns, and candidates whose format inferred automata find likely.

The base matches are the labelled credentials: their values, by kind, teach one automaton per kind,
and candidates outside of any base match teach one of ordinary strings. Candidates are all runs from the
least length of the learnt kinds on, and runs that a base match covers in part. A candidate whose
likelihood per symbol under a kind exceeds that under the ordinary automaton by the
margin of the kind's own values, and is itself as high as theirs, is a span of kind ``format``. So a string that is only
unlike ordinary ones, as a run of digits of a length that no credential has, is none.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitat.llm.automata import Automaton, merged, weighed
from habitat.llm.common import cut, giving_back, map_slices, whole_text

KINDS = ("assign", "access", "hex", "format")
#: Candidates that overlap a base match: scored, but not taught as ordinary ones.
PART = 4
#: Fixed patterns and least lengths of the base.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
#: Runs of credential symbols from the least length of the learnt kinds on are scored; full stops behind them are left off.
CANDIDATE_LEAST = ASSIGN_LEAST
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A prefix is a state of its own, until states are merged, if one of so many values of its kind has it, or of ordinary candidates.
NODES, ORDINARY_NODES = 1500, 3000
#: Part of a kind that is all of it, beside its halves 0 and 1; values that are ranked together; print of the empty prefix.
WHOLE, GROUP, ROOT = -1, 100_000, 0x4BF29CE484222325
#: Bytes of text that a worker handles at a time; answers kept by a worker, and the longest value that has one kept.
SLICE, ANSWERS, ANSWER_LENGTH = 2 << 20, 1 << 15, 128
#: Least gain in nats per symbol, and the share of a kind's own values that may fall below its threshold.
MARGIN, TAIL = 0.5, 0.02


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the base matches, by start and then kind; code points, end exclusive.

    The least lengths inside the last two patterns give the same matches as a filter behind them,
    as a match always takes its whole run of symbols.
    """
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(0, m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def candidates(text: str, base: list) -> list[tuple[int, int, int, str]]:
    """Runs of credential symbols that no base match covers whole, each before its own pieces.

    A run that a match covers in part is a candidate as a whole, as the match may be a piece of a
    longer credential, and so is each piece of ``CANDIDATE_LEAST`` symbols or more that is left of
    it. These have kind ``PART``; runs that no match touches have kind 3.
    """
    out, i = [], 0
    for m in CANDIDATE.finditer(text):
        a = m.start()
        value = m[0].rstrip(".")
        b = a + len(value)
        if len(value) < CANDIDATE_LEAST:
            continue
        while i < len(base) and base[i][2] <= a:
            i += 1
        pieces, at, j = [], a, i
        while j < len(base) and base[j][1] < b:
            if base[j][2] > a:
                pieces.append((at, base[j][1]))
                at = max(at, base[j][2])
            j += 1
        if not pieces:
            out.append((3, a, b, value))
            continue
        pieces.append((at, b))
        pieces = [(max(x, a), y) for x, y in pieces if y > max(x, a)]
        if pieces:
            out.append((PART, a, b, value))
            out += [(PART, x, y, text[x:y]) for x, y in pieces if y - x >= CANDIDATE_LEAST]
    return out


def scan(docs: DataFrame) -> DataFrame:
    """(kind, value): values of the base matches and of candidates of kind 3 in every whole text, once for each batch of rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = set()
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            values.update((k, v) for k, _, _, v in spans)
            values.update((k, v) for k, _, _, v in candidates(text, spans) if k == 3)
        kinds, texts = zip(*values) if values else ((), ())
        return pa.record_batch([pa.array(kinds, pa.int32()), pa.array(texts, pa.string())], ["kind", "value"])

    return map_slices(docs.select(whole_text().alias("text")), run, "kind int, value string", most=SLICE)


def learn(scanned: DataFrame, nodes: int = NODES, ordinary: int = ORDINARY_NODES) -> dict[int, tuple[Automaton, float, float]]:
    """Automata by kind with their thresholds of gain and of likelihood, 3 being that of ordinary candidates.

    All distinct values teach. The states of a kind come from its prefixes that one of ``nodes`` values has (ordinary ones: of
    ``ordinary``), which are as many at each length at most, so a model does not grow with the table; the frequencies of steps, ends and
    lengths are those of all values on their way through the states. Up to ``nodes`` values all prefixes take part.
    """
    values = cut(scanned.distinct())
    sizes = {r["kind"]: r["count"] for r in values.groupBy("kind").count().collect()}
    if not sizes:
        return {}
    # Every other value of a kind is in its second half, counted in groups of a bounded size.
    groups = _by_kind({(k, WHOLE): 1 + n // GROUP for k, n in sizes.items()}, F.lit(WHOLE))
    at = F.row_number().over(Window.partitionBy("kind", F.pmod(F.xxhash64("value"), groups)).orderBy("value"))
    halves = cut(values.filter("kind < 3").select("kind", ((at - 1) % 2).alias("part"), "value"))
    sizes = {(k, WHOLE): n for k, n in sizes.items()} | {(r["kind"], r["part"]): r["count"] for r in halves.groupBy("kind", "part").count().collect()}
    taught = values.select("kind", F.lit(WHOLE).alias("part"), "value").unionByName(halves)
    states = _states(taught, {(k, part): -(-n // (ordinary if k == 3 else nodes)) for (k, part), n in sizes.items()})
    automata = _frequencies(taught, states)
    plain = automata.get((3, WHOLE))
    out = {3: (plain, 0.0, 0.0)} if plain else {}
    limits = _thresholds(halves, automata, {k: n for (k, part), n in sizes.items() if part == WHOLE and k != 3})
    return out | {k: (automata[k, WHOLE], max(MARGIN, gain), likely) for k, (gain, likely) in limits.items()}


def _by_kind(numbers: dict[tuple[int, int], int], part: Column) -> Column:
    """The number of a row's kind and part."""
    return F.coalesce(*[F.when((F.col("kind") == k) & (part == p), F.lit(n)) for (k, p), n in numbers.items()])


def _longer(node: int, symbol: str) -> int:
    """The print of a prefix with one more symbol."""
    return (node ^ ord(symbol)) * 0x100000001B3 & (1 << 63) - 1


def _nodes(values: list[str], least: int) -> list[tuple[int, int, str, int, int]]:
    """(node, parent, symbol, visits, ends) of prefixes of the sorted and distinct ``values``.

    They are those of ``least`` values, those of the first and of the last value, which may have more values in the neighbouring
    ranges, and all that are one symbol longer.
    """
    out = [(ROOT, ROOT, "", len(values), int(not values[0]))]
    known = [(0, len(values), 0, ROOT)]
    while known:
        lo, hi, depth, node = known.pop()
        lo += len(values[lo]) == depth
        while lo < hi:
            symbol = values[lo][depth]
            end = bisect_right(values, symbol, lo, hi, key=itemgetter(depth))
            child = _longer(node, symbol)
            out.append((child, node, symbol, end - lo, int(len(values[lo]) == depth + 1)))
            if end - lo >= least or lo == 0 or end == len(values):
                known.append((lo, end, depth + 1, child))
            lo = end
    return out


def _states(taught: DataFrame, least: dict[tuple[int, int], int]) -> dict[tuple[int, int], list[dict[str, int]]]:
    """Steps of the merged states of each (kind, part), from its prefixes that ``least`` values have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("kind", "part", "value")))]
        for key, own in groupby(rows, itemgetter(0, 1)):
            found = _nodes([r[2] for r in own], least[key])
            columns = [pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]
            columns = [pa.array([k] * len(found), pa.int32()) for k in key] + columns
            yield pa.record_batch(columns, ["kind", "part", "node", "parent", "symbol", "visits", "ends"])

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        index = {n: i for i, n in enumerate([ROOT, *(n for n in rows["node"] if n != ROOT)])}
        nexts: list[dict[str, list[int]]] = [{} for _ in index]
        ends, seen = [0] * len(index), [0] * len(index)
        for node, parent, symbol, visits, end in zip(*(rows[c].tolist() for c in ("node", "parent", "symbol", "visits", "ends"))):
            if node != ROOT:
                nexts[index[parent]][symbol] = [index[node], visits]
            if visits >= least[key[0], key[1]]:
                ends[index[node]], seen[index[node]] = end, visits
        steps, _ = merged((nexts, ends, seen))
        out = [(int(key[0]), int(key[1]), s, c, t) for s, own in enumerate(steps) for c, (t, _) in own.items()]
        return pd.DataFrame(out, columns=["kind", "part", "state", "symbol", "next"])

    # Ranges of sorted values: a prefix that goes on in the next range is one of the last value's.
    ranges = taught.repartitionByRange("kind", "part", "value").sortWithinPartitions("kind", "part", "value")
    each = ranges.mapInArrow(giving_back(count), "kind int, part int, node long, parent long, symbol string, visits long, ends long")
    each = cut(each.groupBy("kind", "part", "node").agg(
        F.min("parent").alias("parent"), F.min("symbol").alias("symbol"), F.sum("visits").alias("visits"), F.sum("ends").alias("ends")))
    often = each.filter(F.col("visits") >= _by_kind(least, F.col("part"))).select("kind", "part", F.col("node").alias("parent"))
    # Bounded by the prefixes that one of so many values has, as are the states.
    found = each.join(often, ["kind", "part", "parent"], "left_semi").groupBy("kind", "part").applyInPandas(
        fit, "kind int, part int, state int, symbol string, next int").collect()
    states: dict[tuple[int, int], list[dict[str, int]]] = {key: [{}] for key in least}
    for r in found:
        own = states[r["kind"], r["part"]]
        own += [{} for _ in range(max(r["state"], r["next"]) + 1 - len(own))]
        own[r["state"]][r["symbol"]] = r["next"]
    return states


def _frequencies(taught: DataFrame, states: dict[tuple[int, int], list[dict[str, int]]]) -> dict[tuple[int, int], Automaton]:
    """The automaton of each (kind, part): the states with the frequencies of all values; a symbol that leads nowhere keeps the state."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = {key: [Counter() for _ in own] for key, own in states.items()}
        lengths = {key: Counter() for key in states}
        for batch in batches:
            for kind, part, value in zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "value"))):
                own, counts, at = states[kind, part], steps[kind, part], 0
                for c in value:
                    counts[at][c] += 1
                    at = own[at].get(c, at)
                counts[at][""] += 1
                lengths[kind, part][len(value)] += 1
        rows = [(*key, s, c, n) for key, own in steps.items() for s, each in enumerate(own) for c, n in each.items()]
        rows += [(*key, -1, str(length), n) for key, own in lengths.items() for length, n in own.items()]
        columns = zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64())) if rows else []
        yield from [pa.record_batch([pa.array(c, k) for c, k in columns], ["kind", "part", "state", "symbol", "n"])] if rows else []

    each = taught.mapInArrow(giving_back(walk), "kind int, part int, state int, symbol string, n long")
    steps = {key: [{} for _ in own] for key, own in states.items()}
    ends = {key: [0] * len(own) for key, own in states.items()}
    lengths: dict[tuple[int, int], dict[int, int]] = {key: {} for key in states}
    # Bounded by the states, the symbols and the different lengths.
    for r in each.groupBy("kind", "part", "state", "symbol").agg(F.sum("n").alias("n")).collect():
        key, at, c, n = (r["kind"], r["part"]), r["state"], r["symbol"], r["n"]
        if at < 0:
            lengths[key][int(c)] = n
        elif not c:
            ends[key][at] = n
        else:
            steps[key][at][c] = (states[key][at].get(c, at), n)
    return {key: weighed(steps[key], ends[key], lengths[key]) for key in states}


def _thresholds(halves: DataFrame, automata: dict[tuple[int, int], Automaton], sizes: dict[int, int]) -> dict[int, tuple[float, float]]:
    """Gain and likelihood per symbol by kind that all but ``TAIL`` of its values reach under the automaton of the other half.

    Few values miss symbols and lengths that the next ones have, and this shows by how much. A single one is its own half.
    """
    plain = automata.get((3, WHOLE))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for kind, part, value in zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "value"))):
            likely = _mean(value, automata.get((kind, 1 - part)) or automata[kind, part])
            rows += [(2 * kind, likely - _ordinary(value, plain)), (2 * kind + 1, likely)]
        of, score = zip(*rows)
        return pa.record_batch([pa.array(of, pa.int32()), pa.array(score, pa.float64())], ["of", "score"])

    if not sizes:
        return {}
    wanted, start = {}, 0
    for kind, n in sorted(sizes.items()):
        for of in (2 * kind, 2 * kind + 1):
            wanted[start + int(TAIL * n)] = of
            start += n
    ranked = map_slices(halves, judge, "of int, score double", text="value").orderBy("of", "score").rdd.zipWithIndex()
    found = {wanted[i]: r["score"] for r, i in ranked.filter(lambda x: x[1] in wanted).collect()}
    return {k: (found[2 * k], found[2 * k + 1]) for k in sizes}


def _ordinary(value: str, plain: Automaton | None) -> float:
    return _mean(value, plain) if plain else -4.2


def _mean(value: str, kind: Automaton) -> float:
    return kind.log_likelihood(value) / (len(value) + 1)


def _gain(value: str, kind: Automaton, plain: Automaton | None) -> float:
    return _mean(value, kind) - _ordinary(value, plain)


def is_secret(value: str, automata: dict[int, tuple[Automaton, float, float]]) -> bool:
    plain = automata[3][0] if 3 in automata else None
    kinds = (automata[k] for k in range(3) if k in automata)
    return any(_mean(value, kind) >= likely and _gain(value, kind, plain) >= gain for kind, gain, likely in kinds)


def _formats(text: str, base: list, judge: Callable[[str], bool]) -> list[tuple[int, int, int]]:
    """Spans of the likely candidates; a piece inside of a span that was taken is left out."""
    out: list[tuple[int, int, int]] = []
    for _, a, b, value in candidates(text, base):
        if (not out or b > out[-1][2]) and judge(value):
            out.append((3, a, b))
    return out


def _judge(automata: dict[int, tuple[Automaton, float, float]]) -> Callable[[str], bool]:
    """``is_secret`` with the answers for values that come again, unless they are long."""
    kept = lru_cache(ANSWERS)(lambda value: is_secret(value, automata))
    return lambda value: kept(value) if len(value) <= ANSWER_LENGTH else is_secret(value, automata)


def secret_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, digest of the base spans and all spans.

    Null texts are empty and have no spans; the digest is then that of the empty string.
    Repeated rows give repeated results. Without any base match no format is learnt
    and none is found. An empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    automata = learn(scan(docs))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, judge = [], _judge(automata)
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            own = [s[:3] for s in spans]
            more = _formats(text, spans, judge)
            base = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in own)
            every = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(own + more, key=lambda s: (s[1], s[0])))
            rows.append([*(sum(s[0] == k for s in own) for k in range(3)), hashlib.sha256(base.encode()).hexdigest(), every, len(more)])
        columns = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        return pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                               ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long"
    return map_slices(docs, run, schema, most=SLICE)


def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; touching spans become one. All rows and columns stay.

    A null text stays null. ``n_chars`` follows the new text where that column exists.
    """
    automata = learn(scan(docs))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, judge = [], _judge(automata)
        for text in batch.column("text").to_pylist():
            if not text:
                out.append(text)
                continue
            base = base_spans(text)
            spans = sorted([s[1:3] for s in base] + [s[1:3] for s in _formats(text, base, judge)])
            parts, at = [], 0
            for a, b in spans:
                if a > at or not parts:
                    parts += [text[at:a], mark]
                at = max(at, b)
            out.append("".join(parts) + text[at:] if spans else text)
        return batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, batch.schema.field("text").type))

    done = map_slices(docs, run, docs.schema, most=SLICE)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return done
