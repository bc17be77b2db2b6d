import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from habitat.llm import personal_data as pd13

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    """The base by its four patterns as they stand."""
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = [True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 12 <= len(digits) <= 19 and plain_luhn(digits), 9 <= len(digits) <= 15][kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "x.y+z@q-1.example.com", "@", ".", "+", "1", "22", "255", "256", "0010", " ", "-", "(", ")", "\n", "é", "4111 1111 1111 1111", "4111-1111-1111-1111",
                                 "+1 (555) 010-9999", "10.0.0.1", "k", "%", "5", "_"]), max_size=14).map("".join))
def test_base_equals_the_plain_patterns(text):
    assert pd13.base_spans(text) == brute(text)


def test_base_is_linear_in_long_runs():
    assert pd13.base_spans("a" * 400_000 + " " + "1" * 400_000 + "." + "+(" * 100_000) == []
    assert pd13.base_spans("1." * 200_001)[0] == (1, 0, 7)


def report(spark, texts):
    rows = [(i, t, "b", 3, "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base_sha256 string, n_email int, spans string")
    return {r.doc_id: r for r in pd13.personal_data(df).collect()}


def teaching():
    rng = np.random.default_rng(3)
    out = []
    for i in range(240):
        number = f"({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
        card = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        card += next(str(c) for c in range(10) if plain_luhn(card + str(c)))
        bad = str(int(card[-1]) + 1 if card[-1] < "9" else 0)
        out += [f"please call +1 {number} or mail user{i}@mail{i % 7}.example.com today", f"paid by {card} from {rng.integers(1, 255)}.{rng.integers(1, 255)}.7.{i % 250} at noon",
                f"order {rng.integers(10**5, 10**6)} of {rng.integers(1, 60)} parts, item {card[:-1]}{bad}, page {i} of 1{i}", f"release 2.{i}.1 on 2024-0{1 + i % 9}-1{i % 10} took {i}.5 s"]
    return out


UNCLEAR = "write to 555 777-8899 soon"
LINKED = "call +1 (555) 777-8899 now. A while later there is more to say about it all: write to 555 777-8899 soon"


def test_a_clear_mention_decides_a_distant_unclear_one(spark):
    got = report(spark, [*teaching(), UNCLEAR, LINKED])
    n = len(teaching())
    assert got[n].n_added == 0
    where = LINKED.rindex("777-8899")
    assert got[n + 1].n_phone == 1 and f"phone:{where - 4}:{where + 8}" in got[n + 1].spans or f"phone:{where}:{where + 8}" in got[n + 1].spans
    # Numbers that fail the check sum, dates, versions and counts stay clean.
    assert sum(got[i].n_added for i in range(n)) == 0


def test_labels_hold_on_held_out_texts():
    texts, field = teaching(), None
    half = len(texts) // 2
    graph, labels = pd13.Graph(), []
    for t in texts[:half]:
        spans = pd13.tokens(t)
        graph.add(t, spans)
        labels += pd13._labels(spans, pd13.base_spans(t))
    field = pd13.fit(*graph.arrays(), np.array(labels))
    right = total = 0
    for t in texts[half:]:
        spans, graph = pd13.tokens(t), pd13.Graph()
        graph.add(t, spans)
        want = np.array(pd13._labels(spans, pd13.base_spans(t)))
        right += int((field.score(*graph.arrays()).argmax(axis=1) == want).sum())
        total += len(want)
    assert right / total > 0.98


def test_beliefs_are_exact_on_a_tree():
    rng = np.random.default_rng(1)
    nodes, pair = rng.normal(size=(5, 3)), rng.normal(size=(2, 3, 3))
    links = np.array([[0, 1, 0], [1, 2, 0], [1, 3, 1], [3, 4, 1]])
    weight = np.zeros((3,) * 5)
    for y in itertools.product(range(3), repeat=5):
        weight[y] = np.exp(sum(nodes[i, y[i]] for i in range(5)) + sum(pair[k, y[a], y[b]] for a, b, k in links))
    weight /= weight.sum()
    sweeps, pd13.SWEEPS = pd13.SWEEPS, 80
    try:
        single, joint = pd13.beliefs(nodes, links, pair)
    finally:
        pd13.SWEEPS = sweeps
    for i in range(5):
        assert np.allclose(np.exp(single[i]), weight.sum(axis=tuple(k for k in range(5) if k != i)), atol=1e-9)
    assert np.allclose(np.exp(joint[2]), weight.sum(axis=(0, 2, 4)), atol=1e-9)


def test_repeats_are_linked_one_by_one():
    text = " x ".join(["12345678"] * 50)
    graph = pd13.Graph()
    graph.add(text, pd13.tokens(text))
    assert len(graph.arrays()[1]) == 49


def test_odd_rows_and_an_empty_table(spark, odd, empty):
    rows = pd13.personal_data(odd).collect()
    assert len(rows) == odd.count()
    none = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == none and r.spans == "" for r in rows if r.doc_id in (3, 4, 5))
    assert pd13.personal_data(empty).count() == 0


@pytest.mark.parametrize("text", ["", " ", "@", "1", "+1", "é@ü.x"])
def test_small_texts(text):
    assert pd13.base_spans(text) == brute(text)
    graph = pd13.Graph()
    spans = pd13.tokens(text)
    graph.add(text, spans)
    assert pd13.Field.blank().score(*graph.arrays()).shape == (len(spans), 5)
