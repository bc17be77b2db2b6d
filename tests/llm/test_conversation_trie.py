import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from habitat.llm import conversation_trie as ct
from habitat.llm.common import WORD

SCHEMA = "conv_id long, turn long, role string, text string, d long, path string, n int"


def brute(rows):
    """The contract by plain dictionaries over (conv_id, turn, role, text)."""
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            talks.setdefault(c, []).append(((turn is not None, turn or 0), sha, (role, text)))
    talks = {c: [t[2] for t in sorted(ts)] for c, ts in talks.items()}
    new = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = tuple(talks.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    members = {}
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    out, below = [], {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(WORD, node[-1][1])) if node else 0
        mine = kids.get(node, [])
        below[node] = (sum(below[k][0] for k in mine) or 1, sum(below[k][1] for k in mine) + (len(members[node]) - 1) * words)
        ends = ",".join(str(c) for c in sorted(members[node]) if new[c] == node)
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(mine), *below[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, rows):
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in ct.conversation_trie(df).collect()), key=str)


def talk(seed, convs=120, words=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(convs):
        for t in range(int(rng.integers(0, 7))):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", " ".join(rng.choice(["a", "b"], int(rng.integers(1, words))))))
    return rows


@pytest.mark.parametrize("shard", [4, 1 << 18])
def test_trie_equals_plain_dictionaries(spark, monkeypatch, shard):
    monkeypatch.setattr(ct, "SHARD", shard)
    monkeypatch.setattr(ct, "CHUNK", 2)
    rows = talk(1)
    assert built(spark, rows) == brute(rows)


def test_trie_of_copies_a_long_conversation_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ct, "CHUNK", 16)
    rows = talk(2, 40)
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(4)]
    rows += [(200, t, "user", f"long  {t}\n") for t in range(500)] + [(220, t, "user", f"long  {t}\n") for t in range(500)]
    rows += [(300, None, None, None), (300, None, None, None), (300, 2, "user", ""), (300, 2, "user", "tie"), (300, 2, "assistant", "tie"), (301, 1, "", None),
             (None, 1, "user", "nobody"), (-7, 1, "user", "below zero"), (-20, 1, "user", "below"), (-20, 2, "user", "zero"), (400, 1, "é", "字 🙂"), (400, 1, "é", "字 🙂")]
    assert built(spark, rows) == brute(rows)


def test_trie_of_equal_conversations_is_one_chain(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 100, 20) for t in range(5)]
    got = built(spark, rows)
    assert got == brute(rows) and len(got) == 6 and {r[5] for r in got} == {1}


def test_trie_of_an_empty_table(spark):
    assert built(spark, []) == []


@pytest.mark.parametrize("block", [2, 8, 256])
def test_find_close_and_leaf_rank(block):
    rng = np.random.default_rng(block)
    for size in (1, 2, 40, 700):
        bits, open_now = [], 0
        left = size
        while left or open_now:
            if left and (not open_now or rng.random() < 0.55):
                bits.append(1)
                open_now, left = open_now + 1, left - 1
            else:
                bits.append(0)
                open_now -= 1
        bits = np.array(bits)
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        tree = ct.Parentheses(bits, block)
        opens = np.flatnonzero(bits)
        assert tree.find_close(opens).tolist() == [want[i] for i in opens]
        assert tree.leaf_rank()[-1] == sum(want[i] == i + 1 for i in opens)


def test_spines_of_shards_add_up():
    root = (1, 9, 5)
    reps = [1, 2, 4, 7]
    paths = [[(1, 4, 10), (1, 1, 0)], [(1, 4, 10), (2, 2, 3)], [(1, 4, 10), (4, 1, 0)], [(7, 5, 8)]]
    whole = ct.shard_sums(root, reps, [True] * 4, paths)
    halves = ct.shard_sums(root, reps[:2], [True] * 2, paths[:2]) + ct.shard_sums(root, reps[2:], [True] * 2, paths[2:])
    merged = {}
    for m, n, *rest in halves:
        merged[m, n] = [x + y for x, y in zip(merged.get((m, n), [0, 0, 0]), rest)]
    assert merged == {(m, n): rest for m, n, *rest in whole}
    assert merged[1, 9] == [4, 5 + 10 + 3 + 8, 2] and merged[1, 4] == [3, 13, 3]
