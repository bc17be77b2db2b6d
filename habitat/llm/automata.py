"""Probabilistic automata inferred from strings by merging compatible prefix-tree states."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Mapping

#: Confidence of the frequency test: two states stay apart if a frequency differs by more than chance.
ALPHA = 0.02
#: Share of probability kept for symbols that a state has not seen, over an alphabet of ``SYMBOLS``.
UNSEEN, SYMBOLS = 0.02, 69
#: Share of probability kept for lengths that no sample has; a length n has 1 / (n (n + 1)) of it.
OTHER_LENGTHS = 0.1


class Automaton:
    """A deterministic automaton with a probability for each step and for the end, and shares of whole lengths.

    Few samples merge into states that end anywhere; the lengths keep what such states forget.
    """

    def __init__(self, steps: list[dict[str, tuple[int, float]]], ends: list[float], lengths: dict[int, float]) -> None:
        self.steps, self.ends, self.lengths = steps, ends, lengths
        self.floor = math.log(UNSEEN / SYMBOLS)

    def log_likelihood(self, text: str) -> float:
        """Log probability of the whole string and of its length; an unseen symbol costs the floor and keeps the state."""
        at, total, steps, floor = 0, 0.0, self.steps, self.floor
        for c in text:
            step = steps[at].get(c)
            if step is None:
                total += floor
            else:
                at, logp = step
                total += logp
        share = (1 - OTHER_LENGTHS) * self.lengths.get(len(text), 0.0) + OTHER_LENGTHS / ((len(text) or 1) * (len(text) + 1))
        return total + self.ends[at] + math.log(share)


#: A prefix tree or what became of it: steps [target, count] by symbol, ends and visits of each node.
Tree = tuple[list[dict[str, list[int]]], list[int], list[int]]


def infer(samples: Iterable[str], alpha: float = ALPHA) -> Automaton:
    """The automaton of ``samples``, from their whole prefix tree."""
    nexts: list[dict[str, list[int]]] = [{}]
    ends, seen = [0], [0]
    lengths: Counter[int] = Counter()
    for text in samples:
        at = 0
        lengths[len(text)] += 1
        seen[0] += 1
        for c in text:
            step = nexts[at].get(c)
            if step is None:
                nexts.append({})
                ends.append(0)
                seen.append(0)
                step = nexts[at][c] = [len(nexts) - 1, 0]
            step[1] += 1
            at = step[0]
            seen[at] += 1
        ends[at] += 1
    return weighed(*merged((nexts, ends, seen), alpha), lengths)


def merged(tree: Tree, alpha: float = ALPHA) -> tuple[list[dict[str, tuple[int, int]]], list[int]]:
    """Red-blue state merging: the steps (state, count) of each state by symbol, and its ends. ``tree`` is used up.

    States are visited breadth first. A blue state is folded into the first red state whose
    frequencies of ending and of each symbol agree, and so on down both subtrees; if
    there is none it becomes red. A node without visits says nothing: its inside is not known.
    """
    nexts, ends, seen = tree
    factor = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > factor * (n**-0.5 + m**-0.5)

    def compatible(a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            x, y = stack.pop()
            n, m = seen[x], seen[y]
            if differ(ends[x], n, ends[y], m):
                return False
            left, right = nexts[x], nexts[y]
            for c in left.keys() | right.keys():
                s, t = left.get(c), right.get(c)
                if differ(s[1] if s else 0, n, t[1] if t else 0, m):
                    return False
                if s and t:
                    stack.append((s[0], t[0]))
        return True

    def fold(a: int, b: int) -> None:
        stack = [(a, b)]
        while stack:
            x, y = stack.pop()
            seen[x] += seen[y]
            ends[x] += ends[y]
            for c, (target, count) in nexts[y].items():
                step = nexts[x].get(c)
                if step is None:
                    nexts[x][c] = [target, count]
                else:
                    step[1] += count
                    stack.append((step[0], target))

    red, at = [0], 0
    known = {0}
    while at < len(red):
        state = red[at]
        for c in sorted(nexts[state]):
            blue = nexts[state][c][0]
            if blue in known:
                continue
            home = next((r for r in red if compatible(r, blue)), None)
            if home is None:
                red.append(blue)
                known.add(blue)
            else:
                nexts[state][c][0] = home
                fold(home, blue)
        # Folding may have added blue children to a red state that was passed already.
        at = next((i for i, r in enumerate(red) if any(t[0] not in known for t in nexts[r].values())), len(red))
    index = {r: i for i, r in enumerate(red)}
    return [{c: (index[t], k) for c, (t, k) in nexts[r].items()} for r in red], [ends[r] for r in red]


def weighed(steps: list[dict[str, tuple[int, int]]], ends: list[int], lengths: Mapping[int, int]) -> Automaton:
    """States with the probabilities that counts of steps, ends and lengths give."""
    spread = UNSEEN / SYMBOLS
    share = lambda k, n: math.log((1 - UNSEEN) * k / n + spread)
    seen = [end + sum(k for _, k in own.values()) for own, end in zip(steps, ends)]
    total = sum(lengths.values())
    return Automaton(
        [{c: (t, share(k, n)) for c, (t, k) in own.items()} for own, n in zip(steps, seen)],
        [share(end, n) if n else 0.0 for end, n in zip(ends, seen)],
        {n: k / total for n, k in lengths.items()},
    )
