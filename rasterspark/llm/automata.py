"""Probabilistic automata learnt from examples by merging prefix-tree states.

State merging in the manner of ALERGIA (Carrasco and Oncina, 1994), red-blue order:
two states merge if their end and transition frequencies, and those of all states
behind them, differ by less than a Hoeffding bound.
"""

from __future__ import annotations

from math import log, sqrt

#: Character classes; other characters stand for themselves.
_CLASSES = {**{c: "d" for c in "0123456789"}, **{c: "h" for c in "abcdef"}, **{c: "H" for c in "ABCDEF"}, **{c: "l" for c in "ghijklmnopqrstuvwxyz"}, **{c: "U" for c in "GHIJKLMNOPQRSTUVWXYZ"}}
_TABLE = str.maketrans(_CLASSES)
FLOOR = log(1e-3)


def shape(text: str) -> str:
    return text.translate(_TABLE)


class _State:
    __slots__ = ("ends", "seen", "next")

    def __init__(self):
        self.ends, self.seen, self.next = 0, 0, {}  # next: symbol -> [count, state]


def _prefix_tree(samples: list[str]) -> _State:
    root = _State()
    for s in samples:
        at = root
        at.seen += 1
        for c in s:
            step = at.next.setdefault(c, [0, None])
            step[0] += 1
            step[1] = at = step[1] or _State()
            at.seen += 1
        at.ends += 1
    return root


def _differ(n1: int, f1: int, n2: int, f2: int, bound: float) -> bool:
    return abs(f1 / n1 - f2 / n2) > bound * (1 / sqrt(n1) + 1 / sqrt(n2))


def _compatible(a: _State, b: _State, bound: float) -> bool:
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if _differ(a.seen, a.ends, b.seen, b.ends, bound):
            return False
        for c in a.next.keys() | b.next.keys():
            x, y = a.next.get(c), b.next.get(c)
            if _differ(a.seen, x[0] if x else 0, b.seen, y[0] if y else 0, bound):
                return False
            if x and y:
                todo.append((x[1], y[1]))
    return True


def _fold(a: _State, b: _State) -> None:
    """Adds the tree below ``b`` to ``a``."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        a.ends += b.ends
        a.seen += b.seen
        for c, (n, to) in b.next.items():
            step = a.next.get(c)
            if step is None:
                a.next[c] = [n, to]
            else:
                step[0] += n
                todo.append((step[1], to))


def learn(samples: list[str], alpha: float = 0.05) -> list[tuple[float, dict[str, tuple[float, int]]]]:
    """States as (log end probability, symbol -> (log probability, state)); state 0 starts."""
    root, bound = _prefix_tree(samples), sqrt(0.5 * log(2 / alpha))
    red, blue = [root], [(root, c) for c in sorted(root.next)]
    while blue:
        # the blue state seen most often comes first
        blue.sort(key=lambda p: (p[0].next[p[1]][1].seen, p[1]))
        parent, c = blue.pop()
        state = parent.next[c][1]
        if any(state is r for r in red):
            continue
        into = next((r for r in red if _compatible(r, state, bound)), None)
        if into is None:
            red.append(state)
        else:
            parent.next[c][1] = into
            _fold(into, state)
        blue = [(r, s) for r in red for s in sorted(r.next) if not any(r.next[s][1] is x for x in red)]
    number = {id(r): i for i, r in enumerate(red)}
    out = []
    for r in red:
        total = r.seen + 1
        out.append((log((r.ends + 0.5) / total), {c: (log(n / total), number[id(to)]) for c, (n, to) in r.next.items()}))
    return out


def likelihood(states, text: str) -> float:
    """Mean log probability per symbol, the end included; an unknown step costs FLOOR and stays."""
    at, total = 0, 0.0
    for c in text:
        step = states[at][1].get(c)
        if step is None:
            total += FLOOR
        else:
            total += step[0]
            at = step[1]
    return (total + states[at][0]) / (len(text) + 1)
