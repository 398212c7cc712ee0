"""Linear-chain inference over many sequences of different lengths at once.

Rows first[i]:first[i + 1] of the score matrix are sequence i.  Step t of every sequence that has one is one array
operation, so the cost in Python calls is the length of the longest sequence.
"""

from __future__ import annotations

import numpy as np


def marginals(up: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal probability of each label of each row, and the expected number of each transition.

    up holds unary scores, move[a, b] the score of label b after label a.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), side="left")  # sequences with more than t rows
    ahead, back = np.zeros_like(up), np.zeros_like(up)
    m = np.exp(move - move.max())
    for t in range(longest):
        rows = begin[: live[t]] + t
        a = up[rows]
        if t:
            p = ahead[rows - 1]
            a = a + np.log(np.exp(p - p.max(1, keepdims=True)) @ m + 1e-300)
        ahead[rows] = a - a.max(1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        rows = begin[: live[t + 1]] + t
        nxt = back[rows + 1] + up[rows + 1]
        b = np.log(np.exp(nxt - nxt.max(1, keepdims=True)) @ m.T + 1e-300)
        back[rows] = b - b.max(1, keepdims=True)
    both = ahead + back
    both = np.exp(both - both.max(1, keepdims=True)) if len(both) else both
    head = np.zeros(len(up), dtype=bool)
    head[first[:-1][np.diff(first) > 0]] = True
    to = np.flatnonzero(~head)
    after = back[to] + up[to]
    joint = np.exp(ahead[to - 1])[:, :, None] * m[None] * np.exp(after - after.max(1, keepdims=True))[:, None, :] if len(to) else np.zeros((0, *move.shape))
    joint /= np.maximum(joint.sum((1, 2), keepdims=True), 1e-300)
    return both / np.maximum(both.sum(1, keepdims=True), 1e-300), joint.sum(0)


def viterbi(up: np.ndarray, move: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> list[int]:
    """Best labels of one sequence; enter and leave are added to its first and last row."""
    best, back = up[0] + enter, []
    for row in up[1:]:
        ways = best[:, None] + move
        back.append(ways.argmax(0))
        best = ways.max(0) + row
    at = int((best + leave).argmax())
    out = [at]
    for step in reversed(back):
        at = int(step[at])
        out.append(at)
    return out[::-1]
