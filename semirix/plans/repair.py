"""Grammar compression by pair replacement, for blocks of rows.

The published algorithm replaces the most frequent adjacent pair by a new symbol until no pair occurs twice. Here each round
replaces many pairs at once: in descending order of frequency, a pair is taken if neither of its symbols is in a pair already taken in the
round. So the places of taken pairs can't overlap, save in runs of one symbol, which are paired from the left. A pair never crosses a
row's end, and the delimiter is in no rule.
"""

from __future__ import annotations

import numpy as np


def compress(stream: np.ndarray, alpha: int, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """stream: codes below ``alpha`` with 0 after each row -> (stream of symbols, rules [n, 2]); rule i is symbol alpha + i.

    Within, the stream's own codes are numbered densely, so a pair's key is below the square of the stream's length, however great codes are.
    """
    codes = np.unique(stream[stream != 0]).astype(np.int64)
    s, rules, base = np.where(stream == 0, 0, np.searchsorted(codes, stream) + 1), [], len(codes) + 1
    while len(s) > 1:
        a, b = s[:-1], s[1:]
        ok = (a != 0) & (b != 0)
        at = np.flatnonzero(ok)
        if not len(at):
            break
        # of a run of one symbol only every other place is a pair
        same = ok & (a == b)
        if same.any():
            run = np.flatnonzero(same)
            start = np.r_[True, np.diff(run) > 1]
            first = run[np.maximum.accumulate(np.where(start, np.arange(len(run)), 0))]
            ok[run[(run - first) % 2 == 1]] = False
            at = np.flatnonzero(ok)
        span = int(s.max()) + 1
        keys, inv, count = np.unique(a[at] * span + b[at], return_inverse=True, return_counts=True)
        order = np.lexsort((keys, -count))
        order = order[count[order] >= least]
        if not len(order):
            break
        used, name = set(), np.full(len(keys), -1, np.int64)
        for k in order.tolist():
            x, y = divmod(int(keys[k]), span)
            if x in used or y in used or (len(rules) and count[k] * 4 < count[order[0]]):
                continue
            used |= {x, y}
            name[k] = base + len(rules)
            rules.append((x, y))
        to = name[inv]
        hit = at[to >= 0]
        s = s.copy()
        s[hit] = to[to >= 0]
        keep = np.ones(len(s), bool)
        keep[hit + 1] = False
        s = s[keep]
    names = np.concatenate([[0], codes, alpha + np.arange(len(rules))]).astype(np.int64)
    return names[s], names[np.array(rules, np.int64).reshape(-1, 2)]


def levels(left: np.ndarray, right: np.ndarray, alpha: int) -> np.ndarray:
    """1 + the greatest level of the children; codes below ``alpha`` have level 0. Children come before their parents."""
    out = np.zeros(len(left), np.int64)
    while True:
        low = np.zeros(len(left), np.int64)
        for child in (left, right):
            inner = child >= alpha
            low[inner] = np.maximum(low[inner], out[child[inner] - alpha])
        if (low + 1 == out).all():
            return out
        out = low + 1
