"""Evaluation of a block's grammar in one task: numpy over the block's symbols, level by level."""

from __future__ import annotations

import numpy as np

from semirix.functions.semiring import Semiring
from semirix.plans.repair import levels


def _at(symbols: np.ndarray, names: np.ndarray) -> np.ndarray:
    return np.searchsorted(symbols, names)


def evaluate(s: Semiring, alpha: int, sym: np.ndarray, left: np.ndarray, right: np.ndarray, rep: np.ndarray, codes: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted symbols and a row of values for each. right is -1 where there is none; a code without a leaf is the identity."""
    order = np.argsort(sym, kind="stable")
    sym, left, right, rep = sym[order], left[order], right[order], rep[order]
    used = np.concatenate([left, right[right >= 0], codes])
    terminals = np.unique(used[used < alpha])
    symbols = np.concatenate([terminals, sym])
    value = np.full((len(symbols), leaves.shape[1]), s.zero, s.dtype)
    value[_at(terminals, codes)] = leaves
    here = lambda c: np.where(c >= alpha, alpha + _at(sym, np.maximum(c, alpha)), c)  # noqa: E731  level() wants dense names
    level = levels(here(left), np.where(right >= 0, here(right), 0), alpha)
    l, r = _at(symbols, left), _at(symbols, np.maximum(right, 0))
    base = len(terminals)
    for k in range(1, int(level.max(initial=0)) + 1):
        at = np.flatnonzero(level == k)
        w = s.repeat(value[l[at]], rep[at][:, None])
        two = right[at] >= 0
        w[two] = s.add(w[two], value[r[at[two]]])
        value[base + at] = w
    return symbols, value


class Rising:
    """Values of a block's symbols that come in ascending order, a batch at a time, so a rule's children are there before it. All that is kept
    is a name and a value for each symbol; a symbol that never came is the identity."""

    def __init__(self, s: Semiring, size: int):
        self.s, self.n = s, 1
        self.names, self.value = np.zeros(1 << 12, np.int64), np.empty((1 << 12, size), s.dtype)
        self.value[0] = s.zero  # the delimiter, for what isn't there

    def add(self, sym: np.ndarray, left: np.ndarray, right: np.ndarray, rep: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The values of the next symbols. left is -1 for a code, which has the value w; right is -1 where there is none."""
        n, m = self.n, self.n + len(sym)
        if m > len(self.names):
            names, value = self.names, self.value
            self.names, self.value = np.empty(2 * m, np.int64), np.empty((2 * m, value.shape[1]), value.dtype)
            self.names[:n], self.value[:n] = names[:n], value[:n]
        self.names[n:m], self.value[n:m], self.n = sym, w, m
        l, r = self._at(left), self._at(right)
        level = levels(np.maximum(l - n + 1, 0), np.maximum(r - n + 1, 0), 1)  # within the batch
        level[left < 0] = 0
        for k in range(1, int(level.max(initial=0)) + 1):
            at = np.flatnonzero(level == k)
            self.value[n + at] = self.s.add(self.s.repeat(self.value[l[at]], rep[at][:, None]), self.value[r[at]])
        return self.value[n:m]

    def _at(self, names: np.ndarray) -> np.ndarray:
        own = self.names[: self.n]
        at = np.minimum(np.searchsorted(own, names), self.n - 1)
        return np.where(own[at] == names, at, 0)


def descend(s: Semiring, alpha: int, sym: np.ndarray, left: np.ndarray, right: np.ndarray, rep: np.ndarray, row: np.ndarray, top: np.ndarray, given: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes below ``top`` (the symbols of the rows ``row``) and, for each, the sum of the values w of the rows ``given`` over its places."""
    order = np.argsort(sym, kind="stable")
    sym, left, right, rep = sym[order], left[order], right[order], rep[order]
    used = np.concatenate([left, right[right >= 0], top])
    terminals = np.unique(used[used < alpha])
    symbols, base = np.concatenate([terminals, sym]), len(terminals)
    value = np.full((len(symbols), w.shape[1]), s.zero, s.dtype)
    by = np.argsort(given, kind="stable")
    at = np.minimum(np.searchsorted(given[by], row), len(by) - 1)
    has = given[by][at] == row
    s.add.at(value, _at(symbols, top[has]), w[by][at[has]])
    here = lambda c: np.where(c >= alpha, alpha + _at(sym, np.maximum(c, alpha)), c)
    level = levels(here(left), np.where(right >= 0, here(right), 0), alpha)
    l, r = _at(symbols, left), _at(symbols, np.maximum(right, 0))
    for k in range(int(level.max(initial=0)), 0, -1):
        own = np.flatnonzero(level == k)
        s.add.at(value, l[own], s.repeat(value[base + own], rep[own][:, None]))
        two = own[right[own] >= 0]
        s.add.at(value, r[two], value[base + two])
    return terminals, value[:base]


def rows(s: Semiring, symbols: np.ndarray, value: np.ndarray, row: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, and the sum of each row's symbols; a symbol twice in a row counts twice."""
    order = np.argsort(row, kind="stable")
    row, sym = row[order], sym[order]
    names, first = np.unique(row, return_index=True)
    return names, s.add.reduceat(value[_at(symbols, sym)], first, axis=0)


def expand(alpha: int, sym: np.ndarray, left: np.ndarray, right: np.ndarray, rep: np.ndarray, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes that the stream's symbols stand for, in order, and for each the place of its symbol in the stream."""
    order = np.argsort(sym, kind="stable")
    sym, left, right, rep = sym[order], left[order], right[order], rep[order]
    place = np.arange(len(stream))
    while (stream >= alpha).any():
        inner = stream >= alpha
        at = np.searchsorted(sym, np.where(inner, stream, sym[0] if len(sym) else 0))
        pair = inner & (right[at] >= 0) if len(sym) else inner
        size = np.where(inner, np.where(pair, 2, rep[at]), 1)
        first = np.cumsum(size) - size
        out = np.repeat(np.where(inner, left[at], stream), size)
        out[first[pair] + 1] = right[at[pair]]
        stream, place = out, np.repeat(place, size)
    return stream, place
