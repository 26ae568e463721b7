"""Semirings as native Column expressions, with the same operations in numpy for partition-local sweeps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for plus infinity in the tropical semiring; part of the data format.
INF = 1_000_000_000


@dataclass(frozen=True)
class Semiring:
    """``leaf`` multiplies a stored value with a vector's, ``total`` adds up a column, ``power`` adds a value to itself.

    ``one`` times a value is that value. ``total`` must be commutative and associative, as Spark sums in any order; ``zero`` is its identity and the result of
    a row without entries. ``finish`` is applied once to the summed value.
    """

    name: str
    zero: float | int
    type: str
    leaf: Callable[[Column, Column], Column]
    total: Callable[[Column], Column]
    plus: Callable[[Column, Column], Column]
    power: Callable[[Column, Column], Column]
    finish: Callable[[Column], Column]
    add: np.ufunc
    times: Callable[[np.ndarray, np.ndarray], np.ndarray]
    repeat: Callable[[np.ndarray, np.ndarray], np.ndarray]
    dtype: type
    one: float = 1.0

    def y(self, w: Column) -> Column:
        """A row's value from its leaves."""
        return self.finish(F.coalesce(self.total(w), F.lit(self.zero))).cast(self.type)


def _whole(v: Column) -> Column:
    """Truncated toward zero; INF for what isn't below it, so the cast can't overflow."""
    return F.when(v.cast("double") >= INF, F.lit(INF)).otherwise(F.greatest(v.cast("double"), F.lit(-9e18)).cast("bigint"))


def _tropical_leaf(v: Column, x: Column) -> Column:
    a, b = _whole(v), _whole(x)
    return F.when((a >= INF) | (b >= INF), F.lit(INF).cast("bigint")).otherwise(a + b)


def _tropical_times(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, b = (np.trunc(np.minimum(np.asarray(u, float), INF)).astype(np.int64) for u in (v, x))
    return np.where((a >= INF) | (b >= INF), INF, a + b)


PLUS_TIMES = Semiring(
    "plustimes", 0.0, "double", lambda v, x: v.cast("double") * x.cast("double"), F.sum, lambda a, b: a + b, lambda w, n: w * n, lambda y: y,
    np.add, lambda v, x: np.asarray(v, float) * x, lambda w, n: w * n, np.float64,
)
BOOLEAN = Semiring(
    "boolean", 0, "int", lambda v, x: ((v != 0) & (x != 0)).cast("int"), F.max, lambda a, b: F.greatest(a, b), lambda w, n: w, lambda y: y,
    np.maximum, lambda v, x: ((np.asarray(v) != 0) & (x != 0)).astype(np.int64), lambda w, n: w, np.int64,
)
TROPICAL = Semiring(
    "tropical", INF, "bigint", _tropical_leaf, F.min, lambda a, b: F.least(a, b), lambda w, n: w, lambda y: F.least(y, F.lit(INF)),
    np.minimum, _tropical_times, lambda w, n: w, np.int64, 0.0,
)

_REGISTRY: dict[str, Semiring] = {}


def register(semiring: Semiring, *aliases: str) -> Semiring:
    for name in (semiring.name, *aliases):
        _REGISTRY[name.lower()] = semiring
    return semiring


register(PLUS_TIMES, "real", "sum")
register(BOOLEAN, "bool")
register(TROPICAL, "minplus")


def get(name: str | Semiring) -> Semiring:
    """By name or alias; an unknown name is an error."""
    if isinstance(name, Semiring):
        return name
    if name.lower() not in _REGISTRY:
        raise ValueError(f"unknown semiring {name!r}; there are {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name.lower()]
