"""Deterministic pseudo-random numbers from integer arithmetic that any SQL engine computes alike.

A number is a permutation of the draw's 62 low bits: two words below P go through a Feistel network of squares modulo P, keyed
by tree and seed. So different draws never share a number, and all products stay below 2 ** 63.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

P = 2147483647
#: Numbers lie in [0, RANGE).
RANGE = P * P
#: What is added in each round.
_ADD = (1013904223, 1640531527, 362437069, 1566083941, 521288629)
_ROUNDS = 4


def hash_sql(j: str, t: str, s: int) -> str:
    """SQL of a number in [0, RANGE) for draw ``j`` of tree ``t`` under seed ``s``."""
    j, t = f"cast({j} as bigint)", f"cast({t} as bigint)"
    a, b = f"(({j} >> 31) & {P})", f"({j} & {P})"
    key = f"(({t} & {P}) * 69621 + {s % P})"
    for add in _ADD[:_ROUNDS]:
        x = f"(({b} + {key} + {add}) % {P})"
        a, b = b, f"(({a} + {x} * {x}) % {P})"
    return f"({a} % {P} * {P} + {b})"


def hashed(j: str, t: str, s: int) -> Column:
    return F.expr(hash_sql(j, t, s))


def hash_numbers(j: np.ndarray, t: np.ndarray | int, s: int) -> np.ndarray:
    """The same numbers of integer arrays."""
    j, t = np.asarray(j, np.int64), np.asarray(t, np.int64)
    a, b = (j >> 31) & P, j & P
    key = (t & P) * 69621 + s % P
    for add in _ADD[:_ROUNDS]:
        x = (b + key + add) % P
        a, b = b, (a + x * x) % P
    return a % P * P + b
