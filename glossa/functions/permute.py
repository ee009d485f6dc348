"""Seeded permutations of dense ids, as arithmetic.

``Permutation(n, seed)`` maps 0..n-1 onto itself, one row at a time: a Feistel network on
pairs (l, r) of numbers below a and b, where a * b is the least such product of near-equal
factors that reaches n. A point that lands beyond n is mapped again until it does not (cycle
walking); fewer than a points lie there, so the driver knows the longest such walk exactly. Positions, and
their inverse, need no sort and no shuffle.

The round function is quadratic modulo a prime, in 64-bit integers any engine has; its
keys are drawn from the SHA-256 of the seed. n may be up to 2**48.
"""

from __future__ import annotations

import hashlib
import math
from functools import cached_property

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
ROUNDS = 6


def round_keys(seed: int) -> list[tuple[int, int]]:
    out = []
    for k in range(ROUNDS):
        h = hashlib.sha256(f"{seed}:{k}".encode()).digest()
        out.append((int.from_bytes(h[:4], "big") % (PRIME - 1) + 1, int.from_bytes(h[4:8], "big") % PRIME))
    return out


def factors(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1) if n > 1 else 1
    return a, max(1, -(-n // a))


class Permutation:
    def __init__(self, n: int, seed: int):
        if not 0 <= n <= 1 << 48:
            raise ValueError(f"cannot permute {n} ids")
        self.n, self.keys = n, round_keys(seed)
        self.a, self.b = factors(n)

    # on the driver ---------------------------------------------------------------------------

    def _once(self, x: np.ndarray, inverse: bool = False) -> np.ndarray:
        left, right = x // self.b, x % self.b
        sign = -1 if inverse else 1
        for k, (mul, add) in (reversed if inverse else list)(list(enumerate(self.keys))):
            v = left if k % 2 else right
            q = (v * mul + add) % PRIME
            f = sign * ((q * q + v) % PRIME)
            if k % 2:
                right = (right + f) % self.b
            else:
                left = (left + f) % self.a
        return left * self.b + right

    @cached_property
    def walks(self) -> int:
        """The most times that a point is mapped once more."""
        beyond, n = np.arange(self.n, self.a * self.b, dtype=np.int64), 0
        # only points that some id is mapped to; others may go round beyond n for ever
        x = beyond[self._once(beyond, inverse=True) < self.n]
        while len(x):
            x, n = self._once(x), n + 1
            x = x[x >= self.n]
        return n

    def of(self, ids, inverse: bool = False) -> np.ndarray:
        """Positions of a few ids (or, with ``inverse``, the ids at some positions)."""
        x = self._once(np.asarray(ids, np.int64), inverse)
        while (out := x >= self.n).any():
            x[out] = self._once(x[out], inverse)
        return x

    # as columns ------------------------------------------------------------------------------

    def _mapped(self, x: str, inverse: bool) -> str:
        rounds = list(enumerate(self.keys))
        table = "array(" + ", ".join(f"named_struct('odd', {str(k % 2 == 1).lower()}, 'm', {m}L, 'c', {c}L)"
                                     for k, (m, c) in (rounds[::-1] if inverse else rounds)) + ")"

        def f(v: str) -> str:
            q = f"(({v} * k.m + k.c) % {PRIME}L)"
            return f"(({q} * {q} + {v}) % {PRIME}L)"

        sign = "-" if inverse else "+"
        return (f"aggregate({table}, named_struct('l', {x} div {self.b}L, 'r', {x} % {self.b}L), (s, k) -> "
                f"if(k.odd, named_struct('l', s.l, 'r', pmod(s.r {sign} {f('s.l')}, {self.b}L)), "
                f"named_struct('l', pmod(s.l {sign} {f('s.r')}, {self.a}L), 'r', s.r)), s -> s.l * {self.b}L + s.r)")

    def column(self, id_col: str, inverse: bool = False) -> Column:
        """Position of a dense id (or, with ``inverse``, the id at a position)."""
        start = f"cast(`{id_col}` as bigint)"
        once = self._mapped("x", inverse)
        return F.expr(f"aggregate(sequence(0, {self.walks}), {start}, "
                      f"(x, i) -> if(i > 0 and x < {self.n}L, x, {once}))")
