"""Eigenvalues and unit eigenvectors of a positive semidefinite integer matrix, exact until the last rounding.

The characteristic polynomial comes from its remainders modulo enough primes
(Hessenberg form, then its recurrence) by Chinese remaindering.  All its roots
are real, so the sign changes of the polynomial shifted to a place are exactly
the roots above it, multiplicities included: bisection on a fine grid isolates
each root, or a multiple root as one.  Eigenvectors come from inverse iteration
in fixed point, whose shift is off the root by less than a grid step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Bits of an isolated root below its leading one.
PRECISION = 120
#: Fraction bits of the inverse iteration.
FRACTION = 3 * PRECISION


def primes(count: int) -> list[int]:
    """The largest primes below 2**31, falling."""
    small = [p for p in range(3, 46_342, 2) if all(p % q for q in range(3, math.isqrt(p) + 1, 2))] if count else []
    found, top = [], 1 << 31
    while len(found) < count:
        low = top - 65_536
        sieve = np.ones(65_536, bool)
        sieve[low % 2 :: 2] = False  # low is even
        for p in small:
            sieve[-low % p :: p] = False
        found += (low + np.flatnonzero(sieve)[::-1]).tolist()
        top = low
    return found[:count]


def primes_needed(matrix: list[list[int]]) -> int:
    """So many that their product exceeds every coefficient: the k-th is a sum of products of eigenvalues."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    bits = d * ((trace // d + 2).bit_length()) + 1
    return -(-bits // 30)


def polynomial_mod(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(xI - M) modulo p, highest power first."""
    d = len(matrix)
    h = np.array([[v % p for v in row] for row in matrix], np.int64)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        i, j = k + 1 + int(below[0]), k + 1
        if i != j:
            h[[i, j]] = h[[j, i]]
            h[:, [i, j]] = h[:, [j, i]]
        u = h[k + 2 :, k] * pow(int(h[j, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[j] % p) % p
        h[:, j] = (h[:, j] + (h[:, k + 2 :] * u % p).sum(axis=1)) % p
    # Row k: the polynomial of the leading k x k part, lowest power first.
    poly = np.zeros((d + 1, d + 1), np.int64)
    poly[0, 0] = 1
    for k in range(1, d + 1):
        poly[k, 1:] = poly[k - 1, :-1]
        along, weights = 1, np.zeros(k, np.int64)
        for i in range(k - 1, -1, -1):  # weights[i]: h[i, k-1] times the subdiagonal from i on
            weights[i] = int(h[i, k - 1]) * along % p
            along = along * int(h[i, i - 1]) % p if i else along
        poly[k] = (poly[k] - (weights[:, None] * poly[:k] % p).sum(axis=0)) % p
    return poly[d, ::-1].tolist()


def combined(remainders: list[tuple[int, list[int]]]) -> list[int]:
    """Coefficients from (prime, remainders): the k-th of a positive semidefinite matrix has the sign (-1)**k."""
    modulus = math.prod(p for p, _ in remainders)
    parts = [(modulus // p) * pow(modulus // p, -1, p) for p, _ in remainders]
    out = []
    for k in range(len(remainders[0][1])):
        value = sum(part * r[k] for part, (_, r) in zip(parts, remainders, strict=True)) % modulus
        out.append(value - modulus if k % 2 and value else value)
    return out


def _above(q: list[int], y: int) -> int:
    """Roots of q (highest power first, all real) above y, each as often as it counts."""
    c, d = list(q), len(q) - 1
    for i in range(d):
        for j in range(1, d + 1 - i):
            c[j] += y * c[j - 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs[:-1], signs[1:], strict=True))


def _value(q: list[int], y: int) -> int:
    v = 0
    for c in q:
        v = v * y + c
    return v


def rank(poly: list[int]) -> int:
    return max((k for k, c in enumerate(poly) if c), default=0)


def largest_roots(poly: list[int], most: int) -> tuple[int, list[tuple[int, int]]]:
    """A grid's fraction bits f, and (y, multiplicity) of the largest positive roots, falling:
    a root lies in ((y - 1) / 2**f, y / 2**f].  As many as count ``most`` together, or all."""
    most = min(most, rank(poly))
    if not most:
        return 0, []
    top = (-poly[1]).bit_length() + 1  # the trace bounds every root
    whole = list(poly[: rank(poly) + 1])  # without the roots at zero
    f = PRECISION
    while True:
        q = [c << (f * k) for k, c in enumerate(whole)]
        # The most-th root's size decides how fine the grid must be.
        lo, hi = -f, top
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if _above(q, 1 << (f + mid)) >= most else (lo, mid)
        if lo > -f or _above(q, 1) >= most:
            break
        f *= 2
    f = max(8, PRECISION - lo)
    q = [c << (f * k) for k, c in enumerate(whole)]
    found: list[tuple[int, int]] = []
    todo = [(0, 1 << (f + top), len(whole) - 1, 0)]  # low end, high end, roots above each
    held = 0
    while todo and held < most:
        lo, hi, n_lo, n_hi = todo.pop()
        if n_lo == n_hi:
            continue
        if n_lo - n_hi == 1 and (sign := _value(q, hi)):
            while hi - lo > 1:
                mid = (lo + hi) // 2
                v = _value(q, mid)
                if v == 0:
                    lo, hi = mid - 1, mid
                elif (v > 0) == (sign > 0):
                    hi = mid
                else:
                    lo = mid
        if hi - lo == 1:
            found.append((hi, n_lo - n_hi))
            held += n_lo - n_hi
            continue
        mid = (lo + hi) // 2
        n = _above(q, mid)
        todo += [(lo, mid, n_lo, n), (mid, hi, n, n_hi)]
    return f, found


def _fixed_div(a, b):
    return (a << FRACTION) // b


def _starts(d: int) -> Iterator[np.ndarray]:
    j = 1
    while True:
        yield np.array([(pow(7, i * j + j, 1_000_003) - 500_000) << (FRACTION - 20) for i in range(1, d + 1)], object)
        j += 1


def _unit(v: np.ndarray) -> np.ndarray:
    norm = math.isqrt(int((v * v).sum()))
    return np.array([_fixed_div(int(x), norm) for x in v], object)


def eigenvectors(matrix: list[list[int]], f: int, y: int, count: int) -> list[np.ndarray]:
    """``count`` orthogonal unit vectors for the root that ends at y / 2**f, as doubles; the largest entry is positive."""
    d = len(matrix)
    size = max(1, max(abs(v) for row in matrix for v in row).bit_length())
    a = np.array([[(v << FRACTION) >> size for v in row] for row in matrix], object)
    shift = ((2 * y - 1) << FRACTION) >> (f + 1 + size)  # the middle of its grid step
    for i in range(d):
        a[i, i] -= shift
    order = np.arange(d)
    tiny = 1 << (FRACTION // 8)
    for k in range(d):
        i = k + int(np.argmax(np.abs(a[k:, k])))
        if i != k:
            a[[i, k]] = a[[k, i]]
            order[[i, k]] = order[[k, i]]
        if abs(a[k, k]) < tiny:
            a[k, k] = tiny
        if k + 1 < d:
            factor = (a[k + 1 :, k] << FRACTION) // a[k, k]
            a[k + 1 :, k] = factor
            a[k + 1 :, k + 1 :] -= (factor[:, None] * a[k, k + 1 :]) >> FRACTION

    def solved(v: np.ndarray) -> np.ndarray:
        w = v[order]
        for k in range(1, d):
            w[k] -= int((a[k, :k] * w[:k]).sum()) >> FRACTION
        for k in range(d - 1, -1, -1):
            rest = int((a[k, k + 1 :] * w[k + 1 :]).sum()) >> FRACTION if k + 1 < d else 0
            w[k] = _fixed_div(int(w[k]) - rest, int(a[k, k]))
        return w

    basis: list[np.ndarray] = []
    for start in _starts(d):
        v = _unit(start)
        for _ in range(3):
            v = _unit(solved(v))
            for _ in range(2):
                for b in basis:
                    v = v - ((b * (int((b * v).sum()) >> FRACTION)) >> FRACTION)
            if int((v * v).sum()) >> FRACTION < 1 << (FRACTION // 2):
                break  # this start lies in what is found already
            v = _unit(v)
        else:
            basis.append(v)
        if len(basis) == count:
            break
    out = []
    for b in basis:
        x = np.array([float(int(v) / (1 << FRACTION)) for v in b])
        out.append(x if x[np.argmax(np.abs(x))] > 0 else -x)
    return out
