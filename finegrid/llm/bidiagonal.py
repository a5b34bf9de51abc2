"""Singular values and right singular vectors of a triangular factor: Householder bidiagonals, dqds, twisted factorisations.

Sizes are those of a vector's length, never of a table.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
#: Entries are scaled to at most 1; a diagonal below this is taken as this, far under the rounding of the factor itself.
TINY = 1e-40
#: Values closer than this, relative to themselves, count as a cluster and get a representation of their own.
CLOSE = 1e-3


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """``(diagonal, superdiagonal, right reflectors)`` of a square matrix; reflector ``k`` acts on the columns from ``k + 1`` on."""
    b = np.array(r, float)
    n = len(b)
    right = []
    for k in range(n):
        v = _reflector(b[k:, k])
        b[k:, k:] -= np.outer(v, 2 * (v @ b[k:, k:]))
        if k < n - 1:
            v = _reflector(b[k, k + 1:])
            b[k:, k + 1:] -= np.outer(2 * (b[k:, k + 1:] @ v), v)
            right.append(v)
    return np.diag(b).copy(), np.diag(b, 1).copy(), right


def _reflector(x: np.ndarray) -> np.ndarray:
    """Unit ``v`` (or zero) such that ``x - 2 v (v.x)`` has one entry only, the first."""
    v = x.copy()
    if not np.any(v[1:]):
        return np.zeros_like(v)
    v /= np.abs(v).max()
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    return v / np.linalg.norm(v)


def back(z: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """A vector of the bidiagonal matrix as one of the matrix that it was made from."""
    z = z.copy()
    for k in range(len(right) - 1, -1, -1):
        v = right[k]
        z[k + 1:] -= 2 * v * (v @ z[k + 1:])
    return z


# --- values -----------------------------------------------------------------------------------------------------------

def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential quotient-difference transform; None if the shift exceeds the least value."""
    n = len(q)
    out, off = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    least = d
    for i in range(n - 1):
        if d < 0:
            return None
        out[i] = d + e[i] or TINY * TINY
        t = q[i + 1] / out[i]
        off[i] = e[i] * t
        d = d * t - shift
        least = min(least, d)
    out[-1] = d
    return None if d < 0 else (out, off, least)


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squares of the singular values, falling, of the bidiagonal matrix with squared entries ``q`` (diagonal) and ``e``.

    Shifts come from the last two rows and are tried again smaller when they were too large; the sum of all shifts
    is carried apart from the values, so small ones stay accurate relative to themselves.
    """
    tol = (10 * EPS) ** 2
    found: list[float] = []
    waiting = [(list(map(float, q)), list(map(float, e)), 0.0)]
    while waiting:
        q_, e_, sigma = waiting.pop()
        if len(q_) > 1 and 1.5 * q_[0] < q_[-1]:
            q_, e_ = q_[::-1], e_[::-1]
        for _ in range(200 * len(q_) + 200):
            n = len(q_)
            if n == 1:
                found.append(q_[0] + sigma)
                break
            cut = next((i for i in range(n - 2, -1, -1) if e_[i] <= tol * (sigma + q_[i + 1]) or e_[i] <= TINY * TINY), None)
            if cut == n - 2:
                found.append(q_[-1] + sigma)
                q_, e_ = q_[:-1], e_[:-1]
                continue
            if cut is not None:
                waiting.append((q_[:cut + 1], e_[:cut], sigma))
                q_, e_ = q_[cut + 1:], e_[cut + 1:]
                continue
            low = max(0.0, np.sqrt(max(q_[-1], 0.0)) - 0.5 * np.sqrt(e_[-1])) ** 2
            for shift in (low, 0.75 * low, 0.25 * low, 0.0):
                step = _step(q_, e_, shift)
                if step is not None:
                    q_, e_, _ = step
                    sigma += shift
                    break
        else:
            raise RuntimeError("dqds did not settle")
    return np.sort(np.array(found))[::-1]


# --- vectors ----------------------------------------------------------------------------------------------------------

def _stationary(d: np.ndarray, l: np.ndarray, mu: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: E741
    """``L D L' - mu = L+ D+ L+'`` from the top: ``(D+, L+, s)``."""
    n = len(d)
    dp, lp, s = np.empty(n), np.empty(n - 1), np.empty(n)
    now = -mu
    for i in range(n):
        s[i] = now
        dp[i] = now + d[i] or EPS * EPS * TINY
        if i < n - 1:
            lp[i] = d[i] * l[i] / dp[i]
            now = lp[i] * l[i] * now - mu
    return dp, lp, s


def _progressive(d: np.ndarray, l: np.ndarray, mu: float) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """``L D L' - mu = U- D- U-'`` from the bottom: ``(U-, p)``."""
    n = len(d)
    um, p = np.empty(n - 1), np.empty(n)
    p[-1] = d[-1] - mu
    for i in range(n - 2, -1, -1):
        below = d[i] * l[i] * l[i] + p[i + 1] or EPS * EPS * TINY
        t = d[i] / below
        um[i] = l[i] * t
        p[i] = p[i + 1] * t - mu
    return um, p


def twisted(d: np.ndarray, l: np.ndarray, mu: float, taken: list[np.ndarray] = []) -> tuple[np.ndarray, float]:  # noqa: B006, E741
    """Unit vector and correction of ``mu`` from the twist with the least pivot; among ``taken`` vectors, a twist that leads away from them."""
    _, lp, s = _stationary(d, l, mu)
    um, p = _progressive(d, l, mu)
    pivots = s + p + mu
    order = np.argsort(np.abs(pivots), kind="stable")
    best = None
    for r in map(int, order[:1 if not taken else 8 + 4 * len(taken)]):
        z = np.zeros(len(d))
        z[r] = 1.0
        for i in range(r - 1, -1, -1):
            z[i] = -lp[i] * z[i + 1]
        for i in range(r, len(d) - 1):
            z[i + 1] = -um[i] * z[i]
        size = np.linalg.norm(z)
        correction, z = float(pivots[r]) / size ** 2, z / size
        for _ in range(2):
            for v in taken:
                z = z - v * (v @ z)
        left = np.linalg.norm(z)
        if best is None or left > 2 * best[2]:
            best = z / (left or 1.0), correction, left
    return best[0], best[1]


def _below(d: np.ndarray, l: np.ndarray, mu: float) -> int:  # noqa: E741
    """Number of values under ``mu``."""
    return int((_stationary(d, l, mu)[0] < 0).sum())


def _bisect(d: np.ndarray, l: np.ndarray, k: int, low: float, high: float) -> float:  # noqa: E741
    """The value with ``k`` values below it."""
    width = max(high - low, EPS * max(abs(low), abs(high)), TINY)
    while _below(d, l, low) > k:
        low, width = low - width, 2 * width
    while _below(d, l, high) <= k:
        high, width = high + width, 2 * width
    for _ in range(200):
        mid = 0.5 * (low + high)
        if high - low <= 2 * EPS * min(abs(low), abs(high)) or mid in (low, high):
            break
        low, high = (low, mid) if _below(d, l, mid) > k else (mid, high)
    return 0.5 * (low + high)


def vectors(d: np.ndarray, l: np.ndarray, values: np.ndarray, first: int, depth: int = 0) -> list[np.ndarray]:  # noqa: E741
    """Unit vectors of ``L D L'`` for its falling ``values``, value ``i`` being number ``first + i`` from the top.

    A value by itself takes a twisted factorisation and its correction; values close to each other are seen from a
    shift right beside them, where they lie apart.  What no shift can part is equal to working precision, and gets
    orthogonal vectors.
    """
    n, out, i = len(d), [], 0
    while i < len(values):
        j = i + 1
        while j < len(values) and values[j - 1] - values[j] < CLOSE * max(abs(values[j - 1]), abs(values[j])):
            j += 1
        group = values[i:j]
        if len(group) == 1:
            z, more = twisted(d, l, group[0])
            for _ in range(3):
                if abs(more) <= 4 * EPS * abs(group[0]):
                    break
                z, more = twisted(d, l, group[0] + more)
            out.append(z)
        elif depth < 8 and group[0] - group[-1] > 64 * EPS * abs(group[0]):
            beside = group[0] + max(group[0] - group[-1], 16 * EPS * abs(group[0])) / 8
            dp, lp, _ = _stationary(d, l, beside)
            near = [_bisect(dp, lp, n - 1 - (first + i + k), v - beside - 4 * EPS * abs(v), v - beside + 4 * EPS * abs(v)) for k, v in enumerate(group)]
            out.extend(vectors(dp, lp, np.array(near), first + i, depth + 1))
        else:
            mine: list[np.ndarray] = []
            for v in group:
                mine.append(twisted(d, l, v, mine)[0])
            out.extend(mine)
        i = j
    return out


def right_singular(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(squares, vectors)``: the ``k`` largest squared singular values of a square matrix, falling, and a row per right singular vector."""
    n = len(r)
    scale = float(np.abs(r).max(initial=0.0))
    if not scale:
        return np.zeros(min(k, n)), np.eye(n)[:k]
    a, b, right = bidiagonal(r / scale)
    a = np.where(np.abs(a) < np.sqrt(TINY), np.sqrt(TINY), a)
    b[np.abs(b) <= 4 * EPS * (np.abs(a[:-1]) + np.abs(a[1:]))] = 0.0  # below the rounding of the reflectors
    ends = [0, *(np.flatnonzero(b == 0) + 1).tolist(), n]
    found = [(float(v), lo, hi, i) for lo, hi in zip(ends, ends[1:]) for i, v in enumerate(dqds(a[lo:hi] ** 2, b[lo:hi - 1] ** 2))]
    chosen = sorted(found, key=lambda f: (-f[0], f[1], f[3]))[:k]
    rows = np.zeros((len(chosen), n))
    for lo, hi in zip(ends, ends[1:]):
        mine = [c for c, f in enumerate(chosen) if f[1] == lo]
        if mine:
            z = vectors(a[lo:hi] ** 2, b[lo:hi - 1] / a[lo:hi - 1], np.array([chosen[c][0] for c in mine]), 0)
            rows[mine, lo:hi] = z
    return np.array([f[0] for f in chosen]) * scale ** 2, np.array([back(row, right) for row in rows])
