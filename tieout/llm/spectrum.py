"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The inertia of A - s I, read off a pivoted LDL' factorisation, says how many
eigenvalues lie above s. Bisection on these counts isolates each leading
eigenvalue in an interval of its own; Rayleigh quotient iteration converges
there cubically; counts on both sides of the result certify its number.
Eigenvalues that no interval can tell apart form a cluster, whose vectors are
kept orthogonal to one another.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
#: Pivot rule: a diagonal pivot at least this share of the largest entry left (fixed value of the factorisation).
_ALPHA = (1 + 17**0.5) / 8


def above(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of ``a`` above ``shift``: positive pivots of P(A - sI)P' = LDL',
    D with blocks of one and two. A block of two has one eigenvalue of each sign."""
    m = a - shift * np.eye(len(a))
    tiny = EPS * max(float(np.abs(a).max(initial=0)), abs(shift), np.finfo(np.float64).tiny)
    count = 0
    while len(m):
        size = np.abs(m)
        p = int(np.argmax(size.diagonal()))
        top = int(np.argmax(size))
        i, j = divmod(top, len(m))
        if size[p, p] >= _ALPHA * size[i, j]:
            pivot = m[p, p] if abs(m[p, p]) > tiny else -tiny  # an eigenvalue at the shift is not above it
            count += pivot > 0
            rest = np.delete(np.arange(len(m)), p)
            column = m[rest, p]
            m = m[np.ix_(rest, rest)] - np.outer(column, column / pivot)
        else:
            pair = [i, j]
            count += 1
            rest = np.delete(np.arange(len(m)), pair)
            columns = m[np.ix_(rest, pair)]
            m = m[np.ix_(rest, rest)] - columns @ np.linalg.solve(m[np.ix_(pair, pair)], columns.T)
        m = (m + m.T) / 2
    return count


class _Slices:
    """Counts at the shifts tried so far, and the bracket of each eigenvalue number they give."""

    def __init__(self, a: np.ndarray):
        self.a = a
        radius = float(np.abs(a).sum(axis=1).max(initial=0)) or 1.0
        self.width = 8 * EPS * radius * len(a)
        self.counts = {-radius - self.width: len(a), radius + self.width: 0}

    def at(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = above(self.a, shift)
        return self.counts[shift]

    def bracket(self, k: int) -> tuple[float, float]:
        """The tightest (low, high) known to hold eigenvalue k: at least k above low, fewer above high."""
        return max(s for s, n in self.counts.items() if n >= k), min(s for s, n in self.counts.items() if n < k)

    def isolate(self, k: int, halvings: int) -> tuple[float, float, bool]:
        """Bracket of eigenvalue k, bisected until it holds no other (True) or is
        as narrow as rounding allows (False), and then ``halvings`` times more."""
        while True:
            low, high = self.bracket(k)
            alone = self.at(low) == k and self.at(high) == k - 1
            if high - low <= self.width or (alone and halvings <= 0):
                return low, high, alone
            halvings -= alone
            self.at((low + high) / 2)


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns
    (all, if there are fewer). Fails if the counts do not certify a number."""
    n = len(a)
    slices, values, vectors = _Slices(a), [], np.zeros((n, 0))
    start = np.cos(np.arange(1, n + 1) * 1.7) + 0.3
    for number in range(1, min(k, n) + 1):
        halvings = 2
        while True:
            low, high, alone = slices.isolate(number, halvings)
            value, vector = _refine(a, (low + high) / 2, start, vectors, slices.width)
            slack = max(slices.width, 4 * float(np.linalg.norm(a @ vector - value * vector)))
            if low - slack <= value <= high + slack and slices.at(value - slack) >= number > slices.at(value + slack):
                break
            if high - low <= slices.width:
                raise ArithmeticError(f"eigenvalue {number} is not certified")
            halvings += 4
        values.append(value)
        vectors = np.column_stack([vectors, vector])
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], vectors[:, order]


def _refine(a: np.ndarray, shift: float, start: np.ndarray, found: np.ndarray, width: float) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from the middle of a bracket, orthogonal to the vectors found before."""
    n = len(a)

    def clean(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - found @ (found.T @ v)
        return v / np.linalg.norm(v)

    v = clean(start)
    for step in range(40):
        # two steps of inverse iteration at the bracket's middle, then the quotient itself
        at = shift if step < 2 else value  # noqa: F821
        try:
            w = np.linalg.solve(a - at * np.eye(n), v)
        except np.linalg.LinAlgError:
            w = np.linalg.solve(a - (at + width) * np.eye(n), v)
        if not np.isfinite(w).all():
            w = np.linalg.solve(a - (at + width) * np.eye(n), v)
        v = clean(w)
        value = float(v @ a @ v)
        if step > 1 and np.linalg.norm(a @ v - value * v) <= width / 4:
            break
    return value, v
