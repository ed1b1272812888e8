"""The best of many scores, kept block by block in a task."""

from __future__ import annotations

import numpy as np

#: Scores are compared and given out rounded to so many places.
PLACES = 6
#: Scores in one block, about: 8 MB.
CELLS = 1 << 20


class Best:
    """The k best ids of each of n queries, by score rounded to six places, ties by the smaller id; NaN is above all numbers.

    Only scores that reach a query's k-th best so far are looked at, so a block costs one comparison a score.
    """

    def __init__(self, n: int, k: int):
        self.n, self.k, self.least = n, k, np.full(n, -np.inf)
        self.q, self.s, self.i = np.zeros(0, np.int64), np.zeros(0), None
        self.new, self.held = [], 0

    def add(self, scores: np.ndarray, ids: np.ndarray, first: int = 0, hit: np.ndarray | None = None) -> None:
        """scores: a row for each query from `first` on, a column for each of ids; hit: which of them count."""
        if np.isnan(scores).any():
            scores = np.where(np.isnan(scores), np.inf, scores)
        if hit is not None:
            scores = np.where(hit, scores, -np.inf)
        least = self.least[first : first + len(scores)]
        if scores.shape[1] > self.k and not np.isfinite(least).all():
            least = np.maximum(least, np.round(np.partition(scores, -self.k, axis=1)[:, -self.k], PLACES))
            self.least[first : first + len(scores)] = least
        over = (scores >= least[:, None] - 2 * 10.0**-PLACES) & (scores > -np.inf)
        q, at = np.nonzero(over)
        if len(q):
            self._hold(q + first, np.round(scores[q, at], PLACES) + 0.0, ids[at], not np.isfinite(least).all())

    def add_products(self, asked: np.ndarray, rows: np.ndarray, ids: np.ndarray, first: int = 0) -> None:
        """As add() of the products of unit vectors: asked has those of the queries from `first` on, rows those of ids.

        Products of single precision tell which pairs can be among the best, and only these are worked out in double precision.
        """
        least = self.least[first : first + len(asked)]
        if not np.isfinite(least).all():
            return self.add(asked @ rows.T, ids, first)
        gap = 2 * 10.0**-PLACES + (asked.shape[1] + 4) * 2.0**-23
        near = asked.astype(np.float32) @ rows.astype(np.float32).T
        q, at = np.divmod(np.flatnonzero(~(near < (least - gap).astype(np.float32)[:, None])), len(rows))
        for start in range(0, len(q), CELLS >> 4):
            some, of = q[start : start + (CELLS >> 4)], at[start : start + (CELLS >> 4)]
            s = np.round(np.einsum("ij,ij->i", asked[some], rows[of]), PLACES) + 0.0
            s[np.isnan(s)] = np.inf
            over = s >= self.least[some + first]
            self._hold(some[over] + first, s[over], ids[of[over]])

    def _hold(self, q: np.ndarray, s: np.ndarray, i: np.ndarray, cut: bool = False) -> None:
        self.new.append((q, s, i))
        self.held += len(q)
        if cut or self.held > 2 * self.n * self.k:
            self._cut()

    def _cut(self) -> None:
        if self.new:
            q, s, i = zip(*self.new, strict=True)
            self.q, self.s, self.i = np.concatenate([self.q, *q]), np.concatenate([self.s, *s]), np.concatenate(i if self.i is None else [self.i, *i])
            self.new = []
        by_id = np.unique(self.i, return_inverse=True)[1] if self.i.dtype == object else self.i
        order = np.lexsort((by_id, -self.s, self.q))
        q = self.q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order = order[place < self.k]
        self.q, self.s, self.i = self.q[order], self.s[order], self.i[order]
        self.held = len(order)
        last = place[place < self.k] == self.k - 1
        self.least[self.q[last]] = self.s[last]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, ids and scores, at most k of each query."""
        if self.new or self.i is not None:
            self._cut()
        return self.q, np.zeros(0, object) if self.i is None else self.i, np.where(np.isinf(self.s) & (self.s > 0), np.nan, self.s)


def blocks(n: int, columns: int) -> range:
    """Starts of blocks of n rows that have about CELLS cells each; the step is their size."""
    return range(0, n, max(1, min(n, CELLS // max(1, columns))))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows at unit length; those without length stay."""
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1)
