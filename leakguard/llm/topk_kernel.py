"""Exact inner products of integer vectors with pruning by residual norms (in tasks)."""

from __future__ import annotations

import numpy as np

SCALE = 1024
# Below this, products of int64 vectors cannot overflow (Cauchy-Schwarz).
_SAFE_NORM = 2.0**31
_LIMIT = (1 << 63) - 1


def integers(vectors: list) -> np.ndarray:
    """floor(1024 * x) of equally long vectors; Python integers where int64 is too small."""
    raw = np.asarray(vectors, np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(raw * SCALE)
        norms = np.sqrt((scaled * scaled).sum(axis=1))
    if scaled.size and not norms.max() < _SAFE_NORM:
        whole = [[int(s) if abs(s) < np.inf else int(x) * SCALE for s, x in zip(*rows)] for rows in zip(scaled, raw)]
        return np.array(whole, object).reshape(raw.shape)
    return scaled.astype(np.int64)


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row inner products, held at the limits of a long."""
    if left.dtype == object or right.dtype == object:
        exact = (left.astype(object) * right.astype(object)).sum(axis=1)
        return np.array([max(-_LIMIT - 1, min(_LIMIT, int(x))) for x in exact], np.int64)
    return np.einsum("ij,ij->i", left, right)


class Best:
    """The highest ``k`` scores of each query so far, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = [np.zeros(0, np.int64)] * queries
        self.ids = [np.zeros(0, np.int64)] * queries
        self.floor = np.full(queries, -np.inf)  # a lower score cannot enter

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[query], scores]), np.concatenate([self.ids[query], ids])
        order = np.lexsort((ids, ~scores))[: self.k]
        self.scores[query], self.ids[query] = scores[order], ids[order]
        if len(order) == self.k:
            self.floor[query] = float(scores[order[-1]])


class Side:
    """Vectors with their rotation and the norms of what follows each cut."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, cuts: list[int]):
        self.ids, self.vectors = ids, vectors
        plain = vectors.astype(np.float64)
        with np.errstate(all="ignore"):
            self.turned = plain @ rotation
        square = self.turned**2
        self.norm = np.sqrt(square.sum(axis=1))
        self.rest = [np.sqrt(square[:, c:].sum(axis=1)) for c in cuts]


def search(queries: Side, block: Side, best: Best, cuts: list[int]) -> None:
    """Add what a block of vectors, longest first, has for the queries.

    A query is done with the block once its floor is above |q| |v| of the longest
    vector.  The others get partial sums over the leading rotated components; a
    candidate stays while the partial sum plus the product of the residual norms can
    reach the floor.  Only candidates that pass all cuts are multiplied exactly.
    """
    slack = 1e-9  # relative to |q| |v|: more than float64 sums of any length here lose
    longest = block.norm.max(initial=0.0)
    # "not below" instead of "at least": sums too large for a float are not dropped
    for q in np.flatnonzero(~(queries.norm * longest * (1 + slack) + 1 < best.floor)):
        bound = queries.norm[q] * block.norm
        at = np.flatnonzero(~(bound * (1 + slack) + 1 < best.floor[q]))
        partial, begin = np.zeros(len(at)), 0
        for i, cut in enumerate(cuts):
            partial = partial + block.turned[at, begin:cut] @ queries.turned[q, begin:cut]
            reach = partial + queries.rest[i][q] * block.rest[i][at] + slack * bound[at] + 1
            stay = ~(reach < best.floor[q])
            at, partial, begin = at[stay], partial[stay], cut
        at = at[block.ids[at] != queries.ids[q]]
        if len(at):
            left = np.broadcast_to(queries.vectors[q], (len(at), queries.vectors.shape[1]))
            best.add(q, exact_scores(left, block.vectors[at]), block.ids[at])
