"""Similarity of blocks of candidates."""

from __future__ import annotations

import numpy as np


#: Pairs that are warped together: the costs and sums of one step stay in a core's cache.
TILE = (24, 256)
#: Squared distances below this share of the greatest squared lengths are formed from differences, not from products.
CLOSE = 1e-4
#: Candidates of a token whose scores are compared place by place, at most.
PLACES = 8


def dtw(x: np.ndarray, y: np.ndarray, band: float = 0.2) -> np.ndarray:
    """Banded dynamic time warping of all pairs of x (n, L, d) and y (m, L, d), over 2 L.

    Euclidean local costs; steps from the left, from below and diagonally; only
    cells within max(1, floor(band L)) of the diagonal; both ends are tied. The
    recurrence runs over cells, each step over a tile of pairs at once. Sums are
    kept for the cells of the band alone, by their distance from the diagonal, so
    a row takes the place of the one before it. Squared distances come from products of steps and squared lengths; where that would
    cancel digits they are formed again from differences, so equal steps are 0.
    """
    n, length, d = x.shape
    m = y.shape[0]
    reach, out = max(1, int(band * length)), np.empty((n, m))
    sx, sy = (x * x).sum(axis=-1), (y * y).sum(axis=-1)
    left = np.ascontiguousarray(np.concatenate([x, sx[..., None], np.ones((n, length, 1))], axis=2).transpose(1, 0, 2))
    right = np.ascontiguousarray(np.concatenate([-2 * y, np.ones((m, length, 1)), sy[..., None]], axis=2).transpose(1, 2, 0))
    close = CLOSE * (sx.max(initial=0.0) + sy.max(initial=0.0))
    whole = [np.empty((k, *TILE)) for k in (2 * reach + 2, 2 * reach + 1)]
    for a in range(0, n, TILE[0]):
        for b in range(0, m, TILE[1]):
            h, w = min(TILE[0], n - a), min(TILE[1], m - b)
            sums, costs = whole if (h, w) == TILE else [np.empty((len(r), h, w)) for r in whole]
            sums[:] = np.inf
            sums[reach] = 0.0
            for i in range(length):
                low, high = max(0, i - reach), min(length, i + reach + 1)
                cost = costs[: high - low]
                np.matmul(left[i, a : a + h], right[low:high, :, b : b + w], out=cost)
                if cost.min() < close:
                    at = np.flatnonzero(cost < close)
                    j, r, c = np.unravel_index(at, cost.shape)
                    cost.ravel()[at] = ((x[a + r, i] - y[b + c, low + j]) ** 2).sum(axis=-1)
                np.sqrt(cost, out=cost)
                for k in range(low - i + reach, high - i + reach):  # sums[k] is still that of the diagonal step, sums[k + 1] that from above
                    now = sums[k]
                    np.minimum(now, sums[k + 1], out=now)
                    if k:
                        np.minimum(now, sums[k - 1], out=now)
                    np.add(now, cost[k + i - reach - low], out=now)
            np.divide(sums[reach], 2 * length, out=out[a : a + h, b : b + w])
    return out


def dtw_rows(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, band: float = 0.2) -> np.ndarray:
    """dtw of the pairs (x[i], y[j]) alone, by their numbers."""
    length, room = x.shape[1], 1 << 13
    reach, out = max(1, int(band * length)), np.empty(len(i))
    for at in range(0, len(i), room):
        p, q = x[i[at : at + room]], y[j[at : at + room]]
        before = np.full((length + 1, len(p)), np.inf)
        before[0] = 0.0
        for r in range(length):
            now = np.full((length + 1, len(p)), np.inf)
            for c in range(max(0, r - reach), min(length, r + reach + 1)):
                now[c + 1] = np.sqrt(((p[:, r] - q[:, c]) ** 2).sum(axis=-1)) + np.minimum(np.minimum(before[c + 1], now[c]), before[c])
            before = now
            before[0] = np.inf
        out[at : at + room] = before[length] / (2 * length)
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of unit vectors, in double precision."""
    return a.astype(np.float64) @ b.astype(np.float64).T


def cosine_rows(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (a[i], b[j]) alone, of vectors of any length, each sum taken in the order of the numbers: equal vectors
    give equal bits. NaN if one has no length."""
    total, of_a, of_b = np.zeros(len(i)), np.zeros(len(a)), np.zeros(len(b))
    for k in range(a.shape[1]):
        total += a[i, k] * b[j, k]
        of_a += a[:, k] * a[:, k]
        of_b += b[:, k] * b[:, k]
    with np.errstate(invalid="ignore"):
        return np.clip(total / np.sqrt(of_a[i] * of_b[j]), -1.0, 1.0)


def best_by_token(score: np.ndarray, allowed: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a block's scores, rows and cols naming each candidate's token, ascending: for each pair of tokens the best
    score, the best allowed one (-inf if none) and where that is, the first in row order."""
    r, c = np.flatnonzero(np.diff(rows, prepend=rows[0] - 1)), np.flatnonzero(np.diff(cols, prepend=cols[0] - 1))
    best = lambda s: np.maximum.reduceat(np.maximum.reduceat(s, r, axis=0), c, axis=1)
    u = best(score)
    gated = np.where(allowed, score, -np.inf)
    t = best(gated)
    of_row, of_col = np.searchsorted(rows[r], rows), np.searchsorted(cols[c], cols)
    hit = (gated == t[of_row[:, None], of_col[None, :]]) & allowed
    i, j = np.nonzero(hit)
    flat = of_row[i] * len(c) + of_col[j]
    first = np.full(u.size, -1)
    first[flat[::-1]] = np.arange(len(i))[::-1]
    i, j = np.append(i, -1), np.append(j, -1)  # what -1 in first finds, also if no pair is allowed
    return rows[r], cols[c], u, t, i[first].reshape(u.shape), j[first].reshape(u.shape)


def best_of_tokens(score: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of rows and cols and the best score of best_by_token."""
    r, c = np.flatnonzero(np.diff(rows, prepend=rows[0] - 1)), np.flatnonzero(np.diff(cols, prepend=cols[0] - 1))
    return rows[r], cols[c], np.maximum.reduceat(np.maximum.reduceat(score, r, axis=0), c, axis=1)


def best_scores(score: np.ndarray, allowed: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of rows and cols, the best score and the best allowed one of best_by_token, without where that is."""
    r, c = np.flatnonzero(np.diff(rows, prepend=rows[0] - 1)), np.flatnonzero(np.diff(cols, prepend=cols[0] - 1))
    best = lambda s: run_maxima(run_maxima(s, r).T, c).T
    return rows[r], cols[c], best(score), best(np.where(allowed, score, -np.inf))


def run_maxima(s: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """np.maximum.reduceat(s, heads, axis=0) for ascending heads. Short runs are taken place by place, over all runs at once."""
    counts = np.diff(heads, append=len(s))
    if counts.max() > PLACES:
        return np.maximum.reduceat(s, heads, axis=0)
    out = s[heads]
    for k in range(1, counts.max()):
        longer = np.flatnonzero(counts > k)
        if len(longer) == len(heads):
            np.maximum(out, s[heads + k], out=out)
        else:
            out[longer] = np.maximum(out[longer], s[heads[longer] + k])
    return out


def greatest(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest values of each row, or all if there are no more, and their places: the first of equals, in any order."""
    k = min(k, v.shape[1])
    least = np.partition(v, v.shape[1] - k, axis=1)[:, v.shape[1] - k : v.shape[1] - k + 1]
    taken = v >= least
    many = np.flatnonzero(taken.sum(axis=1) > k)
    if len(many):
        equal, above = v[many] == least[many], v[many] > least[many]
        taken[many] = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    places = np.nonzero(taken)[1].reshape(len(v), k)
    return np.take_along_axis(v, places, axis=1), places


def fit_pca(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, k leading components and their sample variances."""
    mean = x.mean(axis=0)
    _, s, v = np.linalg.svd(x - mean, full_matrices=False)
    return mean, v[:k], s[:k] ** 2 / max(1, len(x) - 1)


def whitened(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, variances: np.ndarray, share: float = 0.1) -> np.ndarray:
    """Vectors along the axes over sqrt(variance + share of the mean variance), scaled to length 1."""
    y = (x - mean) @ axes.T / np.sqrt(variances + share * variances.mean())
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)


def chamfer(a: np.ndarray, b: np.ndarray) -> float:
    """Mean distance of each mask's points to the nearest point of the other, both ways."""
    p, q = np.argwhere(a), np.argwhere(b)
    if not len(p) or not len(q):
        return float("inf")
    d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=-1))
    return float((d.min(axis=1).mean() + d.min(axis=0).mean()) / 2)
