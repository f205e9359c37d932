"""One-dimensional profiles."""

from __future__ import annotations

import numpy as np


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of the runs of true values."""
    step = np.diff(np.concatenate([[0], np.asarray(mask).astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


def merged(spans: list[tuple[int, int]], gap: float) -> list[tuple[int, int]]:
    """Spans put together where less than gap lies between them."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a - out[-1][1] < gap:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def gap_limit(spans: list[tuple[int, int]], width: float, factor: float = 1.8, share: float = 0.006, fixed: float | None = None) -> float:
    """The gap at which tokens part."""
    if fixed is not None:
        return fixed
    gaps = [b[0] - a[1] for a, b in zip(spans, spans[1:], strict=False)]
    return max(factor * float(np.median(gaps)), share * width) if gaps else float("inf")


def smoothed(x: np.ndarray, size: int) -> np.ndarray:
    """Mean over size places, the ends mirrored."""
    size = max(1, int(size))
    left = size // 2
    padded = np.pad(np.asarray(x, dtype=np.float64), (left, size - 1 - left), mode="symmetric")
    total = np.cumsum(np.concatenate([[0.0], padded]))
    return (total[size:] - total[:-size]) / size


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian average to four deviations, the ends mirrored."""
    reach = max(1, int(4 * sigma + 0.5))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(np.asarray(x, dtype=np.float64), reach, mode="symmetric")
    return np.convolve(padded, weights / weights.sum(), mode="valid")


def peaks(x: np.ndarray, distance: int = 1, prominence: float = 0.0, height: float | None = None) -> np.ndarray:
    """Local maxima (the middle of flat ones), the higher first to keep its distance, then those that stand out enough."""
    x = np.asarray(x, dtype=np.float64)
    found, i = [], 1
    while i < len(x) - 1:
        if x[i] > x[i - 1]:
            j = i
            while j + 1 < len(x) and x[j + 1] == x[i]:
                j += 1
            if j + 1 < len(x) and x[j + 1] < x[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    found = [p for p in found if height is None or x[p] >= height]
    keep = dict.fromkeys(found, True)
    for p in sorted(found, key=lambda p: (-x[p], -p)):
        if keep[p]:
            for q in found:
                if q != p and abs(q - p) < distance:
                    keep[q] = False
    return np.array([p for p in found if keep[p] and prominence_of(x, p) >= prominence], dtype=np.int64)


def prominence_of(x: np.ndarray, p: int) -> float:
    """A peak's height over the higher of the lowest places on the way to higher ground on either side."""
    higher = np.flatnonzero(x[:p] > x[p])
    left = x[(higher[-1] if len(higher) else 0) : p + 1].min()
    higher = np.flatnonzero(x[p + 1 :] > x[p])
    right = x[p : (p + 1 + higher[0] if len(higher) else len(x) - 1) + 1].min()
    return float(x[p] - max(left, right))


def resampled(x: np.ndarray, points: int) -> np.ndarray:
    """Rows interpolated linearly at even steps."""
    at = np.linspace(0, len(x) - 1, points)
    return np.stack([np.interp(at, np.arange(len(x)), x[:, k]) for k in range(x.shape[1])], axis=1)


def tracked(centres: list[float], share: float = 0.3) -> list[float]:
    """A centre that follows each new value by a share."""
    out: list[float] = []
    for c in centres:
        out.append(c if not out else (1 - share) * out[-1] + share * c)
    return out


def seam(cost: np.ndarray) -> np.ndarray:
    """The row of the cheapest path through each column, from left to right, by at most one row a step."""
    total = cost.astype(np.float64).copy()
    for j in range(1, cost.shape[1]):
        before = np.pad(total[:, j - 1], 1, constant_values=np.inf)
        total[:, j] += np.minimum(np.minimum(before[:-2], before[1:-1]), before[2:])
    path = [int(total[:, -1].argmin())]
    for j in range(cost.shape[1] - 2, -1, -1):
        low = max(0, path[-1] - 1)
        path.append(low + int(total[low : path[-1] + 2, j].argmin()))
    return np.array(path[::-1])


def line_pitch(ink: np.ndarray, least: int = 8, share: float = 0.12, default: float = 40.0) -> float:
    """Line spacing: the fundamental of the row profile's autocorrelation.

    The strongest peak may lie at two or three line spacings. So a peak near a
    third or a half of it (the third first) is taken if it is at least a quarter
    as strong.
    """
    profile = ink.sum(axis=1, dtype=np.float64)
    if not profile.any():
        return default
    most = max(least + 2, int(share * len(profile)))
    power = np.abs(np.fft.rfft(profile - profile.mean(), 2 * len(profile))) ** 2
    auto = np.fft.irfft(power)[: most + 2]
    at = peaks(auto)
    at = at[(at >= least) & (at <= most)]
    if not len(at):
        return default
    height = auto[at]
    best = at[height.argmax()]
    times = np.rint(best / at)  # how many spacings the strongest peak would be
    off = np.abs(at - best / times) / np.maximum(2, 0.15 * best / times)
    harmonic = np.isin(times, (2, 3)) & (off <= 1) & (height >= 0.25 * height.max())
    rank = np.lexsort((height, np.where(harmonic, times, 0)))  # by times, then by strength; the strongest peak itself if none is
    return float(at[rank[-1]] if harmonic.any() else best)


def log_otsu(values: np.ndarray, least: int = 15, apart: float = 1.8) -> float | None:
    """The threshold between two classes of positive values, in logarithms; None if they are few or near each other."""
    v = np.sort(np.asarray([x for x in values if x > 0], dtype=np.float64))
    if len(v) < least:
        return None
    log, best, cut = np.log(v), -1.0, None
    for k in range(1, len(v)):
        if v[k] == v[k - 1]:
            continue
        between = k * (len(v) - k) * (log[:k].mean() - log[k:].mean()) ** 2
        if round(between, 9) > best:
            best, cut = round(between, 9), k
    if cut is None or v[cut:].mean() < apart * v[:cut].mean():
        return None
    return float(np.exp((log[cut - 1] + log[cut]) / 2))
