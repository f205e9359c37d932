"""Outlines of text lines: baselines, seams between lines, polygons and the words within."""

from __future__ import annotations

import numpy as np

from pagemill.kernels import image as I
from pagemill.kernels import signal as S


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """A polyline without the points that lie within a tolerance of the rest (Douglas and Peucker, 1973)."""
    points = np.asarray(points, dtype=np.float64)
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = points[b] - points[a]
        rel = points[a + 1 : b] - points[a]
        length = np.hypot(*d)
        off = np.abs(d[0] * rel[:, 1] - d[1] * rel[:, 0]) / length if length else np.hypot(rel[:, 0], rel[:, 1])
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def baseline(ink: np.ndarray, y0: int, y1: int) -> tuple[float, float]:
    """Slope and height at x = 0 of a line through the lowest ink of most columns, strays left out once."""
    strip = ink[y0:y1]
    x = np.flatnonzero(strip.any(axis=0))
    if len(x) < 2:
        return 0.0, float(y1)
    y = y0 + strip.shape[0] - 1 - strip[::-1, x].argmax(axis=0)
    a, b = np.polyfit(x, y, 1)
    off = np.abs(y - a * x - b)
    fine = off <= max(2.0, 2 * np.median(off))
    a, b = np.polyfit(x[fine], y[fine], 1) if fine.sum() > 1 else (a, b)
    return float(a), float(b)


def seams(image_ink: np.ndarray, strips: list[tuple[int, int]]) -> list[np.ndarray]:
    """Between each two line strips, the row for each column where a cut costs least ink."""
    out = []
    for (a0, a1), (b0, b1) in zip(strips, strips[1:], strict=False):
        low, high = (a0 + a1) // 2, (b0 + b1) // 2 + 1
        cost = I.box_mean(image_ink[low:high].astype(np.float64), 5) + 1e-3
        out.append(low + S.seam(cost))
    return out


def line_polygons(ink: np.ndarray, strips: list[tuple[int, int]], tolerance: float = 2.0) -> list[dict]:
    """Polygon and baseline of each line, bounded by the seams above and below it."""
    h, w = ink.shape
    cuts = [np.full(w, max(0, strips[0][0])), *seams(ink, strips), np.full(w, min(h, strips[-1][1]))] if strips else []
    x = np.arange(w)
    out = []
    for i, (y0, y1) in enumerate(strips):
        top = simplified(np.stack([x, cuts[i]], axis=1), tolerance)
        bottom = simplified(np.stack([x, cuts[i + 1]], axis=1), tolerance)
        a, b = baseline(ink, y0, y1)
        out.append({"id": f"l{i + 1:03d}", "polygon": np.concatenate([top, bottom[::-1]]).tolist(), "baseline": [[0.0, b], [float(w - 1), a * (w - 1) + b]]})
    return out


def inside(polygon: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points lie in a polygon, by crossings."""
    p = np.asarray(polygon, dtype=np.float64)
    q = np.roll(p, -1, axis=0)
    hit = np.zeros(np.shape(x), dtype=bool)
    for (ax, ay), (bx, by) in zip(p, q, strict=True):
        if ay != by:
            across = (ay > y) != (by > y)
            hit ^= across & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return hit


def nearest_polygon(polygons: list[np.ndarray], x: float, y: float, reach: float = 8.0) -> int | None:
    """The polygon that holds a point, else the one with the nearest edge within reach."""
    best = None
    for i, polygon in enumerate(polygons):
        p = np.asarray(polygon, dtype=np.float64)
        if inside(p, np.array(x), np.array(y)):
            return i
        q = np.roll(p, -1, axis=0)
        d, r = q - p, np.array([x, y]) - p
        t = np.clip((d * r).sum(axis=1) / np.maximum((d * d).sum(axis=1), 1e-12), 0, 1)
        off = float(np.hypot(*(r - t[:, None] * d).T).min())
        if off <= reach and (best is None or off < best[0]):
            best = (off, i)
    return best[1] if best else None


def line_words(ink: np.ndarray, polygon: np.ndarray, x_height: float) -> list[tuple[int, int]]:
    """Spans of words in a line: gaps of ink columns in its polygon, divided into narrow and wide ones, or at one x-height if they don't divide."""
    p = np.asarray(polygon)
    x0, y0, x1, y1 = int(p[:, 0].min()), int(p[:, 1].min()), int(p[:, 0].max()) + 1, int(p[:, 1].max()) + 1
    y, x = np.mgrid[y0:y1, x0:x1]
    spans = S.runs((ink[y0:y1, x0:x1] & inside(p, x, y)).any(axis=0))
    gaps = [b[0] - a[1] for a, b in zip(spans, spans[1:], strict=False)]
    cut = S.log_otsu(np.array(gaps) / x_height)
    limit = (cut if cut is not None else 1.0) * x_height
    return [(x0 + a, x0 + b) for a, b in S.merged(spans, limit)]


def brackets(ink: np.ndarray, pitch: float, char_height: float) -> list[dict]:
    """High, narrow parts right of the left quarter with ink on their left and room for a label on their right."""
    w, out = ink.shape[1], []
    for c in I.components(ink):
        high, wide = c["y1"] - c["y0"], c["x1"] - c["x0"]
        if high < 1.9 * pitch or high < 3 * wide or c["x0"] < w / 4 or w - c["x1"] < pitch:
            continue
        left = ink[c["y0"] : c["y1"], max(0, c["x0"] - int(4 * pitch)) : c["x0"]]
        if left.sum() > 5 * char_height**2:
            out.append(c)
    return out


def bracket_members(lines: list[tuple[int, int, int]], bracket: dict, margin: float, share: float = 0.35) -> list[int]:
    """Lines (x0, y0, y1) within a bracket's height that start within a share of the way from the margin to it."""
    limit = margin + share * (bracket["x0"] - margin)
    return [i for i, (x0, y0, y1) in enumerate(lines) if x0 <= limit and bracket["y0"] <= (y0 + y1) / 2 <= bracket["y1"]]
