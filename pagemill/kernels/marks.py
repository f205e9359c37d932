"""Measures of marks: what the decision rules in operators.rules ask about each component or stroke of a page."""

from __future__ import annotations

import numpy as np

from pagemill.kernels import image as I
from pagemill.kernels import signal as S

#: Names of the measures of a component, in order.
MEASURES = ("width", "height", "area", "slope", "wave", "thickness", "below", "clear", "dark", "aspect", "around", "axes", "error", "covered", "centre", "gap", "last")


def _line_fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and root mean square distance of a straight fit."""
    if np.ptp(x) == 0:
        return 0.0, 0.0
    a, b = np.polyfit(x, y, 1)
    return float(a), float(np.sqrt(np.mean((y - a * x - b) ** 2)))


def _ellipse(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """Of an outline: axis ratio, mean error of the radius, share of 36 directions covered, and share of points near the centre."""
    cx, cy = x.mean(), y.mean()
    cov = np.cov(np.stack([x, y])) if len(x) > 2 else np.eye(2)
    values, axes = np.linalg.eigh(cov)
    values = np.maximum(values, 1e-9)
    u = np.stack([x - cx, y - cy], axis=1) @ axes / np.sqrt(2 * values)
    radius = np.hypot(u[:, 0], u[:, 1])
    angle = ((np.arctan2(u[:, 1], u[:, 0]) + np.pi) / (2 * np.pi) * 36).astype(int) % 36
    scale = np.sqrt(2 * values.mean())
    return float(np.sqrt(values[0] / values[1])), float(np.mean(np.abs(radius - 1)) * scale), len(np.unique(angle)) / 36, float((radius < 0.3).mean())


def measured(image: np.ndarray, ink: np.ndarray, spacing: float, stroke: float, colour: np.ndarray | None = None) -> list[dict]:
    """Every component with its measures. Sizes are in line spacings, thickness, wave and error in stroke widths,
    surroundings in squared stroke widths; dark is how far ink is from the paper's brightness, as a share. With the pixels'
    saturation, each has its own median saturation, and the page's ink's and paper's."""
    paper = float(np.percentile(image, 90))
    blackest = float(np.percentile(image[ink], 10)) if ink.any() else 0.0
    tints = {} if colour is None or not ink.any() else {"ink_saturation": float(np.median(colour[ink])), "paper_saturation": float(np.median(colour[~ink]))}
    lab, _ = I.labels(ink)
    right_of = np.array([row.nonzero()[0].max(initial=-1) for row in ink])
    out = []
    for c in I.components(ink):
        x0, y0, x1, y1 = c["x0"], c["y0"], c["x1"], c["y1"]
        own = lab[y0:y1, x0:x1] == c["label"]
        y, x = np.nonzero(own)
        w, h = x1 - x0, y1 - y0
        middle = np.array([np.mean(np.nonzero(col)[0]) for col in own.T])
        slope, wave = _line_fit(np.arange(w), middle)
        reach = max(1, int(round(0.3 * spacing)))
        around = ink[max(0, y0 - reach) : y1 + reach, max(0, x0 - reach) : x1 + reach].sum() - ink[y0:y1, x0:x1].sum()
        under = ink[y1 : y1 + max(1, int(0.5 * spacing)), x0:x1]
        side = max(1, int(0.2 * spacing))
        clear = not ink[y0:y1, max(0, x0 - side) : x0].any() and not ink[y0:y1, x1 : x1 + side].any()
        axes, error, covered, centre = _ellipse(x.astype(float), y.astype(float)) if len(x) > 4 else (0.0, np.inf, 0.0, 1.0)
        before = ink[y0:y1, :x0].any(axis=0).nonzero()[0]
        out.append(c | {
            "width": w / spacing, "height": h / spacing, "area": c["area"] / stroke**2, "slope": slope, "wave": wave / stroke,
            "thickness": float(own.sum(axis=0).mean()) / stroke, "below": float(under.mean()) if under.size else 0.0, "clear": clear,
            "dark": float((paper - image[y0:y1, x0:x1][own].mean()) / max(1.0, paper - blackest)), "aspect": w / h, "around": float(around) / stroke**2,
            "axes": axes, "error": error / stroke, "covered": covered, "centre": centre,
            "gap": (x0 - int(before.max()) - 1) / spacing if len(before) else np.inf, "last": bool((right_of[y0:y1] < x1).all()),
            **({"saturation": float(np.median(colour[y0:y1, x0:x1][own])), **tints} if tints else {}),
        })
    return out


def strokes(ink: np.ndarray, spacing: float, stroke: float) -> list[dict]:
    """Straight slanted strokes: components with their main direction, its scatter, length, and the free space on both sides."""
    out = []
    lab, _ = I.labels(ink)
    for c in I.components(ink):
        own = lab[c["y0"] : c["y1"], c["x0"] : c["x1"]] == c["label"]
        y, x = np.nonzero(own)
        if len(x) < 5:
            continue
        p = np.stack([x - x.mean(), y.mean() - y], axis=1)
        _, s, v = np.linalg.svd(p, full_matrices=False)
        angle = float(np.degrees(np.arctan2(v[0, 1], v[0, 0])) % 180)
        along = p @ v[0]
        left = ink[c["y0"] : c["y1"], max(0, c["x0"] - int(0.5 * spacing)) : c["x0"]]
        right = ink[c["y0"] : c["y1"], c["x1"] : c["x1"] + int(0.5 * spacing)]
        free = lambda m: float(1 - m.any(axis=1).mean()) if m.size else 1.0
        out.append(c | {
            "angle": angle, "rms": float(s[1] / np.sqrt(len(x))) / stroke, "length": float(np.ptp(along)) / spacing, "iso_left": free(left), "iso_right": free(right),
            "support": len(x) / max(1.0, np.ptp(along) * stroke),
        })
    return out


def brace_arms(ink: np.ndarray, spacing: float) -> list[dict]:
    """Parts that may be arms of a brace: high, narrow, without a loop."""
    out = []
    for c in I.components(ink):
        w, h = c["x1"] - c["x0"], c["y1"] - c["y0"]
        if h >= 0.4 * spacing and w <= 0.9 * spacing and h >= 1.3 * w and not loops(ink[c["y0"] : c["y1"], c["x0"] : c["x1"]]):
            out.append(c)
    return out


def loops(part: np.ndarray) -> bool:
    """Does paper inside a part not reach its border?"""
    _, n = I.labels(np.pad(~part, 1, constant_values=True))
    return n > 1


def linked_arms(arms: list[dict], spacing: float) -> list[list[dict]]:
    """Arms above each other put together: a gap between -0.15 and 0.6 line spacings, centres within 0.4."""
    rest, out = sorted(arms, key=lambda c: c["y0"]), []
    while rest:
        chain = [rest.pop(0)]
        for c in list(rest):
            gap, off = c["y0"] - chain[-1]["y1"], abs(c["cx"] - chain[-1]["cx"])
            if -0.15 * spacing <= gap <= 0.6 * spacing and off <= 0.4 * spacing:
                chain.append(c)
                rest.remove(c)
        out.append(chain)
    return out


def _brace(ink: np.ndarray, own: np.ndarray, box: tuple[int, int, int, int], arms: int, spacing: float, stroke: float) -> dict:
    """What the brace rule is asked about: own are the candidate's pixels within its box, ink the page's other ink."""
    x0, y0, x1, y1 = box
    rows = np.flatnonzero(own.any(axis=1))
    middle = np.array([np.mean(np.nonzero(own[r])[0]) for r in rows])
    slope, resid = _line_fit(rows, middle)
    side = max(1, int(0.6 * spacing))
    left, right = ink[y0:y1, max(0, x0 - side) : x0], ink[y0:y1, x1 : x1 + side]
    text = ink[y0:y1, max(0, x0 - int(6 * spacing)) : x0]
    free = lambda m: float(1 - m.any(axis=1).mean()) if m.size else 1.0
    cusp = int(rows[np.abs(middle - np.median(middle)).argmax()]) + y0
    return {
        "x0": x0, "y0": y0, "x1": x1, "y1": y1, "slope": slope, "resid": resid / stroke, "left_text": float(text.any(axis=1).mean()) if text.size else 0.0,
        "arms": arms, "height": (y1 - y0) / spacing, "iso_left": free(left), "iso_right": free(right), "cusp": cusp,
    }


def traced(ink: np.ndarray, spacing: float, least: float = 1.6, widest: float = 0.9) -> list[tuple[np.ndarray, tuple[int, int, int, int]]]:
    """Long strokes from top to bottom that touch words, so that they are no component of their own: (pixels, box) of each.

    A path opening keeps the ink that lies on a downward path of at least so
    many line spacings; what it keeps falls into strokes.
    """
    kept = I.path_length(ink.T).T >= least * spacing
    lab, _ = I.labels(kept)
    out = []
    for c in I.components(kept):
        if c["x1"] - c["x0"] <= widest * spacing and c["y1"] - c["y0"] >= least * spacing:
            box = c["x0"], c["y0"], c["x1"], c["y1"]
            out.append((lab[c["y0"] : c["y1"], c["x0"] : c["x1"]] == c["label"], box))
    return out


def braces(ink: np.ndarray, spacing: float, stroke: float) -> list[dict]:
    """Candidates for braces with the features of the brace rule: slope, resid (bend towards the cusp), left_text, arms, height,
    isolation, and whether they were stacked from parts or traced through other ink."""
    out, rest = [], ink.copy()
    for chain in linked_arms(brace_arms(ink, spacing), spacing):
        box = min(c["x0"] for c in chain), chain[0]["y0"], max(c["x1"] for c in chain), chain[-1]["y1"]
        out.append(_brace(ink, ink[box[1] : box[3], box[0] : box[2]], box, len(chain), spacing, stroke) | {"traced": 0})
        for c in chain:
            rest[c["y0"] : c["y1"], c["x0"] : c["x1"]] = False
    for own, box in traced(rest, spacing):
        others = ink.copy()
        others[box[1] : box[3], box[0] : box[2]] &= ~own
        out.append(_brace(others, own, box, 1, spacing, stroke) | {"traced": 1})
    return out


def page_marks(image: np.ndarray, colour: np.ndarray | None = None) -> dict:
    """Spacing, stroke width, ruled lines, components, strokes and brace candidates of a page. Ink of a ruled line is taken out before the rest is measured."""
    ink = I.binarised(image)
    spacing, stroke = S.line_pitch(ink), I.stroke_width(ink)
    rules = I.horizontal_rules(ink, spacing, stroke)
    rest = ink.copy()
    for r in rules:
        rest[r["y0"] : r["y1"], r["x0"] : r["x1"]] = False
    return {"spacing": spacing, "stroke": stroke, "rules": rules, "parts": measured(image, rest, spacing, stroke, colour), "strokes": strokes(rest, spacing, stroke), "braces": braces(rest, spacing, stroke)}
