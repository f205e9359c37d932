"""Pixels of one page: ink, columns, lines, tokens, and the features of a word. Images are numpy arrays, grey from 0 (black) to 255."""

from __future__ import annotations

import heapq
import itertools
import struct
import zlib
from dataclasses import dataclass

import numpy as np

from pagemill.kernels import signal as S


@dataclass(frozen=True)
class Layout:
    """Settings of segmentation as shares of the page. Fixed values of the method."""

    margin: float = 0.015
    gutter: tuple[float, float] = (0.35, 0.65)
    column_smooth: float = 0.02
    line_smooth: float = 0.008
    line_gap: float = 0.018
    prominence: float = 0.08
    line_ink: float = 0.002
    gap_factor: float = 1.8
    token_width: float = 0.006


def grey(data: np.ndarray) -> np.ndarray:
    """Luminance of BGR pixels."""
    if data.ndim == 2:
        return data.astype(np.float64)
    return data[..., 0] * 0.114 + data[..., 1] * 0.587 + data[..., 2] * 0.299


def png(image: np.ndarray) -> bytes:
    """A grey image as a PNG file."""
    pixels = np.clip(np.round(image), 0, 255).astype(np.uint8)
    h, w = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((h, 1), dtype=np.uint8), pixels], axis=1)  # each line begins with its filter, none
    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def otsu(values: np.ndarray) -> int:
    """The grey level that divides values with the greatest between-class variance; the lower class includes it."""
    counts = np.bincount(np.clip(values, 0, 255).astype(np.int64).ravel(), minlength=256).astype(np.float64)
    n = np.cumsum(counts)
    total, s = n[-1], np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (s[-1] * n / total - s) ** 2 / (n * (total - n))
    return int(np.nan_to_num(between, nan=-1, posinf=-1).argmax())


def box_mean(image: np.ndarray, size: int) -> np.ndarray:
    """Mean over size x size pixels, the border mirrored."""
    half = size // 2
    p = np.pad(image.astype(np.float64), half, mode="symmetric")
    total = np.pad(p.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    h, w = image.shape
    size = 2 * half + 1
    return (total[size : size + h, size : size + w] - total[:h, size : size + w] - total[size : size + h, :w] + total[:h, :w]) / size**2


def gaussian_blur(image: np.ndarray, sigma: float) -> np.ndarray:
    rows = np.apply_along_axis(S.gaussian, 0, image.astype(np.float64), sigma)
    return np.apply_along_axis(S.gaussian, 1, rows, sigma)


def labels(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components: a label image, 0 for background, and how many. Runs of a row are joined with those of the row before."""
    out = np.zeros(mask.shape, dtype=np.int64)
    parent = [0]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    before: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        now = []
        k = 0
        for a, b in S.runs(row):
            mine = 0
            while k < len(before) and before[k][1] < a:
                k += 1
            j = k
            while j < len(before) and before[j][0] <= b:
                other = find(before[j][2])
                if mine:
                    low, high = sorted((find(mine), other))
                    parent[high] = low
                    mine = low
                else:
                    mine = other
                j += 1
            if not mine:
                mine = len(parent)
                parent.append(mine)
            out[y, a:b] = mine
            now.append((a, b, mine))
        before = now
    roots = np.array([find(i) for i in range(len(parent))])
    names, dense = np.unique(roots, return_inverse=True)
    return dense[out] if names[0] == 0 else out, len(names) - 1


def components(mask: np.ndarray) -> list[dict]:
    """Label, box, area and centre of each component."""
    lab, n = labels(mask)
    if not n:
        return []
    y, x = np.nonzero(lab)
    k = lab[y, x] - 1
    area = np.bincount(k, minlength=n)
    low = lambda v: np.array([v.max() if len(v) else 0] * n)
    x0, y0, x1, y1 = low(x), low(y), np.zeros(n, dtype=int), np.zeros(n, dtype=int)
    np.minimum.at(x0, k, x)
    np.minimum.at(y0, k, y)
    np.maximum.at(x1, k, x + 1)
    np.maximum.at(y1, k, y + 1)
    cx, cy = np.bincount(k, x, n) / area, np.bincount(k, y, n) / area
    return [{"label": i + 1, "x0": int(x0[i]), "y0": int(y0[i]), "x1": int(x1[i]), "y1": int(y1[i]), "area": int(area[i]), "cx": float(cx[i]), "cy": float(cy[i])} for i in range(n)]


def without_specks(ink: np.ndarray) -> np.ndarray:
    """Ink without components smaller than max(20, pixels / 2 000 000)."""
    lab, n = labels(ink)
    area = np.bincount(lab.ravel(), minlength=n + 1)
    keep = area >= max(20, ink.size / 2_000_000)
    keep[0] = False
    return keep[lab]


def binarised(image: np.ndarray, offset: float = 15) -> np.ndarray:
    """Ink: pixels darker than the Gaussian mean around them by an offset; the window follows the page's size."""
    block = max(31, int(min(image.shape) / 40) | 1)
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    return without_specks(image < gaussian_blur(image, sigma) - offset)


def page_box(image: np.ndarray, p: Layout = Layout()) -> tuple[int, int, int, int]:  # noqa: B008
    """The largest bright region, shrunk by the margin; the whole image if there is none."""
    bright = components(box_mean(image, 25) > otsu(image))
    h, w = image.shape
    b = max(bright, key=lambda c: c["area"]) if bright else {"x0": 0, "y0": 0, "x1": w, "y1": h}
    mx, my = int(p.margin * w), int(p.margin * h)
    return b["x0"] + mx, b["y0"] + my, b["x1"] - mx, b["y1"] - my


def columns(ink: np.ndarray, p: Layout = Layout()) -> list[tuple[int, int]]:  # noqa: B008
    """Two columns, divided at the emptiest place of the smoothed profile in the gutter band."""
    w = ink.shape[1]
    profile = S.smoothed(ink.sum(axis=0), max(1, int(p.column_smooth * w)))
    low, high = int(p.gutter[0] * w), int(p.gutter[1] * w)
    cut = low + int(profile[low:high].argmin())
    return [(0, cut), (cut, w)]


def text_lines(ink: np.ndarray, p: Layout = Layout(), height: int | None = None) -> list[tuple[int, int]]:  # noqa: B008
    """Line strips: peaks of the row profile, cut at the lowest place between two; nearly empty strips are left out."""
    height = height or ink.shape[0]
    profile = S.gaussian(ink.sum(axis=1), max(1.0, p.line_smooth * height))
    distance = max(1, int(p.line_gap * height))
    found = S.peaks(profile, distance, p.prominence * profile.max()) if profile.max() > 0 else []
    if not len(found):
        return []
    half = distance // 2
    cuts = [max(0, int(found[0]) - half - distance // 2)]
    cuts += [int(a) + int(profile[a:b].argmin()) for a, b in zip(found, found[1:], strict=False)]
    cuts.append(min(len(profile), int(found[-1]) + half + distance // 2 + 1))
    least = ink.shape[1] * height * p.line_ink * 0.1
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if ink[a:b].sum() > least]


def line_tokens(ink: np.ndarray, width: int, p: Layout = Layout()) -> list[tuple[int, int, int, int]]:  # noqa: B008
    """Token boxes of a line strip: runs of ink columns in its middle 70 %, merged over small gaps; rows from the whole strip."""
    h = ink.shape[0]
    spans = S.runs(ink[int(0.15 * h) : max(int(0.15 * h) + 1, int(0.85 * h))].any(axis=0))
    if not spans:
        return []
    limit = S.gap_limit(spans, width, p.gap_factor, p.token_width)
    out = []
    for a, b in S.merged(spans, limit):
        rows = np.flatnonzero(ink[:, a:b].any(axis=1))
        if b - a >= p.token_width * width and len(rows):
            out.append((a, int(rows[0]), b, int(rows[-1]) + 1))
    return out


def segmented(image: np.ndarray, p: Layout = Layout()) -> list[dict]:  # noqa: B008
    """All tokens of a page with their column, line and number from 1; lines without tokens don't count."""
    px0, py0, px1, py1 = page_box(image, p)
    ink = binarised(image)[py0:py1, px0:px1]
    out = []
    for c, (a, b) in enumerate(columns(ink, p), 1):
        number = 0
        for y0, y1 in text_lines(ink[:, a:b], p):
            found = line_tokens(ink[y0:y1, a:b], px1 - px0, p)
            number += bool(found)
            for t, (u, v, w, z) in enumerate(found, 1):
                box = (px0 + a + u, py0 + y0 + v, px0 + a + w, py0 + y0 + z)
                out.append({"column": c, "line": number, "token": t, "x0": box[0], "y0": box[1], "x1": box[2], "y1": box[3], "width": box[2] - box[0], "height": box[3] - box[1], "group": -1})
    return out


# --- candidates and features of a word ----------------------------------------------------------------------------------


def inner_cuts(crop_ink: np.ndarray, unit: float, least: float = 0.06) -> list[tuple[int, int]]:
    """(width, centre) of the white gaps between ink in the middle 60 % of a crop that are at least a share of the line pitch wide."""
    h = crop_ink.shape[0]
    spans = S.runs(crop_ink[int(0.2 * h) : max(int(0.2 * h) + 1, int(0.8 * h))].any(axis=0))
    gaps = [(left[1], right[0]) for left, right in itertools.pairwise(spans)]
    return [(b - a, (a + b) // 2) for a, b in gaps if b - a >= least * unit]


def word_pieces(width: int, cuts: list[tuple[int, int]], limit: float) -> list[tuple[int, int]]:
    """The span from 0 to width, cut wherever a piece is wider than the limit: the widest piece first, at its widest gap, the right one of equals."""
    borders, pieces = [0, width], [(-width, 0, width)]
    while pieces and -pieces[0][0] > limit:
        _, a, b = heapq.heappop(pieces)
        inside = [c for c in cuts if a < c[1] < b]
        if inside:
            at = max(inside)[1]
            borders.append(at)
            heapq.heappush(pieces, (a - at, a, at))
            heapq.heappush(pieces, (at - b, at, b))
    return list(itertools.pairwise(sorted(borders)))


def candidate_spans(width: int, cuts: list[tuple[int, int]], unit: float, least: float = 0.6, most: float = 4.0, edge: float = 1.0) -> list[tuple[int, int]]:
    """Distinct spans of a token whose widths, in line pitches, are within the band: its pieces, each also without a first or
    last part of up to an edge's width, so four of each at most."""
    out = []
    for a, b in word_pieces(width, cuts, most * unit):
        inner = sorted(c for _, c in cuts if a < c < b)
        firsts = [a, *[c for c in inner[:1] if c - a <= edge * unit]]
        lasts = [b, *[c for c in inner[-1:] if b - c <= edge * unit]]
        out += [span for span in itertools.product(firsts, lasts) if least * unit <= span[1] - span[0] <= most * unit]
    return list(dict.fromkeys(out))


def tight(crop: np.ndarray) -> np.ndarray:
    """The part of a crop that holds the ink reaching into its middle 40 %; what only touches the upper or lower edge belongs to other lines."""
    h = crop.shape[0]
    own = [c for c in components(crop <= otsu(crop)) if c["y1"] > int(0.3 * h) and c["y0"] < int(0.7 * h)]
    if not own:
        return crop
    return crop[min(c["y0"] for c in own) : max(c["y1"] for c in own), min(c["x0"] for c in own) : max(c["x1"] for c in own)]


def sheared(ink: np.ndarray, degrees: float) -> np.ndarray:
    """Rows moved sideways in proportion to their height over the last row, on a wider canvas."""
    h, w = ink.shape
    t = np.tan(np.radians(degrees))
    shift = np.round((h - 1 - np.arange(h)) * t).astype(int)
    shift -= shift.min()
    out = np.zeros((h, w + int(shift.max())), dtype=ink.dtype)
    for y in range(h):
        out[y, shift[y] : shift[y] + w] = ink[y]
    return out


def deslanted(ink: np.ndarray, most: int = 45, step: int = 3) -> np.ndarray:
    """The shear under which ink stands in the fewest columns: the greatest sum of squared column counts. Counts come from the
    places of the ink, without an image for each angle."""
    y, x = np.nonzero(ink)
    up = ink.shape[0] - 1 - y
    angles = np.arange(-most, most + 1, step)
    moved = [x + np.round(up * np.tan(np.radians(a))).astype(int) for a in angles]
    upright = [float((np.bincount(m - m.min()).astype(np.float64) ** 2).sum()) if len(m) else 0.0 for m in moved]
    return sheared(ink, int(angles[int(np.argmax(upright))]))


def x_height(ink: np.ndarray, share: float = 0.5) -> tuple[int, int]:
    """Rows of the x-height: of the runs of rows with at least a share of the greatest ink, the one that holds the peak."""
    profile = S.smoothed(ink.sum(axis=1), 3)
    peak = int(profile.argmax())
    return next((a, b) for a, b in S.runs(profile >= share * profile[peak]) if a <= peak < b)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear scaling."""
    h, w = image.shape
    y, x = (np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    im = image.astype(np.float64)
    return (im[y0][:, x0] * (1 - fy) + im[y1][:, x0] * fy) * (1 - fx) + (im[y0][:, x1] * (1 - fy) + im[y1][:, x1] * fy) * fx


def zoned(ink: np.ndarray, zones: tuple[int, int, int] = (24, 16, 24)) -> np.ndarray:
    """The x-height scaled to the middle zone; what is above and below is scaled alike and cut off at the zones' ends."""
    a, b = x_height(ink)
    scale = zones[1] / max(1, b - a)
    scaled = resized(ink, max(1, round(ink.shape[0] * scale)), max(1, round(ink.shape[1] * scale))) >= 0.5
    top = zones[0] - round(a * scale)
    out = np.zeros((sum(zones), scaled.shape[1]), dtype=bool)
    y0, y1 = max(0, top), min(len(out), top + len(scaled))
    out[y0:y1] = scaled[y0 - top : y1 - top]
    return out


def thinned(ink: np.ndarray) -> np.ndarray:
    """A one-pixel skeleton by two alternating passes (Zhang and Suen, 1984)."""
    im = np.pad(ink.astype(bool), 1)
    while True:
        changed = False
        for first in (True, False):
            n = [np.roll(np.roll(im, -dy, 0), -dx, 1) for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
            around = sum(x.astype(int) for x in n)
            turns = sum((~n[i] & n[(i + 1) % 8]).astype(int) for i in range(8))
            a = ~(n[0] & n[2] & n[4]) if first else ~(n[0] & n[2] & n[6])
            b = ~(n[2] & n[4] & n[6]) if first else ~(n[0] & n[4] & n[6])
            gone = im & (around >= 2) & (around <= 6) & (turns == 1) & a & b
            changed |= bool(gone.any())
            im = im & ~gone
        if not changed:
            return im[1:-1, 1:-1]


def dilated(ink: np.ndarray, size: int = 3) -> np.ndarray:
    half = size // 2
    p = np.pad(ink, half)
    h, w = ink.shape
    return np.logical_or.reduce([p[y : y + h, x : x + w] for y in range(size) for x in range(size)])


def normalised(crop: np.ndarray, pad: int = 2) -> np.ndarray:
    """A word's ink: deslanted, its x-height in the middle zone, one stroke width, no empty sides."""
    ink = crop <= otsu(crop)
    if not ink.any():
        return np.zeros((64, 2 * pad + 1), dtype=bool)
    word = dilated(thinned(zoned(deslanted(ink))))
    cols = np.flatnonzero(word.any(axis=0))
    word = word[:, cols[0] : cols[-1] + 1] if len(cols) else word[:, :1]
    return np.pad(word, ((0, 0), (pad, pad)))


def column_features(word: np.ndarray, points: int = 40, zones: tuple[int, int, int] = (24, 16, 24)) -> np.ndarray:
    """Of each column: upper and lower edge of its ink, ink, changes over 8, and ink in the middle zone, as shares; resampled.

    Edges of empty columns lie on the line between those of their neighbours, or halfway up if all are empty.
    """
    h, w = word.shape
    y, x = np.nonzero(word)
    edges = np.full((2, w), np.nan)
    np.fmin.at(edges[0], x, y / h)
    np.fmax.at(edges[1], x, y / h)
    inked = np.flatnonzero(~np.isnan(edges[0]))
    shape = [np.interp(np.arange(w), inked, e[inked]) if len(inked) else np.full(w, 0.5) for e in edges]
    steps = (word[1:] != word[:-1]).sum(axis=0) / 8
    middle = word[zones[0] : zones[0] + zones[1]].mean(axis=0)
    return S.resampled(np.column_stack([*shape, word.mean(axis=0), steps, middle]), points)


def hog(image: np.ndarray, orientations: int = 9, cell: int = 8, block: int = 2) -> np.ndarray:
    """Histograms of oriented gradients, blocks scaled by L2, cut at 0.2 and scaled again; (block rows, block columns, values)."""
    im = image.astype(np.float64)
    gy, gx = np.zeros_like(im), np.zeros_like(im)
    gy[1:-1], gx[:, 1:-1] = im[2:] - im[:-2], im[:, 2:] - im[:, :-2]
    size, angle = np.hypot(gx, gy), np.rad2deg(np.arctan2(gy, gx)) % 180
    rows, cols = im.shape[0] // cell, im.shape[1] // cell
    bins = np.minimum((angle / (180 / orientations)).astype(int), orientations - 1)[: rows * cell, : cols * cell]
    weight = size[: rows * cell, : cols * cell]
    at = (np.arange(rows * cell)[:, None] // cell * cols + np.arange(cols * cell)[None] // cell) * orientations + bins
    cells = np.bincount(at.ravel(), weight.ravel(), rows * cols * orientations).reshape(rows, cols, orientations) / cell**2
    out = np.stack([np.stack([cells[y : y + block, x : x + block].ravel() for x in range(cols - block + 1)]) for y in range(rows - block + 1)])
    norm = lambda v: v / np.sqrt((v**2).sum(axis=-1, keepdims=True) + 1e-10)
    return norm(np.minimum(norm(out), 0.2))


def hog_columns(word: np.ndarray, points: int = 32, least: int = 24) -> np.ndarray:
    """A normalised word of natural width as a sequence of its columns of HOG blocks, resampled; narrow words are padded evenly."""
    missing = max(0, least - word.shape[1])
    word = np.pad(word.astype(np.float64), ((0, 0), (missing // 2, missing - missing // 2)))
    blocks = hog(word)
    return S.resampled(np.moveaxis(blocks, 1, 0).reshape(blocks.shape[1], -1), points)


def word_features(crop: np.ndarray, width: int = 144, sequence: bool = False) -> tuple[np.ndarray, ...]:
    """HOG vector of the normalised word on a canvas, its 40 x 5 profile sequence, and, if asked for, its sequence of HOG columns."""
    word = normalised(tight(crop))
    canvas = gaussian_blur(resized(word.astype(np.float64), 64, width), 1.0)
    out = hog(canvas).ravel(), column_features(word)
    return (*out, hog_columns(word)) if sequence else out


# --- sheets ---------------------------------------------------------------------------------------------------------------


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix that takes four points to four others."""
    rows = []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
    return np.append(np.linalg.solve(np.array(rows, dtype=np.float64), np.asarray(target, dtype=np.float64).ravel()), 1).reshape(3, 3)


def warped(image: np.ndarray, matrix: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image seen through a matrix from target to source pixels, nearest pixel, white outside."""
    y, x = np.mgrid[:height, :width]
    p = matrix @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    u, v = np.round(p[0] / p[2]).astype(int), np.round(p[1] / p[2]).astype(int)
    fine = (u >= 0) & (v >= 0) & (u < image.shape[1]) & (v < image.shape[0])
    out = np.full(height * width, 255, dtype=np.float64)
    out[fine] = image[v[fine], u[fine]]
    return out.reshape(height, width)


def sheet_mask(image: np.ndarray, saturation: np.ndarray | None = None) -> np.ndarray:
    """Paper: brighter than the desk's 10th percentile plus 0.4 of the way to the paper's 70th, and not coloured."""
    desk, paper = np.percentile(image, 10), np.percentile(image, 70)
    mask = image > desk + 0.4 * (paper - desk)
    return mask if saturation is None else mask & (saturation < 120)


def robust(x: np.ndarray) -> np.ndarray:
    mid = np.median(x)
    return (x - mid) / (1.4826 * np.median(np.abs(x - mid)) + 1e-8)


def fold(image: np.ndarray, ink: np.ndarray, band: tuple[float, float] = (0.38, 0.62), least: float = 2.5) -> tuple[int, bool]:
    """Where a double page folds, and whether the score is good enough: a shadow on two scales, a step in brightness, little ink."""
    w = image.shape[1]
    light = np.median(image, axis=0)
    shadow = [robust(S.smoothed(light, max(3, int(s * w))) - S.smoothed(light, max(3, int(s * w / 4)))) for s in (0.04, 0.12)]
    step = robust(np.abs(np.gradient(S.smoothed(light, max(3, int(0.02 * w))))))
    score = np.maximum(np.maximum(*shadow), 0) + 0.5 * step + 0.7 * robust(-ink.sum(axis=0).astype(np.float64))
    low, high = int(band[0] * w), int(band[1] * w)
    at = low + int(score[low:high].argmax())
    return at, bool(score[at] >= least)


def split_sheet(image: np.ndarray, overlap: float = 0.01) -> list[tuple[str, int, int]]:
    """(side, x0, x1): L and R of a spread with an overlap, P of a single page."""
    h, w = image.shape
    if w <= 1.15 * h:
        return [("P", 0, w)]
    at, _ = fold(image, image <= otsu(image))
    extra = int(overlap * w)
    return [("L", 0, min(w, at + extra)), ("R", max(0, at - extra), w)]


def stroke_width(ink: np.ndarray, default: float = 3.0) -> float:
    """Twice the median distance to the paper along the skeleton."""
    if not ink.any():
        return default
    depth, left, d = np.zeros(ink.shape), ink.copy(), 0
    while left.any():
        d += 1
        depth[left] = d
        p = np.pad(left, 1)
        left = left & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    ridge = thinned(ink)
    return float(2 * np.median(depth[ridge]) - 1) if ridge.any() else default


def path_length(ink: np.ndarray) -> np.ndarray:
    """For each ink pixel, the longest left-to-right path of ink through it, one column a step and a row up or down at most."""
    def reach(m: np.ndarray) -> np.ndarray:
        out = np.zeros(m.shape, dtype=np.int64)
        for x in range(m.shape[1]):
            before = np.pad(out[:, x - 1], 1) if x else np.zeros(m.shape[0] + 2, dtype=np.int64)
            out[:, x] = m[:, x] * (1 + np.maximum(np.maximum(before[:-2], before[1:-1]), before[2:]))
        return out

    left, right = reach(ink), reach(ink[:, ::-1])[:, ::-1]
    return np.where(ink, left + right - 1, 0)


def horizontal_rules(ink: np.ndarray, spacing: float, stroke: float) -> list[dict]:
    """Ruled lines: components of long horizontal paths whose pixels lie near a quadratic fit."""
    out = []
    lab, _ = labels(path_length(ink) >= 5 * spacing)
    for c in components(lab > 0):
        y, x = np.nonzero((lab > 0)[c["y0"] : c["y1"], c["x0"] : c["x1"]])
        fit = np.polyval(np.polyfit(x, y, 2), x)
        near = np.abs(y - fit) <= 1.5 * stroke + 1
        if near.mean() >= 0.9:
            out.append(c | {"kind": "rule", "off": float(np.abs(y - fit)[near].max())})
    return out
