"""A photographed sheet: which way up, where its corners are, straight and evenly lit."""

from __future__ import annotations

import struct

import numpy as np

from pagemill.kernels import image as I


def orientation(raw: bytes) -> int:
    """The EXIF orientation of a JPEG file, 1 to 8; 1 if it says nothing.

    Segments are walked up to the first EXIF block, whose first directory is
    searched for tag 0x0112.
    """
    at = 2
    while raw[:2] == b"\xff\xd8" and at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] not in (0xD9, 0xDA):
        size = int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        if raw[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            return _tagged(body[6:])
        at += 2 + size
    return 1


def _tagged(tiff: bytes) -> int:
    mark = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if mark is None or len(tiff) < 8:
        return 1
    start = struct.unpack(mark + "I", tiff[4:8])[0]
    count = struct.unpack(mark + "H", tiff[start : start + 2])[0] if start + 2 <= len(tiff) else 0
    for entry in range(start + 2, min(start + 2 + 12 * count, len(tiff) - 11), 12):
        tag, value = struct.unpack(mark + "H", tiff[entry : entry + 2])[0], struct.unpack(mark + "H", tiff[entry + 8 : entry + 10])[0]
        if tag == 0x0112:
            return value if 1 <= value <= 8 else 1
    return 1


def upright(pixels: np.ndarray, turn: int) -> np.ndarray:
    """Pixels (rows, columns, ...) as an orientation says they should be seen: mirrored if it is even in pairs, then turned."""
    mirrored = turn in (2, 4, 5, 7)
    quarters = {1: 0, 2: 0, 3: 2, 4: 2, 5: 1, 6: 3, 7: 3, 8: 1}[turn]  # to the left
    return np.rot90(pixels[:, ::-1] if mirrored else pixels, quarters)


def corners(mask: np.ndarray) -> np.ndarray:
    """Corners of the largest region of a mask, clockwise from the upper left, as (x, y): the places furthest out along both diagonals."""
    lab, _ = I.labels(mask)
    found = I.components(mask)
    if not found:
        h, w = mask.shape
        return np.array([(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)], dtype=np.float64)
    y, x = np.nonzero(lab == max(found, key=lambda c: c["area"])["label"])
    down, up = x + y, x - y
    at = [down.argmin(), up.argmax(), down.argmax(), up.argmin()]
    return np.stack([x[at], y[at]], axis=1).astype(np.float64)


def straightened(image: np.ndarray, quad: np.ndarray, inset: float = 0.004) -> tuple[np.ndarray, np.ndarray]:
    """The sheet within four corners as an upright rectangle of its mean sides, less a thin margin, and the matrix from the
    rectangle's pixels to the photograph's."""
    side = lambda a, b: float(np.hypot(*(quad[a] - quad[b])))
    w, h = max(2, round((side(0, 1) + side(3, 2)) / 2)), max(2, round((side(0, 3) + side(1, 2)) / 2))
    dx, dy = inset * w, inset * h
    target = np.array([(-dx, -dy), (w - 1 + dx, -dy), (w - 1 + dx, h - 1 + dy), (-dx, h - 1 + dy)])
    matrix = I.homography(target, quad)
    return I.warped(image, matrix, h, w), matrix


def _widest(image: np.ndarray, size: int) -> np.ndarray:
    """The greatest value over size x size pixels."""
    half = size // 2
    for axis in (0, 1):
        pad = [(half, half) if a == axis else (0, 0) for a in (0, 1)]
        image = np.lib.stride_tricks.sliding_window_view(np.pad(image, pad, mode="edge"), 2 * half + 1, axis=axis).max(axis=-1)
    return image


def evened(image: np.ndarray, level: float = 0.93, shrink: int = 4) -> np.ndarray:
    """Even lighting: pixels over the bare paper around them, stretched so that paper is white and the darkest ink black.

    Bare paper is what is left when writing is closed over (the greatest, then
    the least value in a window) on a smaller copy, and blurred.
    """
    h, w = image.shape
    window = max(3, int(0.02 * max(h, w) / shrink) | 1)
    small = I.resized(image, max(1, h // shrink), max(1, w // shrink))
    paper = I.gaussian_blur(-_widest(-_widest(small, window), window), window / 2)
    flat = image / np.maximum(I.resized(paper, h, w), 1.0)
    black = float(np.percentile(flat, 0.2))
    return np.round(255 * np.clip((flat - black) / max(level - black, 1e-3), 0, 1))


def saturation(pixels: np.ndarray) -> np.ndarray:
    """Saturation of BGR pixels, 0 to 255: how far the least channel is below the greatest."""
    top, low = pixels.max(axis=-1).astype(np.float64), pixels.min(axis=-1)
    return 255 * (top - low) / np.maximum(top, 1)
