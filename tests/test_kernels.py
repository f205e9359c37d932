"""Array kernels on inputs whose results are known by hand."""

import time
import tracemalloc

import numpy as np
import pytest

from pagemill.kernels import image as I
from pagemill.kernels import pairs as K
from pagemill.kernels import signal as S


def test_runs_and_gaps():
    row = np.array([int(c) for c in "0011011100000110"])
    assert S.runs(row) == [(2, 4), (5, 8), (13, 15)]
    assert S.merged(S.runs(row), 2) == [(2, 8), (13, 15)]
    spans = [(0, 10), (12, 20), (23, 30), (32, 40), (60, 70)]
    assert S.gap_limit(spans, 1000) == 6
    assert S.gap_limit([(0, 5)], 1000) == float("inf")
    assert len(S.merged(spans, 6)) == 2


def test_dtw_in_tiles(monkeypatch):
    """Pairs in tiles of any shape are as pairs alone, equal sequences are at 0 whatever their length, and no plane of all pairs is held."""
    rng = np.random.default_rng(3)
    x, y = 1e3 + rng.normal(size=(37, 9, 2)), 1e3 + rng.normal(size=(23, 9, 2))
    y[:4] = x[:4]
    i, j = np.divmod(np.arange(37 * 23), 23)
    want = K.dtw_rows(x, y, i, j).reshape(37, 23)
    for tile in ((32, 256), (8, 5), (37, 23)):
        monkeypatch.setattr(K, "TILE", tile)
        got = K.dtw(x, y)
        assert np.abs(got - want).max() < 1e-12 and not got[range(4), range(4)].any()
    monkeypatch.undo()
    x = rng.normal(size=(512, 16, 2))
    tracemalloc.start()
    K.dtw(x, x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20  # the result has 2 MB; all pairs' sums would have 70


def test_dtw_keeps_sums_of_the_band_alone():
    """Long sequences take no more room than their band: a plane of sums for each of its cells, not for each step."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(20, 100, 2)), rng.normal(size=(30, 100, 2))
    i, j = np.divmod(np.arange(20 * 30), 30)
    for band in (0.0, 0.03, 0.5, 1.0):
        assert np.abs(K.dtw(x, y, band).ravel() - K.dtw_rows(x, y, i, j, band)).max() < 1e-12
    tracemalloc.start()
    K.dtw(x, y, 0.03)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20  # planes of 100 steps would have 13 MB


def test_dtw():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(5, 12, 3)), rng.normal(size=(4, 12, 3))
    d = K.dtw(x, y)
    assert np.allclose(np.diag(K.dtw(x, x)), 0) and np.allclose(d, K.dtw(y, x).T)
    length, reach = 12, 2
    for a in range(5):
        for b in range(4):
            table = np.full((length + 1, length + 1), np.inf)
            table[0, 0] = 0
            for i in range(length):
                for j in range(max(0, i - reach), min(length, i + reach + 1)):
                    table[i + 1, j + 1] = np.linalg.norm(x[a, i] - y[b, j]) + min(table[i, j + 1], table[i + 1, j], table[i, j])
            assert np.isclose(d[a, b], table[-1, -1] / (2 * length))


def _plain_best(score, allowed, rows, cols):
    r, c = (np.flatnonzero(np.diff(t, prepend=t[0] - 1)) for t in (rows, cols))
    best = lambda s: np.maximum.reduceat(np.maximum.reduceat(s, r, axis=0), c, axis=1)
    return rows[r], cols[c], best(score), best(np.where(allowed, score, -np.inf))


def test_best_scores_of_runs_of_any_length():
    """Tokens of one to many candidates give the bits of plain runs, and two candidates a token take less time than these."""
    rng = np.random.default_rng(8)
    for n, m, most in ((1, 1, 1), (40, 7, 3), (60, 50, 8), (90, 80, 200), (64, 33, 20)):
        rows, cols = np.sort(rng.integers(0, most, n)), np.sort(rng.integers(0, 1 + m // 2, m))
        score, allowed = rng.integers(-5, 5, (n, m)).astype(float), rng.random((n, m)) < 0.3
        assert all(np.array_equal(x, y) for x, y in zip(K.best_scores(score, allowed, rows, cols), _plain_best(score, allowed, rows, cols), strict=True))
    args = rng.normal(size=(512, 512)), rng.random((512, 512)) < 0.2, np.arange(512) // 2, np.arange(512) // 2

    def took(f):
        began = time.perf_counter()
        f(*args)
        return time.perf_counter() - began

    assert min(took(K.best_scores) for _ in range(9)) < 0.7 * min(took(_plain_best) for _ in range(9))


def test_best_by_token():
    rng = np.random.default_rng(1)
    rows, cols = np.array([0, 0, 1, 3, 3, 3]), np.array([2, 4, 4])
    score, allowed = np.round(rng.normal(size=(6, 3)), 1), rng.random((6, 3)) > 0.3
    ra, rb, u, t, i, j = K.best_by_token(score, allowed, rows, cols)
    for x, a in enumerate(ra):
        for y, b in enumerate(rb):
            cells = [(score[p, q], -p, -q) for p in range(6) for q in range(3) if rows[p] == a and cols[q] == b]
            fine = [c for c in cells if allowed[-c[1], -c[2]]]
            assert u[x, y] == max(cells)[0]
            assert (t[x, y], -i[x, y], -j[x, y]) == max(fine) if fine else i[x, y] == -1


def test_whitening_ignores_rotation():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 6)) * np.arange(1, 7)
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    a = K.whitened(x, *K.fit_pca(x, 6))
    b = K.whitened(x @ q, *K.fit_pca(x @ q, 6))
    assert np.allclose(a @ a.T, b @ b.T, atol=1e-8)


def test_chamfer():
    m = np.zeros((9, 9), dtype=bool)
    m[2, 2] = True
    n = np.zeros_like(m)
    n[2, 5] = True
    assert K.chamfer(m, m) == 0 and K.chamfer(m, n) == 3


def test_pitch_and_split():
    page = np.zeros((640, 200), dtype=bool)
    for y in range(20, 640, 40):
        page[y : y + 12] = True
    assert S.line_pitch(page) == 40
    assert S.line_pitch(np.zeros((100, 100))) == 40
    values = [0.2 + 0.01 * i for i in range(20)] + [1.0 + 0.01 * i for i in range(10)]
    assert 0.4 < S.log_otsu(values) < 1.0
    assert S.log_otsu(values[:14]) is None


def test_peaks():
    x = np.array([0, 3, 0, 5, 5, 0, 2, 1, 4, 0], dtype=float)
    assert S.peaks(x).tolist() == [1, 3, 6, 8]
    assert S.peaks(x, distance=3).tolist() == [3, 8]
    assert S.peaks(x, prominence=2.5).tolist() == [1, 3, 8]


def test_labels():
    rng = np.random.default_rng(3)
    mask = rng.random((30, 40)) > 0.55
    lab, n = I.labels(mask)
    seen, count = np.zeros(mask.shape, dtype=bool), 0
    for y, x in np.argwhere(mask):
        if seen[y, x]:
            continue
        count += 1
        todo, own = [(y, x)], set()
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            own.add(lab[a, b])
            for c in range(max(0, a - 1), min(30, a + 2)):
                for d in range(max(0, b - 1), min(40, b + 2)):
                    if mask[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        todo.append((c, d))
        assert len(own) == 1
    assert count == n and (lab[~mask] == 0).all()
    parts = I.components(mask)
    assert sum(p["area"] for p in parts) == mask.sum()


def test_candidates():
    """Cuts at the centres of gaps, the widest first, the right one of equals; then pieces without short ends."""
    ink = np.zeros((10, 100), dtype=bool)
    for a, b in ((5, 40), (50, 70), (80, 95)):
        ink[4, a:b] = True
    ink[0, 40:50] = True  # outside the middle rows
    assert I.inner_cuts(ink, 20) == [(10, 45), (10, 75)]
    assert I.inner_cuts(ink, 200) == []
    cuts = [(10, 45), (10, 75)]
    assert I.word_pieces(100, cuts, 80) == [(0, 75), (75, 100)]
    assert I.word_pieces(100, cuts, 50) == [(0, 45), (45, 75), (75, 100)]
    assert I.word_pieces(100, [], 50) == [(0, 100)]
    assert I.candidate_spans(100, [(10, 15), (10, 90)], 25) == [(0, 100), (0, 90), (15, 100), (15, 90)]
    assert I.candidate_spans(100, cuts, 20) == [(0, 75), (75, 100)]
    assert I.candidate_spans(100, [], 20) == []


def test_tight():
    """Ink that only touches the upper or lower edge is left out, and so is paper around the rest."""
    crop = np.full((20, 40), 250.0)
    crop[8:12, 10:20] = 10
    crop[0:3, 30:35] = 10
    crop[18:, 2:4] = 10
    assert I.tight(crop).shape == (4, 10)
    assert I.tight(np.full((20, 40), 250.0)).shape == (20, 40)


def test_upright_and_x_height():
    """A slanted bar is put upright; the x-height is the run of rows around the peak."""
    bar = np.zeros((30, 60), dtype=bool)
    for y in range(30):
        bar[y, 40 - y : 44 - y] = True
    angles = {a: float((I.sheared(bar, a).sum(axis=0).astype(float) ** 2).sum()) for a in range(-45, 46, 3)}
    assert (I.deslanted(bar) == I.sheared(bar, max(angles, key=angles.get))).all() and max(angles, key=angles.get) == -45
    word = np.zeros((40, 30), dtype=bool)
    word[3:5], word[15:25], word[18, 5:] = True, True, True
    a, b = I.x_height(word)
    assert (a, b) in ((14, 26), (15, 25))


def test_column_features_by_hand():
    word = np.zeros((64, 5), dtype=bool)
    word[10:20, 0], word[30:34, 2], word[5, 4], word[60, 4] = True, True, True, True
    got = I.column_features(word, points=5)
    assert np.allclose(got[:, 0], np.array([10, 20, 30, 17.5, 5]) / 64)
    assert np.allclose(got[:, 1], np.array([19, 26, 33, 46.5, 60]) / 64)
    assert np.allclose(got[:, 2], np.array([10, 0, 4, 0, 2]) / 64)
    assert np.allclose(got[:, 3], np.array([2, 0, 2, 0, 4]) / 8)
    assert np.allclose(got[:, 4], np.array([0, 0, 4, 0, 0]) / 16)
    assert np.allclose(I.column_features(np.zeros((64, 3), dtype=bool))[:, :2], 0.5)


def test_hog_columns():
    """One row for each column of blocks, resampled; equal columns give equal rows, and narrow words are padded."""
    stripes = np.zeros((64, 48), dtype=bool)
    stripes[::8] = True
    seq = I.hog_columns(stripes)
    assert seq.shape == (32, 7 * 36) and np.allclose(seq[8], seq[20])
    assert I.hog_columns(stripes[:, :5]).shape == (32, 7 * 36)
    blocks = I.hog(stripes.astype(float))
    assert np.allclose(seq[0], blocks[:, 0].ravel()) and np.allclose(seq[-1], blocks[:, -1].ravel())


def test_pitch_of_harmonics():
    """Every third line is heavier, so three spacings correlate best; one spacing is the answer."""
    page = np.zeros((1200, 100), dtype=bool)
    for n, y in enumerate(range(10, 1200, 30)):
        page[y : y + 6, : 100 if n % 3 == 0 else 60] = True
    assert S.line_pitch(page) == 30


def test_path_length_and_rules():
    ink = np.zeros((60, 300), dtype=bool)
    for i in range(20):
        ink[20 + i, 5 + i] = True
    assert I.path_length(ink).max() == 20
    ink[:] = False
    ink[30:33, 10:290] = True
    assert [r["kind"] for r in I.horizontal_rules(ink, 40, 3)] == ["rule"]


def page():
    im = np.full((600, 400), 230.0)
    for c in (20, 220):
        for y in range(40, 560, 60):
            for x in (0, 60, 120):
                im[y : y + 22, c + x : c + x + 40 : 3] = 20
    return im


def test_segmentation():
    found = I.segmented(page())
    assert {t["column"] for t in found} == {1, 2}
    assert max(t["line"] for t in found) == 9
    assert len(found) == 2 * 9 * 3


def test_word_features():
    crop = page()[36:66, 18:64]
    hog, seq = I.word_features(crop)
    assert seq.shape == (40, 5) and np.isfinite(seq).all() and np.isfinite(hog).all()
    assert I.normalised(crop).shape[0] == 64
    assert I.normalised(np.full((10, 10), 255.0)).shape[0] == 64
    assert I.word_features(crop, sequence=True)[2].shape == (32, 252)


def test_homography():
    square = np.array([(0, 0), (10, 0), (10, 10), (0, 10)], dtype=float)
    assert np.allclose(I.homography(square, square), np.eye(3))
    assert np.allclose(I.homography(square, square + (3, 4)) @ [1, 1, 1], [4, 5, 1])
    im = np.arange(100.0).reshape(10, 10)
    assert (I.warped(im, np.eye(3), 10, 10) == im).all()


def test_sheets():
    im = np.full((200, 400), 220.0)
    im[:, 195:205] = 120
    im[40:160:20, 30:170] = 30
    im[40:160:20, 230:370] = 30
    sides = I.split_sheet(im)
    assert [s for s, _, _ in sides] == ["L", "R"] and 190 <= sides[0][2] <= 215
    assert I.split_sheet(im[:, :200]) == [("P", 0, 200)]
    assert S.tracked([0.0, 10.0, 10.0]) == pytest.approx([0, 3, 5.1])
    cost = np.array([[9, 9, 1], [1, 9, 9], [9, 1, 9]])
    paths = [(a, b, c) for a in range(3) for b in range(3) for c in range(3) if abs(a - b) <= 1 and abs(b - c) <= 1]
    found = S.seam(cost).tolist()
    assert tuple(found) in paths and cost[found, range(3)].sum() == min(cost[list(p), range(3)].sum() for p in paths)
