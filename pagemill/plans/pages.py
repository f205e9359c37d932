"""Pages of pixels to tokens, candidates and features; pooled whitening; marks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.kernels import image as I
from pagemill.kernels import marks as M
from pagemill.kernels import pairs as K
from pagemill.kernels import polygons as L
from pagemill.kernels import sheets as SH
from pagemill.operators import rules as R
from pagemill.storage import stored

_TOKENS = "page string, column int, line int, token int, x0 int, y0 int, x1 int, y1 int, width int, height int, group int, error string"
_CANDIDATES = (
    "page string, column int, line int, token int, tok long, cand long, tid string, is_full boolean, x0 int, y0 int, x1 int, y1 int, w double, h double, "
    "unit double, hog array<float>, seq array<float>, hseq array<float>, error string"
)


def pixels(row) -> np.ndarray:
    """Grey pixels of a row(height, width, channels, data)."""
    data = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, -1)
    return I.grey(data[..., :3]) if data.shape[2] >= 3 else data[..., 0].astype(np.float64)


def tint(row) -> np.ndarray | None:
    """Saturation of a row's pixels; none for grey images."""
    data = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, -1)
    return SH.saturation(data[..., :3]) if data.shape[2] >= 3 else None


def _by_page(images: DataFrame, work, schema: str, failed: dict, colour: bool = False) -> DataFrame:
    """work(page, pixels), with colour work(page, pixels, saturation), -> rows for each image. A page that fails gives one row
    with its error and stops nothing."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for part in parts:
            for row in part.itertuples():
                try:
                    more = (tint(row),) if colour else ()
                    out = [r | {"page": row.page, "error": None} for r in work(row.page, pixels(row), *more)]
                except Exception as e:  # noqa: BLE001
                    out = [failed | {"page": row.page, "error": f"{type(e).__name__}: {e}"[:500]}]
                if out:
                    yield pd.DataFrame(out, columns=names)

    return images.mapInPandas(each, schema)


def tokens(images: DataFrame, layout: I.Layout = I.Layout()) -> DataFrame:  # noqa: B008
    """images(page, height, width, channels, data) as token rows; error names what went wrong with a page."""
    empty = dict.fromkeys(("column", "line", "token", "x0", "y0", "x1", "y1", "width", "height", "group"), -1)
    return _by_page(images, lambda _, im: I.segmented(im, layout), _TOKENS, empty)


def candidates(images: DataFrame, layout: I.Layout = I.Layout(), least: float = 0.6, most: float = 4.0, sequences: bool = False) -> DataFrame:  # noqa: B008
    """Every token's candidate spans with their features. unit is the page's median token height. hseq, the HOG columns, is made if asked for."""

    def work(page: str, im: np.ndarray) -> list[dict]:
        found, out = I.segmented(im, layout), []
        unit = float(np.median([t["height"] for t in found])) if found else 0.0
        ink = im <= I.otsu(im)
        for n, t in enumerate(found):
            crop = (slice(t["y0"], t["y1"]), slice(t["x0"], t["x1"]))
            cuts = I.inner_cuts(ink[crop], unit)
            for a, b in I.candidate_spans(t["width"], cuts, unit, least, most):
                hog, seq, *more = I.word_features(im[t["y0"] : t["y1"], t["x0"] + a : t["x0"] + b], sequence=sequences)
                name, full = f"c{t['column']}_l{t['line']}_t{t['token']}", (a, b) == (0, t["width"])
                out.append({
                    "column": t["column"], "line": t["line"], "token": t["token"], "tok": n, "cand": len(out), "tid": name if full else f"{name}[{a}:{b}]", "is_full": full,
                    "x0": t["x0"] + a, "y0": t["y0"], "x1": t["x0"] + b, "y1": t["y1"], "w": float(b - a), "h": float(t["height"]), "unit": unit,
                    "hog": hog.astype(np.float32).tolist(), "seq": seq.astype(np.float32).ravel().tolist(),
                    "hseq": more[0].astype(np.float32).ravel().tolist() if more else None,
                })
        return out

    empty = {c.split()[0]: None for c in _CANDIDATES.split(", ")} | dict.fromkeys(("column", "line", "token", "tok", "cand", "x0", "y0", "x1", "y1"), -1) | {"is_full": False}
    return _by_page(images, work, _CANDIDATES, empty)


_PART = "page string, kind string, x0 int, y0 int, x1 int, y1 int, spacing double, stroke double, measures map<string,double>, error string"


def measured(images: DataFrame) -> DataFrame:
    """Everything on a page that may be a mark, with its measures: kind rule, part, stroke or brace (candidates)."""

    def work(page: str, im: np.ndarray, colour: np.ndarray | None) -> list[dict]:
        found, out = M.page_marks(im, colour), []
        for kind, rows in (("rule", found["rules"]), ("part", found["parts"]), ("stroke", found["strokes"]), ("brace", found["braces"])):
            for r in rows:
                numbers = {k: float(v) for k, v in r.items() if k not in ("x0", "y0", "x1", "y1", "label", "kind") and np.isfinite(v)}
                out.append({k: r[k] for k in ("x0", "y0", "x1", "y1")} | {"kind": kind, "spacing": found["spacing"], "stroke": found["stroke"], "measures": numbers})
        return out

    return _by_page(images, work, _PART, dict.fromkeys(("x0", "y0", "x1", "y1"), -1) | {"kind": None, "spacing": None, "stroke": None, "measures": None}, colour=True)


def marks(images: DataFrame) -> DataFrame:
    """Marks of each page by the decision rules: rule, dash, circle, filler, slash, brace. A component gets the first kind that
    fits; circles on colour images say whether they are drawn in pencil or ink."""
    rows = measured(images)
    m = lambda c: F.coalesce(F.try_element_at("measures", F.lit(c)), F.lit(float("inf")))
    yes = lambda c: m(c) == 1.0
    dash = R.dash(m("width"), m("height"), m("slope"), m("wave"), m("thickness"), m("below"), yes("clear"), m("dark"))
    circle = R.circle(F.greatest(m("width"), m("height")), m("aspect"), m("around"), m("axes"), m("error"), m("covered"), m("centre"), m("dark"))
    filler = R.filler(m("height"), m("width"), m("area"), yes("last"), m("gap"), F.lit(False))
    slash = R.slash(m("angle"), m("rms"), m("length"), m("iso_left"), m("iso_right"), m("support")) & (m("length") >= 1.3)
    brace = R.brace(m("slope"), m("resid"), m("left_text"), m("arms"), m("height"), m("iso_left"), m("iso_right"))
    kind = (
        F.when(F.col("error").isNotNull(), F.lit(None)).when(F.col("kind") == "rule", "rule").when((F.col("kind") == "brace") & brace, "brace")
        .when((F.col("kind") == "stroke") & slash, "slash").when((F.col("kind") == "part") & dash, "dash").when((F.col("kind") == "part") & circle, "circle")
        .when((F.col("kind") == "part") & filler, "filler")
    )
    out = rows.withColumn("kind", kind).where("kind is not null or error is not null")
    tinted = F.map_contains_key("measures", "saturation")
    medium = F.when((F.col("kind") == "circle") & tinted, F.when(R.pencil(m("saturation"), m("ink_saturation"), m("paper_saturation")), "pencil").otherwise("ink"))
    return out.select("page", "kind", "x0", "y0", "x1", "y1", "spacing", "stroke", F.to_json("measures").alias("attributes"), medium.alias("medium"), "error")


def polygons(images: DataFrame, layout: I.Layout = I.Layout()) -> DataFrame:  # noqa: B008
    """Text lines of each page as polygons and baselines."""
    kinds = "page string, id string, polygon array<array<double>>, baseline array<array<double>>, error string"

    def work(page: str, im: np.ndarray) -> list[dict]:
        ink = I.binarised(im)
        return L.line_polygons(ink, I.text_lines(ink, layout))

    return _by_page(images, work, kinds, {"id": None, "polygon": None, "baseline": None})


def components(images: DataFrame) -> DataFrame:
    """Connected components of each page's ink with box, area, and share of ink within their box: what mark rules are asked about."""
    kinds = "page string, label int, x0 int, y0 int, x1 int, y1 int, area int, cx double, cy double, error string"
    empty = dict.fromkeys(("label", "x0", "y0", "x1", "y1", "area"), -1) | {"cx": None, "cy": None}
    return _by_page(images, lambda _, im: I.components(I.binarised(im)), kinds, empty)


def straightened(images: DataFrame, inset: float = 0.004) -> DataFrame:
    """Each photograph's sheet as an upright, evenly lit grey rectangle (page, height, width, channels, data), and to_original, the
    matrix row by row from its pixels to the photograph's."""
    kinds = "page string, height int, width int, channels int, data binary, to_original array<double>, error string"

    def work(page: str, im: np.ndarray, colour: np.ndarray | None) -> list[dict]:
        sheet, matrix = SH.straightened(im, SH.corners(I.sheet_mask(im, colour)), inset)
        sheet = SH.evened(sheet).astype(np.uint8)
        return [{"height": sheet.shape[0], "width": sheet.shape[1], "channels": 1, "data": sheet.tobytes(), "to_original": matrix.ravel().tolist()}]

    return _by_page(images, work, kinds, {"height": -1, "width": -1, "channels": -1, "data": None, "to_original": None}, colour=True)


def overlays(images: DataFrame, boxes: DataFrame, thick: int = 2) -> DataFrame:
    """(page, png): each page with its boxes(page, x0, y0, x1, y1) drawn in black, as a PNG file; pages without boxes too."""
    drawn = boxes.groupBy("page").agg(F.collect_list(F.array("x0", "y0", "x1", "y1")).alias("boxes"))  # the boxes of one page
    rows = images.select("page", "height", "width", "channels", "data").join(drawn, "page", "left")

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples():
                im = pixels(row).copy()
                for x0, y0, x1, y1 in row.boxes if row.boxes is not None else ():
                    inner = im[y0 + thick : max(y0 + thick, y1 - thick), x0 + thick : max(x0 + thick, x1 - thick)].copy()
                    im[y0:y1, x0:x1] = 0
                    im[y0 + thick : y0 + thick + inner.shape[0], x0 + thick : x0 + thick + inner.shape[1]] = inner
                out.append((row.page, I.png(im)))
            yield pd.DataFrame(out, columns=["page", "png"])

    return rows.mapInPandas(each, "page string, png binary")


def crops(images: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """(page, key, png): the part of its page in each of boxes(page, key, x0, y0, x1, y1)."""
    drawn = boxes.groupBy("page").agg(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), "x0", "y0", "x1", "y1")).alias("boxes"))
    rows = images.select("page", "height", "width", "channels", "data").join(drawn, "page")

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                im = pixels(row)
                out = [(row.page, b["k"], I.png(im[b["y0"] : b["y1"], b["x0"] : b["x1"]])) for b in row.boxes]
                yield pd.DataFrame(out, columns=["page", key, "png"])

    return rows.mapInPandas(each, f"page string, {key} string, png binary")


def sheets(images: DataFrame) -> DataFrame:
    """Pages of each photographed sheet: side P, or L and R, with their columns of pixels."""
    kinds = "page string, side string, x0 int, x1 int, error string"
    return _by_page(images, lambda _, im: [{"side": s, "x0": a, "x1": b} for s, a, b in I.split_sheet(im)], kinds, {"side": None, "x0": -1, "x1": -1})


def _added(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row with the sums of all rows."""
    n, s, g = 0, 0.0, 0.0
    for part in parts:
        for r in part.itertuples():
            n, s, g = n + r.n, s + np.asarray(r.s), g + np.asarray(r.g)
    if n:
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "g": [g.tolist()]})


def whitening(df: DataFrame, vector: str, dims: int = 128, steps: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, leading axes and their sample variances of a vector column, from sums over all rows. A row may hold several vectors, its steps, flat.

    Each partition sends its count, sum and d x d Gram matrix to eight tasks,
    which add them up; the driver gets eight matrices.
    """

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, g = 0, None, None
        for part in parts:
            if len(part):
                x = np.array(part[vector].tolist(), dtype=np.float64).reshape(len(part) * steps, -1)
                n, s, g = n + len(x), x.sum(axis=0) + (0 if s is None else s), x.T @ x + (0 if g is None else g)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "g": [g.ravel().tolist()]})

    sums = df.select(vector).where(F.col(vector).isNotNull()).mapInPandas(each, "n long, s array<double>, g array<double>")
    # matrices meet in a tree: partial sums of each task come together in a few tasks first, then at the driver
    parts = sums.repartition(8).mapInPandas(lambda ps: _added(ps), "n long, s array<double>, g array<double>").collect()
    row = {"n": sum(r["n"] for r in parts), "s": [r["s"] for r in parts], "g": [r["g"] for r in parts]}
    if not row["n"]:
        raise ValueError("no vectors")
    s, g = np.sum(row["s"], axis=0), np.sum(row["g"], axis=0)
    mean = s / row["n"]
    cov = (g.reshape(len(s), len(s)) - row["n"] * np.outer(mean, mean)) / max(1, row["n"] - 1)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[: min(dims, len(s), max(1, row["n"] - 1))]
    return mean, axes[:, order].T, np.maximum(values[order], 0)


def whitened(df: DataFrame, vector: str, out: str = "feat", dims: int = 128) -> DataFrame:
    """df with the vector whitened by all rows' statistics and scaled to length 1."""
    mean, axes, variances = whitening(df, vector, dims)
    model = df.sparkSession.sparkContext.broadcast((mean, axes, variances))  # dims x d numbers

    def each(values: pd.Series) -> pd.Series:
        if not len(values):
            return values
        return pd.Series(K.whitened(np.array(values.tolist(), dtype=np.float64), *model.value).tolist())

    from pyspark.sql.pandas.functions import PandasUDFType

    return df.withColumn(out, F.pandas_udf(each, "array<double>", PandasUDFType.SCALAR)(F.col(vector)))


def projected(df: DataFrame, sequence: str, steps: int, dims: int = 24) -> DataFrame:
    """df with each step of a flat sequence column along the leading axes of all steps of all rows, over the root of their mean
    variance: axes keep their relative weights."""
    mean, axes, variances = whitening(df, sequence, dims, steps)
    scale = float(np.sqrt(max(variances.mean(), 1e-12)))
    model = df.sparkSession.sparkContext.broadcast((mean, axes, scale))  # dims x d numbers

    def each(values: pd.Series) -> pd.Series:
        if not len(values):
            return values
        m, v, s = model.value
        x = np.array(values.tolist(), dtype=np.float64).reshape(len(values), steps, -1)
        return pd.Series(((x - m) @ v.T / s).reshape(len(values), -1).tolist())

    from pyspark.sql.pandas.functions import PandasUDFType

    return df.withColumn(sequence, F.pandas_udf(each, "array<double>", PandasUDFType.SCALAR)(F.col(sequence)))


def spotted(images: DataFrame, params=None, dims: int = 128):
    """The folder run: candidates of all pages, pooled whitening, matches within and across pages, clusters.

    Returns a dictionary of DataFrames: candidates, failed (pages with errors), matches, summary, clusters.
    """
    from pagemill.plans import spotting as P

    params = params or P.Params()
    rows = stored(candidates(images, sequences=params.hog_dtw_weight > 0), "candidates")
    featured = whitened(rows.where("error is null"), "hog", "feat", dims)
    featured = stored(projected(featured, "hseq", params.hog_steps) if params.hog_dtw_weight > 0 else featured, "features")
    order = featured.select("page", "tok", F.col("column").alias("col"), "line", F.col("token").alias("pos")).distinct()
    found = stored(P.matches(featured, order, params), "matches")
    return {
        "candidates": featured, "failed": rows.where("error is not null").select("page", "error"), "matches": found,
        "summary": P.summary(found, featured), "clusters": P.clusters(found, featured, numbered=False),
    }
