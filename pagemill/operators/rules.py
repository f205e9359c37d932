"""Decision rules on measured features, and grouping that depends on the order of visits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.geometry import coverage
from pagemill.operators.joins import meeting


def brace(slope: Column, resid: Column, left_text: Column, arms: Column, height: Column, iso_left: Column, iso_right: Column) -> Column:
    """Is a candidate a brace? Heights in line spacings; one of two arms or more may be lower but must stand freer."""
    plain = (F.abs(slope) <= 0.45) & (resid >= 0.35) & (left_text >= 0.4)
    stacked = (height >= 1.1) & (iso_left >= 0.75) & (iso_right >= 0.75)
    traced = (height >= 1.6) & (iso_left >= 0.5) & (iso_right >= 0.6)
    return plain & F.when(arms >= 2, stacked).otherwise(traced)


def dash(width: Column, height: Column, slope: Column, wave: Column, thickness: Column, below: Column, clear: Column, dark: Column) -> Column:
    """Is a component a dash? Width and height in line spacings, wave and thickness in stroke widths."""
    return (
        width.between(0.22, 2.2) & (height <= 0.3) & (width >= 1.7 * height) & (F.abs(slope) <= 0.35) & (wave <= 0.5)
        & (thickness <= 2.2) & (below <= 0.2) & clear & (dark >= 0.6)
    )


def circle(size: Column, aspect: Column, around: Column, axes: Column, error: Column, covered: Column, centre: Column, dark: Column) -> Column:
    """Is a component a small circle? Size in line spacings, surroundings in squared and error in single stroke widths."""
    return size.between(0.15, 0.8) & aspect.between(0.6, 1.6) & (around <= 2) & (axes >= 0.5) & (error <= 0.5) & (covered >= 0.8) & (centre <= 0.05) & (dark >= 0.45)


def pencil(saturation: Column, ink: Column, paper: Column) -> Column:
    """Is a circle drawn in pencil: less colour than midway between ink and paper?"""
    return saturation < (ink + paper) / 2


def filler(height: Column, width: Column, area: Column, last: Column, gap: Column, chained: Column) -> Column:
    """Is a component a line filler? Height, width and left gap in line spacings, area in squared stroke widths."""
    return (height <= 0.48) & width.between(0.3, 3.0) & (area >= 6) & last & (gap.between(0.35, 3.0) | chained)


def slash(angle: Column, rms: Column, length: Column, iso_left: Column, iso_right: Column, support: Column) -> Column:
    """Is a stroke a slash? Angle in degrees, rms in stroke widths, length in line spacings."""
    return angle.between(28, 68) & (rms <= 0.65) & (length >= 0.9) & (iso_left >= 0.6) & (iso_right >= 0.6) & (support >= 0.3)


def slash_sign(length: Column, angle: Column, slant: Column) -> Column:
    """Is a slash a sign rather than a letter's stroke: long, or much flatter than the writing?"""
    return (length >= 1.6) | (slant - angle >= 15)


def slash_role(sign: Column, length: Column, beside: Column, alone: Column) -> Column:
    """separator with text beside and alone in its row, else closing; null for what is neither sign nor long enough."""
    return F.when(sign | (length >= 1.3), F.when(beside & alone, "separator").otherwise("closing"))


def rule_line(length: Column, off: Column, stroke: Column) -> Column:
    """Is a horizontal path a ruled line: five line spacings long, pixels within 1.5 stroke widths and one of its fit?"""
    return (length >= 5) & (off <= 1.5 * stroke + 1)


def specks(area: Column, pixels: Column) -> Column:
    """Is a component too small to be ink?"""
    return area < F.greatest(F.lit(20), pixels / 2_000_000)


def junk(x0: Column, y0: Column, x1: Column, y1: Column, area: Column, char: Column, width: Column, height: Column, border: int = 3) -> Column:
    """Is a component no writing: a speck, at the page's border, a ruled line, or as long as the page? char is the height of a letter."""
    w, h = x1 - x0, y1 - y0
    at_border = (x0 <= border) | (y0 <= border) | (x1 >= width - border) | (y1 >= height - border)
    return (area < F.greatest(F.lit(10), 0.05 * char * char)) | at_border | ((w > 10 * char) & (h < 1.2 * char)) | (h > 0.5 * height) | (w > 0.6 * width)


def edge_stroke(x0: Column, w: Column, h: Column, left: Column, char: Column) -> Column:
    """Is a component the shadow of a fold: tall, narrow, and close to its column's left edge?"""
    return (x0 < left + 4 * char) & (h > 3 * char) & (h > 2.5 * w)


def border_shadow(x0: Column, y0: Column, x1: Column, y1: Column, area: Column, near: Column, width: Column, height: Column, margin: int = 2) -> Column:
    """Does a component hug the border: it touches it, and half of it or more (near) lies in the band beside it? What only runs up to it stays."""
    touches = (x0 < margin) | (y0 < margin) | (x1 > width - margin) | (y1 > height - margin)
    return touches & (near >= 0.5 * area)


def solid(area: Column, stroke: Column) -> Column:
    """Is a component more than a full stop: three squared stroke widths or more?"""
    return area >= 3 * stroke * stroke


def brace_lines(lines: DataFrame, braces: DataFrame, by: list[str], reach: float = 6.0, member: float = 0.8, borderline: float = 0.25, size: float = 256) -> DataFrame:
    """Text lines (y0, y1, x0) that a brace (b_y0, b_y1, b_x0, spacing) groups: those that start left of it within reach and
    that its span covers, as member or borderline."""
    near = (F.col("x0") < F.col("b_x0")) & (F.col("b_x0") - F.col("x1") <= reach * F.col("spacing"))
    share = coverage(F.col("y0"), F.col("y1"), F.col("b_y0"), F.col("b_y1"))
    rows = meeting(lines, braces, by, [("y0", "y1", "b_y0", "b_y1")], size).where(near).withColumn("coverage", share)
    relation = F.when(F.col("coverage") >= member, "member").when(F.col("coverage") >= borderline, "borderline")
    return rows.withColumn("relation", relation).where("relation is not null")


def note_lines(lines: DataFrame, cusps: DataFrame, by: list[str], seed: float = 1.2, grow: float = 1.4) -> DataFrame:
    """Lines to the right of a brace's cusp (c_y, c_x, spacing, brace) that are its note: one within seed line spacings of the cusp,
    and all that follow each other from there within grow line spacings."""
    from pyspark.sql.window import Window

    rows = lines.join(cusps, by).where(F.col("x0") >= F.col("c_x")).withColumn("_y", (F.col("y0") + F.col("y1")) / 2)
    w = Window.partitionBy(*by, "brace").orderBy("_y")
    rows = rows.withColumn("_new", (F.col("_y") - F.lag("_y").over(w) > grow * F.col("spacing")).cast("int"))
    rows = rows.withColumn("_part", F.sum(F.coalesce("_new", F.lit(0))).over(w))
    seeds = rows.where(F.abs(F.col("_y") - F.col("c_y")) <= seed * F.col("spacing")).select(*by, "brace", "_part").distinct()
    return rows.join(seeds, [*by, "brace", "_part"], "left_semi").drop("_new", "_part", "_y").withColumn("relation", F.lit("note"))


def leader_groups(df: DataFrame, page: str, key: str, threshold: float = 0.95) -> DataFrame:
    """Items of each page grouped by size: visited from the largest area down, each joins the most similar leader or leads
    itself; groups are numbered by how many they have. The order of visits matters, so a page is one task's work."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_area", key], ascending=[False, True])
        size = np.log(part[["w", "h"]].to_numpy(dtype=np.float64))
        leaders: list[int] = []
        group = np.zeros(len(part), dtype=np.int64)
        for i in range(len(part)):
            near = np.exp(-np.hypot(*(size[leaders] - size[i]).T)) if leaders else np.zeros(0)
            if len(near) and near.max() >= threshold:
                group[i] = int(near.argmax())
            else:
                group[i] = len(leaders)
                leaders.append(i)
        counts = np.bincount(group, minlength=len(leaders))
        order = np.empty(len(leaders), dtype=np.int64)
        order[np.lexsort((np.arange(len(leaders)), -counts))] = np.arange(len(leaders))
        return pd.DataFrame({page: part[page], key: part[key], "group": order[group]})

    kinds = f"{page} {df.schema[page].dataType.simpleString()}, {key} {df.schema[key].dataType.simpleString()}, group long"
    return df.withColumn("_area", F.col("w") * F.col("h")).groupBy(page).applyInPandas(one, kinds)
