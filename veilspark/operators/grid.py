"""Joins of rectangles by a grid: cells of the plane are a second equality key beside the page, so that a page's rectangles meet
their neighbours only. A pair that shares several cells is kept in the one that holds the low corner of what they share.

Rectangles are x0, y0, x1, y1. Those without extent, or with a null, meet nothing. A rectangle takes as many cells as it covers, so the
cell's side (in units of the page) should not be much below the sides of the larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of a cell.
CELL = 50
CORNERS = ("x0", "y0", "x1", "y1")


def cell_of(x: Column, side: float) -> Column:
    return F.floor(x / side)


def cells(x0: Column, y0: Column, x1: Column, y1: Column, side: float) -> Column:
    """Array of (cx, cy) of all cells that the rectangle covers, its edges included."""
    steps = lambda a, b: F.sequence(cell_of(a, side), cell_of(b, side))
    every = F.flatten(F.transform(steps(x0, x1), lambda cx: F.transform(steps(y0, y1), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))
    return F.when((x0 < x1) & (y0 < y1), every)


def _in_cells(df: DataFrame, prefix: str, keys: list[str], side: float) -> DataFrame:
    named = df.select(*(F.col(c).alias(prefix + c) for c in df.columns))
    corner = [F.col(prefix + c) for c in CORNERS]
    out = named.withColumn(prefix + "cell", F.explode(cells(*corner, side)))
    return out.select("*", F.col(f"{prefix}cell.cx").alias(prefix + "cx"), F.col(f"{prefix}cell.cy").alias(prefix + "cy")).drop(prefix + "cell")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], side: float = CELL) -> DataFrame:
    """The pairs of rectangles with common area: the columns of left behind l_ and of right behind r_. Keys are equal."""
    a, b = _in_cells(left, "l_", keys, side), _in_cells(right, "r_", keys, side)
    same = (F.col("l_cx") == F.col("r_cx")) & (F.col("l_cy") == F.col("r_cy"))
    for k in keys:
        same = same & (F.col(f"l_{k}") == F.col(f"r_{k}"))
    low_x, low_y = F.greatest("l_x0", "r_x0"), F.greatest("l_y0", "r_y0")
    common = (low_x < F.least("l_x1", "r_x1")) & (low_y < F.least("l_y1", "r_y1"))
    owner = (F.col("l_cx") == cell_of(low_x, side)) & (F.col("l_cy") == cell_of(low_y, side))
    return a.join(b, same & common & owner).drop("l_cx", "l_cy", "r_cx", "r_cy")


def points_inside(points: DataFrame, x: Column, y: Column, zones: DataFrame, keys: list[str], side: float = CELL) -> DataFrame:
    """Each point with each zone that holds it, edges included: the columns of points, then those of zones behind z_."""
    at = points.select("*", cell_of(x, side).alias("p_cx"), cell_of(y, side).alias("p_cy"), x.alias("p_x"), y.alias("p_y"))
    held = zones.select(*(F.col(c).alias(f"z_{c}") for c in zones.columns))
    covered = F.when(F.col("z_x0") == F.col("z_x1"), F.lit(None)).otherwise(cells(*(F.col(f"z_{c}") for c in CORNERS), side))
    held = held.select("*", F.explode(covered).alias("z_cell"))
    same = (F.col("p_cx") == F.col("z_cell.cx")) & (F.col("p_cy") == F.col("z_cell.cy"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"z_{k}"))
    inside = F.col("p_x").between(F.col("z_x0"), F.col("z_x1")) & F.col("p_y").between(F.col("z_y0"), F.col("z_y1"))
    return at.join(held, same & inside).drop("p_cx", "p_cy", "p_x", "p_y", "z_cell")
