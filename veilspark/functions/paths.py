"""Rectangles that a vector path consists of.

A path is an array of items (op, points), points an array of (x, y): "re" with two opposite corners, "qu" with four
points, "l" with two.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimals to which coordinates of one edge agree.
DECIMALS = 3


def path_rects(items: Column) -> Column:
    """Array of (x0, y0, x1, y1): those of a path of rectangles alone; the one that a single quadrangle, or three or four lines
    along the axes, make up; null for all other paths, and for null."""
    only = lambda op: F.forall(items, lambda i: F.coalesce(i["op"] == op, F.lit(False)))
    corner = lambda i, k: F.get(i["points"], k)
    drawn = F.transform(items, lambda i: F.struct(corner(i, 0)["x"].alias("x0"), corner(i, 0)["y"].alias("y0"), corner(i, 1)["x"].alias("x1"), corner(i, 1)["y"].alias("y1")))
    along = F.forall(items, lambda i: (corner(i, 0)["x"] == corner(i, 1)["x"]) | (corner(i, 0)["y"] == corner(i, 1)["y"]))
    points = F.flatten(F.transform(items, lambda i: i["points"]))
    axis = lambda c: F.array_distinct(F.transform(points, lambda p: F.round(p[c], DECIMALS)))
    x, y = axis("x"), axis("y")
    box = F.array(F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1")))
    closed = ((F.size(items) == 1) & only("qu")) | (F.size(items).between(3, 4) & only("l") & along)
    return F.when((F.size(items) > 0) & only("re"), drawn).when(closed & (F.size(x) == 2) & (F.size(y) == 2), box)
