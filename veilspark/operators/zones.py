"""Words, zones and what lies under, beside or within them. (doc_id, page) are always equality keys of the join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.operators.grid import CORNERS, points_inside
from veilspark.operators.stage import free_names

KEYS = ["doc_id", "page"]


def _zone_side(zones: DataFrame) -> DataFrame:
    return zones.select(*(F.col(k).alias(f"z_{k}") for k in KEYS), "zone_id", *(F.col(c).alias(f"z{c}") for c in ("x0", "y0", "x1", "y1")))


def _same_page() -> Column:
    return reduce(lambda a, b: a & b, (F.col(k) == F.col(f"z_{k}") for k in KEYS))


def centre_inside(x0: str = "x0", x1: str = "x1") -> Column:
    cx, cy = (F.col(x0) + F.col(x1)) / 2, (F.col("y0") + F.col("y1")) / 2
    return cx.between(F.col("zx0"), F.col("zx1")) & cy.between(F.col("zy0"), F.col("zy1"))


def touches(margin: float = 0) -> Column:
    return (F.col("x0") < F.col("zx1") + margin) & (F.col("x1") > F.col("zx0") - margin) & (F.col("y0") < F.col("zy1") + margin) & (F.col("y1") > F.col("zy0") - margin)


def text_under_zones(words: DataFrame, zones: DataFrame) -> DataFrame:
    """doc_id, page, zone_id, text: the words whose centre lies in the zone, in page order. Words and zones meet by cells of a
    grid, so that a page of many of both does not make their product."""
    centre = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = points_inside(words, *centre, zones.select(*KEYS, "zone_id", *CORNERS), KEYS)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "word")))
    return inside.groupBy(*KEYS, F.col("z_zone_id").alias("zone_id")).agg(F.array_join(F.transform(ordered, lambda w: w["word"]), " ").alias("text"))


def words_outside(words: DataFrame, zones: DataFrame, margin: float = 1) -> DataFrame:
    """The words that touch no zone: those must survive."""
    return words.join(_zone_side(zones), _same_page() & touches(margin), "left_anti")


def chars_inside(words: DataFrame, zones: DataFrame) -> DataFrame:
    """Characters whose centre lies in a zone. Words that touch none are dropped before any is split into characters."""
    side = _zone_side(zones)
    near = words.join(side, _same_page() & touches(), "left_semi")
    chars = near.select(*KEYS, "pos", F.posexplode(F.split("word", "")).alias("i", "c"), F.col("x0").alias("wx0"), "y0", "y1").filter("c <> ''")
    boxes = chars.withColumn("x0", F.col("wx0") + F.col("i")).withColumn("x1", F.col("wx0") + F.col("i") + 1)
    return boxes.join(side, _same_page() & centre_inside(), "left_semi").select(*KEYS, "pos", "i", "c")


def multiset_minus(left: DataFrame, right: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """left's rows without as many rows of each key as right has, the first in the given order going first."""
    side, n, times = free_names([*left.columns, *right.columns], "right", "n", "times")
    everything = left.withColumn(side, F.lit(0)).unionByName(right.select(*keys, F.lit(1).alias(side)), allowMissingColumns=True)
    same = Window.partitionBy(*keys)
    # one shuffle: left's rows come first in each key, and right's are counted beside them
    numbered = everything.withColumn(n, F.row_number().over(same.orderBy(side, *order))).withColumn(times, F.sum(side).over(same))
    return numbered.filter((F.col(side) == 0) & (F.col(n) > F.col(times))).select(*left.columns)


def pages_with_loss(before: DataFrame, after: DataFrame, zones: DataFrame) -> DataFrame:
    """doc_id, page (from 1), n_lost for pages of which words outside the zones are gone, counting how often each was there."""
    outside = lambda words: words_outside(words, zones).select(*KEYS, "word")
    lost = outside(before).exceptAll(outside(after)).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_lost"))
    return lost.withColumn("page", F.col("page") + 1)


def zones_with_boxes(zones: DataFrame, boxes: DataFrame) -> DataFrame:
    """The zones (doc_id, page, zone_id, x0, y0, x1, y1) that touch a box (doc_id, page, x0, y0, x1, y1), such as an image's."""
    side = _zone_side(boxes.withColumn("zone_id", F.lit(None)))
    return zones.join(side, _same_page() & touches(), "left_semi")
