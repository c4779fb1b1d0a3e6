"""Images of a file as rows (file, xref, width, height, bits, place, ...).

Defined results. Nulls in a size or place match nothing. xref is an image's key in its file and its order; repeated rows are
images of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.operators.stage import free_names

SIZE = ["width", "height", "bits"]


def ambiguous(images: DataFrame) -> DataFrame:
    """The images that share their size with another one of the file, so that the size does not tell them apart."""
    same = Window.partitionBy("file", *SIZE)
    (n,) = free_names(images.columns, "n")
    return images.withColumn(n, F.count(F.lit(1)).over(same)).filter(F.col(n) > 1).drop(n)


def without_masks(images: DataFrame) -> DataFrame:
    """The images that no other one uses as its mask (column mask: an xref or null)."""
    masks = images.filter("mask IS NOT NULL").select("file", F.col("mask").alias("xref"))
    return images.join(masks, ["file", "xref"], "left_anti")


def matched(copies: DataFrame, gone: DataFrame) -> DataFrame:
    """file, copy, original: each copy with the vanished image that it replaces.

    First those of one size and place, in order of xref on both sides, then what is left, of one size. Within a pass the
    classes of a key are disjoint, so that taking the first that is still free for one copy after the other is the same as
    matching the k-th with the k-th.
    """
    near = _kth(copies, gone, ["file", *SIZE, "place"])
    rest = lambda df, taken: df.join(near.select("file", F.col(taken).alias("xref")), ["file", "xref"], "left_anti")
    return near.unionByName(_kth(rest(copies, "copy"), rest(gone, "original"), ["file", *SIZE]))


def _kth(copies: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("xref"))
    left = copies.select(*keys, F.col("xref").alias("copy"), nth.alias("nth"))
    return left.join(gone.select(*keys, F.col("xref").alias("original"), nth.alias("nth")), [*keys, "nth"]).select("file", "copy", "original")


def smallest(candidates: DataFrame) -> DataFrame:
    """file, xref, chosen, size: of an image's encodings (ordinal, encoding, size) the smallest, the first of equal ones."""
    best = F.min(F.struct("size", "ordinal", "encoding")).alias("best")
    return candidates.filter("size IS NOT NULL").groupBy("file", "xref").agg(best).select("file", "xref", F.col("best.encoding").alias("chosen"), F.col("best.size").alias("size"))
