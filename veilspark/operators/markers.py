"""Markers that stand for images while a file is compressed, and the originals that take their place again.

A marker is sixteen bytes: a magic word, the original's number as four bytes, high byte first, and the complement of these
eight. A compressor may have inverted all of them. Every marker of a file must lead to an image of the original, and none may be
left elsewhere; a file that fails either is withheld as a whole.

Defined results. Null data is no marker, and so is any other length. Images whose data is no marker are masks of their
own and stay. file and xref are an image's key. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The magic word, and the size of the mask that holds a marker.
MAGIC, WIDTH, HEIGHT = "PdCq", 64, 2
_MAGIC = MAGIC.encode().hex().upper()


def _inverted(digits: Column) -> Column:
    """Hexadecimal digits of the complement."""
    return F.translate(digits, "0123456789ABCDEF", "FEDCBA9876543210")


def marker(xref: Column) -> Column:
    """The marker of an object's number, as bytes."""
    row = F.concat(F.lit(_MAGIC), F.lpad(F.hex(xref.cast("long")), 8, "0"))
    return F.unhex(F.concat(row, _inverted(row)))


def marker_id(data: Column) -> Column:
    """The number that a marker holds, inverted or not; null if the data is none."""

    def read(digits: Column) -> Column:
        row = F.substring(digits, 1, 16)
        sound = (F.length(digits) == 32) & F.startswith(digits, F.lit(_MAGIC)) & (F.substring(digits, 17, 16) == _inverted(row))
        return F.when(sound, F.conv(F.substring(digits, 9, 8), 16, 10).cast("long"))

    return F.coalesce(read(F.hex(data)), read(_inverted(F.hex(data))))


def restored(images: DataFrame, originals: DataFrame, streams: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(file, xref, original) of the markers in files that are whole, and (file, reason) of the others.

    images: file, xref, mask, width, height, data; originals: file, xref, image (whether the object is one); streams: file,
    data of whatever else the compressed file holds.
    """
    shape = F.col("mask") & (F.col("width") == WIDTH) & (F.col("height") == HEIGHT)
    found = images.filter(shape).select("file", "xref", marker_id(F.col("data")).alias("original")).filter("original is not null")
    known = originals.select(F.col("file").alias("o_file"), F.col("xref").alias("o_xref"), "image")
    matched = found.join(known, (F.col("file") == F.col("o_file")) & (F.col("original") == F.col("o_xref")), "left").withColumn("fits", F.coalesce("image", F.lit(False)))
    reasons = matched.filter(~F.col("fits")).select("file", F.lit("marker names no image").alias("reason"))
    if streams is not None:
        left = F.contains(F.hex(F.col("data")), F.lit(_MAGIC)) & F.hex(F.col("data")).rlike(f"^(?:..)*?{_MAGIC}")
        reasons = reasons.unionByName(streams.filter(left).select("file", F.lit("marker left").alias("reason")))
    failed = reasons.groupBy("file").agg(F.min("reason").alias("reason"))
    return matched.filter("fits").select("file", "xref", "original").join(failed.select("file"), "file", "left_anti"), failed
