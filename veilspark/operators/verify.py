"""Whether a processed file may be delivered: its pages against those of the original.

Defined results. A page has content if it has an image or text that is not blank; nulls are none. A file without pages in the
output, or one that is there on one side only, has differing pages. Files that need a password cannot be compared.
Repeated (file, page) rows are pages of their own that match nothing but their number. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons, the first that holds being given.
ENCRYPTED, DIFFER, EMPTIED = "encrypted", "pages differ", "page emptied"


def has_content(images: Column, text: Column) -> Column:
    return (F.coalesce(images, F.lit(0)) > 0) | F.coalesce(text, F.lit("")).rlike(r"(?U)[^\s]")


def page_reasons(before: DataFrame, after: DataFrame, encrypted: DataFrame | None = None) -> DataFrame:
    """file, reason (null: it may be delivered). before and after: file, page, has; encrypted: file of outputs with a password."""
    left = before.select("file", "page", "has", F.lit(1).alias("in"))
    right = after.select("file", "page", F.col("has").alias("out_has"), F.lit(1).alias("out"))
    both = left.join(right, ["file", "page"], "full")
    emptied = F.coalesce(F.bool_or(F.col("has") & ~F.coalesce("out_has", F.lit(False))), F.lit(False))
    differ = (F.count("out") != F.count("in")) | (F.count("out") == 0)
    found = both.groupBy("file").agg(F.when(differ, DIFFER).when(emptied, EMPTIED).alias("reason"))
    if encrypted is None:
        return found
    locked = encrypted.select("file", F.lit(True).alias("locked")).distinct()
    return found.join(locked, "file", "full").select("file", F.when(F.col("locked"), ENCRYPTED).otherwise(F.col("reason")).alias("reason"))


def expired(age_ms: Column, most_ms: int = 900_000) -> Column:
    """Files strictly older than a quarter of an hour, unless told otherwise."""
    return age_ms > most_ms


def missing(saved: DataFrame, remaining: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_missing: what was saved and is not there any more, counting how often each was."""
    return saved.select(*keys).exceptAll(remaining.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_missing"))
