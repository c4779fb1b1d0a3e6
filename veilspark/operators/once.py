"""Tables that a plan uses more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.stage import staged


def computed_once(df: DataFrame) -> DataFrame:
    """df, computed once, in the folder that the cluster shares."""
    return staged(df, "once")


def once_a_row(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, however often they are asked for: the optimizer copies none over a generator."""
    held = df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_once"))
    return held.select(*df.columns, *(F.col("_once")[n].alias(n) for n in columns))
