"""Outlines whose levels depend on their order, one document at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relevelled(outline: DataFrame, removed: Column) -> DataFrame:
    """doc_id, pos, title, level without removed rows; the children of those rise to their nearest kept ancestor.

    A row's level is one more than its kept ancestors. The open ancestors are an array that a row cuts back to lower
    levels, removed rows included.
    """
    rows = outline.select("doc_id", F.struct("pos", "level", "title", removed.alias("gone")).alias("r"))
    per_doc = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    zero = F.struct(F.expr("cast(array() as array<int>)").alias("open"), F.expr("cast(array() as array<struct<pos:int,title:string,level:int>>)").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        above = F.filter(acc["open"], lambda level: level < r["level"])
        entry = F.struct(r["pos"].cast("int").alias("pos"), r["title"].alias("title"), (F.size(above) + 1).alias("level"))
        return F.when(r["gone"], F.struct(above.alias("open"), acc["out"].alias("out"))).otherwise(F.struct(F.concat(above, F.array(r["level"].cast("int"))).alias("open"), F.concat(acc["out"], F.array(entry)).alias("out")))

    folded = F.aggregate("rows", zero, step, lambda acc: acc["out"])
    return per_doc.select("doc_id", F.explode(folded).alias("e")).select("doc_id", "e.*")
