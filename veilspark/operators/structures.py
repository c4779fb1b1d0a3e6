"""What a document keeps beside its pages, as a table of strings (doc_id, place, location, ...), and the rule that each
location follows when a string holds a term.

Defined results. Null text holds no term. Strings of unknown locations stay. doc_id and place are a string's key; rows that
repeat it get the same treatment. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.operators.redact import strings_with_terms

#: What happens to a string that holds a term, by its location.
RULES = {
    "layer_name": "renamed", "layer_config": "blanked", "outline_target": "retargeted", "named_dest": "removed", "page_label": "blanked", "thread_info": "removed",
    "open_action": "removed", "additional_action": "removed", "piece_info": "removed", "struct_text": "blanked",
}
#: Locations that go whatever they hold, and those that the sweep for terms passes over.
ALWAYS, PASSED_OVER = ["associated_file"], ["page_content", "font", "character_map", "image", "color_profile"]
LAYER = "Capa "


def cleaned(strings: DataFrame, terms: DataFrame, ours: list[str] | None = None) -> DataFrame:
    """doc_id, place, location, change (null if none), text (null if removed or retargeted) for every string.

    A layer gets a name of its ordinal among the document's layers; a target that pointed to a page (target_page from 1)
    points to it plainly, any other goes nowhere.
    """
    found = strings_with_terms(strings.select("doc_id", "place", "text"), terms, ours).select(F.col("doc_id").alias("_d"), F.col("place").alias("_p"), F.lit(True).alias("_hit")).distinct()
    is_layer = F.col("location") == "layer_name"
    ordinal = F.sum(is_layer.cast("int")).over(Window.partitionBy("doc_id").orderBy("place").rangeBetween(Window.unboundedPreceding, 0))
    rows = strings.withColumn("_nth", ordinal).join(found, (F.col("doc_id") == F.col("_d")) & (F.col("place") == F.col("_p")), "left")
    rule = F.when(F.col("location").isin(*ALWAYS), F.lit("removed")).when(F.col("_hit"), _rule(F.col("location")))
    aimed = F.when(F.col("target_page") >= 1, F.concat(F.lit("page "), F.col("target_page").cast("string")))
    text = (
        F.when(rule.isNull(), F.col("text")).when(rule == "renamed", F.concat(F.lit(LAYER), F.col("_nth").cast("string"))).when(rule == "blanked", F.lit("")).when(rule == "retargeted", aimed)
    )
    return rows.select("doc_id", "place", "location", rule.alias("change"), text.alias("text"))


def _rule(location: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, change in RULES.items():
        out = out.when(location == name, F.lit(change))
    return out


def changes(done: DataFrame) -> DataFrame:
    """doc_id, n_removed, n_changed: how many strings went and how many became others."""
    gone = F.col("change") == "removed"
    return done.groupBy("doc_id").agg(F.count_if(gone).alias("n_removed"), F.count_if(F.col("change").isNotNull() & ~gone).alias("n_changed"))


def leftover(strings: DataFrame, terms: DataFrame, excluded: DataFrame, ours: list[str] | None = None) -> DataFrame:
    """doc_id of documents with a term in any string that can be read (text not null), but for those of excluded places
    (doc_id, place) and of locations that are content."""
    left = strings.filter(F.col("text").isNotNull() & ~F.col("location").isin(*PASSED_OVER)).join(excluded.select("doc_id", "place"), ["doc_id", "place"], "left_anti")
    return strings_with_terms(left.select("doc_id", "place", "text"), terms, ours).select("doc_id").distinct()
