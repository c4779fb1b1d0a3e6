"""Site-relative line deduplication, in DataFrame operations only.

Within a host, a line is boilerplate when the share of the host's pages that hold it exceeds a ratio. Counting sends one
pair of hashes per page and distinct line through a partial aggregation, so a line on a third of all pages arrives as
one row per task. What is left per host is bounded: fewer lines can exceed the ratio than lines stand on an average page
divided by the ratio. That table is broadcast if it was counted and found small, and otherwise joined on host and a
salt, so that no host's pages meet in one task.

Defined results. Null text stays null and counts as a page. Lines without a word are neither counted nor dropped. A null
host is a host of its own. Lines are equal when all their characters are. A page that loses all lines keeps its row.

A page is a row, as in OP5_SQL. With by_content it is a distinct text of the host instead, in shares and in min_pages
alike, and what is found goes from every row: then a page does not become boilerplate of its host by being copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import SPACE, free_names, staged

#: A line on more than this share of a host's pages is boilerplate.
RATIO = 0.08
#: Pages that must hold it in any case; a host of few pages has no boilerplate.
MIN_PAGES = 5
#: Lines in the table up to which it is broadcast (at most 32 bytes each).
BROADCAST_LINES = 100_000
SALTS = 64


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(29), line).alias("b"))


def _has_word(line: Column) -> Column:
    return line.rlike(rf"[^{SPACE}]")


def _line_keys(text: Column) -> Column:
    """The text's distinct lines that have a word."""
    return F.array_distinct(F.transform(F.filter(_lines(text), _has_word), _key))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, by_content: bool = False) -> DataFrame:
    """host, line (a pair of hashes), n, pages for every line beyond the ratio."""
    each = docs.select(F.col(host_col).alias("host"), _key(F.col(text_col)).alias("page"), _line_keys(F.col(text_col)).alias("keys"))
    if by_content:
        each = each.distinct()  # the keys follow from the page; copies are folded in the map task
    pages = each.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    seen = each.select("host", F.explode("keys").alias("line"))
    # hosts without any page of min_pages equal lines fall out before the join
    counts = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    counts = counts.select(F.col("host").alias("h"), "line", "n")
    return counts.join(pages, F.col("h").eqNullSafe(F.col("host"))).filter(F.col("n") > ratio * F.col("pages")).select("host", "line", "n", "pages")


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES, by_content: bool = False, lines_col: str = "n_lines", dropped_col: str = "n_dropped") -> DataFrame:
    """docs with boilerplate lines gone from the text, and how many lines it had (lines_col) and lost (dropped_col) added;
    columns of docs under these two names are replaced, all others stay as they are."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in (lines_col.lower(), dropped_col.lower())))
    bad, host, salt, of, kept_col = free_names([*docs.columns, lines_col, dropped_col], "bad", "host", "salt", "of", "kept")
    found = staged(boilerplate(docs, host_col, text_col, ratio, min_pages, by_content), "boilerplate")
    small = found.count() <= broadcast_lines
    per_host = found.groupBy(F.col("host").alias(host)).agg(F.collect_set("line").alias(bad))
    match = F.col(host_col).eqNullSafe(F.col(host))
    if small:
        joined = docs.join(F.broadcast(per_host), match, "left")
    else:
        salted = docs.withColumn(salt, F.pmod(F.xxhash64(text_col), F.lit(SALTS)))
        copies = per_host.withColumn(of, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, match & (F.col(salt) == F.col(of)), "left").drop(salt, of)
    lines = _lines(F.col(text_col))
    kept = F.when(F.col(bad).isNull(), lines).otherwise(F.filter(lines, lambda x: ~(_has_word(x) & F.array_contains(F.col(bad), _key(x)))))
    out = joined.withColumn(kept_col, kept).withColumn(lines_col, F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    out = out.withColumn(dropped_col, F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.col(lines_col) - F.size(kept_col)).cast("long"))
    return out.withColumn(text_col, F.array_join(kept_col, "\n")).drop(kept_col, bad, host)
