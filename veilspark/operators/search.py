"""Multi-pattern search: the first category wins a value, then every occurrence of the value is a finding.

A document's text is one page. All of a page's steps stay in its row, in arrays, until findings are exploded; nothing is
shuffled. Each pattern goes over a text once, and a value is looked up once per page however often it matched.

Defined results. Null text has no findings, and empty matches are none. Rows may repeat; each gives its own findings, under
the key columns that the caller names (doc_id unless told otherwise). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.text import context, quoted, strip_spaces
from veilspark.sources.patterns import valid_patterns

_STARTS = "array<int>"
_HIT = "array<struct<ord:int,category:string,value:string,starts:array<int>>>"


def _values(text: Column, pattern: str) -> Column:
    """The pattern's distinct stripped matches, in order."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), strip_spaces), lambda v: v != ""))


def with_hits(docs: DataFrame, patterns: list[tuple[int, str, str]], hits: str = "hits") -> DataFrame:
    """docs with an array of (ord, category, value, starts): each distinct value once, under the first pattern that found
    it, with the places of all its occurrences.

    The values of each pattern are a column of their own first, so that what the others found is a matter of columns. The
    filter on a row number keeps the optimizer from copying one pattern's search into every place that asks for its values.
    """
    text, own = F.col("text"), docs.columns
    prefix = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in own), default=0)) + "values"
    names = [f"{prefix}_{k}" for k in range(len(patterns))]
    values = (_values(text, p).alias(n) for n, (_, _, p) in zip(names, patterns, strict=True))
    found = docs.select(*own, *values, F.monotonically_increasing_id().alias(prefix)).filter(F.col(prefix) >= 0)
    parts = []
    for k, (order, category, _) in enumerate(patterns):
        new = F.col(names[k]) if k == 0 else F.array_except(names[k], F.concat(*names[:k]))
        parts.append(_hits(text, new, order, category))
    every = F.concat(*parts) if parts else F.array()
    return found.select(*own, F.coalesce(every.cast(_HIT), F.array().cast(_HIT)).alias(hits))


def _hits(text: Column, values: Column, order: int, category: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(order).alias("ord"), F.lit(category).alias("category"), v.alias("value"), occurrences(text, v).alias("starts")))


def occurrences(text: Column, value: Column) -> Column:
    """Starts of the value's occurrences, left to right without overlap."""
    gaps = F.split(text, quoted(value), -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_STARTS).alias("out"))

    def step(acc: Column, gap: Column) -> Column:
        start = acc["at"] + F.length(gap)
        return F.struct((start + F.length(value)).alias("at"), F.concat(acc["out"], F.array(start)).alias("out"))

    return F.aggregate(F.slice(gaps, F.lit(1), F.size(gaps) - 1), zero, step, lambda acc: acc["out"])


def search(docs: DataFrame, patterns: list[tuple[str, str]], keys: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(findings, errors). Findings: the keys, ord, category, value, nth, start, end, context."""
    good, bad = valid_patterns(docs.sparkSession, patterns)
    page = docs.select(*keys, "text").filter(F.col("text").isNotNull())
    return findings(with_hits(page, good), keys), bad


def findings(found: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Findings of a table with hits."""
    hits = found.select(*keys, "text", F.explode("hits").alias("hit"))
    each = hits.select(*keys, "text", "hit.ord", "hit.category", "hit.value", F.posexplode("hit.starts").alias("nth", "start"))
    end = F.col("start") + F.length("value")
    return each.select(*keys, "ord", "category", "value", "nth", "start", end.alias("end"), context(F.col("text"), F.col("start"), end).alias("context"))


def deduplicated(findings: DataFrame) -> DataFrame:
    """One finding for each place and value. Where several categories found it, the first stays."""
    first = F.min(F.struct("ord", "category", "nth", "context")).alias("m")
    return findings.groupBy("doc_id", "start", "end", "value").agg(first).select("doc_id", "start", "end", "value", "m.ord", "m.category")
