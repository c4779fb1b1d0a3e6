"""Ordered search patterns and redaction items, checked at the edge."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

ITEM = "id string, doc_id long, page int, text string, category string, rect array<double>"


class BadPatterns(ValueError):
    """The patterns are not an object of non-empty strings."""


def load_patterns(raw: str | dict) -> list[tuple[str, str]]:
    """(category, pattern) in the object's order, which decides who wins. Raises before any job starts."""
    found = json.loads(raw) if isinstance(raw, str) else raw
    if not isinstance(found, dict):
        raise BadPatterns("patterns must be an object")
    for category, pattern in found.items():
        if not isinstance(pattern, str) or not pattern:
            raise BadPatterns(f"pattern of {category} must be a non-empty string")
    return list(found.items())


def valid_patterns(spark: SparkSession, patterns: list[tuple[str, str]]) -> tuple[list[tuple[int, str, str]], list[tuple[str, str]]]:
    """(order, category, pattern) of those that compile, and (category, message) of the others, which harm no one else.

    Named groups and references to them are written the JVM's way first, and classes such as \\d, \\w and \\b hold for all
    of Unicode.
    """
    good, bad = [], []
    for k, (category, pattern) in enumerate(patterns):
        translated = "(?U)" + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))
        try:
            spark._jvm.java.util.regex.Pattern.compile(translated)
            good.append((k, category, translated))
        except Exception as e:  # the gateway's error carries the JVM's message
            bad.append((category, str(e.java_exception.getDescription()) if hasattr(e, "java_exception") else str(e)))
    return good, bad


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSON array or of lines; a malformed row fails the read."""
    return spark.read.schema(ITEM).option("mode", "FAILFAST").option("multiLine", True).json(path)


def checked_items(raw: str) -> list[dict]:
    """Items of a JSON text. Raises before any job starts if it is not an array of objects."""
    found = json.loads(raw)
    if not isinstance(found, list) or not all(isinstance(x, dict) for x in found):
        raise ValueError("items must be an array of objects")
    return found


def write_json(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Lines of JSON; with order (say doc_id, ord, start) sorted by it throughout, a sort that only the sink asks for."""
    (df.orderBy(*order) if order else df).write.mode("errorifexists").json(path)


def read_or_skip(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON file, those that can't be read left out."""
    rows = spark.read.schema(f"{schema}, _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.filter("_broken IS NULL").drop("_broken")


BENCH = "mode string, file string, level_asked string, http int, status string, level string, bytes long, seconds double"


def read_bench(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BENCH).option("header", True).option("mode", "FAILFAST").csv(path)


def write_bench(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)
