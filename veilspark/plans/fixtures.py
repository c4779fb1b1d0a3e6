"""Tables derived from the driver's, each with the same rule in SQL. They are ours, not observed data.

A document is one page (page 0). Words stand on a grid of ten to a line, in whole units; every page has two zones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.areas import WORD, page_words

#: Bytes of the documents' files for each part that they are dealt out to.
DEALT_BYTES = 2_000_000
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "long_number": r"[0-9]{6,}", "number": r"[0-9]{2,}"}
#: Zones of every page: id, x0, y0, x1, y1.
ZONES = [(0, 0, 0, 25, 15), (1, 40, 20, 75, 45)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deal(docs: DataFrame, size: int = DEALT_BYTES) -> DataFrame:
    """Documents dealt out by doc_id before they become words, which take many times the room of their text: what is joined,
    grouped or ranked by document then needs no other shuffle, and parts are small enough to be sorted in memory. The number of
    parts follows from the files' size, so deal a table before columns are chosen: what is derived from it then fits together. A setting of the session lets joins by
    document and more make use of it; it bears on shuffles only."""
    docs.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    n = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // size + 1)
    return docs.repartition(parts, "doc_id")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since the epoch to the nearest, halves away from it, as epoch_ms of the SQL; unix_millis rounds down."""
    us = F.unix_micros(ts.cast("timestamp"))
    ms = F.call_function("div", F.abs(us) + 500, F.lit(1000))
    return F.when(us < 0, -ms).otherwise(ms)


def words(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """doc_id, page, pos, word, x0, y0, x1, y1; dealt out by document, if what follows joins or groups by it."""
    docs = table(spark, sf_dir, "documents")
    split = page_words((deal(docs) if dealt else docs).select("doc_id", F.lit(0).alias("page"), "text"))
    x0, y0 = (F.col("pos") % 10) * 10, F.floor(F.col("pos") / 10).cast("int") * 10
    return split.select("doc_id", "page", "pos", "word", x0.alias("x0"), y0.alias("y0"), (x0 + 8).alias("x1"), (y0 + 8).alias("y1"))


WORDS_SQL = rf"""words AS (
  SELECT doc_id, 0 AS page, i - 1 AS pos, w[i] AS word, (i - 1) % 10 * 10 AS x0, (i - 1) // 10 * 10 AS y0, (i - 1) % 10 * 10 + 8 AS x1, (i - 1) // 10 * 10 + 8 AS y1
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS w FROM documents)))"""


def zones(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    each = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(z, ("zone_id", "x0", "y0", "x1", "y1"), strict=True))) for z in ZONES))).alias("z")
    docs = table(spark, sf_dir, "documents")
    return (deal(docs) if dealt else docs).select("doc_id", F.lit(0).alias("page"), each).select("doc_id", "page", "z.*")


ZONES_SQL = "zones(zone_id, zx0, zy0, zx1, zy1) AS (VALUES " + ", ".join(map(str, ZONES)) + ")"
CENTRE_SQL = "(x0 + x1) / 2.0 BETWEEN zx0 AND zx1 AND (y0 + y1) / 2.0 BETWEEN zy0 AND zy1"
TOUCH_SQL = "x0 < zx1 + {m} AND x1 > zx0 - {m} AND y0 < zy1 + {m} AND y1 > zy0 - {m}"

NORM_SQL = r"trim(regexp_replace(replace(lower(nfc_normalize(coalesce({0}, ''))), 'ß', 'ss'), '\s+', ' ', 'g'))"
COMPACT_SQL = r"regexp_replace(" + NORM_SQL + r", '[\s\x{{2010}}-\x{{2015}}\x{{2212}}\x{{AD}}-]+', '', 'g')"

#: Findings in SQL: distinct stripped matches in pattern order, the first category keeping a value; then occurrences.
def findings_sql(patterns: dict[str, str]) -> str:
    matched = " UNION ALL ".join(f"SELECT doc_id, {k} AS ord, '{c}' AS category, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents" for k, (c, p) in enumerate(patterns.items()))
    return f"""matched AS (
  {matched}
), won AS (
  SELECT doc_id, value, min(ord) AS ord, arg_min(category, ord) AS category FROM matched WHERE value <> '' GROUP BY doc_id, value
), cut AS (
  SELECT doc_id, ord, category, value, text, string_split(text, value) AS gaps FROM won JOIN documents USING (doc_id)
), findings AS (
  SELECT doc_id, ord, category, value, text, k - 1 AS nth, list_sum(list_transform(gaps[1:k], lambda g: length(g))) + (k - 1) * length(value) AS start
  FROM (SELECT *, unnest(range(1, len(gaps))) AS k FROM cut)
)"""


FINDINGS_SQL = findings_sql(PATTERNS)
#: Patterns whose matches are several words, so that some run over a line's end.
PHRASES = {"phrase": "[A-Z][a-z]+ th[a-z]+ [a-z]+", "pair": "th[a-z]+ [a-z]+", "number": "[0-9]{2,}"}


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four items a document, some of which can't be masked: bad page, inverted, not finite, off the page."""
    d, k = F.col("doc_id"), F.col("k")
    base = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    kind = (d + k) % 7
    x0 = F.when(kind == 3, F.lit(500.0)).when(kind == 4, F.lit(float("nan"))).otherwise((k * 10).cast("double"))
    return base.select(
        F.concat_ws("-", "doc_id", "k").alias("id"), "doc_id", F.when(kind == 1, -1).when(kind == 2, 5).otherwise(0).alias("page"),
        x0.alias("x0"), F.lit(5.0).alias("y0"), F.when(kind == 5, F.lit(0.0)).otherwise(x0 + 20).alias("x1"), F.lit(25.0).alias("y1"), ((d % 2) * 90).cast("int").alias("rotation"),
    )


ITEMS_SQL = """items AS (
  SELECT doc_id || '-' || k AS id, doc_id, CASE kind WHEN 1 THEN -1 WHEN 2 THEN 5 ELSE 0 END AS page, x0, 5.0 AS y0, CASE WHEN kind = 5 THEN 0.0 ELSE x0 + 20 END AS x1, 25.0 AS y1, doc_id % 2 * 90 AS rotation
  FROM (SELECT *, CASE kind WHEN 3 THEN 500.0 WHEN 4 THEN 'nan'::DOUBLE ELSE k * 10.0 END AS x0
        FROM (SELECT doc_id, k, (doc_id + k) % 7 AS kind FROM documents, range(4) r(k))))"""


#: Locations of the strings table, dealt out by place and document.
LOCATIONS = ["layer_name", "layer_config", "outline_target", "named_dest", "page_label", "thread_info", "open_action", "additional_action", "piece_info", "struct_text", "associated_file", "font", "other", "metadata"]
OURS = ["Written by the tool"]


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, place, location, text (null: can't be read), target_page: a string for each line."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    location = F.get(F.array(*map(F.lit, LOCATIONS)), ((F.col("place") * 5 + F.col("doc_id")) % len(LOCATIONS)).cast("int"))
    return lines.select("doc_id", "place", location.alias("location"), F.when(F.col("place") % 17 != 16, F.col("line")).alias("text"), (F.col("place") % 4).alias("target_page"))


STRINGS_SQL = f"""strings AS (
  SELECT doc_id, i - 1 AS place, {LOCATIONS!r}[1 + ((i - 1) * 5 + doc_id) % {len(LOCATIONS)}] AS location, CASE WHEN (i - 1) % 17 <> 16 THEN l[i] END AS text, (i - 1) % 4 AS target_page
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""
TERMS_SQL = f"terms AS (SELECT DISTINCT doc_id, {NORM_SQL.format('value')} AS term FROM findings WHERE length({NORM_SQL.format('value')}) >= 3)"
DENSE_SQL = f"dense AS (SELECT DISTINCT doc_id, t AS term FROM (SELECT doc_id, {COMPACT_SQL.format('term')} AS t FROM terms) WHERE length(t) >= 3)"
#: Strings that hold a term, white space and dashes not counted.
HELD_SQL = f"held AS (SELECT DISTINCT s.doc_id, s.place FROM (SELECT doc_id, place, {COMPACT_SQL.format('text')} AS c FROM strings) s JOIN dense d ON s.doc_id = d.doc_id AND contains(s.c, d.term) WHERE s.c <> '')"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, xref, width, height, bits, place, mask: an image for each line of an order."""
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file"), line.alias("xref"), (100 + F.col("l_partkey") % 2).alias("width"), F.lit(50).alias("height"), F.lit(8).alias("bits"),
        (F.col("l_suppkey") % 2).alias("place"), F.when(line % 3 == 0, line - 1).alias("mask"), F.floor("l_extendedprice").alias("size"),
    )


IMAGES_SQL = "images AS (SELECT l_orderkey AS file, l_linenumber AS xref, 100 + l_partkey % 2 AS width, 50 AS height, 8 AS bits, l_suppkey % 2 AS place, CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber - 1 END AS mask, CAST(floor(l_extendedprice) AS BIGINT) AS size FROM lineitem)"
