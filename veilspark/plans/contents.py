"""Registered queries over what documents hold: application and report, hidden text, strings beside the pages, images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import policy
from veilspark.functions.paths import path_rects
from veilspark.functions.text import norm, rounded
from veilspark.operators import areas, images, markers, redact, structures, verify, zones
from veilspark.operators.fills import touched_fills
from veilspark.operators.frontier import blanked, flattened, reachable
from veilspark.operators.search import with_hits
from veilspark.plans import fixtures as fx
from veilspark.plans.fixtures import table
from veilspark.plans.queries import _places, _with_hits, query
from veilspark.sources.patterns import load_patterns, valid_patterns


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _with_hits(spark, sf_dir).select("doc_id", F.explode("hits.value").alias("value"))
    return values.select("doc_id", norm(F.col("value")).alias("term")).filter(F.length("term") >= redact.LEAST_TERM).distinct()


_HELD = f"{fx.FINDINGS_SQL}, {fx.TERMS_SQL}, {fx.DENSE_SQL}, {fx.STRINGS_SQL}, {fx.HELD_SQL}"
_CLEANED = (
    f"{_HELD}, ruled AS (SELECT s.*, sum((location = 'layer_name')::INT) OVER (PARTITION BY s.doc_id ORDER BY s.place) AS nth, CASE WHEN location = 'associated_file' THEN 'removed' WHEN h.place IS NULL THEN NULL WHEN location = 'layer_name' THEN 'renamed' WHEN location = 'outline_target' THEN 'retargeted'"
    " WHEN location IN ('layer_config', 'page_label', 'struct_text') THEN 'blanked' WHEN location IN ('named_dest', 'thread_info', 'open_action', 'additional_action', 'piece_info') THEN 'removed' END AS change FROM strings s LEFT JOIN held h ON h.doc_id = s.doc_id AND h.place = s.place)"
)


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.cleaned(fx.strings(spark, sf_dir), _terms(spark, sf_dir), fx.OURS)


@query(f"WITH {_CLEANED} SELECT doc_id, place, location, change, CASE WHEN change IS NULL THEN md5(text) WHEN change = 'renamed' THEN 'Capa ' || nth WHEN change = 'blanked' THEN '' WHEN change = 'retargeted' AND target_page >= 1 THEN 'page ' || target_page END AS text FROM ruled")
def structure_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each string beside the pages: layers, outline targets, destinations, labels, threads, actions."""
    done = _cleaned(spark, sf_dir)
    return done.withColumn("text", F.when(F.col("change").isNull(), F.md5("text")).otherwise(F.col("text")))


@query(f"WITH {_CLEANED} SELECT doc_id, count(*) FILTER (change = 'removed') AS n_removed, count(*) FILTER (change <> 'removed') AS n_changed FROM ruled GROUP BY doc_id")
def structure_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.changes(_cleaned(spark, sf_dir))


@query(f"WITH {_HELD} SELECT DISTINCT s.doc_id FROM strings s JOIN held USING (doc_id, place) WHERE s.text IS NOT NULL AND s.location <> 'font' AND s.place % 13 <> 5")
def term_match_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which a term is left in a string that can be read, dashes and white space not counted."""
    strings = fx.strings(spark, sf_dir)
    return structures.leftover(strings, _terms(spark, sf_dir), strings.filter("place % 13 = 5").select("doc_id", "place"), fx.OURS)


@query(
    f"WITH {fx.WORDS_SQL}, {fx.FINDINGS_SQL}, {fx.TERMS_SQL}, everything AS (SELECT *, 0 AS copy FROM words UNION ALL SELECT *, 1 FROM words WHERE pos % 11 = 0), numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, word, x0, y0 ORDER BY pos, copy) AS n FROM everything), seen AS (SELECT doc_id, word, x0, y0, count(*) AS times FROM words WHERE pos % 7 <> 3 GROUP BY ALL),"
    f" hidden AS (SELECT doc_id, page, pos * 2 + copy AS pos, a.word, {fx.NORM_SQL.format('a.word')} AS n FROM numbered a LEFT JOIN seen USING (doc_id, word, x0, y0) WHERE n > coalesce(times, 0)),"
    " placed AS (SELECT *, sum(length(n) + 1) OVER (PARTITION BY doc_id, page ORDER BY pos) - length(n) AS start FROM hidden), lines AS (SELECT doc_id, page, string_agg(n, ' ' ORDER BY pos) AS line FROM hidden GROUP BY doc_id, page),"
    " spots AS (SELECT l.doc_id, page, unnest(list_filter(range(1, length(line) - length(term) + 2), lambda i: substring(line, i, length(term)) = term)) AS at, length(term) AS n_term FROM lines l JOIN terms t ON l.doc_id = t.doc_id AND contains(line, term))"
    " SELECT DISTINCT p.doc_id, p.page, p.pos, p.word FROM placed p JOIN spots s ON p.doc_id = s.doc_id AND p.page = s.page AND p.start < s.at + s.n_term AND s.at < p.start + length(p.n) + 1"
)
def hidden_term_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are not seen and that a term runs through."""
    words = fx.words(spark, sf_dir, dealt=True)
    everything = words.withColumn("copy", F.lit(0)).unionByName(words.filter("pos % 11 = 0").withColumn("copy", F.lit(1)))
    hidden = zones.multiset_minus(everything, words.filter("pos % 7 <> 3"), ["doc_id", "word", "x0", "y0"], ["pos", "copy"])
    return redact.hidden_term_words(hidden.withColumn("pos", F.col("pos") * 2 + F.col("copy")), _terms(spark, sf_dir))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as items, some of them with a span that can't be masked, and a zone drawn by hand on every text."""
    found = _with_hits(spark, sf_dir)

    def item(kind, category, text, start, end):
        return F.struct(F.concat_ws("-", "doc_id", *kind).alias("id"), category.alias("category"), text.alias("text"), start.alias("start"), end.alias("end"))

    hits = F.transform("hits", lambda h: F.transform(h["starts"], lambda at: item((h["ord"], at), h["category"], h["value"], F.when(at % 23 == 7, -1).otherwise(at), at + F.length(h["value"]))))
    hand = item((F.lit("hand"),), F.lit(redact.BY_HAND), F.lit("label"), F.lit(0), F.least(F.lit(9), F.length("text")))
    every = F.concat(F.flatten(hits), F.when(F.col("text").isNotNull(), F.array(hand)).otherwise(F.array().cast("array<struct<id:string,category:string,text:string,start:int,end:int>>")))
    return found.select("doc_id", F.explode(every).alias("i")).select("doc_id", "i.*")


@query(
    f"WITH {fx.FINDINGS_SQL}, items AS (SELECT doc_id, doc_id || '-' || ord || '-' || start::BIGINT AS id, category, value AS text, CASE WHEN start % 23 = 7 THEN -1 ELSE start END::BIGINT AS s, (start + length(value))::BIGINT AS e FROM findings UNION ALL SELECT doc_id, doc_id || '-hand', 'Censura Manual', 'label', 0, least(9, length(text)) FROM documents WHERE text IS NOT NULL),"
    " checked AS (SELECT i.*, d.text AS page, CASE WHEN s >= e THEN 'span inverted or empty' WHEN s < 0 OR e > length(d.text) THEN 'span off the page' END AS error FROM items i JOIN documents d USING (doc_id)), good AS (SELECT * FROM checked WHERE error IS NULL),"
    f" terms AS (SELECT doc_id, {fx.NORM_SQL.format('text')} AS term FROM items WHERE category <> 'Censura Manual' UNION SELECT doc_id, {fx.NORM_SQL.format('substring(page, s + 1, e - s)')} FROM good),"
    f" places AS (SELECT doc_id, 'outline' AS kind, {fx.NORM_SQL.format('string_split(text, chr(10))[1]')} AS t FROM documents UNION ALL SELECT doc_id, 'metadata_info', {fx.NORM_SQL.format('string_split(text, chr(10))[-1]')} FROM documents),"
    " kinds AS (SELECT doc_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS leaks FROM places JOIN terms USING (doc_id) WHERE length(term) >= 3 AND contains(t, term) GROUP BY doc_id),"
    " counts AS (SELECT doc_id, count(*) FILTER (error IS NULL) AS applied, count(error) AS n_failed, coalesce(string_agg(error, ' | ' ORDER BY id, error) FILTER (error IS NOT NULL), '') AS messages FROM checked GROUP BY doc_id),"
    " hidden AS (SELECT doc_id, list(DISTINCT spot) AS spots FROM (SELECT doc_id, unnest(range(s, e)) AS spot FROM good) GROUP BY doc_id),"
    " done AS (SELECT doc_id, md5(string_agg(CASE WHEN list_contains(spots, i - 1) THEN '█' ELSE substring(text, i::BIGINT, 1) END, '' ORDER BY i)) AS text FROM (SELECT doc_id, text, spots, unnest(range(1, length(text) + 1)) AS i FROM documents JOIN hidden USING (doc_id)) GROUP BY doc_id)"
    " SELECT d.doc_id, k.leaks IS NULL AS verified, coalesce(k.leaks, '') AS leaks, coalesce(c.applied, 0) AS applied, coalesce(c.n_failed, 0) AS n_failed, coalesce(c.messages, '') AS messages, CASE WHEN k.leaks IS NULL AND coalesce(c.n_failed, 0) = 0 THEN coalesce(o.text, md5(d.text)) END AS delivered"
    " FROM documents d LEFT JOIN kinds k USING (doc_id) LEFT JOIN counts c USING (doc_id) LEFT JOIN done o USING (doc_id)"
)
def apply_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items masked, verified and reported; a document with a leak or a failed item is not delivered."""
    docs = table(spark, sf_dir, "documents")
    done = redact.apply(docs, _items(spark, sf_dir), _places(docs))
    messages = F.array_join(F.transform("report.failed", lambda f: f["error"]), " | ")
    return done.select("doc_id", "report.verified", F.array_join("report.leaks", ",").alias("leaks"), "report.applied", F.size("report.failed").alias("n_failed"), messages.alias("messages"), F.md5("text").alias("delivered"))


@query(
    f"WITH RECURSIVE {fx.STRINGS_SQL}, edges AS (SELECT doc_id, place // 2 AS src, CASE WHEN place % 5 = 3 THEN 'Parent' ELSE 'Kids' END AS key, place AS dst FROM strings), reach AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS node FROM strings UNION SELECT e.doc_id, e.dst FROM reach r JOIN edges e ON e.doc_id = r.doc_id AND e.src = r.node WHERE e.key <> 'Parent')"
    f" SELECT s.doc_id, bool_or(contains({fx.NORM_SQL.format('text')}, 'than')) AS has_term, count(*) AS n_strings FROM reach r JOIN strings s ON s.doc_id = r.doc_id AND s.place = r.node GROUP BY s.doc_id"
)
def subtree_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any string that the root reaches holds a term."""
    strings, place = fx.strings(spark, sf_dir), F.col("place").cast("long")
    edges = strings.select("doc_id", F.floor(place / 2).alias("src"), F.when(place % 5 == 3, "Parent").otherwise("Kids").alias("key"), place.alias("dst"))
    inside = reachable(edges).join(strings.select("doc_id", place.alias("node"), F.contains(norm(F.col("text")), F.lit("than")).alias("hit")), ["doc_id", "node"])
    return inside.groupBy("doc_id").agg(F.bool_or("hit").alias("has_term"), F.count(F.lit(1)).alias("n_strings"))


@query(
    f"WITH RECURSIVE {fx.STRINGS_SQL}, edges AS (SELECT doc_id, place // 2 AS src, CASE WHEN place % 5 = 3 THEN 'Parent' ELSE 'Kids' END AS key, place AS dst FROM strings), reach AS (SELECT DISTINCT doc_id, CAST(1 AS BIGINT) AS node FROM strings UNION SELECT e.doc_id, e.dst FROM reach r JOIN edges e ON e.doc_id = r.doc_id AND e.src = r.node WHERE e.key <> 'Parent')"
    f" SELECT s.doc_id, place AS node, r.node IS NOT NULL AND contains({fx.NORM_SQL.format('text')}, 'than') AS blank, CASE WHEN blank THEN '' ELSE md5(text) END AS text FROM strings s LEFT JOIN reach r ON s.doc_id = r.doc_id AND s.place = r.node"
)
def subtree_blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings below object 1 that hold a term become empty; all others stay."""
    strings, place = fx.strings(spark, sf_dir), F.col("place").cast("long")
    edges = strings.select("doc_id", F.floor(place / 2).alias("src"), F.when(place % 5 == 3, "Parent").otherwise("Kids").alias("key"), place.alias("dst"))
    roots = strings.select("doc_id").distinct().withColumn("node", F.lit(1).cast("long"))
    own = strings.select("doc_id", place.alias("node"), "text")
    done = blanked(own, own.filter(F.contains(norm(F.col("text")), F.lit("than"))), reachable(edges, roots=roots))
    return done.select("doc_id", "node", "blank", F.when(F.col("blank"), "").otherwise(F.md5("text")).alias("text"))


@query(
    f"WITH RECURSIVE lines AS (SELECT doc_id, i - 1 AS i, contains({fx.NORM_SQL.format('l[i]')}, 'than') AS gone FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),"
    " nodes AS (SELECT DISTINCT doc_id, i // 3 AS node, CASE WHEN i >= 3 THEN (i // 3 - 1) // 2 END AS parent, 1 - (i // 3 + 1) % 2 AS nth FROM lines),"
    " tree AS (SELECT doc_id, node, CAST([] AS BIGINT[]) AS path FROM nodes WHERE parent IS NULL UNION ALL SELECT n.doc_id, n.node, list_append(t.path, n.nth) FROM tree t JOIN nodes n ON n.doc_id = t.doc_id AND n.parent = t.node),"
    " rewritten AS (SELECT doc_id, bool_or(gone) AS rewritten FROM lines GROUP BY doc_id)"
    " SELECT doc_id, node, i % 3 AS place, rewritten, CASE WHEN rewritten THEN row_number() OVER (PARTITION BY doc_id ORDER BY list_concat(path, [4611686018427387904, i % 3])) END AS position"
    " FROM lines JOIN rewritten USING (doc_id) JOIN tree t USING (doc_id) WHERE t.node = i // 3 AND NOT gone"
)
def name_tree_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of name trees in the tree's order, those with a term left out; a text's lines are three to a node."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    node = F.floor(F.col("i") / 3)
    entries = lines.select("doc_id", node.alias("node"), (F.col("i") % 3).alias("place"), F.contains(norm(F.col("line")), F.lit("than")).alias("gone"))
    nodes = entries.select("doc_id", "node").distinct().select("doc_id", "node", F.when(F.col("node") > 0, F.floor((F.col("node") - 1) / 2)).alias("parent"), (1 - (F.col("node") + 1) % 2).alias("nth"))
    return flattened(nodes, entries, entries.filter("gone"))


_FILLS = (
    f"WITH RECURSIVE {fx.WORDS_SQL}, log AS (SELECT doc_id, pos, pos * 37 % 100 AS x0, pos * 37 % 100 + 8 + pos % 9 AS x1, pos // 10 * 10 + pos * 7 % 25 AS y0, pos // 10 * 10 + pos * 7 % 25 + 6 + pos % 5 AS y1 FROM words),"
    " pages AS (SELECT doc_id, max(y1) AS y1 FROM log GROUP BY doc_id), fills AS (SELECT * FROM log WHERE pos % 4 = 1 AND x0 < 60), shown AS (SELECT * FROM log WHERE pos % 11 <> 5 AND x1 > 60),"
    " meets AS (SELECT f.doc_id, f.pos AS fill, s.pos AS entry FROM fills f JOIN shown s ON f.doc_id = s.doc_id AND f.x0 < s.x1 AND s.x0 < f.x1 AND f.y0 < s.y1 AND s.y0 < f.y1 AND f.pos <> s.pos),"
    " over AS (SELECT m.doc_id, m.fill FROM meets m WHERE entry < fill AND NOT EXISTS (SELECT 1 FROM fills f WHERE f.doc_id = m.doc_id AND f.pos = m.entry) UNION SELECT m.doc_id, m.fill FROM over o JOIN meets m ON m.doc_id = o.doc_id AND m.entry = o.fill AND m.entry < m.fill)"
    " SELECT f.doc_id, 0 AS page, f.pos AS seqno, o.fill IS NOT NULL AS over, o.fill IS NOT NULL AND EXISTS (SELECT 1 FROM meets m WHERE m.doc_id = f.doc_id AND m.fill = f.pos AND m.entry > f.pos) AS later FROM fills f LEFT JOIN over o ON o.doc_id = f.doc_id AND o.fill = f.pos"
)


@query(_FILLS)
def fills_paint_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills that touch a zone over the left part of a page, by what they hid: every word is painted somewhere near its line."""
    pos = F.col("pos")
    x0, y0 = pos * 37 % 100, F.floor(pos / 10) * 10 + pos * 7 % 25
    kind = F.when(pos % 11 == 5, "ignore-text").when(pos % 4 == 1, "fill-path").otherwise("fill-text")
    log = fx.words(spark, sf_dir, dealt=True).select("doc_id", "page", pos.alias("seqno"), kind.alias("kind"), x0.alias("x0"), y0.alias("y0"), (x0 + 8 + pos % 9).alias("x1"), (y0 + 6 + pos % 5).alias("y1"))
    zones_ = log.groupBy("doc_id", "page").agg(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(60).alias("x1"), F.max("y1").alias("y1"))
    return touched_fills(log, log.filter("seqno % 4 = 1"), zones_)


_CONTEXT = "'...' || regexp_replace(replace(substring(text, greatest(start - 30, 0)::BIGINT + 1, (start + length(value) + 30 - greatest(start - 30, 0))::BIGINT), chr(10), ' '), '^\\s+|\\s+$', '', 'g') || '...'"
_UNTIL = rf"len(regexp_extract_all(substring(text, 1, ({{0}})::BIGINT), '{fx.WORD}')) - 1"


@query(
    f"WITH {fx.WORDS_SQL}, {fx.findings_sql(fx.PHRASES)}, spans AS (SELECT *, {_UNTIL.format('start + 1')} AS first, {_UNTIL.format('start + length(value)')} AS last, {_CONTEXT} AS context FROM findings),"
    " lines AS (SELECT s.doc_id, page, category, value, nth, y0, min(x0) AS x0, max(x1) AS x1, max(y1) AS y1 FROM spans s JOIN words w ON w.doc_id = s.doc_id AND w.pos BETWEEN first AND last GROUP BY ALL),"
    " numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, value ORDER BY nth, y0) - 1 AS k FROM lines)"
    " SELECT n.doc_id, page, n.category, n.value, k, x0, y0, x1, y1, coalesce(context, '......') AS context FROM numbered n LEFT JOIN spans s ON s.doc_id = n.doc_id AND s.value = n.value AND s.nth = n.k"
    " QUALIFY row_number() OVER (PARTITION BY n.doc_id, page, n.value, x0, y0, x1, y1 ORDER BY k) = 1"
)
def search_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with page and rectangles; ten words are a line."""
    docs = fx.deal(table(spark, sf_dir, "documents")).select("doc_id", F.lit(0).alias("page"), "text")
    found = with_hits(docs, valid_patterns(spark, load_patterns(fx.PHRASES))[0])
    return areas.areas(found, fx.words(spark, sf_dir, dealt=True)).select("doc_id", "page", "category", "value", "k", "x0", "y0", "x1", "y1", "context")


@query(f"WITH {fx.IMAGES_SQL} SELECT file, xref FROM images QUALIFY count(*) OVER (PARTITION BY file, width, height, bits) > 1")
def image_ambiguous_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.ambiguous(fx.images(spark, sf_dir)).select("file", "xref")


@query(f"WITH {fx.IMAGES_SQL} SELECT file, xref FROM images i WHERE NOT EXISTS (SELECT 1 FROM images m WHERE m.file = i.file AND m.mask = i.xref)")
def image_without_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.without_masks(fx.images(spark, sf_dir)).select("file", "xref")


@query(
    f"WITH {fx.IMAGES_SQL}, g AS (SELECT *, row_number() OVER (PARTITION BY file, width, place ORDER BY xref) AS n FROM images WHERE xref <= 4), c AS (SELECT *, row_number() OVER (PARTITION BY file, width, place ORDER BY xref) AS n FROM images WHERE xref > 4), near AS (SELECT c.file, c.xref AS copy, g.xref AS original FROM c JOIN g ON c.file = g.file AND c.width = g.width AND c.place = g.place AND c.n = g.n),"
    " g2 AS (SELECT *, row_number() OVER (PARTITION BY file, width ORDER BY xref) AS m FROM g WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.file = g.file AND near.original = g.xref)), c2 AS (SELECT *, row_number() OVER (PARTITION BY file, width ORDER BY xref) AS m FROM c WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.file = c.file AND near.copy = c.xref))"
    " SELECT * FROM near UNION ALL SELECT c2.file, c2.xref, g2.xref FROM c2 JOIN g2 ON c2.file = g2.file AND c2.width = g2.width AND c2.m = g2.m"
)
def image_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = fx.images(spark, sf_dir)
    return images.matched(every.filter("xref > 4"), every.filter("xref <= 4"))


@query(
    f"WITH {fx.IMAGES_SQL}, k AS (SELECT file, xref, 0 AS ordinal, 'tables' AS encoding, size FROM images UNION ALL SELECT file, xref, 1, 'quality', CASE WHEN xref % 3 = 0 THEN size WHEN xref % 3 = 1 THEN size - file % 5 + 2 END FROM images) SELECT file, xref, arg_min(encoding, size * 10 + ordinal) AS chosen, min(size) AS size FROM k WHERE size IS NOT NULL GROUP BY file, xref"
)
def image_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smaller of two encodings, the first one when they are equal."""
    every, third = fx.images(spark, sf_dir), F.col("xref") % 3
    one = every.select("file", "xref", F.lit(0).alias("ordinal"), F.lit("tables").alias("encoding"), "size")
    two = every.select("file", "xref", F.lit(1).alias("ordinal"), F.lit("quality").alias("encoding"), F.when(third == 0, F.col("size")).when(third == 1, F.col("size") - F.col("file") % 5 + 2).alias("size"))
    return images.smallest(one.unionByName(two))


@query(
    "WITH r AS (SELECT p_partkey AS k, [1, 8, 8, 4][1 + p_partkey % 4] AS bits, p_size AS colors, [1, 3, 4, 2][1 + p_partkey % 7 % 4] AS n, CASE WHEN p_partkey % 3 = 0 THEN 'JPXDecode' WHEN p_partkey % 3 = 1 THEN 'DCTDecode' ELSE 'FlateDecode' END AS enc, CASE WHEN p_partkey % 5 = 0 THEN false WHEN p_partkey % 5 = 1 THEN true END AS rev, 100 + p_partkey % 90 AS lossless, CASE WHEN p_partkey % 11 <> 0 THEN 90 END AS original, 120 + p_partkey % 40 AS flate, p_partkey % 2 = 0 AS tables FROM part)"
    " SELECT k AS p_partkey, CASE WHEN bits = 1 THEN 'g4' WHEN bits <> 8 OR enc = 'FlateDecode' OR n = 2 OR colors <= 16 THEN 'flate' WHEN enc = 'JPXDecode' THEN CASE WHEN rev IS DISTINCT FROM false AND (original IS NULL OR lossless <= 1.5 * original) THEN CASE WHEN lossless < flate THEN 'jpx_lossless' ELSE 'flate' END WHEN rev IS DISTINCT FROM false THEN 'jpx_5_3_at_rate' ELSE 'jpx_9_7_at_rate' END"
    " WHEN tables THEN 'jpeg_tables' WHEN n = 4 THEN 'flate' ELSE 'jpeg_quality' END AS stored FROM r"
)
def recompression_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), by.cast("int"))
    encoding = pick(["JPXDecode", "DCTDecode", "FlateDecode"], key % 3)
    reversible = F.when(key % 5 == 0, False).when(key % 5 == 1, True)
    stored = policy.recompression(pick([1, 8, 8, 4], key % 4), F.col("p_size"), pick([1, 3, 4, 2], key % 7 % 4), encoding, reversible, 100 + key % 90, F.when(key % 11 != 0, 90), 120 + key % 40, key % 2 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", stored.alias("stored"))


@query(f"WITH {fx.ZONES_SQL} SELECT doc_id, zone_id FROM (SELECT doc_id, doc_id % 90 AS x0, doc_id % 37 AS y0, doc_id % 90 + 10 AS x1, doc_id % 37 + 6 AS y1 FROM documents), zones WHERE {fx.TOUCH_SQL.format(m=0)}")
def zones_with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    boxes = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page"), (d % 90).alias("x0"), (d % 37).alias("y0"), (d % 90 + 10).alias("x1"), (d % 37 + 6).alias("y1"))
    return zones.zones_with_boxes(fx.zones(spark, sf_dir), boxes).select("doc_id", "zone_id")


@query("SELECT p_brand, p_size, count(*) AS n_missing FROM (SELECT p_brand, p_size FROM part EXCEPT ALL SELECT p_brand, p_size FROM part WHERE p_partkey % 3 <> 0) GROUP BY p_brand, p_size")
def missing_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills that were saved and are not there any more, counting how often each was."""
    saved = table(spark, sf_dir, "part")
    return verify.missing(saved, saved.filter("p_partkey % 3 <> 0"), ["p_brand", "p_size"])


@query("SELECT l_orderkey, l_linenumber, CAST(printf('%.1f', l_quantity / 20) AS DOUBLE) AS x, CAST(printf('%.1f', l_extendedprice / 7) AS DOUBLE) AS y FROM lineitem")
def coordinate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rounded(F.col("l_quantity") / 20, 1).alias("x"), rounded(F.col("l_extendedprice") / 7, 1).alias("y"))


@query(
    "WITH i AS (SELECT l_orderkey AS file, l_linenumber AS xref, l_partkey AS p, CASE WHEN l_partkey % 97 = 0 THEN 99 ELSE 8 - l_linenumber END AS id FROM lineitem), o AS (SELECT l_orderkey AS file, 8 - l_linenumber AS xref, l_suppkey % 7 <> 3 AS image FROM lineitem),"
    " m AS (SELECT i.file, i.xref, i.id, coalesce(o.image, false) AS fits FROM i LEFT JOIN o ON o.file = i.file AND o.xref = i.id WHERE p % 3 = 0),"
    " bad AS (SELECT file FROM m WHERE NOT fits UNION SELECT l_orderkey FROM lineitem WHERE l_partkey % 211 = 5)"
    " SELECT file, xref, CAST(id AS BIGINT) AS original, '50644371' || printf('%08X', id) || translate('50644371' || printf('%08X', id), '0123456789ABCDEF', 'FEDCBA9876543210') AS marker FROM m WHERE file NOT IN (SELECT file FROM bad)"
)
def marker_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers replaced by their originals; files with a marker that names no image, or with one left in a stream, are withheld."""
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    lines = table(spark, sf_dir, "lineitem")
    code = markers.marker(F.when(part % 97 == 0, 99).otherwise(8 - line))
    upside_down = F.unhex(F.translate(F.hex(code), "0123456789ABCDEF", "FEDCBA9876543210"))
    data = F.when(part % 3 != 0, F.encode(F.lit("a mask of its own"), "UTF-8")).when(part % 5 == 0, upside_down).otherwise(code)
    held = lines.select(F.col("l_orderkey").alias("file"), line.alias("xref"), F.lit(True).alias("mask"), F.lit(markers.WIDTH).alias("width"), F.lit(markers.HEIGHT).alias("height"), data.alias("data"))
    originals = lines.select(F.col("l_orderkey").alias("file"), (8 - line).alias("xref"), (F.col("l_suppkey") % 7 != 3).alias("image"))
    stream = F.when(part % 211 == 5, F.concat(F.encode(F.lit("q "), "UTF-8"), markers.marker(line))).otherwise(F.encode(F.lit("q Q"), "UTF-8"))
    done, _ = markers.restored(held, originals, lines.select(F.col("l_orderkey").alias("file"), stream.alias("data")))
    return done.select("file", "xref", "original", F.hex(markers.marker(F.col("original"))).alias("marker"))


@query(
    "WITH r AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey % 6 AS kind, CAST(l_partkey % 50 AS DOUBLE) AS x, CAST(l_suppkey % 40 AS DOUBLE) AS y, l_quantity AS w, CAST(l_linenumber AS DOUBLE) AS h FROM lineitem)"
    " SELECT o AS l_orderkey, n AS l_linenumber, CASE kind WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 5 THEN 1 END AS n_rects, CASE kind WHEN 0 THEN x + w + 5 + w WHEN 1 THEN x + w WHEN 2 THEN x + w WHEN 5 THEN x + w END AS right_edge FROM r"
)
def path_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of paths: two rectangles, a quadrangle, four lines, a slanting quadrangle, curves, three lines."""
    kind = F.col("l_partkey") % 6
    x, y = (F.col("l_partkey") % 50).cast("double"), (F.col("l_suppkey") % 40).cast("double")
    w, h = F.col("l_quantity"), F.col("l_linenumber").cast("double")

    def item(op: str, *points):
        return F.struct(F.lit(op).alias("op"), F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in points)).alias("points"))

    a, b, c, d = (x, y), (x + w, y), (x + w, y + h), (x, y + h)
    lines = [item("l", a, b), item("l", b, c), item("l", c, d), item("l", d, a)]
    path = (
        F.when(kind == 0, F.array(item("re", a, c), item("re", c, (x + w + 5 + w, y + h + h)))).when(kind == 1, F.array(item("qu", a, b, d, c))).when(kind == 2, F.array(*lines))
        .when(kind == 3, F.array(item("qu", a, b, (x + 0.5, y + h), c))).when(kind == 4, F.array(item("c", a, b, c, d), lines[0])).otherwise(F.array(*lines[:3]))
    )
    rects = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", path_rects(path).alias("r"))
    return rects.select("l_orderkey", "l_linenumber", F.when(F.col("r").isNotNull(), F.size("r")).alias("n_rects"), F.element_at("r", -1)["x1"].alias("right_edge"))


_SPOTS = ["hidden_text", "form_field", "annotation", "link", "info", "xmp", "outline", "attachment", "form", "struct", "action", "piece"]


@query(
    f"WITH {fx.FINDINGS_SQL}, {fx.TERMS_SQL}, {fx.STRINGS_SQL}, spots AS (SELECT doc_id, place, {_SPOTS!r}[1 + (place * 7 + doc_id) % 12] AS location, text, {fx.NORM_SQL.format('text')} AS n, {fx.COMPACT_SQL.format('text')} AS c FROM strings),"
    f" hit AS (SELECT DISTINCT s.doc_id, CASE location WHEN 'form_field' THEN 'form_fields' WHEN 'annotation' THEN 'annotations' WHEN 'link' THEN 'links' WHEN 'info' THEN 'metadata_info' WHEN 'xmp' THEN 'metadata_xmp' WHEN 'attachment' THEN 'attachments' WHEN 'hidden_text' THEN location WHEN 'outline' THEN location ELSE 'pdf_objects' END AS kind"
    f" FROM spots s JOIN terms t ON s.doc_id = t.doc_id WHERE location <> 'form' AND text IS NOT NULL AND CASE WHEN location IN ('struct', 'action', 'piece') THEN length({fx.COMPACT_SQL.format('term')}) >= 3 AND contains(c, {fx.COMPACT_SQL.format('term')}) ELSE contains(n, term) END),"
    " every AS (SELECT * FROM hit UNION SELECT doc_id, 'form_fields' FROM spots WHERE location = 'form' AND place % 3 = 0 UNION SELECT doc_id, 'content_syntax' FROM documents WHERE doc_id % 37 = 5 UNION SELECT doc_id, 'nesting_depth' FROM strings WHERE place >= 32)"
    " SELECT doc_id, string_agg(kind, ',' ORDER BY kind) AS leaks FROM every GROUP BY doc_id"
)
def leak_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of leaks beside the pages: lines of texts stand for strings of twelve locations; objects below the fifth level fail."""
    strings, place = fx.strings(spark, sf_dir), F.col("place").cast("long")
    location = F.get(F.array(*map(F.lit, _SPOTS)), ((F.col("place") * 7 + F.col("doc_id")) % len(_SPOTS)).cast("int"))
    spots = strings.select("doc_id", "place", location.alias("location"), "text").filter("location <> 'form' OR place % 3 = 0")
    edges = strings.select("doc_id", F.floor(place / 2).alias("src"), F.lit("Kids").alias("key"), place.alias("dst"))
    deep = reachable(edges, max_depth=5).filter("node is null").select("doc_id")
    broken = table(spark, sf_dir, "documents").filter("doc_id % 37 = 5").select("doc_id")
    kinds = redact.leaks_by_location(spots, _terms(spark, sf_dir), fx.OURS, broken, deep)
    return kinds.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("kind")), ",").alias("leaks"))
