"""The registered queries of the core library with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import policy
from veilspark.functions.text import compact, norm, process_error, rounded
from veilspark.operators import outline, redact, verify, zones
from veilspark.operators.frontier import reachable
from veilspark.operators.once import computed_once
from veilspark.operators.search import deduplicated, search, with_hits
from veilspark.plans import fixtures as fx
from veilspark.plans.fixtures import table
from veilspark.sources.patterns import load_patterns, valid_patterns
from veilspark.streaming.limits import positions, rate_limited

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _findings(spark: SparkSession, sf_dir: str, patterns: dict[str, str] | None = None) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), load_patterns(patterns or fx.PATTERNS))[0]


def _with_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), valid_patterns(spark, load_patterns(fx.PATTERNS))[0])


@query(f"WITH {fx.FINDINGS_SQL} SELECT doc_id, value, nth, start FROM findings WHERE ord = 0")
def search_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir, {"email": fx.PATTERNS["email"]}).select("doc_id", "value", "nth", "start")


@query(f"WITH {fx.FINDINGS_SQL} SELECT doc_id, ord, category, value, nth, start FROM findings")
def search_multi_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("doc_id", "ord", "category", "value", "nth", "start")


@query(
    f"WITH {fx.FINDINGS_SQL} SELECT doc_id, value, start, '...' || regexp_replace(replace(substring(text, greatest(start - 30, 0)::BIGINT + 1, (start + length(value) + 30 - greatest(start - 30, 0))::BIGINT), chr(10), ' '), '^\\s+|\\s+$', '', 'g') || '...' AS context FROM findings"
)
def search_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("doc_id", "value", "start", "context")


@query(f"WITH {fx.FINDINGS_SQL} SELECT doc_id, start, value, min(ord) AS ord FROM findings GROUP BY doc_id, start, value")
def search_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(_findings(spark, sf_dir)).select("doc_id", "start", "value", "ord")


@query(f"WITH {fx.FINDINGS_SQL} SELECT 'broken' AS bad_category, (SELECT count(*) FROM findings WHERE ord = 0) AS n_findings")
def search_bad_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An invalid pattern is reported and the others go on."""
    found, errors = search(table(spark, sf_dir, "documents"), [("broken", "(unclosed"), ("email", fx.PATTERNS["email"])])
    return found.agg(F.count(F.lit(1)).alias("n_findings")).select(F.lit(",".join(c for c, _ in errors)).alias("bad_category"), "n_findings")


@query(f"SELECT doc_id, md5({fx.NORM_SQL.format('text')}) AS norm FROM documents")
def term_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(norm(F.col("text"))).alias("norm"))


@query(f"SELECT doc_id, md5({fx.COMPACT_SQL.format('text')}) AS compact FROM documents")
def term_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(compact(F.col("text"))).alias("compact"))


_UNDER_SQL = f"under AS (SELECT doc_id, page, zone_id, string_agg(word, ' ' ORDER BY pos) AS text FROM words, zones WHERE {fx.CENTRE_SQL} GROUP BY doc_id, page, zone_id)"


@query(f"WITH {fx.WORDS_SQL}, {fx.ZONES_SQL}, {_UNDER_SQL} SELECT * FROM under")
def zone_text_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.text_under_zones(fx.words(spark, sf_dir), fx.zones(spark, sf_dir))


@query(
    f"WITH {fx.WORDS_SQL}, {fx.ZONES_SQL}, {_UNDER_SQL}, {fx.FINDINGS_SQL} SELECT DISTINCT doc_id, term FROM (SELECT doc_id, {fx.NORM_SQL.format('value')} AS term FROM findings UNION ALL SELECT doc_id, {fx.NORM_SQL.format('text')} FROM under) WHERE length(term) >= 3"
)
def terms_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _with_hits(spark, sf_dir).select("doc_id", F.explode("hits").alias("h")).select("doc_id", F.col("h.value").alias("text"), "h.category")
    return redact.all_terms(items, zone_text_under(spark, sf_dir))


@query(
    f"WITH {fx.WORDS_SQL}, {fx.ZONES_SQL} SELECT doc_id, count(*) AS n_words, count(DISTINCT word) AS n_distinct FROM words WHERE NOT EXISTS (SELECT 1 FROM zones WHERE {fx.TOUCH_SQL.format(m=1)}) GROUP BY doc_id"
)
def zone_words_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = zones.words_outside(fx.words(spark, sf_dir), fx.zones(spark, sf_dir))
    counts = left.groupBy("doc_id", "word").count()
    return counts.groupBy("doc_id").agg(F.sum("count").alias("n_words"), F.count(F.lit(1)).alias("n_distinct"))


@query(
    f"WITH {fx.WORDS_SQL}, {fx.ZONES_SQL}, near AS (SELECT * FROM words WHERE EXISTS (SELECT 1 FROM zones WHERE {fx.TOUCH_SQL.format(m=0)})), chars AS (SELECT doc_id, pos, i - 1 AS i, x0 + i - 1 AS x0, x0 + i AS x1, y0, y1 FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM near)) SELECT doc_id, count(*) AS n_chars FROM chars WHERE EXISTS (SELECT 1 FROM zones WHERE {fx.CENTRE_SQL}) GROUP BY doc_id"
)
def zone_semi_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.chars_inside(fx.words(spark, sf_dir), fx.zones(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chars"))


@query(
    f"WITH {fx.WORDS_SQL}, everything AS (SELECT *, 0 AS copy FROM words UNION ALL SELECT *, 1 FROM words WHERE pos % 11 = 0), numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, word, x0, y0 ORDER BY pos, copy) AS n FROM everything), seen AS (SELECT doc_id, word, x0, y0, count(*) AS times FROM words WHERE pos % 7 <> 3 GROUP BY ALL) SELECT doc_id, pos, copy, a.word FROM numbered a LEFT JOIN seen USING (doc_id, word, x0, y0) WHERE n > coalesce(times, 0)"
)
def hidden_words_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fx.words(spark, sf_dir, dealt=True)
    everything = words.withColumn("copy", F.lit(0)).unionByName(words.filter("pos % 11 = 0").withColumn("copy", F.lit(1)))
    hidden = zones.multiset_minus(everything, words.filter("pos % 7 <> 3"), ["doc_id", "word", "x0", "y0"], ["pos", "copy"])
    return hidden.select("doc_id", "pos", "copy", "word")


@query(
    f"WITH {fx.WORDS_SQL}, {fx.ZONES_SQL} SELECT doc_id, page + 1 AS page, count(*) AS n_lost FROM words WHERE doc_id % 3 = 0 AND pos % 50 = 49 AND NOT EXISTS (SELECT 1 FROM zones WHERE {fx.TOUCH_SQL.format(m=1)}) GROUP BY doc_id, page"
)
def text_loss_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fx.words(spark, sf_dir, dealt=True)
    return zones.pages_with_loss(words, words.filter("NOT (doc_id % 3 = 0 AND pos % 50 = 49)"), fx.zones(spark, sf_dir, dealt=True))


def _places(docs: DataFrame) -> DataFrame:
    """The first and the last line stand for an outline title and for metadata."""
    lines = F.split("text", "\n", -1)
    kinds = F.explode(F.array(F.struct(F.lit("outline").alias("kind"), F.get(lines, 0).alias("text")), F.struct(F.lit("metadata_info").alias("kind"), F.element_at(lines, -1).alias("text"))))
    return docs.select("doc_id", kinds.alias("p")).select("doc_id", "p.*")


def _report(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Masked documents, of which every fifth was left as it was, and their reports. Texts are searched once."""
    docs = table(spark, sf_dir, "documents")
    found = computed_once(redact.with_masks(_with_hits(spark, sf_dir)).withColumn("done", F.when(F.col("doc_id") % 5 != 0, F.col("masked")).otherwise(F.col("text"))))
    terms = found.select("doc_id", F.explode("hits.value").alias("value")).select("doc_id", norm(F.col("value")).alias("term")).filter(F.length("term") >= redact.LEAST_TERM).distinct()
    seen = found.filter(redact.left_under(F.col("done"), redact.hit_spans(F.col("hits")))).select("doc_id", F.lit("page_text").alias("kind"))
    leaks = seen.unionByName(redact.leaks_in(_places(docs), terms))
    failed = docs.filter("doc_id % 9 = 0").select("doc_id", F.lit("x").alias("id"), F.lit("rect not valid").alias("error"))
    return found.select("doc_id", F.col("done").alias("text")), redact.report(docs, leaks, failed)


_REPORT_SQL = (
    f"WITH {fx.FINDINGS_SQL}, terms AS (SELECT DISTINCT doc_id, {fx.NORM_SQL.format('value')} AS term FROM findings WHERE length({fx.NORM_SQL.format('value')}) >= 3), places AS (SELECT doc_id, 'outline' AS kind, {fx.NORM_SQL.format('string_split(text, chr(10))[1]')} AS t FROM documents UNION ALL SELECT doc_id, 'metadata_info', {fx.NORM_SQL.format('string_split(text, chr(10))[-1]')} FROM documents),"
    " kinds AS (SELECT DISTINCT doc_id, 'page_text' AS kind FROM findings WHERE doc_id % 5 = 0 UNION SELECT doc_id, kind FROM places JOIN terms USING (doc_id) WHERE contains(t, term)),"
    " report AS (SELECT d.doc_id, k.leaks IS NULL AS verified, array_to_string(coalesce(k.leaks, []), ',') AS leaks, CASE WHEN d.doc_id % 9 = 0 THEN 1 ELSE 0 END AS n_failed FROM documents d LEFT JOIN (SELECT doc_id, list(kind ORDER BY kind) AS leaks FROM kinds GROUP BY doc_id) k ON d.doc_id = k.doc_id) "
)


@query(_REPORT_SQL + "SELECT * FROM report")
def leak_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)[1].withColumn("leaks", F.array_join("leaks", ","))


@query(_REPORT_SQL + "SELECT doc_id FROM report WHERE verified AND n_failed = 0")
def delivery_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.delivered(*_report(spark, sf_dir)).select("doc_id")


@query(
    f"WITH {fx.FINDINGS_SQL}, hidden AS (SELECT DISTINCT doc_id, unnest(range(start::BIGINT, (start + length(value))::BIGINT)) AS spot FROM findings)"
    " SELECT doc_id, md5(text) AS masked FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM findings)"
    " UNION ALL SELECT doc_id, md5(string_agg(CASE WHEN list_contains(spots, i - 1) THEN '█' ELSE substring(text, i::BIGINT, 1) END, '' ORDER BY i))"
    " FROM (SELECT doc_id, text, spots, unnest(range(1, length(text) + 1)) AS i FROM documents JOIN (SELECT doc_id, list(spot) AS spots FROM hidden GROUP BY doc_id) USING (doc_id)) GROUP BY doc_id"
)
def mask_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.with_masks(_with_hits(spark, sf_dir)).select("doc_id", F.md5("masked").alias("masked"))


@query("SELECT CAST(0 AS BIGINT) AS n_left")
def search_after_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searching a masked document finds nothing."""
    done = redact.with_masks(_with_hits(spark, sf_dir)).select("doc_id", F.col("masked").alias("text"))
    return search(done, load_patterns(fx.PATTERNS))[0].agg(F.count(F.lit(1)).alias("n_left"))


@query(
    f"WITH {fx.ITEMS_SQL} SELECT id, doc_id, CASE WHEN page < 0 OR page >= 1 THEN 'page not in document' WHEN isnan(x0) OR isnan(x1) THEN 'rect not valid' WHEN x0 >= x1 OR y0 >= y1 THEN 'rect inverted or empty' WHEN x0 >= CASE WHEN rotation % 180 <> 0 THEN 40 ELSE 100 END OR x1 <= 0 OR y0 >= CASE WHEN rotation % 180 <> 0 THEN 100 ELSE 40 END OR y1 <= 0 THEN 'rect off the page' END AS error FROM items"
)
def item_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.lit(1).alias("pages"), F.lit(100.0).alias("width"), F.lit(40.0).alias("height"))
    joined = fx.items(spark, sf_dir).join(pages, "doc_id", "left")
    error = policy.item_error(F.col("page"), F.col("pages"), [F.col(c) for c in ("x0", "y0", "x1", "y1")], F.col("width"), F.col("height"), F.col("rotation"))
    return joined.select("id", "doc_id", error.alias("error"))


@query(
    "WITH i AS (SELECT page_id % 20 AS file, page_id // 20 AS page, html <> '' AS has FROM pages), o AS (SELECT file, page, has AND (file + page) % 13 <> 5 AS has FROM i WHERE NOT (file = 7 AND page % 5 = 2)), j AS (SELECT coalesce(i.file, o.file) AS file, i.page AS ip, o.page AS op, i.has AS ih, o.has AS oh FROM i FULL JOIN o ON i.file = o.file AND i.page = o.page) SELECT file, CASE WHEN count(op) <> count(ip) OR count(op) = 0 THEN 'pages differ' WHEN bool_or(ih AND NOT coalesce(oh, false)) THEN 'page emptied' END AS reason FROM j GROUP BY file"
)
def page_verify_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input and output pages of each file: as many, and none lost its content. The first reason counts."""
    into = table(spark, sf_dir, "pages").select((F.col("page_id") % 20).alias("file"), F.floor(F.col("page_id") / 20).alias("page"), (F.col("html") != "").alias("has"))
    out = into.filter("NOT (file = 7 AND page % 5 = 2)").withColumn("has", F.col("has") & ((F.col("file") + F.col("page")) % 13 != 5))
    return verify.page_reasons(into, out)


_OUTLINE_SQL = f"rows AS (SELECT doc_id, i - 1 AS pos, l[i] AS title, 1 + ((i - 1) * 7 + doc_id) % 4 AS level, contains({fx.NORM_SQL.format('l[i]')}, 'than') AS gone FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"


@query(
    f"WITH {_OUTLINE_SQL}, above AS (SELECT b.doc_id, b.pos, a.pos AS over, a.level AS la FROM rows a JOIN rows b ON a.doc_id = b.doc_id AND a.pos < b.pos AND NOT a.gone AND NOT b.gone WHERE a.level < b.level AND NOT EXISTS (SELECT 1 FROM rows c WHERE c.doc_id = a.doc_id AND c.pos > a.pos AND c.pos < b.pos AND c.level <= a.level)) SELECT r.doc_id, r.pos, md5(r.title) AS title, 1 + count(above.over) AS level FROM rows r LEFT JOIN above ON r.doc_id = above.doc_id AND r.pos = above.pos WHERE NOT r.gone GROUP BY r.doc_id, r.pos, r.title"
)
def outline_relevel(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "title"))
    toc = lines.withColumn("level", (1 + (F.col("pos") * 7 + F.col("doc_id")) % 4).cast("int"))
    kept = outline.relevelled(toc, F.contains(norm(F.col("title")), F.lit("than")))
    return kept.select("doc_id", "pos", F.md5("title").alias("title"), "level")


@query(
    f"WITH RECURSIVE {fx.WORDS_SQL}, edges AS (SELECT doc_id, pos // 2 AS src, CASE WHEN pos % 9 = 4 THEN 'Parent' ELSE 'Kids' END AS key, pos AS dst FROM words UNION ALL SELECT doc_id, pos, 'Kids', pos // 3 FROM words), reach AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS node FROM edges UNION SELECT e.doc_id, e.dst FROM reach r JOIN edges e ON e.doc_id = r.doc_id AND e.src = r.node WHERE e.key <> 'Parent') SELECT doc_id, count(*) AS n_reached, sum(node)::BIGINT AS node_sum FROM reach GROUP BY doc_id"
)
def graph_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that the root reaches in a cyclic graph over a text's words, upward links not followed."""
    words = fx.words(spark, sf_dir, dealt=True)
    down = words.select("doc_id", F.floor(F.col("pos") / 2).alias("src"), F.when(F.col("pos") % 9 == 4, "Parent").otherwise("Kids").alias("key"), F.col("pos").cast("long").alias("dst"))
    back = words.select("doc_id", F.col("pos").cast("long").alias("src"), F.lit("Kids").alias("key"), F.floor(F.col("pos") / 3).alias("dst"))
    return reachable(down.unionByName(back)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_reached"), F.sum("node").alias("node_sum"))


@query(
    "WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_ms(ts) AS t FROM events), w AS (SELECT user_id, min(t) AS began FROM e GROUP BY user_id UNION ALL SELECT w.user_id, (SELECT min(t) FROM e WHERE e.user_id = w.user_id AND e.t >= w.began + 600000) AS began FROM w WHERE w.began IS NOT NULL), p AS (SELECT event_id, e.user_id, t, max(began) AS began FROM e JOIN w ON w.user_id = e.user_id AND w.began <= e.t GROUP BY event_id, e.user_id, t), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, began ORDER BY t, event_id) AS n FROM p) SELECT event_id, user_id, n <= 2 AS admitted, CASE WHEN n > 2 THEN greatest(1, ceil((began + 600000 - t) / 1000.0))::BIGINT END AS retry_s FROM r"
)
def ratelimit_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", fx.epoch_ms(F.col("ts")).alias("ts_ms"))
    return rate_limited(events, per_window=2).select("event_id", "user_id", "admitted", "retry_s")


_LATER = "s.began IS NULL OR e.t - s.began >= 21600000"


@query(
    "WITH RECURSIVE e AS (SELECT event_id, user_id // 10 AS c, epoch_ms(ts) AS t, epoch_ms(ts) + CAST(floor(value * 50000) AS BIGINT) AS until, row_number() OVER (PARTITION BY user_id // 10 ORDER BY epoch_ms(ts), event_id) AS k FROM events),"
    " s AS (SELECT c, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS t, CAST(NULL AS BIGINT) AS began, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS places, CAST(NULL AS VARCHAR) AS reason FROM (SELECT DISTINCT c FROM e) UNION ALL"
    " SELECT c, k, event_id, t, began, n + (reason IS NULL)::BIGINT, CASE WHEN reason IS NULL THEN list_append(held, until) ELSE held END, reason FROM (SELECT *, CASE WHEN len(held) >= 3 THEN 'CONCURRENT' WHEN n >= 4 THEN 'RATE' END AS reason FROM ("
    f" SELECT e.c, e.k, e.event_id, e.t, e.until, CASE WHEN {_LATER} THEN e.t ELSE s.began END AS began, CASE WHEN {_LATER} THEN 0 ELSE s.n END AS n, list_filter(s.places, lambda u: u > e.t) AS held FROM s JOIN e ON e.c = s.c AND e.k = s.k + 1)))"
    " SELECT event_id, c AS user_id, reason IS NULL AS admitted, reason, CASE reason WHEN 'RATE' THEN greatest(1, ceil((began + 21600000 - t) / 1000.0))::BIGINT WHEN 'CONCURRENT' THEN 10 END AS retry_s FROM s WHERE k > 0"
)
def ratelimit_concurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that hold their place until they end, in windows of six hours; ten users are a client."""
    at = fx.epoch_ms(F.col("ts"))
    events = table(spark, sf_dir, "events").select("event_id", F.call_function("div", "user_id", F.lit(10)).alias("user_id"), at.alias("ts_ms"), (at + F.floor(F.col("value") * 50_000)).alias("end_ms"))
    return rate_limited(events, per_window=4, window_ms=21_600_000)


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS position FROM events")
def queue_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "event_type", "ts", "event_id").drop("ts")


@query("SELECT event_type, count(*) FILTER (age > 900000) AS swept, count(*) FILTER (age <= 900000) AS kept FROM (SELECT event_type, (SELECT max(epoch_ms(ts)) FROM events) - epoch_ms(ts) AS age FROM events) GROUP BY event_type")
def ttl_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files strictly older than a quarter of an hour go, as of the last event."""
    files = table(spark, sf_dir, "events").select("event_type", fx.epoch_ms(F.col("ts")).alias("ms"))
    last = files.agg(F.max("ms").alias("now"), F.lit(1).alias("one"))  # one row
    old = verify.expired(F.col("now") - F.col("ms"))
    return files.withColumn("one", F.lit(1)).join(F.broadcast(last), "one").groupBy("event_type").agg(F.count_if(old).alias("swept"), F.count_if(~old).alias("kept"))


@query(
    "WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'recommended' ELSE ['low', 'recommended', 'extreme'][1 + o_orderkey % 4] END AS level, CAST(floor(o_totalprice) AS BIGINT) AS size_in, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) * (90 + o_orderkey % 15) // 100 END AS out, CASE WHEN o_orderkey % 19 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) * (95 + o_orderkey % 7) // 100 END AS low_out FROM orders)"
    " SELECT o_orderkey, level, CASE WHEN out IS NULL THEN 'error' WHEN out <= size_in * 0.98 AND o_orderkey % 11 <> 0 THEN level WHEN out <= size_in * 0.98 OR level = 'low' OR o_orderkey % 23 = 0 THEN 'original' WHEN low_out IS NULL THEN 'error' WHEN low_out <= size_in * 0.98 AND o_orderkey % 13 <> 0 THEN 'low' ELSE 'original' END AS choice FROM r"
)
def compress_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes that can't be read are errors; without time left there is no second try; a result that fails its check is never delivered."""
    key = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("size_in"), F.get(F.array(*map(F.lit, ["low", "recommended", "extreme", "unheard-of"])), (key % 4).cast("int")).alias("asked"))
    level = policy.effective_level(F.col("asked"))
    out = F.when(key % 17 != 0, F.floor(F.col("size_in") * (90 + key % 15) / 100))
    low_out = F.when(key % 19 != 0, F.floor(F.col("size_in") * (95 + key % 7) / 100))
    choice = policy.compression_choice(level, F.col("size_in"), out, low_out, key % 11 != 0, key % 13 != 0, key % 23 != 0)
    return runs.select("o_orderkey", level.alias("level"), choice.alias("choice"))


@query(
    r"WITH l AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace('failed at /tmp/uploads/' || doc_id || '/a.pdf: ' || text, '/tmp/uploads[^\s''\"]*', '<tmp>', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents) SELECT doc_id, 'code ' || CASE WHEN doc_id % 3 = 0 THEN 'SIGKILL' ELSE (doc_id % 3)::VARCHAR END || ': ' || CASE WHEN length(t) > 200 THEN substring(t, 1, 200) || '…' ELSE t END AS line FROM l"
)
def log_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 3)
    stderr = F.concat(F.lit("failed at /tmp/uploads/"), "doc_id", F.lit("/a.pdf: "), "text")
    return table(spark, sf_dir, "documents").select("doc_id", process_error(code, F.lit("SIGKILL"), stderr, ["/tmp/uploads"]).alias("line"))


@query(
    "WITH r AS (SELECT l_suppkey AS file, l_returnflag AS level, l_linenumber % 2 = 1 AS prod, (l_orderkey * 10 + l_linenumber) * 10000000 + CAST(floor(l_extendedprice) AS BIGINT) AS rep, NOT (l_quantity = 13 AND l_linenumber = 7) AS ok, CAST(floor(l_extendedprice) AS BIGINT) AS size, l_quantity AS seconds, l_linestatus AS status FROM lineitem),"
    " g AS (SELECT file, level, bool_or(NOT ok) AS bad, arg_min(size, rep) FILTER (ok AND prod) AS sp, arg_min(size, rep) FILTER (ok AND NOT prod) AS sc, arg_max(status, rep) FILTER (ok AND prod) AS ep, arg_max(status, rep) FILTER (ok AND NOT prod) AS ec, median(seconds) FILTER (ok AND prod) AS mp, median(seconds) FILTER (ok AND NOT prod) AS mc FROM r GROUP BY file, level),"
    " d AS (SELECT *, bad OR sp IS NULL OR sc IS NULL AS error FROM g), f AS (SELECT *, CASE WHEN NOT error THEN CAST(printf('%.1f', (sc - sp) * 100 / sp) AS DOUBLE) END AS change, CASE WHEN NOT error THEN CAST(printf('%.2f', mc / mp) AS DOUBLE) END AS ratio FROM d)"
    " SELECT file, level, error, change, ratio, ratio > 1.2 AS slower, CASE WHEN error THEN 1 ELSE (change > 5 OR change < -5)::INT + (ep <> ec)::INT END AS alerts FROM f"
)
def bench_median_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetitions of two services side by side. Alerts: a repetition that failed (then nothing else counts), a first size
    that differs by more than 5 %, a last status that differs. Being slower by the medians is marked, it is no alert."""
    line = F.col("l_linenumber")
    ok = ~((F.col("l_quantity") == 13) & (line == 7))
    size = F.floor("l_extendedprice")
    rep = (F.col("l_orderkey") * 10 + line) * 10_000_000 + size
    side = lambda odd: F.when(ok & (line % 2 == odd), rep)
    runs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("file"), F.col("l_returnflag").alias("level"))
    of = [x for odd, name in ((1, "prod"), (0, "cand")) for x in (
        F.min_by(size, side(odd)).alias(f"{name}_bytes"), F.max_by("l_linestatus", side(odd)).alias(f"{name}_status"), F.median(F.when(side(odd).isNotNull(), F.col("l_quantity"))).alias(f"{name}_seconds"),
    )]
    both = runs.agg(F.bool_or(~ok).alias("bad"), *of)
    both = both.withColumn("error", F.col("bad") | F.col("prod_bytes").isNull() | F.col("cand_bytes").isNull())
    sure = lambda c: F.when(~F.col("error"), c)
    both = both.withColumn("change", rounded(sure(policy.percent_change(F.col("prod_bytes"), F.col("cand_bytes"))), 1)).withColumn("ratio", rounded(sure(F.col("cand_seconds") / F.col("prod_seconds")), 2))
    alerts = F.when(F.col("error"), 1).otherwise((F.abs("change") > 5).cast("int") + (F.col("prod_status") != F.col("cand_status")).cast("int"))
    return both.select("file", "level", "error", "change", "ratio", (F.col("ratio") > 1.2).alias("slower"), alerts.alias("alerts"))


@query(
    "SELECT p_partkey, CASE WHEN p_size % 10 = 0 OR bits = 1 OR coalesce(top, 99) < 16 THEN true WHEN top IS NOT NULL AND bits = 8 THEN p_size <= 16 WHEN p_partkey % 3 = 0 THEN false WHEN p_size * 1000 * p_size * 40 > 40000000 THEN false ELSE p_size <= 16 END AS keep FROM (SELECT p_partkey, p_size, [1, 4, 8][1 + p_partkey % 3] AS bits, CASE WHEN p_partkey % 5 = 0 THEN p_size * 5 END AS top FROM part)"
)
def image_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    bits = F.get(F.array(F.lit(1), F.lit(4), F.lit(8)), (key % 3).cast("int"))
    encoding = F.when(key % 3 == 0, "DCTDecode").otherwise("FlateDecode")
    keep = policy.lossless_image(size % 10 == 0, bits, F.when(key % 5 == 0, size * 5), size, encoding, size * 1000, size * 40, size)
    return table(spark, sf_dir, "part").select("p_partkey", keep.alias("keep"))
