"""Registered queries over requests: limits of uploads, origins, settings, answers, lines of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import policy
from veilspark.functions.text import error_line
from veilspark.plans.fixtures import epoch_ms, table
from veilspark.plans.queries import query
from veilspark.streaming.limits import rate_limited


def _pick(values: list, by: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), by.cast("int"))


@query(
    "WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'pro' ELSE 'free' END AS plan, CAST(floor(o_totalprice * 400) AS BIGINT) AS size, ['compress', 'search', 'apply'][1 + o_orderkey % 3] AS route, o_orderkey % 11 * 2097152 AS items FROM orders),"
    " a AS (SELECT *, CASE WHEN plan = 'pro' THEN 104857600 ELSE 52428800 END AS most, CASE WHEN k % 4 <> 0 THEN size + k % 7 * 10485760 END AS announced, CASE WHEN route = 'apply' THEN 2 * 16777217 ELSE 4 * 1048576 END + 1048576 AS margin FROM r)"
    " SELECT k AS o_orderkey, plan, CASE WHEN announced > most + margin THEN 'FILE_TOO_LARGE_ANNOUNCED' WHEN size > most THEN 'FILE_TOO_LARGE' WHEN route = 'apply' AND items > 16777216 THEN 'ITEMS_TOO_LARGE' END AS verdict FROM a"
)
def upload_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads against the limits of their plan, a dimension table of two rows."""
    key = F.col("o_orderkey")
    uploads = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 5 == 0, "pro").otherwise("free").alias("plan"), F.floor(F.col("o_totalprice") * 400).alias("size"), _pick(["compress", "search", "apply"], key % 3).alias("route"), (key % 11 * 2 * policy.MB).alias("items"))
    announced = F.when(key % 4 != 0, F.col("size") + key % 7 * 10 * policy.MB)
    joined = uploads.join(F.broadcast(policy.plan_limits(spark)), "plan")
    return joined.select("o_orderkey", "plan", policy.upload_verdict(F.col("route"), F.col("upload_bytes"), announced, F.col("size"), F.col("items")).alias("verdict"))


_ORIGINS = ["https://a.example", "https://b.example.org", "http://a.example", "https://c.example/x", "https://d.example"]


@query(
    f"SELECT c_custkey, ['GET', 'POST', 'OPTIONS'][1 + c_custkey % 3] AS method, c_custkey % 3 = 1 AND (c_custkey % 7 = 6 OR {_ORIGINS!r}[1 + c_custkey % 5] NOT IN ('https://a.example', 'https://b.example.org')) AS refused FROM customer"
)
def origin_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts without an allowed origin are refused; of the setting only plain https origins count."""
    key = F.col("c_custkey")
    method, origin = _pick(["GET", "POST", "OPTIONS"], key % 3), F.when(key % 7 != 6, _pick(_ORIGINS, key % 5))
    allowed = policy.allowed_origins(["https://a.example"], F.lit(" https://b.example.org ,https://c.example/x,*,http://a.example,https://a.example"))
    return table(spark, sf_dir, "customer").select("c_custkey", method.alias("method"), policy.origin_refused(method, origin, allowed).alias("refused"))


@query(
    "SELECT event_id, '[' || CASE WHEN event_id % 5 = 0 THEN 'E' || event_id % 3 WHEN event_id % 4 = 1 THEN 'entity.parse.failed' WHEN event_id % 4 = 2 THEN 'entity.too.large' WHEN event_id % 2 = 0 THEN 'TypeError' ELSE 'Error' END || ']' || CASE WHEN event_id % 4 = 1 THEN ' (message omitted: it quotes the request)' WHEN event_id % 7 = 0 THEN '' ELSE ' failed ' || event_type END AS line FROM events"
)
def error_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    code = F.when(key % 5 == 0, F.concat(F.lit("E"), (key % 3).cast("string")))
    kind = F.when(key % 4 == 1, "entity.parse.failed").when(key % 4 == 2, "entity.too.large")
    message = F.when(key % 7 != 0, F.concat(F.lit("failed "), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", error_line(code, kind, F.when(key % 2 == 0, "TypeError"), message).alias("line"))


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 AND c_custkey % 4 = 0 THEN 504 WHEN c_custkey % 5 = 3 THEN 422 WHEN c_custkey % 5 = 4 AND c_custkey % 3 = 0 THEN 400 WHEN c_custkey % 5 = 0 THEN 200 ELSE 500 END AS status FROM customer"
)
def exec_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers to requests by how their process ended."""
    key = F.col("c_custkey")
    status = policy.exec_status(key % 5, key % 6 == 0, F.when(key % 4 == 0, "SIGKILL").otherwise("SIGTERM"), F.when(key % 3 == 0, "search").otherwise("apply"))
    return table(spark, sf_dir, "customer").select("c_custkey", status.alias("status"))


@query(
    "WITH r AS (SELECT o_orderkey, ['12abc', '-3', '', ' 42', 'x', '+7'][1 + o_orderkey % 6] AS raw, CAST(floor(o_totalprice * 400) AS BIGINT) AS size FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 OR NOT regexp_matches(raw, '^\\s*\\+?[0-9]') THEN 5 ELSE CAST(regexp_extract(raw, '[0-9]+') AS BIGINT) END AS setting, CASE WHEN size > 52428800 THEN 2 ELSE 1 END AS weight,"
    " o_orderkey % 4 = 0 AND o_orderkey % 3 = 0 AS is_pdf, o_orderkey % 8 = 1 AS is_uuid, o_orderkey % 10 < 3 AS is_origin FROM r"
)
def request_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small checks of a request: a whole-number setting, the job's weight, a file's marks, an id's and an origin's shape."""
    key = F.col("o_orderkey")
    raw = F.when(key % 9 != 0, _pick(["12abc", "-3", "", " 42", "x", "+7"], key % 6))
    data = F.concat(F.when(key % 4 == 0, "%PDF-1.7").otherwise("<html>"), key.cast("string"), F.when(key % 3 == 0, "%%EOF").otherwise("%%EO"))
    uuid = F.concat(F.lpad((key % 1000).cast("string"), 8, "0"), F.lit("-0000-4000-8000-00000000000"), F.when(key % 8 == 1, "a").otherwise("g"))
    origin = _pick(["http://a.example", "https://a.example:80", "https://a-b.example", "https://a.example/", "a.example", "ftp://a.example", "https://", "https://a b", "https://a.example:x", "*"], key % 10)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", policy.env_int(raw, 5).alias("setting"), policy.job_weight(F.floor(F.col("o_totalprice") * 400)).alias("weight"),
        policy.looks_like_pdf(F.encode(data, "UTF-8")).alias("is_pdf"), policy.is_uuid(uuid).alias("is_uuid"), policy.valid_origin(origin).alias("is_origin"),
    )


@query(
    "WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_ms(ts) AS t FROM events), w AS (SELECT user_id, min(t) AS began FROM e GROUP BY user_id UNION ALL SELECT w.user_id, (SELECT min(t) FROM e WHERE e.user_id = w.user_id AND e.t >= w.began + 86400000) AS began FROM w WHERE w.began IS NOT NULL), p AS (SELECT event_id, e.user_id, t, max(began) AS began FROM e JOIN w ON w.user_id = e.user_id AND w.began <= e.t GROUP BY event_id, e.user_id, t),"
    " r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, began ORDER BY t, event_id) > 4 AS limited FROM p)"
    " SELECT event_id, CASE WHEN event_id % 19 = 3 THEN 403 WHEN value > 480 THEN 413 WHEN limited THEN 429 WHEN event_id % 23 = 7 THEN 503 WHEN props NOT LIKE '{%' OR event_id % 29 = 1 THEN 400 WHEN event_id % 6 = 5 THEN 504 WHEN event_id % 6 = 3 THEN 422 WHEN event_id % 6 = 4 THEN 400 WHEN event_id % 6 = 0 THEN 200 ELSE 500 END AS status, CASE WHEN status = 429 THEN user_id END AS who FROM events JOIN r USING (event_id)"
)
def request_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches through all checks: origin, size, the client's limit of four a day, a slot, fields, the end of the process."""
    events, k = table(spark, sf_dir, "events"), F.col("event_id")
    verdicts = rate_limited(events.select("event_id", "user_id", epoch_ms(F.col("ts")).alias("ts_ms")), per_window=4, window_ms=86_400_000)
    joined = events.join(verdicts.select("event_id", "admitted"), "event_id")
    code = F.when(k % 6 == 0, 0).when(k % 6 == 3, policy.ENCRYPTED).when(k % 6 == 4, policy.BAD_PATTERNS).otherwise(1)
    ended = policy.exec_status(code, k % 6 == 5, F.lit("SIGKILL"), F.lit("search"))
    status = policy.request_status(k % 19 == 3, F.col("value") > 480, ~F.col("admitted"), k % 23 == 7, F.col("props").startswith("{") & (k % 29 != 1), ended)
    return joined.select("event_id", status.alias("status"), F.when(status == 429, F.col("user_id")).alias("who"))
