import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from veilspark.functions import policy
from veilspark.functions.text import compact, norm, readings, rounded
from veilspark.functions.paths import path_rects
from veilspark.operators import areas, fills, frontier, grid, images, markers, outline, redact, verify, zones
from veilspark.operators.search import search, with_hits
from veilspark.sources import patterns
from veilspark.streaming import limits
from veilspark.streaming.limits import positions, rate_limited, rate_limited_stream


def test_first_category_wins_and_every_occurrence_counts(spark):
    docs = spark.createDataFrame([(1, "id 12345678Z and x12345678Z\n a.b@c.de \\E(1"), (2, ""), (3, None)], "doc_id long, text string")
    found, errors = search(docs, [("word", r"\b12345678Z\b"), ("broken", "("), ("digits", r"\d+Z|\\E\(1"), ("named", r"(?P<user>[a-z.]+)@[a-z.]+")])
    rows = sorted((r.category, r.value, r.start, r.nth) for r in found.collect())
    assert rows == [("digits", "\\E(1", 38, 0), ("named", "a.b@c.de", 29, 0), ("word", "12345678Z", 3, 0), ("word", "12345678Z", 18, 1)]
    assert [c for c, _ in errors] == ["broken"]
    assert search(docs, [("broken", "(")])[0].collect() == []


def test_search_after_masking_is_empty_and_other_text_stays(spark):
    text = "keep this a@b.co,a@b.co and 123456 here"
    docs = spark.createDataFrame([(1, text), (2, "nothing")], "doc_id long, text string")
    pats = [("email", r"[a-z]+@[a-z.]+"), ("number", r"\d{3,}")]
    found = search(docs, pats)[0]
    done = redact.masked(docs, found.select("doc_id", "start", "end")).cache()
    assert search(done, pats)[0].count() == 0
    masked = {r.doc_id: r.text for r in done.collect()}
    assert masked[2] == "nothing" and masked[1] == "keep this ██████,██████ and ██████ here"
    assert redact.leaks_under(done, found).count() == 0 and redact.leaks_under(docs, found).count() == 1


def test_overlapping_spans_are_masked_once(spark):
    docs = spark.createDataFrame([(1, "abcdefghij")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 2, 5), (1, 4, 7), (1, 7, 8), (1, 9, 10)], "doc_id long, start int, end int")
    assert redact.masked(docs, spans).collect()[0].text == "ab██████i█"


def test_delivery_fails_closed(spark):
    docs = spark.createDataFrame([(k,) for k in range(4)], "doc_id long")
    leaks = spark.createDataFrame([(1, "outline"), (1, "metadata_info"), (1, "outline")], "doc_id long, kind string")
    failed = spark.createDataFrame([(2, "a", "rect not valid")], "doc_id long, id string, error string")
    reports = redact.report(docs, leaks, failed)
    assert {r.doc_id: r.leaks for r in reports.collect()}[1] == ["metadata_info", "outline"]
    assert [r.doc_id for r in redact.delivered(docs, reports.filter("doc_id <> 3")).collect()] == [0]


def test_terms_are_normalised_and_found_across_hyphens(spark):
    texts = ["Straße  ÉCOLE x", "é İI", None, "a\x1cb  c", "ANNA-\nMARIA­ −"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", norm(F.col("t")).alias("n"), compact(F.col("t")).alias("c")).collect()
    for r in rows:
        assert r.n == " ".join(unicodedata.normalize("NFC", texts[r.k] or "").casefold().split())
    assert {r.k: r.c for r in rows}[4] == "annamaria"


def test_zones_and_multisets(spark):
    words = spark.createDataFrame([(1, 0, k, w, 10 * k, 0, 10 * k + 8, 8) for k, w in enumerate("a b a c".split())], "doc_id long, page int, pos int, word string, x0 int, y0 int, x1 int, y1 int")
    zone = spark.createDataFrame([(1, 0, 7, 9, 0, 25, 9)], "doc_id long, page int, zone_id int, x0 int, y0 int, x1 int, y1 int")
    assert [r.text for r in zones.text_under_zones(words, zone).collect()] == ["b a"]
    assert sorted(r.word for r in zones.words_outside(words, zone).collect()) == ["a", "c"]  # a ends where the margin begins
    left = zones.multiset_minus(words, words.filter("pos = 2"), ["doc_id", "word"], ["pos"])
    assert sorted((r.pos, r.word) for r in left.collect()) == [(1, "b"), (2, "a"), (3, "c")]  # the first goes


def test_outline_children_rise(spark):
    toc = spark.createDataFrame([(1, k, level, t) for k, (level, t) in enumerate([(1, "a"), (2, "SECRET"), (3, "c"), (2, "d"), (1, "e"), (3, "f")])], "doc_id long, pos int, level int, title string")
    kept = outline.relevelled(toc, F.col("title") == "SECRET").orderBy("pos").collect()
    assert [(r.title, r.level) for r in kept] == [("a", 1), ("c", 2), ("d", 2), ("e", 1), ("f", 2)]


def test_graph_too_deep_fails(spark):
    edges = spark.createDataFrame([(1, k, "Kids", k + 1) for k in range(20)] + [(2, 0, "Kids", 1), (2, 1, "Parent", 5), (2, 1, "Kids", 0)], "doc_id long, src long, key string, dst long")
    got = {(r.doc_id, r.node) for r in frontier.reachable(edges, max_depth=10).collect()}
    assert got == {(1, None), (2, 0), (2, 1)}


def test_patterns_and_items_are_checked_at_the_edge(spark, tmp_path):
    for bad in ("[]", '{"a": 1}', '{"a": ""}'):
        with pytest.raises(patterns.BadPatterns):
            patterns.load_patterns(bad)
    assert patterns.load_patterns('{"b": "x", "a": "y"}') == [("b", "x"), ("a", "y")]
    file = tmp_path / "items.json"
    file.write_text(json.dumps([{"id": "1", "doc_id": 1, "page": 0, "text": "t", "category": "c", "rect": [0, 0, 1, 1]}]))
    assert patterns.read_items(spark, str(file)).collect()[0].rect == [0.0, 0.0, 1.0, 1.0]
    file.write_text('[{"id": "1", "doc_id": "no number"}]')
    with pytest.raises(Exception, match="(?i)malformed"):
        patterns.read_items(spark, str(file)).collect()
    runs = spark.createDataFrame([("serial", "a.pdf", "low", 200, "ok", "low", 12, 1.5)], patterns.BENCH)
    patterns.write_bench(runs, str(tmp_path / "bench"))
    assert patterns.read_bench(spark, str(tmp_path / "bench")).collect() == runs.collect()


def test_policies(spark):
    row = spark.range(1).select(
        policy.env_int(F.lit("12abc"), 5).alias("a"), policy.env_int(F.lit("-3"), 5).alias("b"), policy.env_int(F.lit(None).cast("string"), 5).alias("c"), policy.effective_level(F.lit("toString")).alias("d"),
        policy.looks_like_pdf(F.lit(bytearray(b"%PDF-1.7 ... %%EOF\n"))).alias("e"), policy.looks_like_pdf(F.lit(bytearray(b"%PDF-1.7 %%EOF" + b"x" * 90))).alias("f"), policy.job_weight(F.lit(60 << 20)).alias("g"),
        policy.is_uuid(F.lit("123E4567-e89b-12d3-a456-426614174000")).alias("h"), policy.valid_origin(F.lit("https://a.example:8080")).alias("i"), policy.valid_origin(F.lit("https://a.example/x")).alias("j"),
    ).collect()[0]
    assert tuple(row) == (12, 5, 5, "recommended", True, False, 2, True, True, False)


def plain_limits(rows, per_window, window_ms, concurrent):
    """Requests (event_id, client, at, end) one after the other."""
    out, state = [], {}
    for event_id, client, at, end in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        began, n, ends = state.get(client, (None, 0, []))
        if began is None or at >= began + window_ms:
            began, n = at, 0
        ends = [e for e in ends if e > at]
        reason = "CONCURRENT" if len(ends) >= concurrent else "RATE" if n >= per_window else None
        wait = {"CONCURRENT": 10, "RATE": max(1, -((at - began - window_ms) // 1000)), None: None}[reason]
        if reason is None:
            n, ends = n + 1, [*ends, max(end if end is not None else at, at)]
        state[client] = began, n, ends
        out.append((event_id, client, reason is None, reason, wait))
    return sorted(out)


def drawn_requests(n: int, hold: float, seed: int = 4) -> list:
    """A third of all from one client; ties, nulls, ends before the begin."""
    rng = random.Random(seed)
    rows = [(k, 0 if k % 3 == 0 else rng.choice([1, 2, 3, None]), int(rng.random() * n * 700) // 50 * 50) for k in range(n)]
    return [(*r, r[2] + int(rng.expovariate(1 / hold)) if k % 17 else (None if k % 2 else r[2] - 5)) for k, r in enumerate(rows)] + [(n, 1, None, 5)]


@pytest.mark.parametrize(("per_window", "window_ms", "concurrent", "hold"), [(4, 20_000, 2, 3_000), (60, 600_000, 3, 20_000), (1, 1_000, 1, 500), (3, 15_000, 9, 1)])
def test_limits_equal_one_after_the_other(spark, per_window, window_ms, concurrent, hold):
    rows = drawn_requests(300, hold)
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts_ms long, end_ms long").repartition(3)
    got = sorted(tuple(r) for r in rate_limited(events, per_window, window_ms, concurrent).collect())
    want = plain_limits(rows, per_window, window_ms, concurrent)
    assert got == want
    if hold == 3_000:
        assert {r[3] for r in want} == {None, "RATE", "CONCURRENT"}
    instant = sorted(tuple(r) for r in rate_limited(events.drop("end_ms"), per_window, window_ms, concurrent).collect())
    assert instant == plain_limits([(*r[:3], r[2]) for r in rows], per_window, window_ms, concurrent)


def test_a_hot_client_is_many_groups(spark):
    rows = drawn_requests(600, 900)
    events = spark.createDataFrame([(r[0], 0, r[2], r[3]) for r in rows if r[2] is not None], "event_id long, client long, at long, until long")
    placed = limits.in_windows(events.withColumn("until", F.greatest(F.coalesce("until", "at"), "at")), 20_000)
    periods = limits.busy_periods(placed)
    assert periods.select("stretch").distinct().count() > 15 and periods.groupBy("period").count().agg(F.max("count")).first()[0] < 60
    assert rate_limited(spark.createDataFrame([], "event_id long, user_id long, ts_ms long, end_ms long")).count() == 0


def test_stream_and_batch_decide_alike(spark, tmp_path):
    rows = [(k, k % 3, 1000 * k * (1 + k % 5)) for k in range(60)]
    schema = "event_id long, user_id long, ts_ms long"
    events = spark.createDataFrame(rows, schema)
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    for k in range(2):
        spark.createDataFrame(ordered[30 * k : 30 * k + 30], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = rate_limited_stream(stream, 4, 60_000).writeStream.format("memory").queryName("limits").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        assert q.awaitTermination(60) and q.exception() is None
    finally:
        q.stop()
    want = sorted(tuple(r) for r in rate_limited(events, 4, 60_000).collect())
    assert sorted(tuple(r) for r in spark.table("limits").collect()) == want and any(not r[2] for r in want)


def test_search_goes_over_a_text_once_a_pattern(spark):
    docs = spark.createDataFrame([(1, "a1 b2 " + " ".join(f"k{k}x" for k in range(20)))], "doc_id long, text string")
    patterns = [(f"p{k}", rf"k{k}x|b2") for k in range(20)]
    found = search(docs, patterns)[0]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 20
    assert sorted((r.category, r.value) for r in found.collect()) == sorted([("p0", "b2"), *((f"p{k}", f"k{k}x") for k in range(20))])


def test_classes_of_patterns_hold_for_all_of_unicode(spark):
    docs = spark.createDataFrame([(1, "né à٣٤ x=x ab=ab"), (2, None)], "doc_id long, text string")
    found, bad = search(docs, [("word", r"\bné\b"), ("digits", r"\d+"), ("twice", r"(?P<w>[a-z]+)=(?P=w)")])
    assert sorted((r.category, r.value) for r in found.collect()) == [("digits", "٣٤"), ("twice", "ab=ab"), ("twice", "x=x"), ("word", "né")] and not bad


def test_repeated_keys_are_withheld_not_mixed_up(spark):
    docs = spark.createDataFrame([(1, 0, "one 123456"), (1, 1, "two"), (2, 0, "other"), (3, 0, "9999999"), (4, 0, "x"), (4, 0, "y")], "doc_id long, page int, text string")
    found = search(docs, [("n", r"[0-9]{6,}")], keys=("doc_id", "page"))[0]
    by_page = redact.masked(docs, found.select("doc_id", "page", "start", "end"), keys=("doc_id", "page")).collect()
    assert sorted(map(tuple, by_page)) == [(1, 0, "one ██████"), (1, 1, "two"), (2, 0, "other"), (3, 0, "███████"), (4, 0, "x"), (4, 0, "y")]
    by_doc = {(r.doc_id, r.page): r.text for r in redact.masked(docs, found.select("doc_id", "start", "end")).collect()}
    assert by_doc[1, 0] is None and by_doc[1, 1] is None and by_doc[3, 0] == "███████" and by_doc[2, 0] == "other"
    in_row = redact.with_masks(with_hits(docs, [(0, "n", "[0-9]{6,}")])).select("doc_id", "page", "masked").collect()
    assert sorted(map(tuple, in_row)) == sorted(map(tuple, by_page))
    assert redact.masked(docs.limit(0), found.select("doc_id", "start", "end")).collect() == []


def test_apply_reports_and_fails_closed(spark):
    docs = spark.createDataFrame([(1, "call 123456 now"), (2, "call 777777"), (3, "fine"), (4, "call 888888"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a", "n", "123456", 5, 11), (2, "b", "n", "777777", 5, 11), (2, "c", "n", "x", 5, 99), (4, "d", redact.BY_HAND, "label", 5, 11), (5, "e", "n", "zzz", 0, 3)], "doc_id long, id string, category string, text string, start int, end int")
    places = spark.createDataFrame([(1, "outline", "nothing"), (4, "metadata_info", "No. 888888"), (3, "outline", "label")], "doc_id long, kind string, text string")
    got = {r.doc_id: r for r in redact.apply(docs, items, places).collect()}
    assert {k: r.text for k, r in got.items()} == {1: "call ██████ now", 2: None, 3: "fine", 4: None, 5: None}
    assert got[4].report.leaks == ["metadata_info"] and not got[4].report.success and got[1].report.applied == 1
    assert [tuple(f) for f in got[2].report.failed] == [("c", "span off the page")] and got[5].report.failed[0].error == "page not in document"
    assert {r.doc_id: r.messages for r in redact.failed_messages(redact.apply(docs, items)).collect()}[2] == "span off the page"


def plain_hidden(words, terms):
    line, starts, hit = " ".join(words), [], set()
    for w in words:
        starts.append(len(" ".join([*words[: len(starts)], ""])) if starts else 0)
    for t in terms:
        for i in range(len(line)):
            if line.startswith(t, i):
                hit |= {k for k, at in enumerate(starts) if at < i + len(t) and i < at + len(words[k]) + 1}
    return sorted(hit)


def test_hidden_words_of_terms(spark):
    words = "anna maria aaaa anna mariana banana na x".split()
    terms = ["anna maria", "aa", "ana", "na x", "zzz"]
    hidden = spark.createDataFrame([(d, 0, k, w.upper()) for d in (1, 2) for k, w in enumerate(words)], "doc_id long, page int, pos int, word string")
    wanted = spark.createDataFrame([(1, t) for t in terms] + [(2, "zzz")], "doc_id long, term string")
    got = redact.hidden_term_words(hidden, wanted).collect()
    assert sorted((r.doc_id, r.pos) for r in got) == [(1, k) for k in plain_hidden(words, terms)]


def test_compact_terms_in_any_reading(spark):
    data = ["12345678-Z".encode(), "12345678 Z".encode("utf-16"), "12345678Z".encode("utf-16-be"), b"\xff1234", None, "é12345678‐z".encode()]
    rows = spark.createDataFrame([(1, k, bytearray(d) if d is not None else None) for k, d in enumerate(data)], "doc_id long, place int, data binary")
    strings = rows.select("doc_id", "place", F.explode(readings("data")).alias("text"))
    found = redact.strings_with_terms(strings, spark.createDataFrame([(1, "12345678 z")], "doc_id long, term string"))
    assert {r.place for r in found.collect()} == {0, 1, 2, 5}
    assert redact.strings_with_terms(strings, spark.createDataFrame([(1, "- z")], "doc_id long, term string")).collect() == []


def test_readings_are_what_python_decodes(spark):
    rng = random.Random(9)
    raw = [b"", b"abc", b"\xff", b"\xef\xbb\xbfmark", "wide é🙂".encode("utf-16"), "big 🙂".encode("utf-16-be"), "little é".encode("utf-16-le"), b"\xd8\x00\x00a", b"\x00a\xdc\x00", b"odd\x00", b"\xfe\xff\x00"]
    raw += [bytes(rng.choice([0, 0x41, 0xD8, 0xDC, 0xC3, 0xA9, 0xFF, 0xFE]) for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in [*raw, None]], "data binary").select(readings("data")).collect()]
    for data, found in zip(raw, got, strict=False):
        want = [data.decode("latin-1"), data.decode("latin-1").replace("\0", "")]
        for charset in ["utf-8-sig", *["utf-16"] * (data[:2] in (b"\xfe\xff", b"\xff\xfe")), *["utf-16-be", "utf-16-le"] * (len(data) % 2 == 0 and 0 in data)]:
            try:
                want.append(data.decode(charset))
            except UnicodeDecodeError:
                pass
        assert set(found) == set(want) and len(found) == len(set(found)), data
    assert got[-1] is None


def test_images_are_matched_as_one_by_one(spark):
    rng = random.Random(3)
    rows = [(f, x, 100, rng.choice([50, 60]), 8, rng.randrange(2)) for f in range(40) for x in range(rng.randrange(2, 12))]
    old, new = [r for r in rows if r[1] % 2], [r for r in rows if not r[1] % 2]
    want = []
    for f in range(40):
        free, todo = [r for r in old if r[0] == f], [r for r in new if r[0] == f]
        for by_place in (True, False):
            for c in list(todo):
                hit = next((b for b in free if b[2:5] == c[2:5] and (b[5] == c[5] or not by_place)), None)
                if hit:
                    free.remove(hit)
                    todo.remove(c)
                    want.append((f, c[1], hit[1]))
    schema = "file int, xref int, width int, height int, bits int, place int"
    got = images.matched(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_positions_across_stretches(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice("ab"), rng.randrange(400)) for k in range(500)]
    events = spark.createDataFrame(rows, "event_id long, kind string, s long").withColumn("ts", F.timestamp_seconds("s"))
    want = {}
    for kind in "ab":
        for n, r in enumerate(sorted((s, k) for k, q, s in rows if q == kind)):
            want[r[1]] = n + 1
    assert {r.event_id: r.position for r in positions(events, "kind", "ts", "event_id", 60).collect()} == want


def test_sinks_and_lenient_reads(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    patterns.write_json(df, str(tmp_path / "out"), ["k"])
    (tmp_path / "in.json").write_text('{"k": 1, "v": "a"}\nnot json\n{"k": "x"}\n{"k": 2}\n')
    assert sorted(map(tuple, patterns.read_or_skip(spark, str(tmp_path / "in.json"), "k int, v string").collect()), key=str) == [(1, "a"), (2, None)]
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "out")).collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="array"):
        patterns.checked_items('{"a": 1}')


def test_rounding_follows_the_binary_value(spark):
    got = spark.createDataFrame([(0.35,), (0.25,), (2.5,), (None,)], "x double").select(rounded(F.col("x"), 1).alias("r")).collect()
    assert [r.r for r in got] == [0.3, 0.2, 2.5, None]


def drawn_rects(rng, n, top=400):
    return [(k, 1, k % 2, x := rng.randrange(100), y := rng.randrange(top), x + rng.randrange(0, 25), y + rng.randrange(0, 20)) for k in range(n)]


def test_grid_joins_are_plain_overlaps(spark):
    rng = random.Random(2)
    a, b = drawn_rects(rng, 150), drawn_rects(rng, 120)
    schema = "seqno int, doc_id long, page int, x0 int, y0 int, x1 int, y1 int"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame([*b, (999, 1, None, 0, 0, 9, 9)], schema)
    full = lambda r: r[3] < r[5] and r[4] < r[6]
    want = sorted((p[0], q[0]) for p in a for q in b if p[2] == q[2] and full(p) and full(q) and max(p[3], q[3]) < min(p[5], q[5]) and max(p[4], q[4]) < min(p[6], q[6]))
    for side in (7, 50, 1000):
        assert sorted((r.l_seqno, r.r_seqno) for r in grid.overlapping(left, right, ["doc_id", "page"], side).collect()) == want


def test_many_words_and_zones_do_not_make_their_product(spark):
    words = spark.range(10_000).selectExpr("1L AS doc_id", "0 AS page", "cast(id AS int) AS pos", "'w' AS word", "cast(id % 100 * 10 AS int) AS x0", "cast(id div 100 * 10 AS int) AS y0", "cast(id % 100 * 10 + 8 AS int) AS x1", "cast(id div 100 * 10 + 8 AS int) AS y1")
    areas = spark.range(1000).selectExpr("1L AS doc_id", "0 AS page", "id AS zone_id", "cast(id % 40 * 25 AS int) AS x0", "cast(id div 40 * 40 AS int) AS y0", "cast(id % 40 * 25 + 20 AS int) AS x1", "cast(id div 40 * 40 + 30 AS int) AS y1")
    cut = areas.select("zone_id", F.explode(grid.cells(*(F.col(c) for c in grid.CORNERS), grid.CELL)).alias("c"))
    at = words.select(grid.cell_of((F.col("x0") + F.col("x1")) / 2, grid.CELL).alias("cx"), grid.cell_of((F.col("y0") + F.col("y1")) / 2, grid.CELL).alias("cy"))
    met = at.join(cut.select("c.*"), ["cx", "cy"]).count()  # what the join compares: of 10,000,000 pairs
    assert met < 150_000
    got = zones.text_under_zones(words, areas)
    inside = lambda v, lo, hi: lo <= v <= hi
    first = sum(inside(i % 100 * 10 + 4, 0, 20) and inside(i // 100 * 10 + 4, 0, 30) for i in range(10_000))
    assert got.count() == 1000 and len(got.filter("zone_id = 0").first()["text"].split()) == first


@pytest.mark.parametrize("seed", range(3))
def test_fills_in_paint_order_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    log = [(k, 1, 0, rng.choice(["fill-text", "fill-path", "ignore-text"]), x := rng.randrange(120), y := rng.randrange(60), x + rng.randrange(0, 20), y + rng.randrange(0, 12)) for k in range(200)]
    areas = [(1, 0, 0, 0, 50, 40), (1, 0, 70, 20, 90, 60)]
    paths = [(r[0], 1, 0, *r[4:]) for r in log if r[3] == "fill-path"]
    paths += [(r[0], 1, 0, r[4] + 3, r[5] + 20, r[6] + 6, r[7] + 25) for r in log if r[3] == "fill-path" and r[0] % 5 == 0]
    cross = lambda p, q: p[0] < p[2] and q[0] < q[2] and p[1] < p[3] and q[1] < q[3] and max(p[0], q[0]) < min(p[2], q[2]) and max(p[1], q[1]) < min(p[3], q[3])
    rects = {}
    for r in paths:
        rects.setdefault(r[0], []).append(r[3:])
    chosen = [k for k in sorted(rects) if any(cross(r, z[2:]) for r in rects[k] for z in areas)]
    shows = [r for r in log if r[3] != "ignore-text" and not any(z[2] <= r[4] and z[3] <= r[5] and r[6] <= z[4] and r[7] <= z[5] for z in areas)]
    hid_nothing, want = set(), []
    for k in chosen:
        on = [r[0] for r in shows if r[0] != k and any(cross(x, r[4:]) for x in rects[k])]
        over = any(j < k and j not in hid_nothing for j in on)
        if not over:
            hid_nothing.add(k)
        want.append((k, over, over and any(j > k for j in on)))
    df = lambda rows, names: spark.createDataFrame(rows, names)
    box = "x0 int, y0 int, x1 int, y1 int"
    got = fills.touched_fills(df(log, f"seqno int, doc_id long, page int, kind string, {box}"), df(paths, f"seqno int, doc_id long, page int, {box}"), df(areas, f"doc_id long, page int, {box}"), 16)
    assert sorted((r.seqno, r.over, r.later) for r in got.collect()) == want and {w[1] for w in want} == {False, True}


def test_traversal_spreads_one_document_and_fails_closed(spark):
    rng = random.Random(6)
    n = 400
    edges = [(1, rng.randrange(n), rng.choice(["Kids", "Parent", "A"]), rng.randrange(n)) for _ in range(700)] + [(1, None, "A", 3), (2, 0, "A", 0), (3, 5, "A", 6)] + [(4, k, "A", k + 1) for k in range(12)]
    table = spark.createDataFrame(edges, "doc_id long, src long, key string, dst long")
    seen, at, depth = {0: 0}, [0], 0
    while at:
        depth += 1
        at = list({d for doc, s, key, d in edges if doc == 1 and s in at and key != "Parent" and d not in seen})
        seen.update(dict.fromkeys(at, depth))
    got = frontier.reachable(table)
    assert {(r.node, r.depth) for r in got.filter("doc_id = 1").collect()} == set(seen.items())
    assert {(r.doc_id, r.node) for r in got.filter("doc_id in (2, 3)").collect()} == {(2, 0), (3, 0)} and got.filter("doc_id = 4").count() == 13
    short = frontier.reachable(table.filter("doc_id > 1"), max_depth=9)
    assert {(r.doc_id, r.node) for r in short.collect()} == {(2, 0), (3, 0), (4, None)}
    strings = spark.createDataFrame([(2, 0, "x"), (3, 0, "y"), (3, 9, "x"), (4, 0, "x"), (5, 1, "x")], "doc_id long, node long, text string")
    done = {(r.doc_id, r.node): (r.text, r.blank) for r in frontier.blanked(strings, strings.filter("text = 'x'"), short).collect()}
    assert done == {(2, 0): ("", True), (3, 0): ("y", False), (3, 9): ("x", False), (4, 0): (None, None), (5, 1): ("x", False)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan


def test_name_trees_keep_their_order(spark):
    rng = random.Random(5)
    nodes = [(1, 0, None, 0)] + [(1, k, rng.randrange(k), rng.randrange(100) * 50 + k) for k in range(1, 40)] + [(1, 99, 98, 0), (2, 0, None, 0)]
    entries = [(1, rng.randrange(40), p) for p in range(120)] + [(1, 99, 1), (2, 0, 5)]
    entries = list({(d, n, p): None for d, n, p in entries})
    gone = {e for e in entries if e[2] % 7 == 0 and e[0] == 1}
    kids = {}
    for d, k, parent, nth in nodes:
        kids.setdefault((d, parent), []).append((nth, k))

    def walk(node):
        for _, k in sorted(kids.get((1, node), [])):
            yield from walk(k)
        yield from sorted((n, p) for d, n, p in entries if d == 1 and n == node and (d, n, p) not in gone)

    want = [(1, k + 1, n, p, True) for k, (n, p) in enumerate(walk(0))] + [(2, None, 0, 5, False)]
    df = spark.createDataFrame
    tree, named = df(nodes, "doc_id long, node long, parent long, nth long"), df(entries, "doc_id long, node long, place long")
    got = frontier.flattened(tree, named, df(sorted(gone), "doc_id long, node long, place long"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    deep = frontier.flattened(tree, named, named.limit(0), max_depth=1)
    assert {tuple(r) for r in deep.collect()} == {(1, None, None, None, None), (2, None, 0, 5, False)}


def test_areas_of_a_match_over_two_lines(spark):
    docs = spark.createDataFrame([(1, 0, "see the cat\nand the cat the cat"), (1, 1, "nothing"), (2, 0, None)], "doc_id long, page int, text string")
    boxes = [(1, 0, k, x0, y0, x0 + 8, y0 + 8) for k, (x0, y0) in enumerate([(0, 0), (10, 0), (20, 0), (0, 10), (10, 10), (0, 20), (10, 20), (20, 20)])]
    words = spark.createDataFrame(boxes, "doc_id long, page int, pos int, x0 int, y0 int, x1 int, y1 int")
    found = with_hits(docs, [(0, "cat", "the cat")])
    rows = sorted((r.k, r.x0, r.y0, r.x1, r.y1, r.context) for r in areas.areas(found, words).collect())
    around = ["...see the cat and the cat the cat..."] * 3
    # the second occurrence ends one line and begins the next: four areas, three occurrences
    assert rows == [(0, 10, 0, 28, 8, around[0]), (1, 10, 10, 18, 18, around[1]), (2, 0, 20, 8, 28, around[2]), (3, 10, 20, 28, 28, "......")]
    assert [(r.page, r.pos, r.word) for r in areas.page_words(docs).filter("page = 1").collect()] == [(1, 0, "nothing")] and areas.areas(found.limit(0), words).count() == 0


def test_markers_round_trip_and_withhold(spark):
    ids = [0, 1, 255, 256, 65_536, 2**32 - 1]
    rows = spark.createDataFrame([(i,) for i in ids], "id long").select("id", markers.marker(F.col("id")).alias("m"))
    for r in rows.collect():
        row = b"PdCq" + r.id.to_bytes(4, "big")
        assert bytes(r.m) == row + bytes(255 - b for b in row)
    both = rows.select("id", markers.marker_id(F.col("m")).alias("a"), markers.marker_id(F.unhex(F.translate(F.hex("m"), "0123456789ABCDEF", "FEDCBA9876543210"))).alias("b"), markers.marker_id(F.concat("m", F.unhex(F.lit("00")))).alias("c"))
    assert all(r.id == r.a == r.b and r.c is None for r in both.collect())
    code = lambda i: (row := b"PdCq" + i.to_bytes(4, "big")) + bytes(255 - b for b in row)
    images_ = [(1, 7, True, 64, 2, code(3)), (1, 8, True, 64, 2, b"own mask"), (2, 7, True, 64, 2, code(4)), (3, 7, True, 64, 2, code(9)), (4, 7, True, 64, 2, code(3)), (5, 1, True, 63, 2, code(3)), (6, 1, True, 64, 2, None)]
    given = spark.createDataFrame(images_, "file long, xref long, mask boolean, width int, height int, data binary")
    originals = spark.createDataFrame([(f, 3, True) for f in range(1, 7)] + [(2, 4, False)], "file long, xref long, image boolean")
    streams = spark.createDataFrame([(4, b"q " + code(3)), (1, b"\\x05\\x06\\x44\\x37"), (1, None)], "file long, data binary")
    done, failed = markers.restored(given, originals, streams)
    assert [tuple(r) for r in done.collect()] == [(1, 7, 3)]
    assert sorted(map(tuple, failed.collect())) == [(2, "marker names no image"), (3, "marker names no image"), (4, "marker left")]


def test_paths_of_rectangles(spark):
    cases = [
        ([("re", [(0, 0), (5, 4)])], [(0, 0, 5, 4)]), ([("re", [(0, 0), (5, 4)]), ("re", [(1, 1), (2, 2)])], [(0, 0, 5, 4), (1, 1, 2, 2)]), ([("qu", [(0, 0), (5, 0), (0, 4), (5, 4)])], [(0, 0, 5, 4)]),
        ([("qu", [(0, 0), (5, 0), (1, 4), (5, 4)])], None), ([("l", [(0, 0), (5, 0)]), ("l", [(5, 0), (5, 4)]), ("l", [(5, 4), (0, 4)])], [(0, 0, 5, 4)]), ([("l", [(0, 0), (5, 0)]), ("l", [(5, 0), (5, 4)])], None),
        ([("l", [(0, 0), (5, 4)])] * 3, None), ([("re", [(0, 0), (5, 4)]), ("l", [(0, 0), (5, 0)])], None), ([], None), (None, None), ([("qu", [(0, 0), (5, 0.0001), (0, 4), (5, 4)])], [(0, 0, 5, 4)]),
    ]
    rows = [(k, None if p is None else [(op, [(float(x), float(y)) for x, y in points]) for op, points in p]) for k, (p, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "k int, items array<struct<op:string,points:array<struct<x:double,y:double>>>>")
    got = {r.k: r.r for r in df.select("k", path_rects(F.col("items")).alias("r")).collect()}
    for k, (_, want) in enumerate(cases):
        assert (None if got[k] is None else [tuple(map(round, x)) for x in got[k]]) == want, k


def test_verification_gives_the_first_reason(spark):
    rows = lambda pages: spark.createDataFrame(pages, "file long, page long, has boolean")
    before = rows([(1, 0, True), (1, 1, False), (2, 0, True), (2, 1, True), (3, 0, True), (4, 0, True), (5, 0, None)])
    after = rows([(1, 0, True), (1, 1, True), (2, 0, True), (3, 0, False), (4, 0, True), (5, 0, None), (6, 0, True)])
    locked = spark.createDataFrame([(4,), (7,)], "file long")
    got = {r.file: r.reason for r in verify.page_reasons(before, after, locked).collect()}
    assert got == {1: None, 2: verify.DIFFER, 3: verify.EMPTIED, 4: verify.ENCRYPTED, 5: None, 6: verify.DIFFER, 7: verify.ENCRYPTED}
    has = spark.createDataFrame([(0, None), (1, None), (0, " \n "), (0, "x"), (None, "")], "n int, t string").select(verify.has_content(F.col("n"), F.col("t")).alias("h"))
    assert [r.h for r in has.collect()] == [False, True, False, True, False]
    assert verify.missing(before, after, ["file"]).collect()[0].asDict() == {"file": 2, "n_missing": 1}


def test_a_request_gets_the_status_of_the_first_check_that_fails(spark):
    t, f, none = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    cases = [((t, t, t, t, f), 403), ((f, t, t, t, f), 413), ((f, f, t, t, f), 429), ((f, f, f, t, f), 503), ((f, f, f, f, f), 400), ((f, f, f, f, none), 400), ((none, none, none, none, t), 200)]
    row = spark.range(1).select(*(policy.request_status(*c, F.lit(200)).alias(f"s{k}") for k, (c, _) in enumerate(cases))).first()
    assert list(row) == [want for _, want in cases]


def test_leak_kinds_by_location(spark):
    spots = [(1, "link", "see 12 345"), (1, "link", "see 12345"), (1, "struct", "12-345"), (2, "form", None), (3, "info", "Made by us 12345"), (3, "xmp", None), (4, "outline", "clean"), (5, "piece", "12 345")]
    strings = spark.createDataFrame(spots, "doc_id long, location string, text string")
    terms = spark.createDataFrame([(k, "12345") for k in (1, 3, 4)], "doc_id long, term string")
    deep, broken = spark.createDataFrame([(9,)], "doc_id long"), spark.createDataFrame([(4,), (4,)], "doc_id long")
    got = sorted(map(tuple, redact.leaks_by_location(strings, terms, ["Made by us 12345"], broken, deep).collect()))
    assert got == [(1, "links"), (1, "pdf_objects"), (2, "form_fields"), (4, "content_syntax"), (9, "nesting_depth")]


def test_traversal_of_many_documents_takes_few_jobs_and_large_ones_go_by_levels(spark):
    rng = random.Random(8)
    edges = [(doc, rng.randrange(60), "Kids", rng.randrange(60)) for doc in range(40) for _ in range(doc * 4)] + [(50 + doc, k, "Kids", k + 1) for doc in range(2) for k in range(20 + doc)]
    table = spark.createDataFrame(edges, "doc_id long, src long, key string, dst long")
    want = set()
    for doc in {e[0] for e in edges}:
        seen, at = {0: 0}, [0]
        while at:
            new = sorted({d for x, s, _, d in edges if x == doc and s in at and d not in seen})
            seen.update(dict.fromkeys(new, seen[at[0]] + 1))
            at = new
        deep = max(seen.values()) > 20
        want |= {(doc, None, None)} if deep else {(doc, node, depth) for node, depth in seen.items()}
    roots = table.select("doc_id").distinct().selectExpr("doc_id", "cast(0 as long) AS node")
    for whole in (frontier.WHOLE, 70, 1):  # all as rows; some by levels; all by levels
        spark.sparkContext.setJobGroup(f"walk-{whole}", "")
        assert set(map(tuple, frontier.levels(table, roots, 20, whole).collect())) == want
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = {whole: len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"walk-{whole}")) for whole in (frontier.WHOLE, 1)}
    assert jobs[frontier.WHOLE] < 12 < jobs[1]  # twenty levels deep
    assert (51, None, None) in want and (50, 20, 20) in want


def test_words_before_an_offset_are_counted_by_blocks(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab\u00e9\U0001f600 \n\t\x0b\u00a0") * rng.choice([1, 1, 1, 40]) for _ in range(n)) for n in (0, 1, 30, 200, 400)] + ["x" * 1000, " " * 600, "x" * 256 + " y" * 200]
    docs = areas.in_blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = docs.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.length("text")), areas.words_until)).alias("end", "n")).collect()
    want = {(k, end): len(re.findall(areas.WORD, text[:end])) for k, text in enumerate(texts) for end in range(len(text) + 1)}
    assert {(r.doc_id, r.end): r.n for r in got} == want


def test_areas_of_a_long_text_with_many_findings(spark):
    import time

    from veilspark.operators.search import with_hits

    n = 30_000
    text = " ".join(f"{100 + k % 700} w{'x' * (k % 5)}" for k in range(n))
    docs = spark.createDataFrame([(1, 0, text)], "doc_id long, page int, text string")
    words = areas.page_words(docs).select("doc_id", "page", "pos", (F.col("pos") % 10 * 10).alias("x0"), F.floor(F.col("pos") / 10).alias("y0"), (F.col("pos") % 10 * 10 + 8).alias("x1"), (F.floor(F.col("pos") / 10) + 1).alias("y1"))
    begun = time.monotonic()
    got = areas.areas(with_hits(docs, [(0, "number", "[0-9]{3}")]), words).collect()
    assert time.monotonic() - begun < 60 and len(got) == n
    assert {(r.y0 * 10 + r.x0 // 10) // 2 for r in got} == set(range(n)) and all(r.value in r.context for r in got)
