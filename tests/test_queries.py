"""Every core query against its SQL on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from veilspark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(float(f"{r[k]:.9g}") if isinstance(r[k], float) else r[k] for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_matches_sql(spark, sf, duck, name):
    df, sql = registry.queries()[name](spark, sf), duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    assert got == plain(sql.fetchall(), sql.columns) and got


def test_flagship_and_guard(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())


def test_graph_over_words_beyond_the_200th(spark, tmp_path):
    spark.createDataFrame([(1, "w " * 500), (2, "one"), (3, " "), (4, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    down = {}
    for pos in range(500):
        down.setdefault(pos // 2, []).extend([pos] * (pos % 9 != 4))
        down.setdefault(pos, []).append(pos // 3)
    reached, todo = {0}, [0]
    while todo:
        new = set(down.get(todo.pop(), ())) - reached
        reached |= new
        todo += new
    got = sorted(map(tuple, registry.queries()["graph_reach"](spark, str(tmp_path)).collect()))
    assert max(reached) > 200 and got == [(1, len(reached), sum(reached)), (2, 1, 0)]


def test_every_event_has_a_position(spark, tmp_path):
    rows = [(k, "ab"[k % 2], 100 - k) for k in range(1, 9)]
    spark.createDataFrame(rows, "event_id long, event_type string, ts long").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.position for r in registry.queries()["queue_position"](spark, str(tmp_path)).collect()}
    assert got == {8: 1, 6: 2, 4: 3, 2: 4, 7: 1, 5: 2, 3: 3, 1: 4}


def test_core_stands_without_the_subpackage(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    real = importlib.import_module
    for blocked in ("veilspark.llm.registry", "corpus_pipeline"):

        def refuse(name, *more, blocked=blocked):
            if name == blocked:
                raise ImportError(name)
            return real(name, *more)

        monkeypatch.setattr(importlib, "import_module", refuse)
        names = set(entry.queries())
        assert set(registry.queries()) <= names and "pipeline" not in names and set(entry.oracle_sql()) <= names


def test_times_are_rounded_as_in_the_sql(spark, duck, tmp_path):
    from veilspark.plans import fixtures as fx

    at = [0, 1, 499, 500, 501, 1499, 1500, 1704386464049098, 1704976432019500, 1704976432019999, -1, -499, -500, -501, -1500]
    got = spark.createDataFrame([(k,) for k in at], "us long").selectExpr("us", "cast(timestamp_micros(us) as timestamp_ntz) AS ts").select("us", fx.epoch_ms(F.col("ts")).alias("ms"))
    want = duck.sql(f"SELECT us, epoch_ms(make_timestamp(us)) FROM (SELECT unnest({at}) AS us)").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_waits_of_requests_between_milliseconds(spark, tmp_path):
    # a window begins at 0.0006 s, and the fifth request comes at 1.0004 s: the wait is 21,599.001 s or 21,599.000 s by how both are rounded
    us = [600, 700, 800, 900, 1_000_400, 1_000_600]
    rows = [(k, -15, t, 0.0) for k, t in enumerate(us)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, us long, value double").selectExpr("event_id", "user_id", "cast(timestamp_micros(us) as timestamp_ntz) AS ts", "value")
    events.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    names = ["event_id", "user_id", "admitted", "reason", "retry_s"]
    for name in ("ratelimit_concurrent", "ratelimit_fixed_window"):
        cols = [c for c in names if name == "ratelimit_concurrent" or c != "reason"]
        want = con.sql(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).select(*cols).collect())) == sorted(want) and any(w[-1] for w in want)


@pytest.mark.parametrize("name", ["hidden_words_diff", "text_loss_pages", "hidden_term_words", "search_areas", "graph_reach"])
def test_words_are_not_shuffled(spark, sf, name):
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    shuffled = [line for line in plan.splitlines() if "Exchange " in line and "REPARTITION_BY_NUM" not in line]
    assert len(shuffled) == {"hidden_term_words": 1, "graph_reach": 1}.get(name, 0)  # terms; a row for each document


def test_entries_of_the_log_are_not_shuffled(spark, sf, monkeypatch):
    from veilspark.operators import fills

    plans, real = {}, fills.staged

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(fills, "staged", noted)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        registry.queries()["fills_paint_order"](spark, sf)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    shuffled = {name: [line for line in plan.splitlines() if "Exchange " in line and "REPARTITION_BY_NUM" not in line] for name, plan in plans.items()}
    assert not shuffled["fills"] and len(shuffled["fill-edges"]) == 1  # the staged fills, to the rectangles' parts
