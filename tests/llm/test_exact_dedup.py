import hashlib
import random
from collections import defaultdict

from veilspark.llm import exact_dedup
from veilspark.llm.shared import ASCII_LOWER


def brute(rows):
    groups = defaultdict(list)
    for k, (doc_id, text) in enumerate(rows):
        groups[(text or "").translate(ASCII_LOWER)].append((doc_id, k))
    out = []
    for text, members in groups.items():
        top = max((d for d, _ in members if d is not None), default=None)
        stays = next(k for d, k in members if d == top)
        out += [(d, top, len(members), k == stays, hashlib.sha256(text.encode()).hexdigest()) for d, k in members]
    return out


def key(rows):
    return sorted(rows, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return [tuple(r) for r in exact_dedup.exact_duplicates(df, **more).collect()]


def test_ties_nulls_empty_and_repeated_rows(spark):
    rows = [(1, "A"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "b"), (None, "B"), (5, "É"), (6, "é"), (7, "x" * 100_000), (8, "X" * 100_000)]
    assert key(run(spark, rows)) == key(brute(rows))


def test_spilling_at_every_depth_gives_the_same(spark):
    rng = random.Random(3)
    texts = [f"text {rng.randrange(150)} " + "y" * rng.randrange(3) for _ in range(900)] + ["hot"] * 600
    rows = list(enumerate(texts))
    assert key(run(spark, rows, table_bytes=900)) == key(brute(rows))


def test_fold_survives_hash_collisions(monkeypatch):
    class Hash:
        @staticmethod
        def xxh3_64_intdigest(key, seed=0):
            return len(key) if seed < 1000 else hash((key, seed)) & (1 << 63) - 1

    monkeypatch.setattr(exact_dedup, "xxhash", Hash)
    records = [(f"{i % 7}".encode(), [1]) for i in range(70)]
    merge = lambda into, value: into.__setitem__(0, into[0] + value[0])
    for budget in (1 << 20, 500):
        assert sorted((k, v[0]) for k, v in exact_dedup.grace_fold(iter([(k, list(v)) for k, v in records]), merge, budget)) == [(f"{i}".encode(), 10) for i in range(7)]


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, gid string, rows int, top string")
    assert exact_dedup.exact_duplicates(df).collect() == []
    df = spark.createDataFrame([(1, "a", "z", 4, "t")], "doc_id long, text string, gid string, rows int, top string")
    assert [r.keep_id for r in exact_dedup.exact_duplicates(df).collect()] == [1]
