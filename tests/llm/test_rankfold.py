"""The fold of ranked merges against tiktoken and a plain loop."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from veilspark.llm import registry
from veilspark.llm.rankfold import FOLD_BYTES, brute_ids, decode_ids, fold_texts, read_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def texts() -> list:
    rng = random.Random(3)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "etaoin shrdlu", "0123456789,. ", "äöüß €—é", "東京大学日本語", "🙂👍a1 ", " \n\t　\xa0\x85", "'sdtmreve ll", "ࡱᲉ\U00010570\U00010d40x "]
    drawn = ["".join(rng.choice(a) for _ in range(rng.randrange(1, 60))) for a in alphabets for _ in range(12)]
    long = ["".join(rng.choice("abcdef") for _ in range(FOLD_BYTES + k)) for k in (-1, 0, 1, 900)]
    return [None, "", "The cat sat on the mat. The cat's mat!", "<|endoftext|> is text", "\x00 null \x00\x00", " " * 300, "-" * 500, *drawn, *long, "a " + long[2] + " b " + long[3]]


@pytest.mark.parametrize("cached", [1 << 17, 5])
def test_fold_equals_tiktoken(spark, cached):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, `a.b` int").repartition(2)
    got = {r["doc_id"]: r for r in fold_texts(docs, PATH, "bytes", cached=cached).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        ids = own.encode_ordinary(t or "")
        assert np.frombuffer(bytes(got[k]["ids"]), "<u4").tolist() == ids, t
        assert bytes(got[k]["decoded"]) == (t or "").encode()
    digest = {r["doc_id"]: r for r in fold_texts(docs.limit(4), PATH, cached=cached).collect()}
    for k, r in digest.items():
        assert r["ids_sha256"] == hashlib.sha256(bytes(got[k]["ids"])).hexdigest() and r["n_tokens"] == len(got[k]["ids"]) // 4


def test_plain_loop_and_decoding(spark):
    ranks = read_ranks(PATH)
    words = ["hello", " world", "antidisestablishmentarianism", "zzzzzzzzzz", "é"]
    docs = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "doc_id long, text string")
    got = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in fold_texts(docs, PATH, "bytes", cached=0).collect()}
    assert [got[k] for k in range(len(words))] == [brute_ids(w, ranks) for w in words]
    table = spark.createDataFrame([(got[0],), ([],), ([99_999_999],), (None,)], "ids array<int>")
    assert [None if r["decoded"] is None else bytes(r["decoded"]) for r in decode_ids(table, PATH).collect()] == [b"hello", b"", None, None]


def test_no_python_without_long_words(spark):
    docs = spark.createDataFrame([(1, "plain words only"), (None, "plain"), (1, "plain words only")], "doc_id long, text string")
    done = fold_texts(docs, PATH)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert done.count() == 3 and fold_texts(docs.limit(0), PATH).count() == 0
    assert done.filter(F.col("doc_id").isNull()).count() == 1


def test_descriptions_of_the_plan_stay_short(spark, tmp_path):
    """The driver keeps one for each run: with the tables in them it ran out of heap after some runs."""
    spark.createDataFrame([(1, "plain words only"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    keys = ("spark.sql.debug.maxToStringFields", "spark.sql.maxPlanStringLength", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        done = registry.queries()["op13_byte_bpe"](spark, str(tmp_path))
        run = done._jdf.queryExecution()
        assert len(run.toString()) < 50_000 and len(run.executedPlan().simpleString(1)) < 50_000
        assert done.count() == 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
