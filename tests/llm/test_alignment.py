"""Cross-tokenizer alignment against a version that compares every pair of tokens."""

import hashlib

import public_tokenizers
import pytest

from veilspark.llm import alignment
from veilspark.llm.alignment import align_texts, brute_alignment
from veilspark.llm.wordcache import by_ranks

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The cat sat on the mat.", "", None, "The cat sat on the mat.", "two  spaces\n\nand lines\t tabs ", " leading", "naïve Straße 東京 日本語 🙂🙂", "a▁b mark", "<|endoftext|> and <s> </s> are text",
    "x" * 300, "1234567890 12,5 %", "\x00\x01 odd", "don't they're I'll", "   ", "\n", "words " * 400,
]


@pytest.mark.parametrize("frequent", [1 << 18, 3, 0])
def test_alignment_equals_brute_force(spark, frequent):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, `a.b` string, pairs int").repartition(3)
    want = brute_alignment(TEXTS, A, B)
    got = {r["doc_id"]: r for r in align_texts(docs, A, B, "groups", frequent=frequent).collect()}
    assert len(got) == len(TEXTS)
    for k, w in enumerate(want):
        g = got[k]
        assert (g["n_a"], g["n_b"], g["n_groups"], g["n_links"], g["n_best"], g["count_sum"], g["groups"]) == w, TEXTS[k]
    assert want[0][0] > 0 and want[7][0] == 0  # a space mark in a text comes back as a space
    digests = {r["doc_id"]: r["groups_sha256"] for r in align_texts(docs, A, B).collect()}
    assert all(digests[k] == (hashlib.sha256(w[6].encode()).hexdigest() if w[0] else "") for k, w in enumerate(want))


def test_repeated_and_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "one text"), (1, "one text"), (None, "another")], "doc_id long, text string")
    rows = sorted((r["doc_id"] or 0, r["n_a"], r["count_sum"]) for r in align_texts(docs, A, B).collect())
    assert [r[0] for r in rows] == [0, 1, 1] and rows[1] == rows[2]
    assert align_texts(docs.limit(0), A, B).count() == 0


def test_white_space_on_both_sides_of_a_space(spark):
    texts = ["a\n \nb", "one\t \ttwo", "x \ny", "x\n y", "a\u00a0 \u0085b", "end\n "]
    want = brute_alignment(texts, A, B)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, align_texts(docs, A, B, "groups").collect()))
    assert [r[1:] for r in got] == want


def test_words_are_merged_by_ranks(monkeypatch):
    a, words = alignment.Aligner(A, B, by_ranks(A)), [" plain", " words,", " it's", " \u00dfé\u2014x"]
    want = alignment.Aligner(A, B, False).aligned(words)

    def never(*_, **__):
        raise AssertionError("the library was called for known code points")

    monkeypatch.setattr(alignment.UnitIds, "of_units", never)
    assert by_ranks(A) and a.aligned(words) == want
