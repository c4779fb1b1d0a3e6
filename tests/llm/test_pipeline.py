import corpus_pipeline as cp
import numpy as np
from pyspark.sql import functions as F
from tests.llm.test_native_scans import brute_lines, brute_secrets
from tests.llm.test_ngram_join import brute, corpus

from veilspark.llm import quality_classifier as qc
from veilspark.llm import secrets
from veilspark.llm.line_dedup import RATIO


def test_one_of_each_group_against_brute_force(spark):
    texts = corpus(3, False)
    rows = [(k, t) for k, t in enumerate(texts)] + [(900, None), (901, ""), (None, texts[0]), (None, "no id at all"), (2, texts[2]), (2, "another text with the same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = brute(rows, 80, 5)
    want = {r for r, (d, n, c) in zip(rows, found, strict=True) if n == 0 or d == c}
    got = [tuple(r) for r in cp.one_of_each_group(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_copied_document_keeps_its_lines(spark):
    rows = [(k, f"menu\nonly {k}", "en", "site", 0) for k in range(40)] + [(100 + k, "a clean page\nof two lines", "en", "site", 26) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in cp.drop_site_lines(spark, docs, "").collect()}
    assert got == {k: text.removeprefix("menu\n") for k, text, *_ in rows}


def test_unlinked_texts_under_one_id_both_stay(spark):
    one, other = " ".join(f"river{k}" for k in range(40)), " ".join(f"stone{k}" for k in range(40))
    rows = [(1, one), (1, other), (5, one), (6, other), (1, one), (9, other + " and more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, cp.one_of_each_group(spark, docs, "").collect())) == [(1, one), (1, other)]


def test_stages_on_the_small_tables(spark, sf):
    docs = cp.read_table(spark, sf, "documents")
    seen = {}
    for name, stage in cp.STAGES:
        before, docs = docs, cp.staged(stage(spark, docs, sf), "test")
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = seen["line_dedup"]
    want = brute_lines([(r.doc_id, r.source, r.text) for r in before.collect()], RATIO, 5)
    assert sorted((r.doc_id, r.text) for r in after.collect()) == sorted(x[:2] for x in want)
    before, after = seen["secret_scan"]
    table = secrets.ratio_table(secrets.labelled_samples(), secrets.corpus_pairs(before))
    texts = {r.doc_id: r.text for r in before.collect()}
    changed = {r.doc_id for r in after.collect() if r.text != texts[r.doc_id]}
    assert changed == {d for d, t in texts.items() if brute_secrets(t, table)[-1]} and len(texts) == after.count()
    before, after = seen["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    whole = sorted(map(tuple, after.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert whole == sorted(map(tuple, cp.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect()))


def test_classifier_on_held_out_labels(spark, sf):
    d = sf.replace("0.001", "0.01")
    docs, labels = (cp.read_table(spark, d, t) for t in ("documents", "labels"))
    held = {r.doc_id: r.quality for r in labels.filter("doc_id % 4 = 1").collect()}
    got = {r.doc_id: r._kept for r in qc.quality_scores(docs, labels.filter("doc_id % 4 <> 1")).select("doc_id", "_kept").collect()}
    assert sum(got[i] == bool(q) for i, q in held.items()) >= 0.97 * len(held)


def test_co_training_teaches_the_poorer_view():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.6
    text = (truth * 2 - 1)[:, None] * 1.5 + rng.normal(0, 0.7, (4000, 1))
    meta = (truth * 2 - 1)[:, None] * np.array([[0.8, 0.4]]) + rng.normal(0, 1.0, (4000, 2))
    few = slice(0, 60)
    model = qc.co_train(text[few], meta[few], truth[few].astype(float), text[60:3000], meta[60:3000])
    right = ((model.scores(text[3000:], meta[3000:]) > 0.5) == truth[3000:]).mean()
    assert right > 0.97


def plain_score(model, kinds, text, values):
    """A document's score by loops: places counted word by word, views summed number by number."""
    places = qc.WordPlaces()
    data = (text or "").encode()
    x = list(qc.measures(qc.Measured(data)))
    words = [places[w] for w in data.split()]
    x += [(words.count(k) / max(1, len(words))) ** 0.5 for k in range(qc.WORD_PLACES)]
    low = data.lower()
    grams = [((a * 961 + b * 31 + c) * 2654435761 % 2**32) >> 26 for a, b, c in zip(low, low[1:], low[2:], strict=False)]
    x += [(grams.count(k) / max(1, len(grams))) ** 0.5 for k in range(qc.TRIGRAM_PLACES)]
    at, numbers = qc.meta_features(values, kinds)
    meta = [0.0] * (qc.PLACES * len(kinds)) + numbers
    for k in at:
        meta[k] = 1.0
    odds = -model.base
    for view, f in ((model.text, x), (model.meta, meta)):
        z = sum((v - m) / s * w for v, m, s, w in zip(f, view.mean, view.scale, view.weights, strict=False)) + view.weights[-1]
        odds += min(20, max(-20, view.slope * z + view.shift))
    return 1 / (1 + np.exp(-odds))


def test_classifier_against_plain_loops(spark, sf):
    docs, labels = (cp.read_table(spark, sf, t) for t in ("documents", "labels"))
    model = qc.train(docs, labels, list(qc.META))
    again = qc.train(docs.repartition(7), labels.repartition(3), list(qc.META))
    assert np.allclose(model.text.weights, again.text.weights) and np.allclose(model.meta.weights, again.meta.weights)
    got = qc.quality_scores(docs, labels, model=model, score_col="s", kept_col="k").collect()
    assert got
    for r in got[:60]:
        want = plain_score(model, [False, False, True], r.text, (r.lang, r.source, float(r.n_chars)))
        assert abs(r.s - want) < 1e-6 and r.k == (want >= qc.KEEP)


def test_stages_keep_columns_of_any_name_and_take_empty_tables(spark, sf):
    names = ["_x", "_m0", "_Score", "_kept", "_base", "_spans", "_bad", "_host", "_id", "_mark", "several", "_several", "count", "label", "node", "n_lines"]
    docs = cp.read_table(spark, sf, "documents").limit(60)
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    docs = cp.staged(docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))), "test")
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert rows and all(r[n] == n for r in rows for n in names), name
        assert stage(spark, docs.limit(0), sf).collect() == []
    assert cp.STAGES[-1][1](spark, docs.limit(0), sf).collect() == []


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, "e"), (None, "", "en", 3, "e"), (3, "x " * 60_000, "en", 4, "e"), (3, "x", "fr", None, "e")], "doc_id long, text string, lang string, n_chars long, quality string")
    none = spark.createDataFrame([(1, 1), (1, 0), (3, None)], "doc_id long, quality int")
    rows = qc.quality_scores(docs, none).collect()
    assert len(rows) == 4 and all(r._score == 0.5 and r._kept for r in rows)
    assert qc.quality_scores(docs.limit(0), none).collect() == []


def test_stages_keep_columns_whose_names_need_quotes(spark, sf):
    docs = cp.read_table(spark, sf, "documents").limit(40).selectExpr("*", "doc_id AS `a.b`", "1 AS `c d`")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.filter("`a.b` <> doc_id").count() == 0
    assert cp.STAGES[-1][1](spark, docs, sf).count() >= 40
