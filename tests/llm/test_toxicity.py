import math
import random

import numpy as np

from veilspark.llm.toxicity import CLEAR, SPAN, TOP, Bags, Model, ngrams, toxicity_scores, train, training_rows, windows_of, words_of

CALM = "river stone cloud meadow window paper garden silver bread table music letter winter morning candle bridge".split()
RUDE = ["vermin", "rubbish", "idiotic"]


def make(n, seed, rude=RUDE):
    rng, rows = random.Random(seed), []
    for k in range(n):
        words = [rng.choice(CALM) for _ in range(rng.randrange(20, 120))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(rude))
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy_and_unseen_misspellings(spark):
    rows = make(240, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity_scores(docs, labels).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 40 and sum(p == y for p, y in held) >= 0.97 * len(held)
    model = train([t for _, t, _ in rows], [y for _, _, y in rows])
    assert min(model.word(w) for w in ("vermiin", "rubbishy", "idiotik")) > max(model.word(w) for w in CALM)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "vermin", "x"), (3, "a " * 60_000, "x"), (3, "a", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity_scores(docs, labels).collect()
    assert len(rows) == 5 and all(r.score == 0.5 for r in rows)
    model = Model(np.ones(1 << 17), 0.5, np.array([1.0, 1.0, 1.0]), 0.0)
    assert all(0 <= r.score <= 1 for r in toxicity_scores(docs, labels, model=model).collect())
    assert toxicity_scores(docs.limit(0), labels).collect() == []


def test_the_middle_of_a_long_run_is_scored():
    for n in range(41, 130):
        run = "".join(chr(0x4E00 + k) for k in range(n))
        parts = words_of(run)
        assert all(any(run[k : k + 10] in p for p in parts) for k in range(n - 9)) and parts[0][0] + parts[-1][-1] == run[0] + run[-1]
    assert words_of("short " + "x" * 40) == ["short", "x" * 40] and len(ngrams("".join(map(chr, range(97, 123))) * 2)) > 75
    rows = make(240, 1)
    model = train([t for _, t, _ in rows], [y for _, _, y in rows])
    score = lambda text: model.score(np.array([model.word(w) for w in words_of(text)]))
    most = lambda text: max(map(model.word, words_of(text)))
    assert score("-".join(CALM[:6] + RUDE + CALM[6:12])) > 0.7 > 0.3 > score("-".join(CALM[:12]))
    assert most("".join(CALM[:6] + RUDE + CALM[6:12])) > most("".join(CALM[:12]))


def plain_score(model, text):
    """The score by loops over whole windows' mean vectors, one n-gram after the other."""
    words = words_of(text or "")
    numbers = []
    for w in words:
        total = 0.0
        for bucket in ngrams(w):
            total += float(model.worth[bucket])
        numbers.append(total / len(ngrams(w)))
    odds = [sum(numbers[at : at + SPAN]) / SPAN + model.bias for at in range(max(1, len(numbers) - SPAN + 1))]
    best = sorted(odds[:: SPAN // 2])[-TOP:]
    clear = sum(1 / (1 + math.exp(-2 * min(max(x - CLEAR, -15), 15))) for x in odds) / SPAN
    z = model.slopes[0] * sum(best) / len(best) + model.slopes[1] * math.log(1 + clear) + model.slopes[2] * math.log(len(words) + 20) + model.shift
    return 1 / (1 + math.exp(-min(max(z, -30), 30)))


def test_scores_against_plain_loops(spark):
    rows = make(200, 3)
    texts = [t for _, t, _ in rows[:60]] + [None, "", "one", "vermin " * 5000, "idiotic-rubbish" * 20, "a b c d", "a b c d e"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] * 2, "doc_id long, text string")
    model = train([t for _, t, _ in rows], [y for _, _, y in rows])
    got = toxicity_scores(docs, docs.selectExpr("doc_id", "1 AS toxic"), model=model).collect()
    assert len(got) == 2 * len(texts) and all(abs(r.score - plain_score(model, texts[r.doc_id])) < 1e-6 and r.predicted == (r.score >= 0.7) for r in got)


def test_training_rows_are_labelled_bounded_and_repeatable(spark):
    rows = [(k % 50, f"text {k} " * 30) for k in range(300)] + [(None, "x")] * 3
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    one = training_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), labels)
    assert one == training_rows(spark.createDataFrame(rows[::-1], "doc_id long, text string"), labels) and 20 < len(one[0]) < 50
    assert sum(map(len, training_rows(spark.createDataFrame(rows, "doc_id long, text string"), labels, train_chars=16_000)[0])) <= 16_000


def test_windows_are_bounded_by_parameters():
    bags, rng = Bags(["w " * 96 * 20, "w " * 96 * 20]), np.random.default_rng(1)
    count = lambda **most: np.bincount([y for _, y in windows_of(bags, np.arange(2), np.array([False, True]), rng, **most)]).tolist()
    assert count() == [2, 8] and count(toxic_windows=99, clean_windows=99) == [20, 20]
