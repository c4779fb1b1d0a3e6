import re
from collections import Counter

import numpy as np

from veilspark.llm import quality_rules
from veilspark.llm.quality_rules import BASE, MORE, Rule, cascade_order, quality_verdicts

TEXTS = [
    None, "", "one two", "a b c d e f g h i j k", "word " * 30, "x\ny\nx\n\nx\n", "clean text of more than ten words that says something once only, é ü 漢字",
    "A&&& b### c*** d$$$ e%%% f||| g<<< h>>> i j k l", "SHOUT LOUD ALL THE TIME AND NEVER STOP IT NOW OK YES!", "w" * 50_000, "a b c d e " * 3 + "z y x w v", " ".join(map(str, range(9000))) + " 1 2 3 4 5",
]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(grams)
    covered = {p for i, g in enumerate(grams) if times[g] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_counts_against_brute_force(spark):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)] * 2, "doc_id long, text string, kept int")
    got = sorted(tuple(r) for r in quality_verdicts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert got == sorted([(k, *brute(t)) for k, t in enumerate(TEXTS)] * 2)
    kept = {r.doc_id: r.kept for r in quality_verdicts(docs, counts=False).collect()}
    assert {k for k in kept if kept[k]} == {6, 11}  # 3 has words of one letter
    assert quality_verdicts(docs.limit(0)).collect() == []


def test_verdict_does_not_depend_on_the_given_order(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    one, two = (sorted(map(tuple, quality_verdicts(docs, rules, counts=False).collect())) for rules in ([*BASE, *MORE], [*MORE[::-1], *BASE[::-1]]))
    assert one == two


def test_order_is_by_rejections_per_second_among_the_rest():
    failed = np.array([[1, 1, 0], [1, 1, 0], [1, 0, 0], [0, 0, 1]], bool)
    seconds = np.tile([3.0, 1.0, 2.0], (4, 1))
    assert cascade_order(seconds, failed) == [1, 2, 0]
    assert cascade_order(np.zeros((0, 2)), np.zeros((0, 2), bool)) == [0, 1]


def test_own_rules(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "bb")], "doc_id long, text string")
    got = quality_verdicts(docs, [Rule("short", lambda m: len(m.data) < 2)], counts=False)
    assert sorted(map(tuple, got.collect())) == [(1, False), (2, True)]


def test_repeated_windows_in_a_vast_vocabulary():
    n = 3_000_000
    words = [b"%d" % k for k in range(n)]
    assert quality_rules.Measured(b" ".join([*words, *words[100:107]])).n_repeat_words == 14
