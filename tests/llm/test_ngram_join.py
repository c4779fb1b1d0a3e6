import random
import re
from collections import Counter

import numpy as np
import pytest

from veilspark.llm import ngram_join
from veilspark.llm.components import connected_components
from veilspark.llm.shared import ASCII_LOWER


def brute(rows, percent, size):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII_LOWER))
        k = min(size, len(w))
        sets.append(frozenset((tuple(w[i : i + k]), k) for i in range(len(w) - k + 1)) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def corpus(seed, common):
    """Families at all distances; with common, most tokens are frequent and lie in passages that many share."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12 if common else 400)]
    passage = [rng.choice(vocabulary) for _ in range(90)]
    texts = []
    for _ in range(14):
        origin = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 14, 40, 90, 200]))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 4, 12])):
            copy = list(origin)
            for _ in range(rng.randrange(0, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice([rng.choice(vocabulary), f"new{rng.random()}"])
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else "\t".join(copy))
    return texts


EDGES = [None, "", " \n ", "one", "ONE", "one two", "one two three", "one two three four", "x " * 20_000, "x " * 20_001, "é É", "É é", "a b c d", "a b"]


@pytest.mark.parametrize(("percent", "size", "common", "width"), [(90, 3, False, 16), (90, 3, True, 16), (80, 5, True, 17), (80, 5, False, None), (60, 2, True, 16)])
def test_components_against_brute_force(spark, percent, size, common, width):
    texts = corpus(percent + common, common) + EDGES
    rows = [(i * 7 % 997, t) for i, t in enumerate(texts)] + [(5, texts[0]), (5, texts[20]), (None, texts[3]), (None, "alone in the world"), (5, texts[0])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    got = [tuple(r) for r in ngram_join.near_components(docs, percent, size, width=width).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, percent, size), key=str)


def family(seed, n, words=120):
    """Near copies of one text at distances around the threshold, two versions of it, and texts that share a passage."""
    rng = random.Random(seed)
    origin = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    other = [*origin[: words // 2], *(f"v{k}" for k in range(words // 6)), *origin[words // 2 :]]
    texts = []
    for k in range(n):
        copy = list(origin if k % 3 else other)
        for _ in range(rng.randrange(0, 7)):
            copy[rng.randrange(len(copy))] = rng.choice([f"e{rng.randrange(5)}", f"new{rng.random()}"])
        texts.append(" ".join(copy))
    return texts + [" ".join([*origin[:90], *(f"own{k}_{j}" for j in range(rng.randrange(5, 30)))]) for k in range(n // 3)]


@pytest.mark.parametrize(("percent", "size", "few"), [(80, 5, 2), (90, 3, 2), (80, 5, 8)])
def test_large_entries_against_brute_force(spark, percent, size, few):
    rows = list(enumerate(family(few + percent, 70)))
    got = [tuple(r) for r in ngram_join.near_components(spark.createDataFrame(rows, "doc_id long, text string"), percent, size, few=few).collect()]
    want = brute(rows, percent, size)
    assert sorted(got) == sorted(want) and len({c for *_, c in want}) > 3


def test_sets_that_share_a_hash_stay_apart(spark):
    texts = ["a b c d e", "f g h i j", "a b c d e", "k l m n o"]
    nodes = {ngram_join.hashes_of(ngram_join.Words().shingles(t.encode(), 3)) for t in texts}
    facts = spark.createDataFrame([(k, k, 7, again, 3) for k, (_, again) in enumerate(sorted(nodes))], "doc_id long, mark long, node long, again long, n long")
    join = ngram_join.JaccardJoin(spark.createDataFrame([(1, "x")], "doc_id long, text string"), 90, 3, "doc_id", "text", 16)
    assert {r.node for r in join.with_nodes(facts).collect()} == {again for _, again in nodes} and join.twice == {7}
    first, second = sorted(nodes)[0]
    assert ngram_join.node_of(ngram_join.Words().shingles(b"a b c d e", 3), frozenset([ngram_join.hashes_of(ngram_join.Words().shingles(b"a b c d e", 3))[0]])) in {again for _, again in nodes} and first != second


def test_empty_table(spark):
    assert ngram_join.near_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("percent", [90, 80, 60])
def test_linked_sets_always_share_an_entry(percent):
    rng = np.random.default_rng(percent)
    for trial in range(400):
        # every kind of level, so that prefixes hold singles, pairs and triples
        table = rng.choice(np.array([0, 3, 14, 17, 40, 60], np.uint8), 1 << 16, p=[0.05, 0.05, 0.2, 0.2, 0.25, 0.25])
        p = ngram_join.Prefixes(percent, table, 10.0)
        n = int(rng.integers(2, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        edits = int(rng.integers(0, max(1, (100 - percent) * n // 130) + 1))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[edits:]], rng.integers(0, 1 << 63, int(rng.integers(0, edits + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) > 1 and len(a) > 1 and 100 * both >= percent * (len(a) + len(b) - both):
            assert len(np.intersect1d(p.entries(a)[0], p.entries(b)[0])), (trial, len(a), len(b), both)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 400, 300).astype(np.uint64)) for _ in range(2))
        differ = sum(int(x ^ y).bit_count() if (x ^ y) >= 0 else int((int(x) ^ int(y)) & (1 << 64) - 1).bit_count() for x, y in zip(ngram_join.parities(a).tolist(), ngram_join.parities(b).tolist(), strict=True))
        assert differ <= len(np.setxor1d(a, b))


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(50)] + [(1000, 1000 + k) for k in range(1, 300)] + [(2000, 1999), (1999, 2000)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = Counter(r.label for r in connected_components(df).collect())
    assert got == {0: 51, 1000: 300, 1999: 2}
    assert connected_components(df.limit(0)).collect() == []


def test_near_copies_without_their_leader_meet_once(spark):
    """A family whose leader links with none of it: the others, near copies of each other, need no pairs among them."""
    rng = random.Random(4)
    origin = [f"w{k}" for k in range(300)]
    copies = [[f"e{rng.random()}" if j in at else w for j, w in enumerate(origin)] for at in [rng.sample(range(230, 300), 2) for _ in range(80)]]
    texts = [" ".join(origin[:225]), *(" ".join(c) for c in copies)]
    nodes = [ngram_join.node_of(ngram_join.Words().shingles(t.encode(), 5)) for t in texts]
    join = ngram_join.JaccardJoin(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 80, 5, "doc_id", "text", 16)
    join.shared_entries = lambda: spark.createDataFrame([(1, n, nodes[0], len(nodes)) for n in nodes], "key long, node long, leader long, size long")
    counts, found = [], join.apart

    def counted(families, sets):
        counts.append((pairs := found(families, sets)).count())
        return pairs

    join.apart = counted
    links = join.run()[1]
    assert counts[0] <= len(nodes)
    assert {r.node for r in connected_components(links).collect()} == set(nodes[1:])
    assert connected_components(links).select("label").distinct().count() == 1
