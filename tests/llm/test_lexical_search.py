"""The tiered index against plain loops, whatever the tiers."""

import random

import pytest

from veilspark.llm import lexical_search as ls


def corpus(n: int = 150) -> list[tuple]:
    rng = random.Random(7)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.randrange(1, 80)))) for k in range(n)]
    docs += [(3, docs[3][1]), (None, docs[5][1]), (900, None), (901, ""), (902, "... !!"), (903, "W1 w1\tW1-É É"), (904, "w7 " * 400), (905, docs[9][1]), (905, docs[9][1])]
    return docs


def asked(n: int = 12) -> list[tuple]:
    rng = random.Random(8)
    return [(k, " ".join(rng.choices([f"w{j}" for j in range(70)], k=rng.randrange(1, 25)))) for k in range(n)] + [(77, None), (78, "nothing-of-this"), (79, "É w1, W1"), (80, "w59")]


@pytest.mark.parametrize(("tiers", "candidates", "block"), [((500, 8000), 40, 1 << 15), ((5, 20), 12, 1 << 15), ((3,), 10, 40), ((), 10, 1 << 15)])
def test_search_equals_plain_loops(spark, tiers, candidates, block):
    docs, items = corpus(), asked()
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, `a.b` int").repartition(3)
    queries = spark.createDataFrame([(*q, "x") for q in items], "item_id int, text string, query string")
    got = sorted(map(tuple, ls.ranked_search(table, queries, tiers=tiers, candidates=candidates, block_terms=block).collect()))
    assert got == sorted(ls.brute_search(docs, items))


def test_proofs_spare_lower_tiers_and_hold(spark, monkeypatch):
    docs = [(k, "common word here") for k in range(300)] + [(1000 + k, f"rare{k % 3} common") for k in range(60)]
    items = [(1, "rare1 common"), (2, "common word")]
    left, search = [], ls.Index.search
    monkeypatch.setattr(ls.Index, "search", lambda self, *a: (search(self, *a), left.append(self.left))[0])
    table, queries = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    assert sorted(map(tuple, ls.ranked_search(table, queries, tiers=(30,)).collect())) == sorted(ls.brute_search(docs, items))
    assert left == [1]  # the rare term's results are proven in the first tier, equal common ones never are


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(corpus()[:5], "doc_id long, text string"), spark.createDataFrame([(1, "w1")], "item_id int, text string")
    assert ls.ranked_search(docs.limit(0), items).count() == 0
    assert ls.ranked_search(docs, items.limit(0)).count() == 0
