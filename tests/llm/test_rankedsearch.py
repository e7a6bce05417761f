"""Ranked search against scores of all documents, computed plainly."""

import math
from collections import Counter

import numpy as np
import pytest

from shoebox.llm import rankedsearch
from tests.llm.helpers import AWKWARD, documents, prose, words


def plain(docs, items, best=10):
    bags = [(i, Counter(words(t))) for i, t in docs]
    n_docs = sum(bool(b) for _, b in bags)
    length = sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked = Counter(words(text))
        scores = []
        for doc, bag in bags:
            score = 0
            for t, times in asked.items():
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 25 + 75 * bag.total() * n_docs // length
                    score += times * w * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc))
        scores.sort(key=lambda s: (s[0], s[1] is not None, s[1] or 0))
        out += [(item, rank + 1, doc, -score) for rank, (score, doc) in enumerate(scores[:best])]
    return Counter(out)


def found(spark, docs, items, **how):
    table = spark.createDataFrame([(*r, 1, "x", 0.5) for r in items], "item_id long, text string, score long, term string, id double")
    got = rankedsearch.search(documents(spark, [(i, t, "en") for i, t in docs]).repartition(3), table, rankedsearch.Search(**how))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(map(tuple, got.collect()))


@pytest.mark.parametrize("how", [{}, {"owners": 1, "shard_docs": 7}, {"owners": 6, "shard_docs": 16, "shard_bytes": 3000, "group_items": 3, "block_bytes": 700}])
def test_ranking_equals_plain_scores(spark, how):
    rng = np.random.default_rng(3)
    docs = [(i, prose(rng, rng.integers(1, 120), 60)) for i in range(120)]
    # Many copies: equal scores go by the id.
    docs += [(500 - i, docs[3][1]) for i in range(40)]
    items = [(i, prose(rng, rng.integers(1, 20), 70)) for i in range(10)] + [(77, docs[3][1][:60]), (77, docs[3][1][:60])]
    assert found(spark, docs, items, **how) == plain(docs, items)


def test_awkward_texts(spark):
    docs = [(i if i != 4 else None, t) for i, t in enumerate(AWKWARD)] + [(3, "one"), (3, "one"), (None, "two one")]
    items = [(1, None), (2, ""), (None, "ONE one two"), (3, "éä Éä ÉÄ"), (4, "a" * 50_000), (5, "😀 nothing else"), (6, "unheard")]
    assert found(spark, docs, items, owners=3, shard_docs=4) == plain(docs, items)


def test_empty_tables(spark):
    assert not found(spark, [], [(1, "one")])
    assert not found(spark, [(1, "one")], [])


def test_owners_hold_about_as_many_postings():
    rng = np.random.default_rng(1)
    df = rng.zipf(1.5, 5000) % 1000
    owner = rankedsearch.deal(df, 4)
    assert [abs(df[owner == k].sum() * 4 / df.sum() - 1) < 0.1 for k in range(4)] == [True] * 4
    assert all(df[owner == k].max() <= df[owner == k + 1].min() for k in range(3))
