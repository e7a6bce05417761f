import itertools
from collections import Counter

import numpy as np
import pytest

from shoebox.llm import forest
from shoebox.llm.components import components
from tests.llm.helpers import AWKWARD, documents, prose, shingles


def plain(rows, least=0.8):
    """class_id, n_links, n_text_links, n_copies of each row, by comparing all pairs."""
    rows = [(i, t or "") for i, t in rows]
    copies = Counter(t for _, t in rows)
    sets = {t: shingles(t) for t in copies}
    near = {t: set() for t in copies}
    for a, b in itertools.combinations(copies, 2):
        both = len(sets[a] & sets[b])
        if both and both >= least * (len(sets[a] | sets[b])) - 1e-9:
            near[a].add(b)
            near[b].add(a)
    lowest = {t: min(i for i, x in rows if x == t) for t in copies}
    out = []
    for i, t in rows:
        seen, todo = {t}, [t]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out.append((i, min(lowest[x] for x in seen), sum(copies[x] for x in near[t]) + copies[t] - 1, len(near[t]), copies[t]))
    return sorted(out)


def sample():
    rng = np.random.default_rng(4)
    rows = [(i, t) for i, t in enumerate(AWKWARD)]
    base = [prose(rng, n) for n in (6, 30, 120, 400) for _ in range(6)]
    for text in base:
        w = text.split()
        rows.append((len(rows), text))
        for _ in range(4):
            v = list(w)
            for p in rng.integers(len(w), size=max(1, len(w) // 40)):
                v[p] = "changed"
            rows.append((len(rows), " ".join(v)))
    rows += [(len(rows) + k, base[0].upper() + "!") for k in range(3)] + [(5000 + k, base[7]) for k in range(40)] + [(5000, base[7])]
    # A large group of different texts that are all alike.
    w = prose(rng, 150).split()
    rows += [(9000 - k, " ".join([*w[: k % 150], f"own{k}", *w[k % 150 :]])) for k in range(300)]
    return rows


@pytest.mark.parametrize("block", [16, 128])
def test_equals_all_pairs(spark, block):
    rows = sample()
    spec = forest.Forest(block=block)
    found = forest.near_groups(documents(spark, [(i, t, "en") for i, t in rows]), spec)
    assert sorted(map(tuple, found.collect())) == plain(rows)


def test_keep_one_leaves_columns_and_one_row_a_group(spark):
    rows = sample()
    docs = documents(spark, [(i, t, "en") for i, t in rows])
    kept = forest.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, *_ in plain(rows)})


def test_null_ids_and_empty_table(spark):
    docs = documents(spark, [(None, "a b c d e f", "en"), (None, "a b c d e f", "en"), (3, "g h", "en")])
    assert sorted((r["doc_id"] or -1, r["n_links"]) for r in forest.near_groups(docs).collect()) == [(-1, 1), (-1, 1), (3, 0)]
    assert forest.keep_one(docs).count() == 2
    none = documents(spark, [])
    assert forest.near_groups(none).count() == 0 and forest.keep_one(none).count() == 0


def test_depths_keep_the_recall():
    spec = forest.Forest()
    for pairs in ({}, {(t, d): 10.0 ** (t + 6 - d) for t in range(16) for d in (4, 5, 6)}):
        depths = forest.shorten(pairs, spec)
        assert 1 - np.prod([1 - 0.8**d for d in depths]) >= spec.recall
    with pytest.raises(ValueError):
        forest.shorten({}, forest.Forest(trees=2))


def test_depths_are_chosen_by_all_buckets(spark, monkeypatch):
    docs = documents(spark, [(i, t, "en") for i, t in sample()])
    spec = forest.Forest()
    classes = forest.signatures(docs, spec, "doc_id", "text").filter("sig IS NOT NULL").dropDuplicates(["node"]).cache()
    seen = {}
    monkeypatch.setattr(forest, "shorten", lambda pairs, spec: seen.update(pairs) or [spec.depth] * spec.trees)
    forest.choose_depths(classes, spec)
    sig = np.stack([np.frombuffer(r["sig"], np.uint32) for r in classes.collect()]).reshape(-1, spec.trees, spec.depth)
    for tree in range(spec.trees):
        for depth in range(spec.shortest, spec.depth + 1):
            sizes = Counter(map(bytes, sig[:, tree, :depth]))
            assert seen[tree, depth] == sum(n * (n - 1) / 2 for n in sizes.values())


def test_components_of_a_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(900, 901), (950, 950)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert all(roots[i] == 0 for i in range(n + 1)) and roots[901] == 900 and roots[950] == 950
