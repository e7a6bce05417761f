import numpy as np

from shoebox.llm import decontam
from tests.llm.helpers import AWKWARD, documents, prose, words


def plain(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(str(item) if item is not None else None)
    lengths = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[tuple(w[p : p + n])]
        out.append((i, len(w), len(hit), sorted(f for f in found if f is not None)))
    return sorted(out, key=repr)


def sample():
    rng = np.random.default_rng(2)
    items = [(k, prose(rng, n, 30)) for k, n in enumerate([1, 3, 9, 10, 11, 25, 40, 12])]
    items += [(20, None), (21, ""), (None, prose(rng, 14, 30)), (5, items[5][1]), (22, items[5][1]), (23, "same " * 30)]
    docs = [(k, t) for k, t in enumerate(AWKWARD)]
    for k in range(60):
        text = prose(rng, 80, 30).split()
        for _ in range(k % 4):
            piece = (items[rng.integers(len(items))][1] or "").split()
            at = rng.integers(len(text))
            text[at:at] = piece[: rng.integers(5, 45)]
        docs.append((100 + k, " ".join(text).upper() if k % 5 == 0 else ",\n".join(text)))
    docs += [docs[-1], (None, items[6][1]), (7, "same " * 25)]
    return docs, items


def run(spark, docs, items, **more):
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.scan(documents(spark, [(i, t, "en") for i, t in docs]), table, **more)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_equals_plain_version(spark):
    docs, items = sample()
    assert run(spark, docs, items) == plain(docs, items)


def test_benchmark_in_several_passes(spark):
    docs, items = sample()
    assert run(spark, docs, items, block_bytes=4000) == plain(docs, items)


def test_clean_documents_stay(spark):
    docs, items = sample()
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = documents(spark, [(i, t, "en") for i, t in docs])
    kept = decontam.clean_only(whole, table)
    assert kept.columns == whole.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((i for i, _, hit, _ in plain(docs, items) if not hit), key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark, [(1, "a b c", "en")])
    assert [tuple(r) for r in decontam.scan(docs, none).collect()] == [(1, 3, 0, [])]
    assert decontam.clean_only(docs, none).count() == 1
    assert decontam.scan(documents(spark, []), spark.createDataFrame([(1, "a b")], none.schema)).count() == 0
