import base64
import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shoebox.llm import crf
from tests.llm.helpers import AWKWARD, documents


def test_posteriors_equal_enumeration():
    rng = np.random.default_rng(0)
    score, transition = rng.normal(size=(9, 3)).astype(np.float32), rng.normal(size=(3, 3))
    bounds = np.array([0, 4, 4, 9])
    found = crf.posteriors(score, bounds, transition)
    for s, e in ((0, 4), (4, 9)):
        total = np.zeros((e - s, 3))
        for path in itertools.product(range(3), repeat=e - s):
            weight = np.exp(sum(score[s + t, y] for t, y in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:])))
            for t, y in enumerate(path):
                total[t, y] += weight
        np.testing.assert_allclose(found[s:e], total / total.sum(axis=1, keepdims=True), rtol=1e-5)


def paths(score, transition):
    """All label sequences with their unnormalised log weights."""
    for path in itertools.product(range(score.shape[1]), repeat=len(score)):
        yield path, sum(score[t, y] for t, y in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:]))


def log_likelihood(score, bounds, transition, truth):
    total = 0.0
    for s, e in zip(bounds, bounds[1:]):
        if e > s:
            weights = dict(paths(score[s:e], transition))
            total += weights[tuple(truth[s:e])] - np.log(sum(np.exp(w) for w in weights.values()))
    return total


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_expected_moves_equal_enumeration_and_finite_differences(monkeypatch, block):
    monkeypatch.setattr(crf, "BLOCK", block)
    rng = np.random.default_rng(2)
    score, transition = rng.normal(size=(11, 3)), 2 * rng.normal(size=(3, 3))
    bounds, truth = np.array([0, 5, 5, 6, 11]), rng.integers(0, 3, 11)
    expected = np.zeros((3, 3))
    crf.posteriors(score, bounds, transition, expected)
    plain = np.zeros((3, 3))
    for s, e in ((0, 5), (6, 11)):
        weights = {path: np.exp(w) for path, w in paths(score[s:e], transition)}
        for path, w in weights.items():
            for a, b in zip(path, path[1:]):
                plain[a, b] += w / sum(weights.values())
    np.testing.assert_allclose(expected, plain, rtol=1e-9)
    seen = np.zeros((3, 3))
    for s, e in ((0, 5), (6, 11)):
        np.add.at(seen, (truth[s : e - 1], truth[s + 1 : e]), 1)
    for a, b in itertools.product(range(3), repeat=2):
        near = np.zeros((3, 3))
        near[a, b] = 1e-5
        slope = (log_likelihood(score, bounds, transition + near, truth) - log_likelihood(score, bounds, transition - near, truth)) / 2e-5
        assert abs(slope - (seen - expected)[a, b]) < 1e-6


def test_blocks_join_exactly(monkeypatch):
    rng = np.random.default_rng(1)
    score, transition = rng.normal(size=(700, 4)).astype(np.float32), rng.normal(size=(4, 4))
    bounds = np.array([0, 1, 66, 130, 130, 700])
    small = crf.posteriors(score, bounds, transition)
    monkeypatch.setattr(crf, "BLOCK", 1024)
    np.testing.assert_allclose(small, crf.posteriors(score, bounds, transition), rtol=1e-6)


def test_held_out_accuracy_and_code_switching(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = crf.label_documents(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and len(held) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)

    # Two languages in one text: words are labelled on both sides of the switch.
    model = crf.train(docs, ~crf.held_out())
    by = {k: next(r["text"] for r in held if r["lang"] == k and "|" not in r["text"] and len(r["text"]) > 900) for k in ("de", "es")}
    halves = " ".join(by["de"].split()[:60]), " ".join(by["es"].split()[:60])
    labels = [w for w, _ in crf.word_labels([" ".join(halves)], model)[0]]
    cut = len(crf.word_labels([halves[0]], model)[0])
    assert np.mean([w == "de" for w in labels[:cut]]) > 0.85 and np.mean([w == "es" for w in labels[cut:]]) > 0.85


def test_defined_cases(spark):
    rows = [(i, t, None) for i, t in enumerate(AWKWARD)] + [(100 + i, "the of and to", "en") for i in range(30)] + [(200 + i, "der und die das", "de") for i in range(30)]
    rows += [rows[-1], (None, "und die", "de")]
    docs = documents(spark, rows)
    found = {r["doc_id"]: r for r in crf.label_documents(docs).collect()}
    letters = [any(c.isalpha() for c in t or "") for t in AWKWARD]
    assert [found[i]["lang_pred"] != "und" for i in range(len(AWKWARD))] == letters
    assert found[100]["lang_pred"] == "en" and found[200]["lang_pred"] == "de" and found[None]["held_out"] is False
    kept = crf.known_only(docs)
    assert kept.columns == docs.columns
    assert kept.filter("doc_id >= 100 or doc_id is null").count() == 62


def test_junk_and_foreign_texts_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rng = np.random.default_rng(4)
    by = {k: docs.filter(f"lang = '{k}' and length(text) > 1500 and instr(text, '|') = 0").orderBy("doc_id").first()["text"].split()[:50] for k in ("de", "en", "es", "fr")}
    good = [" ".join(sum(by.values(), [])), " ".join(by["de"] + by["es"]), " ".join(by["fr"][:12])]
    junk = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 10))) for _ in range(200)) for _ in range(20)]
    junk += [base64.b64encode(rng.bytes(900)).decode() for _ in range(20)]
    junk += ["".join(chr(c) for c in rng.integers(33, 127, 900)) for _ in range(20)]
    junk += ["Mieleni minun tekevi aivoni ajattelevi lähteäni laulamahan saa'ani sanelemahan sukuvirttä suoltamahan lajivirttä laulamahan"]
    junk += ["Litwo ojczyzno moja ty jesteś jak zdrowie ile cię trzeba cenić ten tylko się dowie kto cię stracił", "Мой дядя самых честных правил когда не в шутку занемог"]
    # The junk is labelled, so some of it is trained on.
    planted = spark.createDataFrame([(10**9 + i, t, "en", "s", len(t)) for i, t in enumerate(good + junk)], docs.schema)
    kept = crf.known_only(docs.union(planted)).select("doc_id").collect()
    assert sorted(r["doc_id"] - 10**9 for r in kept if r["doc_id"] >= 10**9) == list(range(len(good)))
    assert len(kept) - len(good) > 0.99 * docs.count()


@pytest.mark.parametrize("small", [False, True])
def test_all_texts_are_learned_from(spark, small):
    # More texts than a bounded sample holds, each with a word of its own, and many copies of one.
    own = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) * 2 for i in range(1500)]
    rows = [(i, f"the of and to {own[i]}" if i % 2 else f"der und die das {own[i]}", "en" if i % 2 else "de") for i in range(1500)]
    rows += [(2000 + i, "one text that comes very often", "en") for i in range(700)]
    docs = documents(spark, rows)
    spec = crf.Training(shard_bytes=1 << 13, chunk_bytes=1 << 11) if small else crf.Training()
    model = crf.train(docs, F.lit(True), spec, calibrate=True)
    texts = crf.raw_text(pa.array([t for _, t, _ in rows], pa.string()))
    counts = crf._count(*texts, np.array([model.labels.index(k) for *_, k in rows]), 2)
    np.testing.assert_allclose(model.shares, crf.frequencies(counts))
    assert np.isfinite(model.floors).all()
    assert (model.weights[crf.features(*crf.raw_text(pa.array(own, pa.string()))).fixed] != 0).any(axis=2).all()
    if small:
        again = crf.train(docs.repartition(5), F.lit(True), spec, calibrate=True)
        assert (again.weights == model.weights).all() and (again.transition == model.transition).all() and (again.floors == model.floors).all()


def dealing(spark):
    counts = [1] * 300 + [2, 3, 4, 7, 50]
    rows = [(1000 * i + k, f"text number {i}", "en" if i % 2 else "de") for i, n in enumerate(counts) for k in range(n)]
    # The same text under two labels is not a copy.
    rows += [(-1, "text number 0", "es")]
    return rows, documents(spark, rows).select("text", F.col("lang").alias("label")).repartition(7)


def test_only_texts_with_copies_are_brought_together(spark):
    rows, table = dealing(spark)
    copied = {(t, k) for _, t, k in rows if [r[1:] for r in rows].count((t, k)) > 1}
    found = crf._marked(table).collect()
    assert sorted(tuple(r)[:2] for r in found) == sorted(r[1:] for r in rows)
    assert copied == {tuple(r)[:2] for r in found if r["repeated"]} and len(copied) == 5


@pytest.mark.parametrize("cells", [64, 1 << 26])
def test_copies_are_dealt_round(spark, monkeypatch, cells):
    monkeypatch.setattr(crf, "CELLS", cells)
    rows, table = dealing(spark)
    found = {}
    for r in crf._dealt(table, 4).collect():
        assert r["shard"] not in found.setdefault((r["text"], r["label"]), {})
        found[r["text"], r["label"]][r["shard"]] = r["copies"]
    home = {tuple(r)[:2]: r["home"] for r in table.distinct().withColumn("home", crf._home(4)).collect()}
    assert found.keys() == home.keys()
    for key, shards in found.items():
        n = [r[1:] for r in rows].count(key)
        assert shards == {(home[key] + p) % 4: n // min(n, 4) + (p < n % min(n, 4)) for p in range(min(n, 4))}


def test_single_texts_pass_no_exchange_before_that_to_their_shards(spark):
    docs = documents(spark, [(i, f"{'words of some length ' * 20}{i}", "en") for i in range(200) for _ in range(3 if i % 20 == 0 else 1)])
    dealt = crf._dealt(docs.select("text", F.col("lang").alias("label")), 4)
    dealt.collect()

    def exchanges(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return exchanges(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return exchanges(plan.plan())
        here = [plan.metrics().apply("dataSize").value()] if name == "ShuffleExchangeExec" else []
        return here + [size for i in range(plan.children().size()) for size in exchanges(plan.children().apply(i))]

    moved, total = sum(exchanges(dealt._jdf.queryExecution().executedPlan())), sum(len(r["text"]) for r in docs.collect())
    assert 0 < moved < 0.5 * total, (moved, total)


def test_chunks_hold_every_copy_whatever_the_batches():
    rows = [{"text": "x" * (i % 37), "label": str(i), "copies": 1 + (i % 50 == 0) * 30} for i in range(400)]
    want = [r["label"] for r in rows for _ in range(r["copies"])]
    found = []
    for step in (7, 400):
        batches = [pa.RecordBatch.from_pylist(rows[i : i + step]) for i in range(0, 400, step)]
        found.append([c.column("label").to_pylist() for c in crf._chunks(iter(batches), 500)])
    assert found[0] == found[1] and sum(found[0], []) == want and len(found[0]) > 20


def test_nothing_to_learn(spark):
    docs = documents(spark, [(1, "words here", None), (2, None, "en")])
    assert [(r["lang_pred"], r["score"]) for r in crf.label_documents(docs).collect()] == [("und", 0.0)] * 2
    assert crf.label_documents(documents(spark, [])).count() == 0
