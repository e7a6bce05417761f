import numpy as np
import xxhash
from pyspark.sql import functions as F

from shoebox.llm import sketch
from tests.llm.helpers import AWKWARD, documents, prose, shingles, words


def hashed(parts):
    seed = 42
    for part in parts:
        seed = xxhash.xxh64_intdigest(part.encode(), seed=seed)
    return seed


def plain(text):
    w = words(text)
    grams = [hashed(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [hashed([" ".join(w)])] if w else []
    return sorted({h for h in grams if h < int(sketch.FRACTION * 2**64)})


def near(a, b, equal):
    either = len(set(a) | set(b))
    return len(set(a) & set(b)) / either if either else float(equal)


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = plain(text), plain(edited), plain(after)
        out.append((i, len(text), "".join(f"{h:016x}" for h in a), "".join(f"{h:016x}" for h in b), near(a, b, text == edited), near(a, c, text == after)))
    return sorted(out, key=repr)


def run(spark, rows):
    found = sketch.fingerprints(documents(spark, [(i, t, "en") for i, t in rows]))
    return sorted(((r["doc_id"], r["n_chars"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in found.collect()), key=repr)


def test_equals_plain_version(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), t) for i, t in zip(rng.integers(0, 1 << 60, len(AWKWARD)), AWKWARD)]
    rows += [(int(i), prose(rng, int(rng.integers(1, 300)))) for i in rng.integers(0, 50, 120)]
    rows += [rows[-1], (None, "no id"), (-5, prose(rng, 40))]
    assert run(spark, rows) == expected(rows)


def test_one_row_is_its_own_next(spark):
    rows = [(4, "a b c d e f g h")]
    assert run(spark, rows) == expected(rows)
    assert run(spark, []) == []


def test_merge_and_containment(spark):
    rng = np.random.default_rng(5)
    whole = prose(rng, 6000, 5000)
    part = " ".join(whole.split()[1000:2000])
    row = spark.createDataFrame([(whole, part)], "a string, b string").select(sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b"))
    r = row.select(
        sketch.containment(F.col("b"), F.col("a")).alias("inside"),
        sketch.containment(F.col("a"), F.col("b")).alias("around"),
        (sketch.merge(F.col("a"), F.col("b")) == F.col("a")).alias("merged"),
    ).first()
    assert r["inside"] == 1.0 and abs(r["around"] - 1 / 6) < 0.06 and r["merged"]


def test_error_against_exact_likeness(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = {r["doc_id"]: r for r in sketch.fingerprints(docs).collect()}
    texts = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    errors, empty = [], 0
    for k, (i, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        half = len(text) // 2
        a, b = shingles(text), shingles(text[: len(text) - half] + after[:half])
        empty += bool(a) and not rows[i]["fingerprint"]
        if len(a) >= 20:
            errors.append(abs(rows[i]["near_edited"] - len(a & b) / len(a | b)))
    print("mean and largest error", np.mean(errors), max(errors), "empty", empty, "of", len(texts))
    assert np.mean(errors) < 0.03 and max(errors) < 0.25 and empty < 0.02 * len(texts)
