import numpy as np
import public_tokenizers
import pyarrow as pa
import regex

from shoebox.llm import trietokens
from tests.llm.helpers import AWKWARD, documents, prose


def plain(text):
    vocabulary = trietokens._pieces("byte_bpe_multi_50k.tiktoken")
    parts = regex.findall(public_tokenizers.PATTERN, text or "")
    walked = [trietokens.walk(p.encode(), vocabulary) for p in parts]
    return len(parts), sum(n for _, n in walked), sum(s for s, _ in walked)


def all_ways(token, scores):
    """Best score and fewest pieces by trying every segmentation."""
    if not token:
        return (0.0, 0)
    ways = []
    for cut in range(1, len(token) + 1):
        if token[:cut] in scores:
            score, pieces = all_ways(token[cut:], scores)
            ways.append((round(scores[token[:cut]] + score, 9), -(1 - pieces)))
    best = max(ways)
    return best[0], best[1]


def test_walk_against_every_segmentation():
    vocabulary = trietokens._pieces("byte_bpe_multi_50k.tiktoken")
    for token in (b" the", b"tionan", b"\xc3\xa9ement", b"Haan", b"12a"):
        score, pieces = trietokens.walk(token, vocabulary)
        want = all_ways(token, vocabulary.scores)
        assert abs(score - want[0]) < 1e-6 and pieces == -want[1]


def test_trie_equals_walk():
    vocabulary = trietokens._pieces("byte_bpe_multi_50k.tiktoken")
    rng = np.random.default_rng(1)
    tokens = {"".join(rng.choice(list("aehtn é"), size=rng.integers(1, 14))) for _ in range(800)} | {"a", "ab", "abc", "x" * 64}
    tokens = sorted(tokens, key=str.encode)
    score, number = trietokens.trie_scores(pa.array(tokens), vocabulary)
    want = [trietokens.walk(t.encode(), vocabulary) for t in tokens]
    assert number.tolist() == [n for _, n in want]
    np.testing.assert_array_equal(score, [s for s, _ in want])


def test_documents(spark):
    rng = np.random.default_rng(2)
    rows = [(i, t) for i, t in enumerate(AWKWARD[:8] + AWKWARD[9:])] + [(100, prose(rng, 300)), (100, prose(rng, 300)), (None, "x"), (101, "y" * 3000)]
    found = trietokens.token_counts(documents(spark, [(i, t, "en") for i, t in rows])).collect()
    want = sorted(((i, *plain(t)) for i, t in rows), key=repr)
    for got, expected in zip(sorted((tuple(r) for r in found), key=repr), want, strict=True):
        assert got[:3] == expected[:3] and abs(got[3] - expected[3]) < 1e-6 * max(1, -expected[3])
    assert trietokens.token_counts(documents(spark, [])).count() == 0
