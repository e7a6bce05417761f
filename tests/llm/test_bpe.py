import hashlib

import numpy as np
import pytest

from shoebox.llm import bpe
from tests.llm.helpers import AWKWARD, documents, prose


def plain(text):
    text = text or ""
    ids = bpe._encoding("byte_bpe_multi_50k.tiktoken").encode_ordinary(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def texts():
    rng = np.random.default_rng(8)
    odd = ["a" * 900 + " b " + "c" * 900, " " * 700 + "x", "\n \n  b" * 400, "don't we'll I'm " * 90, "<|endoftext|> " * 60, "é è ü\x1cz " * 150, "12345 678," * 200]
    mixed = ["".join(rng.choice(list("ab \n\t'sé,1"), size=1500)) for _ in range(30)]
    return AWKWARD + odd + mixed + [prose(rng, 500) for _ in range(5)]


@pytest.mark.parametrize("spec", [bpe.Chunking(), bpe.Chunking(size=300, overlap=40), bpe.Chunking(size=64, overlap=64)])
def test_equals_whole_texts(spark, spec):
    rows = list(enumerate(texts()))
    rows += [rows[-1], (None, rows[-2][1])]
    found = bpe.encode_digests(documents(spark, [(i, t, "en") for i, t in rows]), spec)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(((i, *plain(t)) for i, t in rows), key=repr)


def test_empty_table(spark):
    assert bpe.encode_digests(documents(spark, [])).count() == 0


def test_no_agreed_boundary_gives_no_seam():
    assert bpe.seam("a" * 100, 50) is None
    assert bpe.seam("ab cd ef gh ij", 4) == 5
