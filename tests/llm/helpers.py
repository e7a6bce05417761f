"""Small inputs and plain versions shared by the tests of the text operators."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def shingles(text, width=5):
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.integers(vocabulary)}x{rng.integers(3)}" for _ in range(n))


AWKWARD = [None, "", "   \n ", "one", "One, TWO three", "ÉÄ ñandú", "😀 😀", "!!!", "a" * 50_000, "x\x00y", " \n" * 3000]


def documents(spark, rows):
    """A documents table with columns that operators might use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, root string, `_text` int, score double"
    return spark.createDataFrame([(i, t, lang, "src0", len(t or ""), 1, "r", 7, 0.5) for i, t, lang in rows], schema)
