"""Threshold-scaled document sketches.

A sketch keeps every hash of a text's word shingles below a fixed fraction of the hash range. So the
sketch of two texts together is the union of theirs, and the share of one sketch's hashes
that the other has estimates how much of one text is contained in the other, however unequal their lengths.

Defined results: null counts as the empty text, whose sketch is empty. A text of fewer words than
a shingle is one shingle. Where both sketches are empty, equal texts have likeness 1 and others 0; a
document with an empty sketch is contained in nothing else.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.llm.decontam import words

WIDTH = 5
FRACTION = 1 / 2
BLOCK_ROWS = 50_000


def sketch(text: Column, width: int = WIDTH, fraction: float = FRACTION) -> Column:
    """Sorted hashes of the text's shingles below ``fraction`` (at most a half) of the range."""
    most = F.lit(int(fraction * 2**64) - 1)

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(width))))
        few = F.array(F.xxhash64(F.array_join(w, " ")))
        grams = F.when(F.size(w) >= width, many).when(F.size(w) > 0, few).otherwise(F.array().cast("array<bigint>"))
        return F.sort_array(F.array_distinct(F.filter(grams, lambda h: (h >= 0) & (h <= most))))

    # One pass of a lambda, so that the words are made once.
    return F.transform(F.array(words(text)), of)[0]


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts taken together."""
    return F.sort_array(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Estimated Jaccard similarity; ``equal`` says whether the texts are equal, for two empty sketches."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.when(equal, F.lit(1.0)).otherwise(F.lit(0.0)))


def as_text(hashes: Column) -> Column:
    """Sixteen hex digits a hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _rank(key: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds are at most ``key``, by binary search."""
    if not bounds:
        return F.lit(0)
    known = F.lit(bounds)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) <= key, at + step).otherwise(at))


def with_next(docs: DataFrame, id_col: str, carried: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each row with ``next_<c>`` of the row that follows by id (after the last: the first), for the ``carried`` columns.

    Rows are dealt to blocks of successive ids, and the first row of a block is also sent to the one before it, so every row
    finds its follower in its own block. Null ids come first; equal ids are ordered by the carried columns.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("double"), F.lit(float("-inf")))
    keys = docs.select(key.alias("k"))
    total = keys.count()
    if not total:
        return docs.select("*", *(F.col(c).alias(f"next_{c}") for c in carried))
    blocks = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / block_rows))
    shares = [i / blocks for i in range(1, blocks)]
    bounds = sorted(set(keys.agg(F.percentile_approx("k", F.lit(shares), F.lit(max(10_000, 10 * blocks)))).first()[0]))
    block = _rank(key, bounds)
    heads = sorted(keys.select("k", _rank(F.col("k"), bounds).alias("b")).groupBy("b").agg(F.min("k")).collect())
    head, before = [math.inf] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for i, (b, least) in enumerate(heads):
        head[b], before[b] = least, heads[i - 1][0]

    own = F.struct(F.col("_block").alias("block"), F.lit(0).alias("after"))
    ahead = F.struct(F.get(F.lit(before), F.col("_block")).alias("block"), F.lit(1).alias("after"))
    rows = docs.withColumns({"_key": key, "_block": block})
    first = F.get(F.lit(head), F.col("_block")) == F.col("_key")
    rows = rows.withColumn("_at", F.explode(F.when(first, F.array(own, ahead)).otherwise(F.array(own)))).drop("_key", "_block")
    order = Window.partitionBy("_at.block").orderBy("_at.after", F.col(id_col).asc_nulls_first(), *carried)
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return rows.filter(F.col("_at.after") == 0).drop("_at")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sketches of every text and of its edited text, with their likeness to each other and to the next text's."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("own", sketch(F.col("text"))), "doc_id", ["text", "own"])
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", size.cast("long").alias("n_chars"), "text", "next_text", "own", "next_own", edited.alias("edited"))
    rows = rows.withColumn("changed", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own"), F.col("text") == F.col("next_text")).alias("near_next"),
        containment(F.col("own"), F.col("changed")).alias("within_edited"),
        containment(F.col("own"), F.col("next_own")).alias("within_next"),
    )
