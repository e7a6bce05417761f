"""Benchmark decontamination as a prefix-filtered set join.

Every item is cut into windows of words. A window can only occur where all of its words do, so the needed
prefix of its words, ordered by rarity over all documents, is the rarest one alone. Document words are joined to
these prefix words; the word's place in the window bounds where an occurrence would start and end, and the
whole window is then compared at that place. A window with a word that no document has is
dropped before the join.

The windows are handed to all tasks in blocks of at most ``block_bytes``, measured before; a larger benchmark takes several
passes over the documents. Words of the benchmark are handled likewise when they are counted.

Defined results: null texts have no words and no hits. Items without words have no windows, and items without
id hit but are not listed. Repeated items count once, repeated documents give a row each.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm.tables import free_name
from shoebox.session import cut

WINDOW = 10
BLOCK_BYTES = 32 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# No word contains this; it stands once behind the words of every document.
_END = "\x00"


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, then runs of anything but ASCII that is no digit and no letter."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def item_windows(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``item, window``: every run of ``size`` words, or all words of a shorter item."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    rows = rows.withColumn("n", F.least(F.size("w"), F.lit(size)))
    rows = rows.withColumn("p", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
    return rows.select("item", F.slice("w", F.col("p"), F.col("n")).alias("window")).distinct()


def _in_blocks(table: DataFrame, size: Column, key: str, block_bytes: int) -> list[DataFrame]:
    """The table in parts of about ``block_bytes`` by a hash of ``key``; a single part if all of it fits."""
    total = table.agg(F.sum(size)).first()[0] or 0
    parts = -(-total // block_bytes)
    if parts <= 1:
        return [table]
    # Twice as many, so that an uneven part fits too.
    return [table.filter(F.pmod(F.xxhash64(key), F.lit(2 * parts)) == i) for i in range(2 * parts)]


def prefixes(docs: DataFrame, windows: DataFrame, text_col: str, block_bytes: int) -> DataFrame:
    """Each window with its rarest word over all documents (``token``) and that word's place (``place``, from 0)."""
    vocabulary = windows.select(F.explode("window").alias("token")).distinct()
    found = docs.select(F.explode(words(F.col(text_col))).alias("token"))
    size = F.octet_length("token") + 16
    counts = [found.join(F.broadcast(part), "token", "left_semi").groupBy("token").count() for part in _in_blocks(vocabulary, size, "token", block_bytes)]
    counts = functools.reduce(DataFrame.unionByName, counts)
    placed = windows.select("item", "window", F.posexplode("window").alias("place", "token"))
    placed = placed.join(counts, "token", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rarest = placed.groupBy("item", "window").agg(F.min(F.struct("count", "token", "place")).alias("r"))
    return rarest.filter(F.col("r.count") > 0).select("item", "window", "r.token", "r.place")


def occurrences(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id, text_key, n_words, item, start, stop``: word spans where windows occur.

    Every document also has one row with ``item`` and span null for each pass over it, and ``pass`` 0 for the first.
    """
    windows = cut(item_windows(items, size, item_col, "text"), "windows")
    lead = cut(prefixes(docs, windows, text_col, block_bytes), "prefixes")
    mark = docs.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("item"), F.lit(None).cast("array<string>").alias("window"), F.lit(_END).alias("token"), F.lit(None).cast("int").alias("place")
    )
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_key"), words(F.col(text_col)).alias("w")
    )
    rows = rows.select("id", "text_key", F.size("w").alias("n_words"), F.concat("w", F.array(F.lit(_END))).alias("w"))
    size_of = F.octet_length(F.array_join("window", " ")) + 20 * F.size("window") + 64
    found = []
    for number, part in enumerate(_in_blocks(lead, size_of, "token", block_bytes)):
        at = rows.select("id", "text_key", "n_words", "w", F.posexplode("w").alias("pos", "token"))
        met = at.join(F.broadcast(part.unionByName(mark) if number == 0 else part), "token")
        met = met.withColumn("start", F.col("pos") - F.col("place")).withColumn("stop", F.col("start") + F.size("window"))
        fits = (F.col("start") >= 0) & (F.col("stop") <= F.col("n_words"))
        # The slice is taken only where the bounds hold.
        same = F.when(fits, F.slice("w", F.col("start") + 1, F.size("window")) == F.col("window"))
        met = met.filter(F.col("place").isNull() | same)
        found.append(met.select("id", "text_key", "n_words", "item", "start", "stop", F.col("place").isNull().alias("own")))
    return functools.reduce(DataFrame.unionByName, found)


def scan(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: ``id, n_words, n_hit, items`` (sorted ids of items with an occurring window)."""
    met = occurrences(docs, items, size, id_col, text_col, item_col, block_bytes)
    by_text = met.groupBy("id", "text_key").agg(
        F.first("n_words").alias("n_words"),
        F.sum(F.col("own").cast("int")).alias("rows"),
        F.sort_array(F.collect_set(F.when(~F.col("own"), F.struct("start", "stop")))).alias("spans"),
        F.sort_array(F.collect_set("item")).alias("items"),
    )
    # Spans in order: each adds the words past the farthest end so far.
    none = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("far"))
    covered = F.aggregate(
        "spans",
        none,
        lambda acc, s: F.struct(
            (acc["hit"] + F.greatest(F.lit(0), s["stop"] - F.greatest(acc["far"], s["start"]))).alias("hit"), F.greatest(acc["far"], s["stop"]).alias("far")
        ),
        lambda acc: acc["hit"],
    )
    whole = by_text.select("id", "n_words", covered.alias("n_hit"), "items", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_"))
    return whole.select(F.col("id").alias(id_col), F.col("n_words").cast("long"), F.col("n_hit").cast("long"), "items")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The report of every document, with the hit items as a count and a digest."""
    found = scan(docs, items)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_only(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit, columns unchanged."""
    met = occurrences(docs, items, id_col=id_col, text_col=text_col).filter(~F.col("own"))
    bad = cut(met.select(F.col("id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "contaminated")
    key = free_name(docs, "key")
    marked = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return marked.join(bad, (marked[key] == bad["_key"]) & marked[id_col].eqNullSafe(bad["_id"]), "left_anti").drop(key)
