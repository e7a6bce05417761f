"""N-gram Jaccard join by a MinHash LSH forest.

Equal texts are first folded into classes. Every class gets a signature of least hash values,
split over the trees of a forest; in each tree, classes sorted by their values form a prefix
trie. Prefixes start at full depth and are shortened, tree by tree, where that adds the
fewest candidates, until a pair at the threshold meets in some tree with the wanted
probability. Within a bucket, classes hang on leaders, never on each other, so that a large
group of copies makes as many rows as it has members. Groups of possible neighbours are
then cut into tiles of two blocks, and each tile compares its shingle sets exactly.

Defined results: null counts as the empty text. Equal texts are linked, also those without
words; other texts without words have no links. A text of fewer words than a shingle is one
shingle. Repeated rows count as copies. Classes are told apart by a 64-bit hash of the text's
SHA-256.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoebox.llm.components import components, spanning_forest
from shoebox.llm.tables import free_name
from shoebox.llm.words import mixed, pieces, raw_text, shingle_hashes, word_hashes
from shoebox.session import cut


@dataclass(frozen=True)
class Forest:
    """``trees`` x ``depth`` hash values a text.

    ``recall`` is the least probability that two texts at exactly ``similarity`` meet; ``shortest`` bounds
    how far prefixes are shortened. ``block`` is the number of texts on each side of a tile.
    """

    similarity: float = 0.8
    width: int = 5
    trees: int = 16
    depth: int = 6
    shortest: int = 4
    recall: float = 0.999
    block: int = 128
    seed: int = 1


# Of the compared signature bytes, the share that makes a bucket's member lean on a leader, and the
# share at which it is tied to one: at a similarity of 0.8 to a member that leans on a leader, a
# text is far above the second.
LEAN, TIE, COMPARED = 0.85, 0.35, 64


def signatures(docs: DataFrame, spec: Forest, id_col: str, text_col: str) -> DataFrame:
    """``id, node, sig``: node tells texts apart, sig is null for a text without words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.sha2(text, 256)).alias("node"), text.alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("node", T.LongType()), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(spec.seed)
        count = spec.trees * spec.depth
        scale = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shift = rng.integers(0, 1 << 63, count, dtype=np.uint64)
        for batch in (p for b in batches for p in pieces(b, "text")):
            grams, bounds = shingle_hashes(*word_hashes(*raw_text(batch.column("text"))), spec.width)
            full = np.flatnonzero(np.diff(bounds))
            out = np.zeros((batch.num_rows, count), np.uint32)
            value = np.empty_like(grams)
            if len(full):
                for k in range(count):
                    np.multiply(grams, scale[k], out=value)
                    value += shift[k]
                    out[full, k] = np.minimum.reduceat(value, bounds[full]) >> np.uint64(32)
            known = np.zeros(batch.num_rows, bool)
            known[full] = True
            sig = pa.array([row.tobytes() if k else None for row, k in zip(out, known)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("node"), sig], names=["id", "node", "sig"])

    return rows.mapInArrow(run, schema)


def _signature_rows(batch: pa.RecordBatch, spec: Forest) -> np.ndarray:
    flat = b"".join(batch.column("sig").to_pylist())
    return np.frombuffer(flat, np.uint32).reshape(-1, spec.trees, spec.depth)


def _prefix(sig: np.ndarray, tree: int, depth: int) -> np.ndarray:
    h = np.full(len(sig), tree + 1, np.uint64)
    for value in sig[:, tree, :depth].T:
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + value.astype(np.uint64))
    return h


def shorten(pairs: dict[tuple[int, int], float], spec: Forest) -> list[int]:
    """Prefix length of each tree: from full depth, shorten where it adds fewest pairs for the recall it gives."""
    depths = [spec.depth] * spec.trees
    miss = lambda d: math.log(1 - spec.similarity**d)
    while sum(map(miss, depths)) > math.log(1 - spec.recall):
        open_trees = [t for t in range(spec.trees) if depths[t] > spec.shortest]
        if not open_trees:
            raise ValueError("more trees or shorter prefixes are needed for this recall")

        def price(t: int) -> float:
            d = depths[t]
            return (1 + pairs.get((t, d - 1), 0) - pairs.get((t, d), 0)) / (miss(d) - miss(d - 1))

        depths[min(open_trees, key=price)] -= 1
    return depths


def choose_depths(classes: DataFrame, spec: Forest) -> list[int]:
    """Count the pairs that prefixes of each length would form, in every bucket, and shorten by them."""
    schema = "tree int, depth int, bucket long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _signature_rows(batch, spec)
            for tree in range(spec.trees):
                for depth in range(spec.shortest, spec.depth + 1):
                    h = _prefix(sig, tree, depth).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), tree, np.int32)), pa.array(np.full(len(h), depth, np.int32)), pa.array(h)], names=["tree", "depth", "bucket"])

    sizes = classes.select("sig").mapInArrow(run, schema).groupBy("tree", "depth", "bucket").count()
    pairs = sizes.groupBy("tree", "depth").agg(F.sum(F.col("count") * (F.col("count") - 1.0) / 2).alias("pairs"))
    return shorten({(r["tree"], r["depth"]): r["pairs"] for r in pairs.collect()}, spec)


def bucket_links(classes: DataFrame, depths: list[int], spec: Forest) -> DataFrame:
    """``a, b``: ties of bucket members to leaders."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _signature_rows(batch, spec)
            low = np.ascontiguousarray(sig.reshape(len(sig), -1)[:, :COMPARED].astype(np.uint8))
            packed = pa.array([row.tobytes() for row in low], pa.binary())
            for tree, depth in enumerate(depths):
                yield pa.RecordBatch.from_arrays([pa.array(_prefix(sig, tree, depth).view(np.int64)), batch.column("node"), packed], names=["bucket", "node", "low"])

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, leaders = None, []  # of the run that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column("bucket").to_numpy()
            node = batch.column("node").to_numpy()
            low = np.frombuffer(b"".join(batch.column("low").to_pylist()), np.uint8).reshape(len(node), -1)
            found: list[tuple[np.ndarray, int]] = []
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            long_runs = np.flatnonzero(np.diff(cuts) > 1)
            # Runs of one row matter only at the ends of a batch, where they may go on.
            for k in sorted({0, len(cuts) - 2, *long_runs.tolist()}):
                start, stop = cuts[k], cuts[k + 1]
                if bucket[start] != current:
                    current, leaders = bucket[start], []
                rows, names = low[start:stop], node[start:stop]
                free = np.ones(len(rows), bool)
                for name, row in leaders:
                    same = np.count_nonzero(rows == row, axis=1)
                    found.append((names[same >= TIE * low.shape[1]], name))
                    free &= same < LEAN * low.shape[1]
                while free.any():
                    i = int(free.argmax())
                    leaders.append((names[i], rows[i]))
                    same = np.count_nonzero(rows[i + 1 :] == rows[i], axis=1)
                    found.append((names[i + 1 :][same >= TIE * low.shape[1]], names[i]))
                    free[i] = False
                    free[i + 1 :] &= same < LEAN * low.shape[1]
            # Members tied to several leaders join these; only a spanning forest leaves the task.
            root = spanning_forest((int(a), int(leader)) for members, leader in found for a in members)
            yield pa.RecordBatch.from_arrays([pa.array(root.keys(), pa.int64()), pa.array(root.values(), pa.int64())], names=["a", "b"])

    rows = classes.select("node", "sig").mapInArrow(label, "bucket long, node long, low binary")
    placed = rows.repartition("bucket").sortWithinPartitions("bucket", "node")
    return placed.mapInArrow(tie, "a long, b long").distinct()


def _shingle_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in (p for b in batches for p in pieces(b, "text")):
        grams, bounds = shingle_hashes(*word_hashes(*raw_text(batch.column("text"))), width)
        sets = [np.unique(grams[s:e]).tobytes() for s, e in zip(bounds, bounds[1:])]
        rest = [batch.column(c) for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(sets, pa.binary())], names=[*(c for c in batch.schema.names if c != "text"), "grams"])


def shared_counts(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """How many shingles each two of the sets share."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    keep = count[code] > 1
    column, owner = rank[code[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((m, m), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, chunk):
        lo, hi = np.searchsorted(column, [start, start + chunk])
        part = np.zeros((m, chunk), np.float32)
        part[owner[lo:hi], column[lo:hi] - start] = 1
        shared += part @ part.T
    return shared


def _compare(nodes: np.ndarray, sides: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], similarity: float):
    """Links of each member of a tile: with other texts, with their copies, and the least node reached."""
    sizes = np.array([len(s) for s in sets], np.float64)
    shared = shared_counts(sets).astype(np.float64)
    linked = shared * (1 + similarity) >= similarity * (sizes[:, None] + sizes[None, :]) - 1e-9
    if sides[0] != sides[-1]:
        linked &= sides[:, None] != sides[None, :]
    np.fill_diagonal(linked, False)
    root = nodes.copy()
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (least == root).all():
            break
        root = least
    return linked.sum(axis=1), linked @ copies, root


def _verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    names = ["node", "texts", "docs", "root"]
    held: list[tuple] = []
    tile = None

    def settle() -> pa.RecordBatch:
        held.sort(key=lambda r: r[1])
        nodes = np.array([r[0] for r in held], np.int64)
        sets = [np.frombuffer(r[3], np.uint64) for r in held]
        texts, docs, root = _compare(nodes, np.array([r[1] for r in held]), np.array([r[2] for r in held], np.int64), sets, similarity)
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(texts.astype(np.int64)), pa.array(docs.astype(np.int64)), pa.array(root)], names=names)

    for batch in batches:
        for group, lo, hi, *row in zip(*(batch.column(c).to_pylist() for c in ("root", "lo", "hi", "node", "side", "copies", "grams"))):
            if (group, lo, hi) != tile:
                if len(held) > 1:
                    yield settle()
                tile, held = (group, lo, hi), []
            held.append(tuple(row))
    if len(held) > 1:
        yield settle()


def text_groups(docs: DataFrame, spec: Forest = Forest(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows ``id, node``, and classes ``node, rep, copies, n_links, n_text_links, root``.

    ``rep`` is the least id of a class; ``n_text_links`` counts other texts in reach, ``n_links`` other rows.
    """
    rows = cut(signatures(docs, spec, id_col, text_col), "signatures")
    classes = cut(
        rows.groupBy("node").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")), "classes"
    )
    worded = classes.filter(F.col("sig").isNotNull())
    ties = bucket_links(worded, choose_depths(worded, spec), spec)
    groups = cut(components(ties), "groups")

    sizes = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(spec.block)).cast("int").alias("blocks"))
    members = groups.join(sizes, "root").join(classes.select("node", "rep", "copies"), "node")
    members = members.withColumn("side", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.sha2(text, 256)).alias("node"), text.alias("text"))
    members = members.withColumnRenamed("node", "member")
    texts = texts.join(members, (F.col("node") == F.col("member")) & F.col("id").eqNullSafe(F.col("rep")))
    texts = texts.dropDuplicates(["node"]).select("root", "blocks", "side", "node", "copies", "text")
    sets = texts.mapInArrow(lambda b: _shingle_sets(b, spec.width), "root long, blocks int, side int, node long, copies long, grams binary")
    tiles = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("root", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "node", "side", "copies", "grams")
    placed = tiles.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    checked = cut(
        placed.mapInArrow(lambda b: _verify(b, spec.similarity), "node long, texts long, docs long, root long"), "checked"
    )
    found = checked.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    linked = components(checked.filter(F.col("node") != F.col("root")).select(F.col("node").alias("a"), F.col("root").alias("b")))
    whole = classes.drop("sig").join(found, "node", "left").join(linked, "node", "left")
    whole = whole.select(
        "node",
        "rep",
        "copies",
        (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
        F.coalesce("root", "node").alias("root"),
    )
    return rows.select("id", "node"), cut(whole, "links")


def _leads(classes: DataFrame) -> DataFrame:
    """``root, class_id, lead``: of each group, the least id and the class it belongs to."""
    first = F.min(F.struct(F.col("rep").isNull().alias("n"), "rep", "node"))
    return classes.groupBy("root").agg(first.alias("f")).select("root", F.col("f.rep").alias("class_id"), F.col("f.node").alias("lead"))


def near_groups(docs: DataFrame, spec: Forest = Forest(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row ``id, class_id, n_links, n_text_links, n_copies``; class_id is the least id of all texts linked."""
    rows, classes = text_groups(docs, spec, id_col, text_col)
    named = classes.join(_leads(classes), "root")
    return rows.join(named, "node").select(
        F.col("id").alias(id_col), "class_id", "n_links", "n_text_links", F.col("copies").alias("n_copies")
    )


def keep_one(docs: DataFrame, spec: Forest = Forest(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the least id of each group of linked texts, one row a group, columns unchanged."""
    _, classes = text_groups(docs, spec, id_col, text_col)
    leads = _leads(classes).select(F.col("lead").alias("_node"), F.col("class_id").alias("_id"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mark = free_name(docs, "node")
    marked = docs.withColumn(mark, F.xxhash64(F.sha2(text, 256)))
    kept = marked.join(leads, (marked[mark] == leads["_node"]) & marked[id_col].eqNullSafe(leads["_id"]), "left_semi")
    return kept.dropDuplicates([mark]).drop(mark)
