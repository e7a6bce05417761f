"""Ranked lexical search over term partitions, as a pipeline of owners.

Documents are read once per block of items and become postings of the items' terms, in shards of a bounded number of
documents. The terms are dealt to ``owners`` so that each holds about as many postings, the rarest terms with the
first. The items of a group travel as one bundle a shard: at every stage a cogroup brings the bundle to the
next owner's postings, which adds its integer contributions to the sparse accumulators (item, document, score) that
the bundle carries on. As rare terms come first, the accumulators stay small until the last stages. The last
owner selects the best of the shard; the best of all shards follow from a ranking with early limits.

Every document with a term of an item is scored; nothing is estimated or left out. Words are told apart by 64-bit hashes.

Items come to the driver in blocks of at most ``block_bytes`` of text (measured before); their terms, weights and
owners are handed to all tasks. Each block is one pass over the documents, each group of ``group_items`` items one pipeline.

Defined results: null texts have no terms; documents without terms are not counted; items without terms find
nothing. Each row of a table is a document, or an item, of its own, also if it repeats another one.
Equal scores go by ascending id, null first. Without items or documents there are no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from shoebox.llm.words import pieces, raw_text, word_hashes
from shoebox.session import cut


@dataclass(frozen=True)
class Search:
    """Parameters: results an item, stages of the pipeline, and the sizes that bound memory."""

    best: int = 10
    owners: int = 4
    shard_docs: int = 4096  # at most 65536, as places in a shard take two bytes
    shard_bytes: int = 16 << 20
    group_items: int = 256
    block_bytes: int = 8 << 20


@dataclass(frozen=True)
class Bundle:
    """The items of one group: the terms of item i are ``terms[starts[i]:starts[i+1]]``, with how often each stands in it."""

    starts: np.ndarray
    terms: np.ndarray
    times: np.ndarray


def _item_terms(texts: list[str | None]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """All term hashes in order, and of each text its term numbers with their counts."""
    raw, bounds = raw_text(pa.array(texts, pa.string()))
    words, at = word_hashes(raw, bounds)
    vocabulary, number = np.unique(words, return_inverse=True)
    return vocabulary, [np.unique(number[s:e], return_counts=True) for s, e in zip(at, at[1:])]


def postings(docs: DataFrame, vocabulary: np.ndarray, how: Search, id_col: str, text_col: str) -> DataFrame:
    """One row a shard: ids and lengths of its documents, and by term the documents with their counts."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    schema = pa.schema([("shard", pa.int64()), ("ids", pa.list_(id_type)), *[(n, pa.binary()) for n in ("n", "term", "first", "doc", "tf")]])

    def shard(number: int, ids: list, lengths: list, keys: list) -> pa.RecordBatch:
        found, tf = np.unique(np.concatenate(keys), return_counts=True)
        term, first = np.unique(found >> 16, return_index=True)
        arrays = [np.concatenate(lengths).astype(np.int64), term.astype(np.int32), np.append(first, len(found)).astype(np.int32), (found & 0xFFFF).astype(np.uint16), tf.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(id_type)), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Unique in the table: a written table has the rows of one attempt of each task.
        number = TaskContext.get().partitionId() << 32
        ids, lengths, keys, size = [], [], [], 0
        for batch in batches:
            for part in pieces(batch, "text"):
                for start in range(0, part.num_rows, how.shard_docs):
                    some = part.slice(start, how.shard_docs)
                    if ids and (len(ids) + some.num_rows > how.shard_docs or size > how.shard_bytes):
                        yield shard(number, ids, lengths, keys)
                        number, ids, lengths, keys, size = number + 1, [], [], [], 0
                    raw, bounds = raw_text(some.column("text"))
                    words, at = word_hashes(raw, bounds)
                    n = np.diff(at)
                    term = np.minimum(np.searchsorted(known.value, words), len(known.value) - 1)
                    hit = known.value[term] == words
                    place = np.repeat(np.arange(len(n)) + len(ids), n)
                    keys.append(term[hit] << 16 | place[hit])
                    lengths.append(n)
                    ids.extend(some.column("id").to_pylist())
                    size += len(raw)
        if ids:
            yield shard(number, ids, lengths, keys)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = T.StructType(
        [T.StructField("shard", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), *[T.StructField(n, T.BinaryType()) for n in ("n", "term", "first", "doc", "tf")]]
    )
    return cut(rows.mapInArrow(run, out), "postings")


def statistics(shards: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, terms with repeats, and the documents of each term; one row a term reaches the driver."""
    schema = pa.schema([("term", pa.int64()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, length = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            for n, term, first in zip(*[batch.column(c).to_pylist() for c in ("n", "term", "first")]):
                n = np.frombuffer(n, np.int64)
                docs, length = docs + int((n > 0).sum()), length + int(n.sum())
                df[np.frombuffer(term, np.int32)] += np.diff(np.frombuffer(first, np.int32))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-1, -2])), pa.array(np.append(df[seen], [docs, length]))], schema=schema)

    rows = shards.select("n", "term", "first").mapInArrow(count, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).collect()
    totals = {r.term: r.docs for r in rows}
    df = np.zeros(terms, np.int64)
    for term, docs in totals.items():
        if term >= 0:
            df[term] = docs
    return totals.get(-1, 0), totals.get(-2, 0), df


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def deal(df: np.ndarray, owners: int) -> np.ndarray:
    """Owner of every term: from rare to frequent, each with about the same number of postings."""
    order = np.argsort(df, kind="stable")
    before = np.cumsum(df[order]) - df[order]
    owner = np.zeros(len(df), np.int64)
    owner[order] = before * owners // max(1, int(df.sum()))
    return owner


def _visit(bundle: Bundle, weight: np.ndarray, how: Search, sparse: list[np.ndarray], held: dict[str, np.ndarray], lengths: np.ndarray) -> np.ndarray:
    """Scores of all items and documents of a shard after one owner's contributions."""
    scores = np.zeros((len(bundle.starts) - 1, len(lengths)), np.int64)
    item, doc, score = sparse
    scores[item, doc] = score
    term, first = held["term"], held["first"]
    slot = np.full(len(weight), -1, np.int64)
    slot[term] = np.arange(len(term))
    tf = held["tf"].astype(np.int64)
    owner_weight = np.repeat(weight[term], np.diff(first))
    gains = owner_weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * lengths[held["doc"]]))
    for i in range(len(bundle.starts) - 1):
        for j in range(bundle.starts[i], bundle.starts[i + 1]):
            at = slot[bundle.terms[j]]
            if at >= 0:
                span = slice(first[at], first[at + 1])
                scores[i, held["doc"][span]] += bundle.times[j] * gains[span]
    return scores


_HELD = {"term": np.int32, "first": np.int32, "doc": np.uint16, "tf": np.int32}


def _pipeline(shards: DataFrame, bundle: Bundle, weight: np.ndarray, owner: np.ndarray, documents: int, length: int, how: Search) -> DataFrame:
    """``item, id, score``: the best documents of each shard for every item of the group."""
    spark = shards.sparkSession
    shared = spark.sparkContext.broadcast((bundle, weight, owner))
    id_type = shards.schema["ids"].dataType.elementType
    arrow_id = to_arrow_type(id_type)
    held_schema = pa.schema([("shard", pa.int64()), *[(n, pa.binary()) for n in _HELD]])
    carried = pa.schema([("shard", pa.int64()), ("ids", pa.list_(arrow_id)), ("n", pa.binary()), *[(n, pa.binary()) for n in ("item", "doc", "score")]])
    carried_ddl = T.StructType(
        [T.StructField("shard", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), *[T.StructField(n, T.BinaryType()) for n in ("n", "item", "doc", "score")]]
    )
    chosen = pa.schema([("item", pa.int64()), ("id", arrow_id), ("score", pa.int64())])

    def held_by(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for shard, *raw in zip(*[batch.column(n).to_pylist() for n in held_schema.names]):
                    term, first, doc, tf = (np.frombuffer(b, t) for b, t in zip(raw, _HELD.values()))
                    mine = shared.value[2][term] == number
                    counts = np.diff(first)
                    keep = np.repeat(mine, counts)
                    starts = np.append(0, np.cumsum(counts[mine])).astype(np.int32)
                    rows.append((shard, *[a.tobytes() for a in (term[mine], starts, doc[keep], tf[keep])]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), held_schema.types)], schema=held_schema)

        return run

    def scored(left: pa.Table, right: pa.Table) -> tuple[dict, np.ndarray]:
        row = left.to_pylist()[0]
        n = np.frombuffer(row["n"], np.int64)
        # The length rule of the score: 100 - 75 + 75 * n * N / L, rounded down.
        lengths = 25 + 75 * n * documents // max(1, length)
        sparse = [np.frombuffer(row[c], t) for c, t in (("item", np.uint16), ("doc", np.uint16), ("score", np.int64))]
        held = {c: np.frombuffer(right.column(c)[0].as_py(), t) for c, t in _HELD.items()}
        return row, _visit(shared.value[0], shared.value[1], how, sparse, held, lengths)

    def hand_on(left: pa.Table, right: pa.Table) -> pa.Table:
        row, scores = scored(left, right)
        item, doc = np.nonzero(scores)
        arrays = (item.astype(np.uint16), doc.astype(np.uint16), scores[item, doc])
        return pa.table([pa.array([row["shard"]]), pa.array([row["ids"]], pa.list_(arrow_id)), *[pa.array([b], pa.binary()) for b in (row["n"], *[a.tobytes() for a in arrays])]], schema=carried)

    def select(left: pa.Table, right: pa.Table) -> pa.Table:
        row, scores = scored(left, right)
        ids = row["ids"]
        rank = np.empty(len(ids), np.int64)
        rank[sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0))] = np.arange(len(ids))
        out: list[tuple] = []
        for item in range(len(scores)):
            some = np.flatnonzero(scores[item])
            top = some[np.lexsort((rank[some], -scores[item, some]))[: how.best]]
            out += [(item, ids[d], int(scores[item, d])) for d in top]
        columns = zip(*out) if out else ([], [], [])
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, chosen.types)], schema=chosen)

    empty = [F.lit(b"").alias(c) for c in ("item", "doc", "score")]
    bundles = shards.select("shard", "ids", "n", *empty)
    found = T.StructType([T.StructField("item", T.LongType()), T.StructField("id", id_type), T.StructField("score", T.LongType())])
    for number in range(how.owners):
        held = shards.select("shard", *_HELD).mapInArrow(held_by(number), "shard long, term binary, first binary, doc binary, tf binary")
        last = number == how.owners - 1
        visit, out = (select, found) if last else (hand_on, carried_ddl)
        bundles = bundles.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(visit, out)
    return bundles


def search(docs: DataFrame, items: DataFrame, how: Search = Search(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The best documents of every item: ``item_id, rank, doc_id, score`` (columns named as the ids of the tables)."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    size = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    blocks = -(-size // how.block_bytes)
    id_type, item_type = docs.schema[id_col].dataType, items.schema[item_col].dataType
    results = [
        spark.createDataFrame([], T.StructType([T.StructField(item_col, item_type), T.StructField("rank", T.IntegerType()), T.StructField(id_col, id_type), T.StructField("score", T.LongType())]))
    ]
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        rows.sort(key=lambda r: (r.item_id is not None, r.item_id if r.item_id is not None else 0, r.text or ""))
        vocabulary, by_item = _item_terms([r.text for r in rows])
        if not len(vocabulary):
            continue
        shards = postings(docs, vocabulary, how, id_col, text_col)
        documents, length, df = statistics(shards, len(vocabulary))
        weight, owner = weights(documents, df), deal(df, how.owners)
        for start in range(0, len(rows), how.group_items):
            part = by_item[start : start + how.group_items]
            bundle = Bundle(np.cumsum([0, *[len(t) for t, _ in part]]), np.concatenate([t for t, _ in part]), np.concatenate([c for _, c in part]))
            best = _pipeline(shards, bundle, weight, owner, documents, length, how).filter("score > 0")
            order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_first())
            best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= how.best)
            names = spark.createDataFrame(
                [(i, r.item_id) for i, r in enumerate(rows[start : start + how.group_items])], T.StructType([T.StructField("item", T.LongType()), T.StructField("_item_id", item_type)])
            )
            named = best.join(F.broadcast(names), "item")
            results.append(named.select(F.col("_item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
    return functools.reduce(DataFrame.unionByName, results)
