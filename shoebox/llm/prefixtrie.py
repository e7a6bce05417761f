"""Tree of conversations that begin alike, found by count-min screening of prefix digests.

Every turn is hashed where it is read; only digests and word counts travel. The digest of the first d turns of a
conversation is a sum of position-bound turn hashes (two times 64 bits), so a conversation of any length may
be cut into blocks whose sums are stitched afterwards.

All prefixes enter a count-min sketch of fixed largest size. A prefix that the sketch counts once is in one
conversation only, and so are all longer ones of it: their nodes are emitted where they are. Only the
prefixes up to the first one that is proven single are shuffled and grouped exactly. Of the shared part

- a conversation is the least member of its nodes from some depth on (``first``); each of its turns before that depth is
  a repetition, so what a subtree saves is a sum over its members;
- a leaf counts for all nodes of its least member.

Defined results: rows without ``conv_id`` belong to no conversation. Null role and text are empty. Turns are in order of
``turn``, null first; equal ones in order of the digest of their role and text. An empty table has no nodes.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.words import mixed
from shoebox.operators.skew import spread_join
from shoebox.session import cut, default_blocks

_SPACE = r"[^\x20\x09-\x0D]+"
_PIECE = 1 << 14  # cells of the sketch in one row
CHUNK_BYTES = 1 << 16


@dataclass(frozen=True)
class Screen:
    """Size of the sketch: ``rows`` counters a prefix, ``per_prefix`` cells a prefix and row, at most ``most_cells`` a row."""

    rows: int = 4
    per_prefix: int = 8
    most_cells: int = 1 << 24

    def cells(self, prefixes: int) -> int:
        return min(self.most_cells, max(1 << 14, 1 << max(0, self.per_prefix * prefixes - 1).bit_length()))


@dataclass(frozen=True)
class Rebuild:
    """Conversation c starts with turns of c - c % ``family``; their number is crc32 of c modulo ``most``."""

    family: int = 20
    most: int = 4


def _numpy(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}


def _runs(conv: np.ndarray) -> np.ndarray:
    """Index of the first row of each row's run of equal ids."""
    new = np.ones(len(conv), bool)
    new[1:] = conv[1:] != conv[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))


def _totals(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running totals that begin anew at each run; unsigned values wrap."""
    total = np.cumsum(values, dtype=values.dtype)
    return total - np.where(starts > 0, total[starts - 1], 0).astype(values.dtype)


def _running(make: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: pa.Schema) -> Callable:
    """Task that adds ``block`` and running totals per conversation of what ``make`` returns, over sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last, carried = TaskContext.get().partitionId(), None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = _numpy(batch)
            conv = cols["conv_id"]
            starts = _runs(conv)
            for name, values in make(cols).items():
                total = _totals(values, starts)
                if last is not None and conv[0] == last:
                    total[starts == 0] += carried[name]
                carried[name] = total[-1]
                cols[name] = total.view(np.int64)
                if name in ("a", "b"):
                    cols[f"own_{name}"] = values.view(np.int64)
            last = conv[-1]
            cols["block"] = np.full(len(conv), block, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cols[n], t) for n, t in zip(schema.names, schema.types)], schema=schema)

    return run


def _carries(table: DataFrame, order: str, sums: list[str]) -> dict[int, tuple[int, ...]]:
    """What the blocks before add to the first conversation of a block; two rows a block reach the driver."""
    ends = table.groupBy("block").agg(
        F.min("conv_id").alias("lo"), F.max(F.struct("conv_id", *[c for c in [order] if c not in sums], *sums)).alias("end")
    )
    found: dict[int, tuple[int, ...]] = {}
    last, total = None, tuple(0 for _ in sums)
    for row in sorted(ends.collect(), key=lambda r: r.block):
        own = tuple(row.end[s] % (1 << 64) for s in sums)
        if last is not None and row.lo == last:
            found[row.block] = (row.lo, *total)
        else:
            total = tuple(0 for _ in sums)
        total = tuple((x + y) % (1 << 64) for x, y in zip(total, own)) if row.end.conv_id == row.lo else own
        last = row.end.conv_id
    return found


def _with_carry(cols: dict[str, np.ndarray], carries: dict[int, tuple[int, ...]], sums: list[str]) -> None:
    """Add, in place, what earlier blocks hold of the same conversation."""
    for block in np.unique(cols["block"]):
        if block in carries:
            conv, *more = carries[block]
            rows = (cols["block"] == block) & (cols["conv_id"] == conv)
            for name, extra in zip(sums, more):
                values = cols[name].view(np.uint64).copy()
                values[rows] += np.uint64(extra)
                cols[name] = values.view(np.int64)


def _sorted_blocks(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartitionByRange(default_blocks(df.sparkSession), *keys).sortWithinPartitions(*keys)


def _sql_type(field: pa.Field) -> str:
    return "long" if field.type == pa.int64() else "binary"


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_sql_type(f)}" for f in schema)


def _longs(*names: str) -> pa.Schema:
    return pa.schema([(n, pa.int64()) for n in names])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 1), ``d1, d2`` (digest of role and text) and ``words`` of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)

    def part(start: int):
        # 15 hexadecimal digits fit a positive long.
        return F.conv(F.substring(digest, start, 15), 16, 10).cast("long")

    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", part(1).alias("d1"), part(16).alias("d2"),
        F.regexp_count(text, F.lit(_SPACE)).cast("long").alias("words"),
    )
    schema = _longs("conv_id", "pos", "d1", "d2", "words", "block")
    count = _running(lambda c: {"pos": np.ones(len(c["conv_id"]), np.uint64)}, schema)
    local = cut(_sorted_blocks(rows, ["conv_id", "turn", "d1", "d2"]).drop("turn").mapInArrow(count, _ddl(schema)), "turns")
    carries = _carries(local, "pos", ["pos"])
    out = _longs("conv_id", "pos", "d1", "d2", "words")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = _numpy(batch)
            _with_carry(cols, carries, ["pos"])
            yield pa.RecordBatch.from_arrays([pa.array(cols[n]) for n in out.names], schema=out)

    return local.mapInArrow(settle, _ddl(out)) if carries else local.drop("block")


def rebuilt_turns(turns: DataFrame, rule: Rebuild) -> tuple[DataFrame, DataFrame]:
    """``conv_id, d, d1, d2, words, len`` of the turns of rebuilt conversations, and ``conv_id, len`` of all of them."""
    head = F.sort_array(F.collect_list(F.struct("pos", "d1", "d2", "words")))
    donors = turns.filter((F.col("conv_id") % rule.family == 0) & (F.col("pos") < rule.most)).groupBy(F.col("conv_id").alias("donor")).agg(head.alias("head"))
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % rule.most).cast("int"))
    convs = convs.withColumn("donor", F.col("conv_id") - F.col("conv_id") % rule.family).join(donors, "donor", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array().cast(donors.schema["head"].dataType)), F.lit(1), F.col("h")))
    convs = convs.withColumn("k", F.size("head")).withColumn("len", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = cut(convs.select("conv_id", "h", F.col("k").cast("long").alias("k"), F.col("len").cast("long").alias("len"), "head"), "rebuilt")
    heads = convs.select("conv_id", F.inline("head"), "len").select("conv_id", F.col("pos").alias("d"), "d1", "d2", "words", "len")
    own = spread_join(turns, convs.select("conv_id", "h", "k", "len"), ["conv_id"], ["pos"], "inner").filter(F.col("pos") > F.col("h"))
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("d"), "d1", "d2", "words", "len")
    return heads.unionByName(own), convs.select("conv_id", "len")


_SUMS = ["a", "b", "w"]


def _prefix_sums(rows: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, ...]]]:
    """Running digests ``a, b`` and words ``w`` inside blocks, and what the blocks before add to them."""

    def lanes(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        d1, d2, at = (c[n].astype(np.uint64) for n in ("d1", "d2", "d"))
        step = mixed(at + np.uint64(0x9E3779B97F4A7C15))
        a = mixed(mixed(d1 ^ step) + d2)
        b = mixed(mixed(d2 + step) ^ (d1 * np.uint64(0x9E3779B97F4A7C15)))
        return {"a": a, "b": b, "w": c["words"].astype(np.uint64)}

    schema = _longs("conv_id", "d", "len", "words", "a", "b", "w", "own_a", "own_b", "block")
    sums = cut(_sorted_blocks(rows, ["conv_id", "d"]).mapInArrow(_running(lanes, schema), _ddl(schema)), "prefixes")
    return sums, _carries(sums, "d", _SUMS)


def _cell(a: np.ndarray, b: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mixed(a.view(np.uint64) + np.uint64(row + 1) * b.view(np.uint64)) & np.uint64(cells - 1)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    four = counts.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    packed = np.frombuffer(raw, np.uint8)
    return np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], axis=1).reshape(-1)


def sketch(sums: DataFrame, carries: dict, cells: int, rows: int) -> np.ndarray:
    """Counters (0, 1, or 2 for more) of all prefixes: ``rows`` x ``cells``, four to a byte."""
    pieces = cells // _PIECE
    schema = pa.schema([("piece", pa.int64()), ("counts", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((rows, cells), np.uint8)
        for batch in batches:
            cols = _numpy(batch)
            _with_carry(cols, carries, ["a", "b"])
            for row in range(rows):
                at, n = np.unique(_cell(cols["a"], cols["b"], row, cells), return_counts=True)
                counts[row, at] = np.minimum(2, counts[row, at] + np.minimum(n, 2))
        parts = counts.reshape(rows * pieces, _PIECE)
        for piece in np.flatnonzero(parts.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([_packed(parts[piece])], pa.binary())], schema=schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for piece, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if piece != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([_packed(total)], pa.binary())], schema=schema)
                    at, total = piece, np.zeros(_PIECE, np.uint8)
                total = np.minimum(2, total + _unpacked(raw))
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([_packed(total)], pa.binary())], schema=schema)

    narrow = sums.select("conv_id", "a", "b", "block")
    built = narrow.mapInArrow(build, "piece long, counts binary")
    merged = built.repartition("piece").sortWithinPartitions("piece").mapInArrow(merge, "piece long, counts binary")
    whole = np.zeros((rows * pieces, _PIECE // 4), np.uint8)
    # At most rows * cells / 4 bytes, whatever the size of the table.
    for row in merged.collect():
        whole[row.piece] = np.frombuffer(row.counts, np.uint8)
    return whole.reshape(rows, cells // 4)


def screened(sums: DataFrame, carries: dict, counts: np.ndarray) -> DataFrame:
    """The prefixes with whole sums and ``tail``: 1 where the prefix one turn shorter is proven to be single."""
    rows, quarter = counts.shape
    shared = sums.sparkSession.sparkContext.broadcast(counts)
    schema = _longs("conv_id", "d", "len", "words", "a", "b", "w", "tail")

    def single(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = np.zeros(len(a), bool)
        for row in range(rows):
            at = _cell(a, b, row, 4 * quarter)
            found |= (shared.value[row, at >> 2] >> (2 * (at & 3)).astype(np.uint8) & 3) == 1
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = _numpy(batch)
            _with_carry(cols, carries, _SUMS)
            before = [(cols[n].view(np.uint64) - cols[f"own_{n}"].view(np.uint64)) for n in ("a", "b")]
            # The root is in every conversation and not in the sketch.
            cols["tail"] = (single(*before) & (cols["d"] > 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cols[n]) for n in schema.names], schema=schema)

    return cut(sums.mapInArrow(run, _ddl(schema)), "screened")


_NODE = ["d", "a", "b"]


def _ends(members: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids of each node, comma-joined, from text chunks that are made in parallel."""
    chunks = pa.schema([*[(n, pa.int64()) for n in _NODE], ("first", pa.int64()), ("ids", pa.binary())])
    digests = pa.schema([*[(n, pa.int64()) for n in _NODE], ("ends_sha256", pa.string())])

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = _numpy(batch)
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.any([cols[n][1:] != cols[n][:-1] for n in _NODE], axis=0)
            # Ids have at most 20 characters; a chunk ends with its node or with the batch.
            cuts = sorted({*np.flatnonzero(new), *range(0, batch.num_rows, CHUNK_BYTES // 20), batch.num_rows})
            spans = list(zip(cuts, cuts[1:]))
            ids = [",".join(map(str, cols["conv_id"][s:e])).encode() for s, e in spans]
            at = np.array([s for s, _ in spans], np.int64)
            yield pa.RecordBatch.from_arrays([*[pa.array(cols[n][at]) for n in _NODE], pa.array(cols["conv_id"][at]), pa.array(ids, pa.binary())], schema=chunks)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for *node, _, ids in zip(*[batch.column(n).to_pylist() for n in chunks.names]):
                if node == at:
                    state.update(b"," + ids)
                else:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = node, hashlib.sha256(ids)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), digests.types)], schema=digests)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*at, state.hexdigest()), digests.types)], schema=digests)

    parts = _sorted_blocks(members.select(*_NODE, "conv_id"), [*_NODE, "conv_id"]).mapInArrow(join_ids, "d long, a long, b long, first long, ids binary")
    whole = parts.repartition(*_NODE).sortWithinPartitions(*_NODE, "first")
    return whole.mapInArrow(digest, "d long, a long, b long, ends_sha256 string")


def _shared_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of all given prefixes, grouped exactly.

    ``rows`` holds every conversation from the root down to its first prefix that no other one has, or to its end.
    """
    nodes = rows.groupBy(*_NODE).agg(F.min("conv_id").alias("rep"), F.max("len").alias("longest"))
    met = cut(spread_join(rows, cut(nodes, "nodes"), _NODE, ["conv_id"], "inner"), "members")
    own = F.col("rep") == F.col("conv_id")
    ends_here = F.col("d") == F.col("len")
    convs = met.groupBy("conv_id").agg(
        F.min(F.when(own, F.col("d"))).alias("first"),
        F.max(F.when(~own, F.struct("d", "rep", "w"))).alias("above"),
        # A conversation whose end is not among the rows ends in nodes of its own.
        F.coalesce(~F.max(ends_here) | F.max(own & ends_here & (F.col("longest") == F.col("len"))), F.lit(False)).alias("leaf"),
    )
    convs = convs.select("conv_id", "first", F.col("above.rep").alias("above_rep"), F.col("above.w").alias("above_w"), "leaf")
    rated = spread_join(met, cut(convs, "firsts"), ["conv_id"], ["d"], "inner")
    child = (F.col("first") <= F.col("d") + 1) & (F.col("d") < F.col("len"))
    saved = F.when(~own, F.col("above_w") - (F.col("w") - F.col("words")))
    parent = F.when(own & (F.col("d") > 0), F.when(F.col("first") < F.col("d"), F.col("conv_id")).otherwise(F.col("above_rep")))
    found = rated.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.max(parent).alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.coalesce(child, F.lit(False)).cast("long")).alias("n_children"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.coalesce(F.sum(saved), F.lit(0)).alias("saved_tokens"),
    )
    found = found.join(_ends(rows.filter(ends_here)), _NODE, "left")
    return found.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_tree(conversations: DataFrame, rule: Rebuild = Rebuild(), screen: Screen = Screen()) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    turns = numbered_turns(conversations)
    rows, convs = rebuilt_turns(turns, rule)
    sums, carries = _prefix_sums(rows)
    counts = sketch(sums, carries, screen.cells(sums.count()), screen.rows)
    prefixes = screened(sums, carries, counts)
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("d"), "len", *[zero.alias(n) for n in ("words", "a", "b", "w")])
    shared = _shared_nodes(prefixes.filter("tail = 0").drop("tail").unionByName(roots))
    last = F.col("d") == F.col("len")
    one = F.lit(1).cast("long")
    tails = prefixes.filter("tail = 1").select(
        "conv_id", F.col("d").alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.sha2(F.when(last, F.col("conv_id").cast("string")).otherwise(""), 256).alias("ends_sha256"),
    )
    return shared.unionByName(tails)
