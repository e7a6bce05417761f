"""Token counts under a unigram model of a public vocabulary, by dynamic programming over a trie.

Texts are split into pre-tokens. The distinct pre-tokens of a run of texts, sorted, form a trie: what neighbours
share is one path. The forward score of a node is the best sum of piece scores over all ways to cut its path, and it is
computed once, level by level, for all nodes new at that depth; with it goes the number of pieces of that way (the fewest,
where scores tie). The count at a pre-token's terminal node then serves all its occurrences. Pre-tokens of more
than ``deep`` bytes share no paths worth the memory and are walked one by one.

Scores follow the ranks of the vocabulary by Zipf's law: the score of rank r is -log(r + 2). Single bytes are in the
vocabulary, so every pre-token can be cut.

Defined results: null counts as the empty text, with no tokens and score 0. Repeated rows are counted each.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoebox.llm.words import mixed, pieces, raw_text

_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Vocabulary:
    """Ranks file (found where the tasks run), and the longest pre-token kept in the trie."""

    ranks: str = "byte_bpe_multi_50k.tiktoken"
    deep: int = 64


def _push(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return h * _STEP + byte.astype(np.uint64) + np.uint64(1)


@dataclass
class Pieces:
    """Pieces by bytes, and an open-addressed table of their hashes for looking up many at once."""

    scores: dict[bytes, float]
    lengths: list[int]
    keys: np.ndarray
    values: np.ndarray
    shift: np.uint64

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Score of each hash, minus infinity where there is no such piece."""
        out = np.full(len(h), -np.inf)
        slot = (mixed(h) >> self.shift).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            key = self.keys[slot]
            hit = key == h[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (key != 0)
            todo, slot = todo[on], (slot[on] + 1) % len(self.keys)
        return out


def _hash(piece: bytes) -> int:
    h = 0
    for byte in piece:
        h = (h * int(_STEP) + byte + 1) % (1 << 64)
    return h


@functools.cache
def _pieces(name: str) -> Pieces:
    with open(public_tokenizers.path(name), "rb") as lines:
        scores = {base64.b64decode(t): -math.log(int(r) + 2) for t, r in map(bytes.split, lines)}
    bits = (4 * len(scores)).bit_length()
    keys, values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits)
    hashes = np.array([_hash(p) for p in scores], np.uint64)
    for h, slot, score in zip(hashes, (mixed(hashes) >> np.uint64(64 - bits)).tolist(), scores.values()):
        while keys[slot]:
            slot = (slot + 1) % len(keys)
        keys[slot], values[slot] = h, score
    return Pieces(scores, sorted({len(p) for p in scores}), keys, values, np.uint64(64 - bits))


def walk(token: bytes, vocabulary: Pieces) -> tuple[float, int]:
    """Best score and number of pieces of one pre-token."""
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        ways = []
        for length in vocabulary.lengths:
            if length > end:
                break
            score = vocabulary.scores.get(token[end - length : end])
            if score is not None:
                ways.append((best[end - length][0] + score, best[end - length][1] - 1))
        best.append(max(ways))
    return best[-1][0], -best[-1][1]


def trie_scores(tokens: pa.Array, vocabulary: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Best score and number of pieces of each of the sorted, distinct ``tokens``."""
    raw, bounds = raw_text(tokens)
    count, lengths = len(tokens), np.diff(bounds)
    depth = int(lengths.max()) if count else 0
    longest = vocabulary.lengths[-1]
    score, number = np.zeros(count), np.zeros(count, np.int64)
    # Per depth: hash, best score and pieces of the node that each row's path has there.
    hashes, scores, numbers = [np.zeros(count, np.uint64)], [np.zeros(count)], [np.zeros(count, np.int32)]
    shared = np.zeros(count, bool)  # the path so far is also that of the row before
    shared[1:] = True
    for d in range(1, depth + 1):
        live = lengths >= d
        byte = np.where(live, raw[np.minimum(bounds[:-1] + d - 1, max(len(raw) - 1, 0))], 0)
        shared[1:] &= live[1:] & live[:-1] & (byte[1:] == byte[:-1])
        h = _push(hashes[d - 1], byte)
        new = np.flatnonzero(live & ~shared)
        best, fewest = np.full(len(new), -np.inf), np.zeros(len(new), np.int32)
        for length in vocabulary.lengths:
            if length > d:
                break
            piece = h[new] - hashes[d - length][new] * np.uint64(pow(int(_STEP), length, 1 << 64))
            found = scores[d - length][new] + vocabulary.look_up(piece)
            pieces_so_far = numbers[d - length][new] + 1
            better = (found > best) | ((found == best) & (pieces_so_far < fewest))
            best[better], fewest[better] = found[better], pieces_so_far[better]
        # Rows that share the path take the values of the node's first row.
        at = np.zeros(count, np.int64)
        at[new] = np.arange(len(new))
        at = np.maximum.accumulate(at)
        hashes.append(h)
        scores.append(best[at] if len(new) else np.zeros(count))
        numbers.append(fewest[at] if len(new) else np.zeros(count, np.int32))
        ends = lengths == d
        score[ends], number[ends] = scores[d][ends], numbers[d][ends]
        if d >= longest:
            hashes[d - longest] = scores[d - longest] = numbers[d - longest] = None
    return score, number


def _count(batches: Iterator[pa.RecordBatch], spec: Vocabulary) -> Iterator[pa.RecordBatch]:
    vocabulary = _pieces(spec.ranks)
    split = regex.compile(public_tokenizers.PATTERN).findall
    for batch in (p for b in batches for p in pieces(b, "text", 4 << 20)):
        found, bounds = [], [0]
        for text in batch.column("text").to_pylist():
            found += split(text)
            bounds.append(len(found))
        coded = pa.array(found, pa.string()).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        ordered = coded.dictionary.take(order)
        score, number = np.zeros(len(ordered)), np.zeros(len(ordered), np.int64)
        short = np.asarray(pc.less_equal(pc.binary_length(ordered), spec.deep))
        score[short], number[short] = trie_scores(ordered.filter(pa.array(short)), vocabulary)
        for i in np.flatnonzero(~short):
            score[i], number[i] = walk(ordered[int(i)].as_py().encode(), vocabulary)
        back = np.empty(len(ordered), np.int64)
        back[order.to_numpy()] = np.arange(len(ordered))
        code = back[coded.indices.to_numpy()]
        total = np.concatenate([[0], np.cumsum(number[code])])
        bounds = np.array(bounds)
        sums = [float(s) for s in (math.fsum(score[code[a:b]]) for a, b in zip(bounds, bounds[1:]))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(np.diff(bounds)), pa.array(total[bounds[1:]] - total[bounds[:-1]]), pa.array(sums, pa.float64())],
            names=["id", "n_pretokens", "n_tokens", "score"],
        )


def token_counts(docs: DataFrame, spec: Vocabulary = Vocabulary(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_pretokens, n_tokens, score`` of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL("n_pretokens long, n_tokens long, score double").fields])
    return rows.mapInArrow(lambda b: _count(b, spec), schema).withColumnRenamed("id", id_col)
