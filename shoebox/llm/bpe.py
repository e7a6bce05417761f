"""Byte-level BPE encoding of long texts in overlapping chunks, and decoding.

A text longer than a chunk is cut into chunks that overlap. Every chunk is pre-tokenised on
its own; in the overlap, the chunk before it and its own run agree again after a few matches.
The seam is the first boundary that both runs have and that stands between a visible character and
white space: no match of the pattern crosses such a place, so pieces between seams have the same
matches alone as in the whole text. A seam that finds no such boundary joins its pieces. The
pieces are encoded in parallel, and their ids are put together by text. Decoding
concatenates the bytes of the ids.

Defined results: null counts as the empty text, which has no ids and the digests of nothing. Repeated
rows are encoded each. Ids of the vocabulary are all that is used; special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoebox.llm.words import pieces
from shoebox.session import cut


@dataclass(frozen=True)
class Chunking:
    """Ranks file (found where the tasks run), characters a chunk, and characters that two chunks share."""

    ranks: str = "byte_bpe_multi_50k.tiktoken"
    size: int = 1 << 14
    overlap: int = 256


@functools.cache
def _encoding(name: str) -> tiktoken.Encoding:
    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def boundaries(text: str, start: int, stop: int) -> set[int]:
    """Ends of the matches in ``text[start:]``, up to ``stop``."""
    found = set()
    for match in _pattern().finditer(text, start):
        if match.end() > stop:
            break
        found.add(match.end())
    return found


def seam(text: str, at: int) -> int | None:
    """Where a chunk that starts at ``at`` resynchronises with the one that starts at 0; ``text`` ends with the overlap."""
    agreed = boundaries(text, 0, len(text) - 1) & boundaries(text, at, len(text) - 1)
    return min((p for p in agreed if p > at and text[p] in " \n\t\r" and not text[p - 1].isspace()), default=None)


def _digests(ids: list[int], encoding: tiktoken.Encoding) -> tuple[int, str, str]:
    joined = ",".join(map(str, ids)).encode()
    return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(encoding.decode_bytes(ids)).hexdigest()


def _open_texts(batches: Iterator[pa.RecordBatch], spec: Chunking) -> Iterator[pa.RecordBatch]:
    """Short texts with their digests; long ones as chunks, each with the seam at its end."""
    encoding = _encoding(spec.ranks)
    names = ["row", "id", "chunk", "text", "seam", "n_tokens", "ids_sha256", "decoded_sha256"]
    kinds = [pa.int64(), None, pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()]
    for batch in (p for b in batches for p in pieces(b, "text")):
        kinds[1] = batch.column("id").type
        out = []
        for row, key, text in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "text"))):
            if len(text) <= spec.size + spec.overlap:
                out.append((row, key, None, None, None, *_digests(encoding.encode_ordinary(text), encoding)))
                continue
            for chunk, start in enumerate(range(0, len(text), spec.size)):
                part = text[start : start + spec.size + spec.overlap]
                last = start + spec.size >= len(text)
                out.append((row, key, chunk, part, None if last else seam(part, spec.size), None, None, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def _encode_pieces(batches: Iterator[pa.RecordBatch], spec: Chunking) -> Iterator[pa.RecordBatch]:
    encoding = _encoding(spec.ranks)
    for batch in batches:
        ids = []
        for parts in batch.column("parts").to_pylist():
            # Chunks that no seam parts follow one another without their overlap.
            texts = [p["text"][: spec.size] for p in parts[:-1]] + [parts[-1]["text"]]
            stop = parts[-1]["seam"]
            whole = "".join(texts)
            end = None if stop is None else len(whole) - len(texts[-1]) + stop
            ids.append(np.array(encoding.encode_ordinary(whole[parts[0]["begin"] : end]), np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("piece"), pa.array(ids, pa.binary())], names=["row", "id", "piece", "ids"])


def _close_texts(batches: Iterator[pa.RecordBatch], spec: Chunking) -> Iterator[pa.RecordBatch]:
    encoding = _encoding(spec.ranks)
    for batch in batches:
        rows = []
        for parts in batch.column("pieces").to_pylist():
            ids = np.frombuffer(b"".join(p["ids"] for p in parts), np.int32).tolist()
            rows.append(_digests(ids, encoding))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))] if rows else []
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_digests(docs: DataFrame, spec: Chunking = Chunking(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` of every row."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    digests = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    key = rows.schema["id"]
    schema = T.StructType([rows.schema["row"], key, *T.StructType.fromDDL(f"chunk int, text string, seam int, {digests}").fields])
    opened = cut(rows.mapInArrow(lambda b: _open_texts(b, spec), schema), "chunks")
    short = opened.filter(F.col("chunk").isNull()).select("id", "n_tokens", "ids_sha256", "decoded_sha256")

    # A piece starts at every seam that was found; the last chunk has none, and needs none.
    order = Window.partitionBy("row").orderBy("chunk")
    parts = opened.filter(F.col("chunk").isNotNull()).withColumn("before", F.lag("seam").over(order))
    parts = parts.withColumn("begin", F.coalesce(F.col("before") - F.lit(spec.size), F.lit(0)))
    parts = parts.withColumn("piece", F.count("before").over(order))
    grouped = parts.repartition("row", "piece").groupBy("row", "piece").agg(
        F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("chunk", "begin", "text", "seam"))).alias("parts")
    )
    coded = grouped.select("row", "id", "piece", "parts").mapInArrow(
        lambda b: _encode_pieces(b, spec), T.StructType([rows.schema["row"], key, T.StructField("piece", T.LongType()), T.StructField("ids", T.BinaryType())])
    )
    texts = coded.groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("pieces"))
    long = texts.select("id", "pieces").mapInArrow(
        lambda b: _close_texts(b, spec), T.StructType([key, *T.StructType.fromDDL(digests).fields])
    )
    return short.unionByName(long).withColumnRenamed("id", id_col)
