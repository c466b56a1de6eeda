"""Chunks of documents as numbered words.

A chunk is a run of a task's documents. It becomes one row of documents (keys,
lengths, and the number of each word, in place) and a row for each distinct
word. Facts about words are then found once for each distinct word over all
chunks, joined to the chunks' word rows, and met with the documents by chunk.
Frequent words have as many rows as there are chunks, never as many as they
have occurrences, and no chunk grows with the input.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks

#: Bytes of text in a chunk, about; a larger chunk repeats fewer words, and takes more of a worker's memory.
CHUNK_BYTES = 32_000_000
LEVEL = 9
SCHEMA = "chunk long, doc_ids array<long>, lengths binary, places binary, tags binary, idx int, word binary, n long"


def pack_bytes(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(data)


def unpack_bytes(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def squeeze(values: np.ndarray) -> bytes:
    """Compressed whole numbers below 2**28: seven bits a byte, least first, the top bit set if more follow."""
    out = []
    for at in range(0, len(values), 1 << 18):
        x = np.asarray(values[at : at + (1 << 18)], np.int32)
        size = 1 + (x >= 1 << 7) + (x >= 1 << 14) + (x >= 1 << 21)
        spread = np.stack([x >> 7 * k & 127 | (size > k + 1) << 7 for k in range(4)], axis=1).astype(np.uint8)
        out.append(spread[np.arange(4) < size[:, None]].tobytes())
    return pack_bytes(b"".join(out))


def unsqueeze(data: bytes) -> np.ndarray:
    raw = np.frombuffer(unpack_bytes(data), np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = (raw[starts] & 127).astype(np.int32)
    for k in range(1, 4):
        more = np.flatnonzero(ends - starts >= k)
        out[more] |= (raw[starts[more] + k] & 127).astype(np.int32) << 7 * k
    return out


def by_frequency(coded: list[np.ndarray], words: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
    """Words renumbered from the most frequent down: small numbers are short when squeezed."""
    if not words:
        return coded, words
    order = np.argsort(-np.bincount(np.concatenate(coded), minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.int32)
    rank[order] = np.arange(len(words), dtype=np.int32)
    return [rank[c] for c in coded], [words[i] for i in order.tolist()]


def chunked(batches: Iterator[pa.RecordBatch], split: Callable[[bytes], list[bytes]], most: int = CHUNK_BYTES) -> Iterator[tuple[int, list, list[np.ndarray], list[bytes]]]:
    """(chunk, keys, word numbers of each document, words) of a task's documents."""
    chunk = TaskContext.get().partitionId() << 32

    def fresh() -> defaultdict:
        seen: defaultdict[bytes, int] = defaultdict()
        seen.default_factory = seen.__len__
        return seen

    keys, coded, seen, held = [], [], fresh(), 0
    for block in blocks(batches):
        for key, text in zip(block.column("doc_id").cast(pa.int64()).to_pylist(), as_bytes(block.column("text")), strict=True):
            parts = split(text)
            keys.append(key)
            coded.append(np.fromiter(map(seen.__getitem__, parts), np.int32, len(parts)))
            held += len(text)
        if held >= most:
            yield chunk, keys, *by_frequency(coded, list(seen))
            chunk += 1
            keys, coded, seen, held = [], [], fresh(), 0
    if keys:
        yield chunk, keys, *by_frequency(coded, list(seen))


def numbered(docs: DataFrame, split: Callable[[bytes], list[bytes]], counted: Callable[[int | None], bool], tag: Callable[[bytes], int] | None = None, most: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows (word null) and word rows (word set; n: occurrences in documents whose key is counted).

    tag: a number for each word; a chunk row has those of its words in order.
    """

    schema = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("places", pa.binary()), ("tags", pa.binary()), ("idx", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, keys, coded, words in chunked(batches, split, most):
            n = len(words)
            take = [c for k, c in zip(keys, coded, strict=True) if counted(k)]
            counts = np.bincount(np.concatenate(take), minlength=n) if take else np.zeros(n, np.int64)
            tags = squeeze(np.fromiter(map(tag, words), np.int32, n)) if tag else None
            head = [[chunk], [keys], [squeeze(np.array([len(c) for c in coded]))], [squeeze(np.concatenate(coded))], [tags], [None], [None], [None]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(head, schema, strict=True)], schema=schema)
            for at in range(0, n, 50_000):
                part = words[at : at + 50_000]
                m = len(part)
                none = [pa.nulls(m, f.type) for f in schema]
                none[0], none[5], none[6], none[7] = pa.array(np.full(m, chunk)), pa.array(np.arange(at, at + m, dtype=np.int32)), pa.array(part, pa.binary()), pa.array(counts[at : at + m].astype(np.int64))
                yield pa.RecordBatch.from_arrays(none, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(make, SCHEMA)


def chunk_rows(staged_chunks: DataFrame) -> DataFrame:
    return staged_chunks.filter(F.col("word").isNull()).select("chunk", "doc_ids", "lengths", "places", "tags")


def word_rows(staged_chunks: DataFrame) -> DataFrame:
    return staged_chunks.filter(F.col("word").isNotNull()).select("chunk", "idx", "word", "n")
