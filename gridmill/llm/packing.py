"""Cost-balanced packing of token sequences.

Each document's ids (with an end id) are dealt to buckets of bounded size by a
hash of its key and place. In a bucket, the number of sequences is the least
that holds all tokens. Documents go by descending cost (linear plus quadratic
in their length) to the sequence of lowest cost that still has room for the
whole document; where none has, the document is cut, and a piece fills the
cheapest sequence with any room. So all sequences but one of a bucket's total
are full at the end: padding in a bucket is under one sequence.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_pieces import END, load, merger
from .common import as_bytes, blocks, text_bytes

#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Bytes of text dealt to one bucket, about.
BUCKET_BYTES = 6_000_000
#: Words, and bytes of words and their ids, that a worker keeps; beyond either the table starts anew.
KEPT_WORDS, KEPT_BYTES = 600_000, 48_000_000
END_ID = 1

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _WordIds(dict):
    """Ids of a word as unsigned 16-bit little-endian bytes, made once when first seen.

    Plain words of letters go to the merge loop directly; others are
    normalised and split as the tokenizer's file says, and a word that could
    hold a special string or other white space goes to the tokenizer itself.
    """

    def __init__(self, path: str):
        import regex

        tokenizer, self.specials = load(path)
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        self.whole, self.held = tokenizer.encode, 0
        self.merge, self.short = merger(path)
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall

    def __missing__(self, word: bytes) -> bytes:
        short = self.short
        if word.isalpha():
            out = b"".join([short[r] for r in self.merge(word.lower() + END)])
        elif any(s in word for s in self.specials):
            out = np.asarray(self.whole(word.decode(), add_special_tokens=False).ids, "<u2").tobytes()
        else:
            text = word.decode()
            text = text.lower() if word.isascii() else "".join([c.lower() for c in normalize("NFC", text)])
            out = b"".join([short[r] for part in self.split(text) for r in self.merge(part.encode() + END)])
        size = len(word) + len(out)
        if len(self) >= KEPT_WORDS or self.held + size > KEPT_BYTES:
            self.clear()
            self.held = 0
        if size <= KEPT_BYTES // 8:
            self[word] = out
            self.held += size
        return out


_words: dict[str, _WordIds] = {}


def encode_words(data: bytes, path: str) -> bytes:
    """Ids of a text (two bytes each) for a tokenizer that lower-cases and drops white space.

    ASCII white space separates words for it, and a word's ids don't depend on
    its neighbours, so a text's ids are those of its words in order.
    """
    table = _words.get(path) or _words.setdefault(path, _WordIds(path))
    return b"".join(map(table.__getitem__, data.split()))


class Cheapest:
    """Sequences by room: the one of lowest cost (then lowest number) among those with at least some room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.size)]
        self.tree: list[tuple[float, int] | None] = [None] * (2 * self.size)

    def _lift(self, room: int) -> None:
        """The least of each node above a room, after its heap has changed."""
        at = self.size + room
        self.tree[at] = self.heaps[room][0] if self.heaps[room] else None
        while at > 1:
            at //= 2
            a, b = self.tree[2 * at], self.tree[2 * at + 1]
            self.tree[at] = b if a is None else a if b is None or a < b else b

    def add(self, room: int, cost: float, sequence: int) -> None:
        if room:
            heapq.heappush(self.heaps[room], (cost, sequence))
            self._lift(room)

    def take(self, least: int) -> tuple[float, int, int] | None:
        """Remove and return (cost, sequence, room) of the cheapest with that room or more."""
        best, lo, hi = None, self.size + least, 2 * self.size
        while lo < hi:
            for at in ([lo] if lo & 1 else []) + ([hi - 1] if hi & 1 else []):
                if self.tree[at] is not None and (best is None or self.tree[at] < self.tree[best]):
                    best = at
            lo, hi = (lo + 1) // 2, hi // 2
        if best is None:
            return None
        while best < self.size:
            best = 2 * best if self.tree[2 * best] == self.tree[best] else 2 * best + 1
        room = best - self.size
        cost, sequence = heapq.heappop(self.heaps[room])
        self._lift(room)
        return cost, sequence, room


def pack_lengths(lengths: list[int], capacity: int = 2048) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece, for documents of given lengths."""
    out, sequences = [], 0
    rest = []
    for d, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            out.append((d, k * capacity, capacity, sequences, 0))
            sequences += 1
        if n % capacity:
            rest.append((n % capacity, d, whole * capacity))
    open_ones = Cheapest(capacity)
    for i in range(-(-sum(r[0] for r in rest) // capacity)):
        open_ones.add(capacity, 0.0, sequences + i)
    for n, d, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        while n:
            cost, sequence, room = open_ones.take(n) or open_ones.take(1)
            m = min(n, room)
            out.append((d, start, m, sequence, capacity - room))
            open_ones.add(room - m, cost + LINEAR * m + QUADRATIC * m * m, sequence)
            start, n = start + m, n - m
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is empty: the end id alone. Documents with a null key are packed
    too and keep their null key. Repeated rows are packed as often as they
    occur; rows of one key go by their ids, so a rerun lays them out alike.
    Other columns are not read. An empty table gives no rows.
    """
    buckets = max(1, text_bytes(docs) // BUCKET_BYTES)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, place = END_ID.to_bytes(2, "little"), 0
        for block in blocks(batches):
            keys = block.column("doc_id").cast(pa.int64())
            ids = [encode_words(t, tokenizer) + end for t in as_bytes(block.column("text"))]
            # The place among a task's rows spreads repeated keys.
            homes = [zlib.crc32(b"%d %d" % (-1 if k is None else k, place + i)) % buckets for i, k in enumerate(keys.to_pylist())]
            place += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(homes, pa.int64()), keys, pa.array(ids, pa.binary())], names=["bucket", "doc_id", "ids"])

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, raw = rows["doc_id"].tolist(), rows["ids"].tolist()
        # Ids are compared for equal keys alone.
        order = sorted(range(len(raw)), key=lambda i: (pd.isna(keys[i]), 0 if pd.isna(keys[i]) else keys[i], raw[i]))
        keys, ids = [keys[i] for i in order], [np.frombuffer(raw[i], "<u2").astype("<u4") for i in order]
        made = pack_lengths([len(x) for x in ids], capacity)
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if pd.isna(keys[d]) else int(keys[d]) for d, *_ in made], "Int64"),
                "start": [s for _, s, *_ in made],
                "length": [n for _, _, n, *_ in made],
                "ids_crc32": [zlib.crc32(ids[d][s : s + n]) for d, s, n, *_ in made],
                "doc_tokens": [len(ids[d]) for d, *_ in made],
                "sequence_id": [(int(key[0]) << 32) + q for *_, q, _ in made],
                "offset": [o for *_, o in made],
            }
        )

    encoded = docs.select("doc_id", "text").mapInArrow(encode, "bucket long, doc_id long, ids binary")
    return encoded.repartition(F.col("bucket")).groupBy("bucket").applyInPandas(pack, PIECES)
