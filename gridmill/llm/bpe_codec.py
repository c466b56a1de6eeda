"""BPE encoding and decoding through a table of distinct words.

Texts are split into words that encode independently. A chunk of documents
keeps each word's place; its distinct words go, packed, to parts dealt by the
words' hash. A part encodes each distinct word once, whatever the number of
chunks and texts it occurs in, and sends ids back to the chunks, where they are
joined by place into the texts' ids. Decoding joins ids to the vocabulary's
pieces.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_pieces import _added, byte_alphabet, load, merger, pieces
from .chunks import chunked, pack_bytes, squeeze, unpack_bytes, unsqueeze
from .common import staged, text_bytes

#: Bytes of text whose words share a part, about.
PART_BYTES = 24_000_000
STAGED = "chunk long, part int, doc_ids array<long>, lengths binary, places binary, homes binary, words binary"
ENCODED = "chunk long, part int, sizes binary, ids binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=2)
def vocabulary(path: str) -> list[bytes]:
    """The piece of each id: the join table of decoding, as long as the vocabulary."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    alphabet, special = byte_alphabet(), {x["content"]: x["id"] for x in _added(path)}
    size = max([*model["vocab"].values(), *special.values()]) + 1
    out = [b""] * size
    for entry, i in model["vocab"].items():
        if entry not in special:
            out[i] = bytes(alphabet[c] for c in entry)
    for entry, i in special.items():
        out[i] = entry.encode()
    return out


class WordEncoder:
    """Ids of a word as unsigned 16-bit little-endian bytes."""

    def __init__(self, path: str):
        import regex

        self.specials = load(path)[1]
        self.merge, self.short = merger(path)
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall

    def __call__(self, word: bytes) -> bytes:
        if word in self.specials:
            return self.specials[word].to_bytes(2, "little")
        short, merge = self.short, self.merge
        return b"".join([short[r] for part in self.split(word.decode()) for r in merge(part.encode())])


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _pack(words: list[bytes]) -> bytes:
    sizes = squeeze(np.fromiter(map(len, words), np.int32, len(words)))
    return len(sizes).to_bytes(4, "little") + sizes + pack_bytes(b"".join(words))


def _unpack(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(unsqueeze(data[4 : 4 + n])).tolist()
    joined = unpack_bytes(data[4 + n :])
    return [joined[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def split_texts(docs: DataFrame, tokenizer: str, parts: int) -> DataFrame:
    """A row of places for each chunk (part -1), and its words packed by part."""
    none = [None] * 5

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials = load(tokenizer)[1]
        schema = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("places", pa.binary()), ("homes", pa.binary()), ("words", pa.binary())])

        def batch(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for chunk, keys, coded, words in chunked(batches, lambda t: pieces(t, specials)):
            homes = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts
            every = np.concatenate(coded) if coded else np.zeros(0, np.int32)
            yield batch([[chunk, -1, keys, squeeze(np.array([len(c) for c in coded])), squeeze(every), squeeze(homes), None]])
            order = np.argsort(homes, kind="stable")
            borders = np.flatnonzero(np.diff(homes[order])) + 1
            held: list[list] = []
            for own in np.split(order, borders) if len(order) else []:
                held.append([chunk, int(homes[own[0]]), *none[:4], _pack([words[i] for i in own.tolist()])])
                if len(held) == 64:
                    yield batch(held)
                    held = []
            if held:
                yield batch(held)

    return docs.select("doc_id", "text").mapInArrow(split, STAGED)


def encode_parts(packed: DataFrame, tokenizer: str) -> DataFrame:
    """Ids of each packed row's words; in a part, each distinct word is encoded once."""

    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        encoder, known, out = _encoder(tokenizer), {}, []
        for chunk, part, words in zip(rows["chunk"], rows["part"], rows["words"], strict=True):
            ids = []
            for w in _unpack(words):
                if (x := known.get(w)) is None:
                    x = known[w] = encoder(w)
                ids.append(x)
            out.append((chunk, part, squeeze(np.fromiter(map(len, ids), np.int32, len(ids))), pack_bytes(b"".join(ids))))
        return pd.DataFrame(out, columns=["chunk", "part", "sizes", "ids"])

    return packed.select("chunk", "part", "words").groupBy("part").applyInPandas(encode, ENCODED)


def _joined(chunk: pd.Series, encoded: pd.DataFrame) -> Iterator[tuple[int | None, bytes]]:
    """Each document's key and ids (16 bits each), joined by place."""
    encoded = encoded.sort_values("part")
    order = np.argsort(unsqueeze(chunk["homes"]), kind="stable").tolist()
    words: list[bytes] = [b""] * len(order)
    at = 0
    for sizes, ids in zip(encoded["sizes"], encoded["ids"], strict=True):
        ends = np.cumsum(unsqueeze(sizes)).tolist()
        raw = unpack_bytes(ids)
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            words[order[at]] = raw[a:b]
            at += 1
    places, lengths = unsqueeze(chunk["places"]), unsqueeze(chunk["lengths"])
    ends = np.cumsum(lengths)
    for key, a, b in zip(chunk["doc_ids"], ends - lengths, ends, strict=True):
        yield (None if key is None or key != key else int(key)), b"".join([words[i] for i in places[a:b].tolist()])


def _assembled(docs: DataFrame, tokenizer: str, finish, schema: str) -> DataFrame:
    parts = max(8, text_bytes(docs) // PART_BYTES)
    rows = staged(split_texts(docs, tokenizer, parts), "bpe-words")
    chunks = rows.filter("part < 0").select("chunk", "doc_ids", "lengths", "places", "homes")
    encoded = encode_parts(rows.filter("part >= 0"), tokenizer).withColumnRenamed("chunk", "of")

    def assemble(chunk: pd.DataFrame, ids: pd.DataFrame) -> pd.DataFrame:
        return finish(x for _, row in chunk.iterrows() for x in _joined(row, ids))

    return chunks.groupBy("chunk").cogroup(encoded.groupBy("of")).applyInPandas(assemble, schema)


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids array<int>. Null text has no ids; repeated rows give repeated results."""

    def finish(texts: Iterator[tuple[int | None, bytes]]) -> pd.DataFrame:
        rows = [(k, np.frombuffer(x, "<u2").astype(np.int32)) for k, x in texts]
        return pd.DataFrame({"doc_id": pd.array([k for k, _ in rows], "Int64"), "ids": [x for _, x in rows]})

    return _assembled(docs, tokenizer, finish, "doc_id long, ids array<int>")


def decode_ids(ids: np.ndarray, pieces_of: list[bytes]) -> str:
    """The text of ids by their pieces; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(pieces_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text of encode_documents()'s rows; null ids give an empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(tokenizer)
        for batch in batches:
            texts = [decode_ids(np.asarray(x or [], np.int64), table) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def codec_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, encoded and decoded again.

    Null and empty texts have no ids. A null doc_id stays null, repeated rows
    give repeated results, other columns are not read, and an empty table gives
    no rows.
    """

    def finish(texts: Iterator[tuple[int | None, bytes]]) -> pd.DataFrame:
        table, out = vocabulary(tokenizer), []
        for key, short in texts:
            ids = np.frombuffer(short, "<u2")
            out.append((key, len(ids), hashlib.sha256(ids.astype("<u4")).hexdigest(), hashlib.sha256(decode_ids(ids, table).encode()).hexdigest()))
        frame = pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        return frame.astype({"doc_id": "Int64"})

    return _assembled(docs, tokenizer, finish, DIGESTS)
