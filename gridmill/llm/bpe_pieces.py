"""Byte-level BPE tokenizer files: splitting a text into pieces that encode independently.

A piece is an optional space and a run of other characters, or a run of white
space. The pre-tokenizer never looks across such a border (it attaches at most
one space to what follows, and its look-ahead only asks whether white space
ends), so a text's ids are the ids of its pieces in order. Special strings are
cut out first, as the library does.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

# White space of Unicode beyond ASCII.
WIDE_SPACE = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = "\t-\r " + WIDE_SPACE
_ASCII_PIECES = re.compile(rb" ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_WIDE_PIECES = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_HAS_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


@lru_cache(maxsize=4)
def load(path: str):
    """Tokenizer, and its special strings with their ids."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), {x["content"].encode(): x["id"] for x in _added(path)}


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Stands for the end of a word; no UTF-8 text holds this byte.
END = b"\xff"


@lru_cache(maxsize=4)
def merger(path: str):
    """Byte-pair merging of one pre-token, and each rank's id as unsigned 16-bit little-endian bytes.

    tiktoken's merge loop takes the file's merges as ranks. With word ends, END
    is a byte after the word, whose merges come before all others.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    alphabet, ends = byte_alphabet(), model["end_of_word_suffix"] or ""

    def raw(entry: str) -> bytes:
        last = ends and entry.endswith(ends)
        return bytes(alphabet[c] for c in (entry[: -len(ends)] if last else entry)) + (END if last else b"")

    ranks = {bytes([b]): b for b in range(256)}
    if ends:
        ranks |= {bytes([b]) + END: 256 + b for b in range(255)}
    base = len(ranks)
    for i, (left, right) in enumerate(model["merges"]):
        ranks.setdefault(raw(left) + raw(right), base + i)
    special = {x["content"] for x in _added(path)}
    ids = {raw(entry): i for entry, i in model["vocab"].items() if entry not in special}
    short = [b""] * (base + len(model["merges"]))
    for entry, rank in ranks.items():
        short[rank] = ids.get(entry, 0).to_bytes(2, "little")
    return tiktoken._tiktoken.CoreBPE(ranks, {}, ".").encode_single_piece, short


@lru_cache(maxsize=4)
def _added(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as f:
        return json.load(f)["added_tokens"]


def _plain(data: bytes) -> list[bytes]:
    if _HAS_WIDE.search(data):
        return [x.encode() for x in _WIDE_PIECES.findall(data.decode())]
    return _ASCII_PIECES.findall(data)


def pieces(data: bytes, specials) -> list[bytes]:
    """Pieces of a text in order; a special string is a piece of its own."""
    if not any(s in data for s in specials):
        return _plain(data)
    out: list[bytes] = []
    for part in re.split(b"(" + b"|".join(map(re.escape, specials)) + b")", data):
        if part in specials:
            out.append(part)
        elif part:
            out.extend(_plain(part))
    return out
