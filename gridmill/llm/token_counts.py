"""Exact token counts at every prefix of a text.

For one pre-token the counts come from prefix dynamic programming: the encoding
of a prefix ends in exactly one vocabulary entry t for which the encoding of
what precedes t, followed by t, has no border that byte-pair merging would
cross. So last[i] and count[i] follow from last[i - len(t)] and
count[i - len(t)], in time linear in the pre-token. Texts repeat their pieces;
a piece's counts are made once and kept, and a text is a list of pieces with
running totals, from which count, truncation and budget questions are answered
without encoding anything again.

Null and empty texts have no tokens. Very long texts are handled whole; they
cost memory in proportion to their own length only.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_pieces import WIDE_SPACE, byte_alphabet, load, pieces
from .common import as_bytes, blocks

#: Pieces, and bytes of pieces, whose counts a worker keeps; beyond either the store starts anew.
KEPT_PIECES, KEPT_BYTES = 500_000, 32_000_000
_SPACE_START = re.compile(f"[\t-\r {WIDE_SPACE}]+")
_SPACE_END = re.compile(f"[\t-\r {WIDE_SPACE}]$(?!\n)")


class PrefixCounter:
    """Token counts of all prefixes of a piece, by dynamic programming."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        # Ranks replace ids: a single byte has its value, a merge 256 + its place.
        self.rank = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in model["merges"]:
            a, b = raw(left), raw(right)
            made = len(self.halves)
            pair = (self.rank[a], self.rank[b])
            self.halves.append(pair)
            self.merged[pair] = made
            self.rank.setdefault(a + b, made)
        if len(self.halves) > 1 << 16:
            raise ValueError("ranks beyond 16 bits")  # two of them share a key below
        # All entries that end at a place of a pre-token, longest first; a byte is a Latin-1 character.
        found = ahocorasick.Automaton()
        for entry, t in self.rank.items():
            found.add_word(entry.decode("latin-1"), (len(entry), t))
        found.make_automaton()
        self.ending = found.iter
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.stands: dict[int, bool] = {}
        self.known: dict[bytes, list[int] | bytes] = {}
        self.parted: dict[str, list[int] | bytes] = {}
        self.held = {"known": 0, "parted": 0}
        self.bytes_of = {t: b for b, t in self.rank.items()}
        self.entire: dict[int, bool] = {}

    def border_stands(self, left: int, right: int) -> bool:
        """Whether merging keeps the border between two adjacent entries.

        Undo merges on both sides of the border, latest first. At each step the
        two entries that touch must not form a merge earlier than what was
        undone, or byte-pair encoding would have joined them.
        """
        limit, merged, halves = 1 << 60, self.merged, self.halves
        a, b, ok = left, right, True
        while True:
            if merged.get((a, b), limit) < limit:
                ok = False
                break
            if a < 256 and b < 256:
                break
            # At equal ranks the left one was merged first, so undo the right one.
            if a > b:
                limit, a = a, halves[a][1]
            else:
                limit, b = b + 1, halves[b][0]
        if len(self.stands) > 2_000_000:
            self.stands.clear()
        self.stands[left << 16 | right] = ok
        return ok

    def _pretoken(self, data: bytes) -> list[int]:
        """count[i] for each i from 1 to len(data), in bytes."""
        stands, stood, whole = self.border_stands, self.stands, self.entire
        last, count = [0] * (len(data) + 1), [0] * (len(data) + 1)
        done = 0
        for end, (n, t) in self.ending(data.decode("latin-1")):
            end += 1
            if end == done:
                continue
            if before := end - n:
                if (ok := stood.get(last[before] << 16 | t)) is None:
                    ok = stands(last[before], t)
            elif (ok := whole.get(t)) is None:
                ok = self._whole(t)
            if ok:
                last[end], count[end], done = t, count[before] + 1, end
        return count[1:]

    def _whole(self, t: int) -> bool:
        """Whether byte-pair encoding of an entry's own bytes is that entry."""
        parts = list(self.bytes_of[t])
        while len(parts) > 1:
            best = min((self.merged.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [best[0]]
        self.entire[t] = parts == [t]
        return self.entire[t]

    def _part(self, part: str) -> list[int] | bytes:
        """Counts of a pre-token, one for each character end."""
        raw = part.encode()
        counts = self._pretoken(raw)
        if len(raw) != len(part):
            at, ends = 0, []
            for c in part:
                at += len(c.encode())
                ends.append(counts[at - 1])
            counts = ends
        if part[0] == "'" and len(part) == 3 and part[1:] in ("re", "ve", "ll"):
            counts = [1, 2, counts[2]]  # an unfinished contraction is a mark and a letter
        return bytes(counts) if counts[-1] < 256 else counts

    def _keep(self, name: str, key: bytes | str, counts: list[int] | bytes) -> None:
        """Keep counts in a store, which starts anew where it would hold too many pieces or bytes. A count in a list takes eight."""
        store, size = getattr(self, name), len(key) + len(counts) * (1 if isinstance(counts, bytes) else 8)
        if len(store) >= KEPT_PIECES or self.held[name] + size > KEPT_BYTES:
            store.clear()
            self.held[name] = 0
        if size <= KEPT_BYTES // 8:
            store[key] = counts
            self.held[name] += size

    def piece(self, data: bytes) -> list[int] | bytes:
        """Token counts of the piece's prefixes, one for each character end."""
        parts = self.split(data.decode())
        parted = self.parted
        if len(parts) == 1:
            out = parted.get(parts[0]) or self._part(parts[0])
        else:
            out, before = [], 0
            for part in parts:
                if (counts := parted.get(part)) is None:
                    counts = self._part(part)
                    self._keep("parted", part, counts)
                out.extend([before + n for n in counts])
                before = out[-1]
            out = bytes(out) if before < 256 else out
        self._keep("known", data, out)
        return out


@lru_cache(maxsize=2)
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


class PrefixStore:
    """Counts of one text: its pieces, and running totals of their tokens and characters."""

    def __init__(self, data: bytes, path: str):
        counter, specials = _counter(path), load(path)[1]
        self.path, self.specials = path, specials
        self.parts = pieces(data, specials)
        # Until it is complete, a special string is ordinary text.
        known, piece = counter.known, counter.piece
        self.counts = [known.get(p) or piece(p) for p in self.parts]
        if any(s in data for s in specials):
            self.counts = [[*c[:-1], 1] if p in specials else c for p, c in zip(self.parts, self.counts, strict=True)]
        self.tokens = list(accumulate([c[-1] for c in self.counts], initial=0))

    @property
    def total(self) -> int:
        return self.tokens[-1]

    @cached_property
    def chars(self) -> list[int]:
        return list(accumulate(map(len, self.counts), initial=0))

    def _inside(self, k: int) -> list[int]:
        """Counts inside piece k, as they are where the text ends there.

        White space that ends a prefix joins the white space before it, and an
        unfinished special string joins what precedes it; such pieces are
        counted together with what they join.
        """
        part = self.parts[k]
        cut = _SPACE_START.match(part.decode()) and k and _SPACE_END.search(self.parts[k - 1].decode())
        if not cut and part not in self.specials:
            return self.counts[k]
        j = k
        while j and self.parts[j - 1] not in self.specials and (part in self.specials or _SPACE_END.search(self.parts[j - 1].decode())):
            j -= 1
        joined, whole, base = b"".join(self.parts[j:k]), part.decode(), self.tokens[j] - self.tokens[k]
        some = len(whole) - 1 if part in self.specials else _SPACE_START.match(whole).end()
        heads = [base + PrefixStore(joined + whole[: i + 1].encode(), self.path).total for i in range(some)]
        return heads + list(self.counts[k][some:])

    def at(self, chars: int) -> int:
        """Tokens of the prefix of that many characters."""
        k = bisect_left(self.chars, chars) - 1
        return 0 if k < 0 else self.tokens[k] + self._inside(k)[chars - self.chars[k] - 1]

    def all(self) -> np.ndarray:
        """Tokens of every prefix, from none to all characters."""
        out = [np.zeros(1, np.int64)]
        out += [self.tokens[k] + np.asarray(list(self._inside(k)), np.int64) for k in range(len(self.parts))]
        return np.concatenate(out)

    def fitting(self, limit: int) -> int:
        """Characters of the longest prefix that ends a piece, or lies in the next piece, within limit tokens."""
        k = bisect_right(self.tokens, limit) - 1
        if k >= len(self.parts):
            return self.chars[-1]
        inside = [i + 1 for i, n in enumerate(self._inside(k)) if self.tokens[k] + n <= limit]
        return self.chars[k] + max(inside, default=0)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (characters kept when cut to `limit` tokens).

    Null text counts as empty. Repeated rows give repeated results; columns
    other than doc_id and text are not read. An empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = as_bytes(block.column("text"))
            stores = [PrefixStore(t, tokenizer) for t in texts]
            totals = [s.total for s in stores]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id").cast(pa.int64()),
                    pa.array(map(len, texts), pa.int64()),
                    pa.array(totals, pa.int64()),
                    pa.array([n > limit for n in totals], pa.bool_()),
                    pa.array([s.fitting(limit) for s in stores], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, prefix_tokens array<int>: entry i is the token count of the first i characters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            rows = [PrefixStore(t, tokenizer).all().astype(np.int32) for t in as_bytes(block.column("text"))]
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "prefix_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, prefix_tokens array<int>")
