"""Counting, encoding, decoding and packing against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridmill.llm import bpe_codec, packing, token_counts
from gridmill.llm.queries import QUERIES, tokenizer_path

from .conftest import SF, TEXTS

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def by_byte():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def by_word():
    return Tokenizer.from_file(WORD)


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


PARTS = ["a", "b", "the", "'", "'ll", "'re", "'s", " ", "  ", "\n", "\n ", "é", "ß", " ", " ", "1", "23", "###", "!", "<|endoftext|>", "<|endof", "́", "漢", "\t", "\x1c", "\x00", "\x85", "I'll", "don't", "Σ", "İ", "😀"]


@pytest.mark.parametrize("seed", range(120))
def test_every_prefix(by_byte, seed):
    r = random.Random(seed)
    text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 14)))
    store = token_counts.PrefixStore(text.encode(), BYTE)
    want = [len(ids(by_byte, text[:k])) for k in range(len(text) + 1)]
    assert store.all().tolist() == want
    assert [store.at(k) for k in range(len(text) + 1)] == want and store.total == want[-1]
    for limit in (0, 2, 5):
        assert want[store.fitting(limit)] <= limit


@pytest.mark.parametrize("seed", range(60))
def test_words_encode_alone(by_word, by_byte, seed):
    r = random.Random(seed)
    text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 30)))
    assert np.frombuffer(packing.encode_words(text.encode(), WORD), "<u2").tolist() == ids(by_word, text)


def test_vocabulary_encodes_to_itself(by_byte):
    """Whole entries of the vocabulary, which merging could split, agree with the library."""
    table = bpe_codec.vocabulary(BYTE)
    encoder = bpe_codec.WordEncoder(BYTE)
    for i in range(0, len(table), 37):
        try:
            text = table[i].decode()
        except UnicodeDecodeError:
            continue
        pieces = b"".join(encoder(p) for p in token_counts.pieces(table[i], encoder.specials))
        assert np.frombuffer(pieces, "<u2").tolist() == ids(by_byte, text)


def test_op3(spark, by_byte):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op3_token_counts"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        n = len(ids(by_byte, d.text))
        assert (got[d.doc_id].n_bytes, got[d.doc_id].n_tokens, got[d.doc_id].over_limit) == (len((d.text or "").encode()), n, n > 512)


def test_op3_odd(odd, empty, by_byte):
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.token_counts(odd, BYTE).collect())
    assert got == sorted((str(k), len(ids(by_byte, t))) for k, t in TEXTS)
    assert token_counts.token_counts(empty, BYTE).collect() == []
    small = odd.filter("doc_id = 9 or doc_id = 3")
    assert sorted(map(tuple, token_counts.prefix_counts(small, BYTE).collect())) == [(3, [0]), (9, [0, 1])]


def digests(by_byte, text):
    x = ids(by_byte, text)
    return len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(by_byte.decode(x, skip_special_tokens=False).encode()).hexdigest()


def test_op8(spark, by_byte):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op8_bpe_codec"](spark, SF).collect()}
    assert got == {d.doc_id: digests(by_byte, d.text) for d in docs}


def test_op8_odd(odd, empty, by_byte):
    got = sorted(tuple(map(str, r)) for r in bpe_codec.codec_digests(odd, BYTE).collect())
    assert got == sorted((str(k), *map(str, digests(by_byte, t))) for k, t in TEXTS)
    assert bpe_codec.codec_digests(empty, BYTE).collect() == []
    encoded = bpe_codec.encode_documents(odd, BYTE)
    back = sorted((str(r.doc_id), r.text) for r in bpe_codec.decode_documents(encoded, BYTE).collect())
    assert back == sorted((str(k), t or "") for k, t in TEXTS)


def check_pieces(rows, texts, tokenizer, most_padding):
    """Each id in exactly one piece, sequences gapless and within capacity."""
    whole = defaultdict(list)
    for key, text in texts:
        whole[key].append(np.array([*ids(tokenizer, text), 1], "<u4"))
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length > 0 and any(r.doc_tokens == len(x) and zlib.crc32(x[r.start : r.start + r.length]) == r.ids_crc32 for x in whole[r.doc_id])
        covered[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert covered.keys() == whole.keys()
    for key, arrays in whole.items():
        want = sorted(p for x in arrays for p in range(len(x)))
        assert sorted(p for s, n in covered[key] for p in range(s, s + n)) == want
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    used = sum(n for parts in sequences.values() for _, n in parts)
    assert len(sequences) * 2048 - used < most_padding


def test_op5(spark, by_word):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_pieces(QUERIES["op5_packing"](spark, SF).collect(), docs, by_word, 2048)


def test_op5_odd(odd, empty, by_word):
    check_pieces(packing.pack_documents(odd, WORD).collect(), TEXTS, by_word, 2048)
    assert packing.pack_documents(empty, WORD).collect() == []


@pytest.mark.parametrize("seed", range(30))
def test_pack_lengths(seed):
    r = random.Random(seed)
    lengths = [r.choice([0, 1, 5, 100, 2047, 2048, 2049, 9000, r.randint(1, 3000)]) for _ in range(r.randint(0, 60))]
    made = packing.pack_lengths(lengths)
    per_doc, per_seq = defaultdict(int), defaultdict(int)
    for d, _, n, q, _ in made:
        per_doc[d] += n
        per_seq[q] += n
    assert [per_doc[d] for d in range(len(lengths))] == lengths
    assert all(n <= 2048 for n in per_seq.values()) and len(per_seq) * 2048 - sum(lengths) < 2048


def slow_packing(lengths, capacity):
    """Every piece by a look at all sequences: the cheapest with room for the whole rest, or else with any room."""
    out, rest, first = [], [], 0
    for d, n in enumerate(lengths):
        for k in range(n // capacity):
            out.append((d, k * capacity, capacity, first, 0))
            first += 1
        if n % capacity:
            rest.append((n % capacity, d, n // capacity * capacity))
    count = -(-sum(r[0] for r in rest) // capacity)
    room, cost = [capacity] * count, [0.0] * count
    for n, d, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        while n:
            fit = [i for i in range(count) if room[i] >= n] or [i for i in range(count) if room[i]]
            i = min(fit, key=lambda i: (cost[i], i))
            m = min(n, room[i])
            out.append((d, start, m, first + i, capacity - room[i]))
            room[i], cost[i] = room[i] - m, cost[i] + packing.LINEAR * m + packing.QUADRATIC * m * m
            start, n = start + m, n - m
    return out


@pytest.mark.parametrize("capacity", [7, 64, 100, 2048])
def test_cheapest_sequence_by_brute_force(capacity):
    r = random.Random(capacity)
    for _ in range(10):
        lengths = [r.choice([r.randint(0, capacity * 3), r.randint(1, capacity // 3 + 1)]) for _ in range(r.randint(0, 120))]
        assert packing.pack_lengths(lengths, capacity) == slow_packing(lengths, capacity)


def test_packing_does_not_follow_the_order_of_repeated_keys(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(n))) for n in (900, 40, 700, 500, 3, 1200)] + [(1, "x")] * 3
    pieces = lambda r: sorted((p.start, p.length, p.ids_crc32, p.sequence_id, p.offset) for p in packing.pack_documents(spark.createDataFrame(r, "doc_id long, text string").coalesce(1), WORD).collect())
    assert pieces(rows) == pieces(rows[::-1])


def test_costs_are_balanced():
    made = packing.pack_lengths([100 + i % 400 for i in range(2000)])
    cost = defaultdict(float)
    for _, _, n, q, _ in made:
        cost[q] += packing.LINEAR * n + packing.QUADRATIC * n * n
    full = sorted(cost.values())[1:]
    assert full[-1] < 1.25 * full[0]


def test_caches_are_bounded_by_bytes(monkeypatch, by_byte):
    monkeypatch.setattr(token_counts, "KEPT_BYTES", 4000)
    monkeypatch.setattr(packing, "KEPT_BYTES", 4000)
    counter, words = token_counts.PrefixCounter(BYTE), packing._WordIds(WORD)
    r = random.Random(6)
    texts = ["".join(r.choice("abcXYZ019+/") for _ in range(n)) for n in (3000, 200, 400, 300, 350, 250)] * 2
    for t in texts:
        assert counter.piece(t.encode())[-1] == len(ids(by_byte, t))
        assert words[t.encode()]
        assert all(x <= 4000 for x in counter.held.values()) and words.held <= 4000
    assert len(counter.known) < 6 and len(words) < 6
