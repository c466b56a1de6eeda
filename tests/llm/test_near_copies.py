"""The pipeline's near copies against brute force, and its rows with repeated or null keys."""

import random

import numpy as np

from gridmill.llm import near_copies, stages

from .conftest import SF

FIELDS = "doc_id long, text string"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def planted():
    """Bases with copies of a few changed words, and chains of copies of copies."""
    r = random.Random(1)
    out = []
    for _ in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(60, 300))]
        out.append(" ".join(words))
        for _ in range(3):
            for _ in range(r.randint(1, 4)):
                words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
            out.append(" ".join(words))
    r.shuffle(out)
    return out


def brute(texts):
    """Index of the first text of each component."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i in range(len(texts))}


def test_planted_near_copies_go(spark):
    texts = planted()
    want = brute(texts)
    assert len(want) < len(texts) // 2
    df = spark.createDataFrame(list(enumerate(texts)), FIELDS).repartition(3)
    assert {r.doc_id for r in stages.simhash_stage(spark, df, SF).collect()} == want


def test_large_group_and_links_beyond_its_smallest(spark):
    r = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(60):  # each differs from the next by a word: the ends of the chain share no link
        base[(k * 7) % 200] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(base))
    df = spark.createDataFrame(list(enumerate(texts)), FIELDS)
    assert {r.doc_id for r in near_copies.drop_near_copies(df).collect()} == brute(texts) == {0}


def test_rows_with_repeated_or_null_keys(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text), (2, "another text that is like no other one here"), (None, text + " end"), (None, "a text of its own without any key at all"), (3, None), (4, ""), (3, None)]
    got = near_copies.drop_near_copies(spark.createDataFrame(rows, FIELDS)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)


def test_similar_pairs_by_brute_force():
    rng = np.random.default_rng(5)
    bases = [rng.integers(0, 1 << 60, n, np.uint64) for n in (0, 1, 9, 120, 9000)]
    sets = [np.unique(np.where(rng.random(len(b)) < share, rng.integers(0, 1 << 60, len(b), np.uint64), b)) for b in bases for share in (0, 0.05, 0.1, 0.2)]
    want = [[i, j] for i, a in enumerate(sets[:12]) for j, b in enumerate(sets[4:]) if near_copies.similar(a.tobytes(), b.tobytes())]
    assert near_copies.similar_pairs(sets[:12], sets[4:]).tolist() == want


def test_buckets_in_blocks(spark, monkeypatch):
    """Copies of many kinds of edits: most are like some others, few like the smallest."""
    r = random.Random(3)
    base, texts = [f"w{i}" for i in range(100)], []
    for _ in range(120):
        words = list(base)
        for _ in range(r.choice([1, 3, 5, 8])):
            words[r.randrange(100)] = f"x{r.randrange(50)}"
        texts.append(" ".join(words))
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", 16)
    df = spark.createDataFrame(list(enumerate(texts)), FIELDS)
    assert {x.doc_id for x in near_copies.drop_near_copies(df).collect()} == brute(texts)


def test_clashing_columns_and_empty_tables(spark):
    names = ["_row", "words", "root", "keys", "text_hash", "least", "a.b"]
    df = spark.createDataFrame([(1, "one text of some words", *names), (1, "one text of some words", *names), (2, "One  text of some WORDS", *names), (None, None, *names)], FIELDS + ", " + ", ".join(f"`{n}` string" for n in names))
    out = stages.simhash_stage(spark, df, SF)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "one text of some words", *names), (None, None, *names)]
    assert stages.simhash_stage(spark, df.limit(0), SF).collect() == []
