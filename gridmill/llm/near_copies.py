"""Near copies: texts whose sets of five-word shingles have Jaccard similarity 0.8 or more.

The SimHash operator's fingerprints and Gray-order index propose what lies
within two bits. At similarity 0.8 two fingerprints lie about ten bits apart,
too far for exact agreement on any useful part of them, so MinHash bands
propose the rest: a pair of similarity s shares one of BANDS bands with
probability 1 - (1 - s**ROWS)**BANDS, 0.99993 at 0.8 and more above. Every pair
proposed is decided by the exact similarity. Members of a band's bucket are
first held against its smallest; where a bucket still holds several components
after that, its members meet in blocks inside a task, which compares them by
their whole sets and gives back only links that join components. So no link
between proposed pairs is lost, and no group is spread into rows of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks, staged
from .simhash import components, majority, shingle_hashes
from .simhash import links as close_prints

#: Words of a shingle; least Jaccard similarity of near copies.
SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 5
#: Members of a bucket, and shingles of its members, that meet others in one task; shingles compared at once.
BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS = 512, 2_000_000, 4096
#: Shingles that are hashed anew at once.
PART = 1 << 12
SEED = 7

_TIMES, _PLUS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
_TIMES = _TIMES << np.uint64(1) | np.uint64(1)


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of a set's MinHash signature; none for the empty set."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), PART):
        np.minimum(low, (hashes[k : k + PART] * _TIMES + _PLUS).min(axis=1), out=low)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(low.reshape(BANDS, ROWS))]


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _key(data: bytes) -> int:
    return xxhash.xxh64_intdigest(b" ".join(data.lower().split()), 42)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_row, doc_id, words (hash of the word sequence), n (shingles), fp (SimHash), keys (of the bands)."""
    for block in blocks(batches):
        texts = as_bytes(block.column("text"))
        sets = [np.unique(shingle_hashes(t, SHINGLE)) for t in texts]
        keys = [_signed(bands(s)) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                block.column("_row"),
                block.column("doc_id").cast(pa.int64()),
                pa.array(_signed([_key(t) for t in texts])),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(_signed([majority(s) for s in sets])),
                pa.array(keys, pa.list_(pa.int64())),
            ],
            names=["_row", "doc_id", "words", "n", "fp", "keys"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """words, shingles (sorted distinct hashes)."""
    for block in blocks(batches):
        found = [np.unique(shingle_hashes(t, SHINGLE)).tobytes() for t in as_bytes(block.column("text"))]
        yield pa.RecordBatch.from_arrays([block.column("words"), pa.array(found, pa.binary())], names=["words", "shingles"])


def similar(x: bytes, y: bytes) -> bool:
    """Whether two sets of hashes have the least similarity or more."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 10 * both >= round(10 * SIMILAR) * (len(a) + len(b) - both)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in batches:
        x, y = block.column("x").to_pylist(), block.column("y").to_pylist()
        near = pa.array([similar(a, b) for a, b in zip(x, y, strict=True)], pa.bool_())
        yield block.select(["a", "b"]).filter(near)


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b that are near copies, by their whole sets of shingles."""
    x, y = sets.select(F.col("words").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("words").alias("b"), F.col("shingles").alias("y"))
    return staged(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_decide, "a long, b long"), "near-links")


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Places (i, j) of all pairs with the least similarity, by products of membership tables, COLUMNS shingles at a time."""
    both = np.zeros((len(left), len(right)), np.float32)
    sizes = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    _, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    own = np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
    order = np.argsort(column, kind="stable")
    borders = np.searchsorted(column[order], np.arange(0, int(column.max(initial=0)) + 1 + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(borders[:-1], borders[1:], strict=True)):
        at = order[a:b]
        tables = []
        for side, here in ((left, at < sizes[0].sum()), (right, at >= sizes[0].sum())):
            table = np.zeros((len(side), COLUMNS), np.float32)
            table[own[at[here]], column[at[here]] - k * COLUMNS] = 1
            tables.append(table)
        both += tables[0] @ tables[1].T
    times = round(10 * SIMILAR)
    return np.argwhere(10 * both >= times * (sizes[0][:, None] + sizes[1][None] - both))


def _inside(rows: pd.DataFrame) -> pd.DataFrame:
    """Links that join components, between two blocks of a bucket or within one."""
    p, q = rows["p"].iloc[0], rows["q"].iloc[0]
    left, right = rows[rows["own"] == p], rows[rows["own"] == q]
    sets = [[np.frombuffer(x, np.uint64) for x in side["shingles"]] for side in (left, right)]
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    out = []
    (a, a_root), (b, b_root) = ((side["words"].tolist(), side["root"].tolist()) for side in (left, right))
    for i, j in similar_pairs(*sets).tolist():
        x, y = root(a_root[i]), root(b_root[j])
        if x != y:
            up[x] = y
            out.append((a[i], b[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


#: A pair whose sets differ more in size than similar ones can.
_SIZES = f"least(n, other) >= {SIMILAR} * greatest(n, other)"


def _roots(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """node, root: components of the near copies among the distinct texts of rows."""
    texts = staged(rows.groupBy("words").agg(F.min("_row").alias("_row"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "near-texts")
    dealt = texts.select("words", "n", F.explode("keys").alias("key"))
    buckets = dealt.groupBy("key").agg(F.min(F.struct("words", "n")).alias("least"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).filter("size > 1")
    members = staged(dealt.join(buckets, "key"), "near-members")
    # Fingerprints within two bits: the smallest text of each, and every text with its fingerprint's smallest.
    prints = staged(texts.groupBy("fp").agg(F.min(F.struct("words", "n")).alias("least")), "near-prints")
    end = lambda x: prints.select(F.col("fp").alias(x), F.col("least").alias(f"least_{x}"))
    close = close_prints(prints.select("fp")).join(end("a"), "a").join(end("b"), "b")
    close = close.select(F.least("least_a.words", "least_b.words").alias("a"), F.greatest("least_a.words", "least_b.words").alias("b"), F.col("least_a.n").alias("n"), F.col("least_b.n").alias("other"))
    star = lambda df: df.filter("words <> least.words").select(F.col("least.words").alias("a"), F.col("words").alias("b"), "n", F.col("least.n").alias("other"))
    first = close.unionByName(star(texts.join(prints, "fp"))).unionByName(star(members))
    first = staged(first.filter(_SIZES).select("a", "b").distinct(), "near-pairs")

    wanted = members.select("words").union(first.select("a")).union(first.select("b")).distinct().join(texts.select("words", "_row"), "words")
    sets = keyed.select("_row", "row.text").join(wanted, "_row").dropDuplicates(["words"]).select("words", "text")
    sets = staged(sets.mapInArrow(_sets, "words long, shingles binary"), "near-sets")
    links = _links(first, sets)
    roots = components(links)

    placed = members.join(roots, members["words"] == roots["node"], "left").select("key", "words", "size", "total", F.coalesce("root", "words").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_SHINGLES))
    placed = placed.join(mixed, "key", "left_semi").withColumn("own", F.pmod(F.xxhash64("words"), blocks))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})
    meeting = placed.select("key", "p", "q", "own", "words", "root").join(sets, "words")
    more = staged(meeting.groupBy("key", "p", "q").applyInPandas(_inside, "a long, b long"), "near-links")
    return roots if more.isEmpty() else components(links.unionByName(more))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies: that of smallest doc_id, nulls last; of equal ones one by a hash of the row.

    Null and empty texts, and others without a word, are copies of each other.
    Rows are judged by their texts, also where a doc_id is repeated or null, so
    a text never goes because of another text's key; of rows that are equal in
    every column one stays. Columns of any name are passed on; an empty table
    gives no rows.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.xxhash64(*columns).alias("_row"), F.struct(*columns).alias("row"))
    rows = staged(keyed.select("_row", "row.doc_id", "row.text").mapInArrow(_sketch, "_row long, doc_id long, words long, n long, fp long, keys array<long>"), "near-sketches")
    roots = _roots(keyed, rows)
    rooted = rows.join(roots, rows["words"] == roots["node"], "left").select("_row", "doc_id", F.coalesce("root", "words").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("keyless"), "doc_id", "_row")
    kept = rooted.groupBy("root").agg(F.min(order).alias("least")).select(F.col("least._row").alias("_row"))
    return keyed.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
