"""SimHash fingerprints and all links between them within two bits.

Distinct fingerprints are dealt by exact agreement on one third of their bits:
two that differ in at most two bits agree on at least one third. A group that
is still large is dealt again by thirds of its remaining bits, as often as
needed; after four deals at most 2**13 distinct fingerprints can share a group,
so groups are bounded without dropping a link. Inside a group a hierarchical
index in Gray order finds the links: neighbours in that order share most bits,
an upper node holds the bits all its members share, and differences from a
query in shared bits rule out whole nodes at once. A group reports a spanning
forest of its links, never all pairs, and components follow by alternating
star contraction of a table in the shared folder.
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

BITS = 64
#: Words of a shingle.
SHINGLE = 3
#: Most differing bits of a link.
DISTANCE = 2
#: Fingerprints of a group beyond which it is dealt again.
GROUP = 512
#: Members of a node of the index.
FANOUT = 16
DEALS = 4


def shingle_hashes(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hash of each shingle in order; a shorter text is one shingle, a text without words has none."""
    words = data.lower().split()  # bytes: A-Z alone change, ASCII white space alone separates
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(lengths)])
    ends = (starts[shingle:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends, strict=False)], np.uint64, len(ends))


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text: bit i is set if it is in over half of its shingles' hashes."""
    return majority(shingle_hashes(data, shingle))


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[k : k + (1 << 14)]).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = np.array([fingerprint(t) for t in as_bytes(block.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), pa.array(found)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(make, "doc_id long, fp long")


def thirds(mask: int) -> list[int]:
    """The bits outside mask in three parts, each joined with mask."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(1 << i for i in part.tolist()) for part in np.array_split(free, DISTANCE + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in the sequence of Gray codes."""
    out = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class GrayIndex:
    """Nodes over fingerprints in Gray order; each level has the shared bits of FANOUT nodes below."""

    def __init__(self, values: np.ndarray):
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        ones, zeros = self.values, ~self.values
        while len(ones) > FANOUT:
            starts = np.arange(0, len(ones), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
            self.levels.append((ones, ones | zeros))

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (a, b), a < b, of all linked members, a node of queries at a time."""
        n = len(self.values)
        for start in range(0, n, FANOUT * FANOUT):
            queries = np.arange(start, min(n, start + FANOUT * FANOUT))
            top = len(self.levels[-1][0]) if self.levels else n
            q, node = (x.ravel() for x in np.meshgrid(queries, np.arange(top), indexing="ij"))
            for depth in range(len(self.levels) - 1, -1, -1):
                ones, shared = self.levels[depth]
                keep = np.bitwise_count((self.values[q] ^ ones[node]) & shared[node]) <= DISTANCE
                q, node = q[keep], node[keep]
                below = len(self.levels[depth - 1][0]) if depth else n
                child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q = np.repeat(q, FANOUT)
                real = child < below
                q, node = q[real], child[real]
            keep = q < node
            q, node = q[keep], node[keep]
            near = _apart(self.values[q], self.values[node]) <= DISTANCE
            yield q[near], node[near]


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between distinct fingerprints of a group."""
    index = GrayIndex(values)
    parent = list(range(len(values)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for left, right in index.links():
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[rb] = ra
                out.append((a, b))
    ordered = index.values.view(np.int64)
    return [(int(ordered[a]), int(ordered[b])) for a, b in out]


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of each group; rows come sorted by group, and a group may go on in the next batch."""
    held: list[pd.DataFrame] = []

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        mask, part, fp = (rows[c].to_numpy() for c in ("mask", "part", "fp"))
        borders = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
        found = [e for group in np.split(fp, borders) for e in forest(np.unique(group).view(np.uint64))]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    for batch in batches:
        if not len(batch):
            continue
        last = batch.iloc[-1]
        open_group = (batch["mask"] == last["mask"]) & (batch["part"] == last["part"])
        if held and not open_group.all():
            first = held[-1].iloc[-1]
            same = (batch["mask"] == first["mask"]) & (batch["part"] == first["part"])
            held.append(batch[same])
            yield links(pd.concat(held))
            held = []
            batch, open_group = batch[~same], open_group[~same]
        elif held:
            first = held[-1].iloc[-1]
            if (first["mask"], first["part"]) != (last["mask"], last["part"]):
                yield links(pd.concat(held))
                held = []
        if not open_group.all():
            yield links(batch[~open_group])
        held.append(batch[open_group])
    if held:
        yield links(pd.concat(held))


def links(distinct: DataFrame, group: int = GROUP) -> DataFrame:
    """a, b: spanning links between distinct fingerprints within two bits."""
    rows = distinct.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in thirds(0)])).alias("mask"))
    masks, out = thirds(0), None
    for deal in range(DEALS):
        rows = rows.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        last = deal == DEALS - 1
        sizes = staged(sizes, "simhash-groups")
        # Sizes grow with the fingerprints, so they are never sent to all executors.
        small = rows.join((sizes if last else sizes.filter(F.col("size") <= group)).hint("merge"), ["mask", "part"], "left_semi")
        found = small.repartition("mask", "part").sortWithinPartitions("mask", "part").mapInPandas(_search, "a long, b long")
        out = found if out is None else out.unionByName(found)
        if last or sizes.filter(F.col("size") > group).isEmpty():
            break
        finer = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(t)) for t in thirds(m)]))])
        hot = rows.join(sizes.filter(F.col("size") > group).hint("merge"), ["mask", "part"], "left_semi")
        rows = hot.select("fp", F.explode(finer[F.col("mask")]).alias("mask")).distinct()
        masks = sorted({t for m in masks for t in thirds(m)})  # different ways can lead to one mask
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component, by alternating star contraction."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = staged(edges.filter("a <> b").distinct(), "simhash-links")
    while True:
        # Large star: each node's larger neighbours join its smallest; small star: the others do.
        nodes = both(edges)
        least = nodes.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = nodes.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.filter("a <> b").distinct(), "simhash-links")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least.hint("merge"), "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        new = staged(small.filter("a <> b").distinct(), "simhash-links")
        # The contraction is done when every node has one link, to a node without smaller ones.
        tails = new.select(F.col("a").alias("tail")).distinct()
        if new.groupBy("a").count().filter("count > 1").isEmpty() and new.join(tails, F.col("b") == F.col("tail"), "left_semi").isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = new


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and are linked like any other.
    Repeated rows are kept. A null doc_id gets a result too, and is never the
    smallest unless its component has no other. Other columns are not read. An
    empty table gives no rows.
    """
    prints = staged(fingerprints(docs), "simhash-prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots.hint("merge"), distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = staged(rooted, "simhash-roots")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(smallest.hint("merge"), "root").select("fp", "component_id")
    return prints.join(labels.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
