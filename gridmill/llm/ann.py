"""Nearest vectors by largest inner product: inverted file with product-quantised residuals.

Coarse centroids, as many as twice the root of the number of vectors, and the
sub-space code books are fitted on a bounded sample (the vectors with the
lowest hash of their id); every vector is indexed: its cell is the nearest
centroid, its code the nearest code-book entries of its residual, and the length
of what the code leaves out is kept beside it. A query probes the cells whose
centroids have the largest inner product with it, ranks their vectors by
asymmetric distance tables, and reranks by the exact inner product of the
original vectors in double precision: the best by table, and all that can still
be nearer by what their codes leave out. How many cells are probed, and how far
exact products lie from the tables, is read off the whole table: TRIED of the
queries are compared with every vector. Neighbouring cells share a group, large
cells are split over several, and so are the queries, so a task holds a bounded
number of both and a query goes once to a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: Cells at most; vectors of the sample at least, and for each cell; sub-spaces' size; entries of a code book; passes of k-means.
CELLS, SAMPLE, CELL_SAMPLE, SUB, CODES, PASSES = 4096, 20_000, 32, 4, 64, 8
#: As many cells are probed as hold this share of the nearest vectors of so many queries, and in as large a share of them nine in ten.
HELD, TRIED, NEAREST, LEAST_PROBED = 0.98, 256, 20, 8
#: Best by table that are reranked first, in each group; share of nearest vectors whose exact product the slack of the tables reaches.
RERANKED, REACHED = 100, 0.995
#: Vectors of a group and queries that meet in one task.
GROUP_ROWS, QUERY_ROWS = 4096, 16_384
SEED = 11
#: What rounding may change in a product, in parts of both vectors' lengths, with room to spare; least slack.
ROUNDING, LEAST_SLACK = 1e-9, 0.01


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centers**2).sum(axis=1) / 2
    for k in range(0, len(x), 4096):
        out[k : k + 4096] = (x[k : k + 4096] @ centers.T - half).argmax(axis=1)
    return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centers of at most k clusters of distinct points; an empty cluster keeps its center."""
    points = np.unique(x, axis=0)
    if len(points) <= k:
        return points
    centers = points[np.sort(rng.choice(len(points), k, replace=False))].copy()
    for _ in range(PASSES):
        own = _nearest(x, centers)
        sizes = np.bincount(own, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        centers[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centers


@dataclass
class Index:
    centers: np.ndarray
    books: list[np.ndarray]
    dim: int
    probes: int = LEAST_PROBED
    slack: float = 1.0

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, -self.dim % SUB)))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code of each vector."""
        cell = _nearest(x, self.centers)
        rest = self.pad(x - self.centers[cell])
        codes = [_nearest(rest[:, j * SUB : (j + 1) * SUB], book) for j, book in enumerate(self.books)]
        return cell, np.stack(codes, axis=1).astype(np.uint8)

    def decode(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that cells and codes stand for."""
        parts = [book[codes[:, j]] for j, book in enumerate(self.books)]
        return self.centers[cells] + np.concatenate(parts, axis=1)[:, : self.dim]

    def probe(self, queries: np.ndarray) -> np.ndarray:
        return np.argsort(-(queries @ self.centers.T), axis=1, kind="stable")[:, : self.probes]

    def calibrate(self, tried: np.ndarray, near: list[np.ndarray]) -> None:
        """Probe as many cells as hold the share HELD of the nearest vectors, given by their cells for each query."""
        self.probes = len(self.centers)
        order = self.probe(tried)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
        own = [np.sort(p[cells]) for p, cells in zip(place, near, strict=True) if len(cells)]
        if own:
            most = [o[-(-9 * len(o) // 10) - 1] for o in own]
            needed = max(np.quantile(x, HELD, method="higher") for x in (np.concatenate(own), most))
            self.probes = min(max(LEAST_PROBED, int(needed) + 1), len(self.centers))

    def errors(self, x: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The length of what cell and code leave out of each vector: a product lies that far from the tables at most, for a query of length one."""
        return np.linalg.norm(x - self.decode(cells, codes), axis=1) + ROUNDING * np.linalg.norm(x, axis=1)

    def above(self, queries: np.ndarray, x: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far products lie above the tables, query by vector, in parts of the most they can."""
        gain = (queries * (x - self.decode(cells, codes))).sum(axis=1)
        return gain / (np.linalg.norm(queries, axis=1) * self.errors(x, cells, codes))

    def loosen(self, above: np.ndarray) -> None:
        """Rerank as far from the tables as the share REACHED of the nearest vectors lies."""
        self.slack = float(np.clip(np.quantile(above, REACHED, method="higher"), LEAST_SLACK, 1)) if len(above) else 1.0

    def by_table(self, queries: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products, queries x vectors; -inf where the query does not probe the vector's cell."""
        parts, own = self.pad(queries), queries @ self.centers.T
        probed = np.full_like(own, -np.inf)
        np.put_along_axis(probed, at := self.probe(queries), np.take_along_axis(own, at, axis=1), axis=1)
        out = np.take(probed, cells, axis=1)
        for j, book in enumerate(self.books):
            out += np.take(parts[:, j * SUB : (j + 1) * SUB] @ book.T, codes[:, j], axis=1)
        return out


def nearest_in(queries: np.ndarray, asking: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query's place, vector's place and exact product of each query's k best of all vectors but its own, ties to the smaller id."""
    rough = queries @ x.T
    rough[asking[:, None] == ids[None]] = -np.inf
    n = min(k, len(ids))
    least = np.partition(rough, len(ids) - n, axis=1)[:, len(ids) - n] - ROUNDING * np.linalg.norm(queries, axis=1) * np.linalg.norm(x, axis=1).max()
    found = []
    for i, low in enumerate(least):
        places = np.flatnonzero(np.isfinite(rough[i]) & (rough[i] >= low))
        exact = products(x[places], queries[i])
        top = np.lexsort((ids[places], -exact))[:k]
        found.append((np.full(len(top), i), places[top], exact[top]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def products(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products; equal vectors have equal ones, whatever lies beside them."""
    return np.einsum("ij,j->i", x, query)  # row by row: a matrix product's last digits depend on a row's place


def cells_of(total: int) -> int:
    return int(np.clip(round(2 * total**0.5), 1, CELLS))


def grouped(counts: dict[int, int]) -> list[tuple[int, int, int]]:
    """(cell, first group, groups) of each cell: small cells share one group, a large one is dealt to several."""
    out, group, held = [], 0, 0
    for cell, n in sorted(counts.items()):
        if held and held + n > GROUP_ROWS:
            group, held = group + 1, 0
        parts = -(-n // GROUP_ROWS)
        out.append((cell, group, parts))
        group, held = (group + parts, 0) if parts > 1 else (group, held + n)
    return out


def fit(x: np.ndarray, total: int) -> Index:
    rng = np.random.default_rng(SEED)
    dim = x.shape[1]
    centers = kmeans(x, cells_of(total), rng)
    index = Index(centers, [], dim)
    rest = index.pad(x - centers[_nearest(x, centers)])
    index.books = [kmeans(rest[:, j : j + SUB], CODES, rng) for j in range(0, rest.shape[1], SUB)]
    tried = np.arange(min(TRIED, len(x)))
    query, near, _ = nearest_in(x[tried], tried, np.arange(len(x)), x, NEAREST)
    cells, codes = index.encode(x[near])
    index.calibrate(x[tried], [cells[query == i] for i in tried])
    index.loosen(index.above(x[query], x[near], cells, codes))
    return index


def ranked(index: Index, queries: np.ndarray, asking: np.ndarray, ids: np.ndarray, cells: np.ndarray, codes: np.ndarray, errors: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query's place, vector's place and exact product of the k best of each query among the probed vectors of a group."""
    rough = index.by_table(queries, cells, codes)
    rough[asking[:, None] == ids[None]] = -np.inf
    reach = rough + index.slack * np.linalg.norm(queries, axis=1)[:, None] * errors
    n = min(max(RERANKED, k), len(ids))
    first = np.argpartition(-rough, n - 1, axis=1)[:, :n]
    found = []
    for i, places in enumerate(first):
        places = places[np.isfinite(rough[i, places])]
        if len(places) > k:  # the k-th best so far is a bound for the rest
            low = np.partition(products(x[places], queries[i]), len(places) - k)[len(places) - k]
            asked = reach[i] >= low
            asked[places] = True
            places = np.flatnonzero(asked)
        exact = products(x[places], queries[i])
        top = np.lexsort((ids[places], -exact))[:k]
        found.append((np.full(len(top), i), places[top], exact[top]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


RESULT = "query_id long, vec_id long, score double"


def search(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`. Vectors that are
    null, zero, or hold a null or non-finite component take no part, nor do
    null ids and vectors whose size is not the most common one. Rows that share
    a query's id are its own; where they differ, the least of them asks. Extra
    columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"  # as given, so nothing is lost
    sound = usable(vectors)
    sizes = sound.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = sizes[0]["d"], sizes[0]["count"]
    sound = sound.filter(F.size("embedding") == dim)
    most = max(SAMPLE, CELL_SAMPLE * cells_of(total))  # bounded by CELLS
    sample = sound.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toPandas()
    index = fit(np.array(sample["embedding"].tolist(), np.float64), total)
    fitted = spark.sparkContext.broadcast(index)  # bounded by CELLS and CODES

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def raw(x: np.ndarray) -> pa.Array:
        return pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("embedding"))
            if len(x):
                cell, codes = fitted.value.encode(x)
                error = pa.array(fitted.value.errors(x, cell, codes))
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("vec_id").cast(pa.int64()), pa.array([r.tobytes() for r in codes], pa.binary()), error, raw(x)], names=["cell", "vec_id", "code", "error", "vector"])

    indexed = staged(sound.mapInArrow(encode, "cell long, vec_id long, code binary, error double, vector binary"), "ann-index")
    asked = sound.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    some = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIED).toPandas()
    if some.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tried, trying = np.array(some["embedding"].tolist(), np.float64), some["vec_id"].to_numpy(np.int64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            ids, cells = (batch.column(c).to_numpy() for c in ("vec_id", "cell"))
            x, codes = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(len(ids), -1) for c, t in (("vector", kind), ("code", np.uint8)))
            if len(ids):
                query, near, score = nearest_in(tried, trying, ids, x.astype(np.float64), k)
                above = fitted.value.above(tried[query], x[near].astype(np.float64), cells[near], codes[near])
                new = pd.DataFrame({"query": query, "near": ids[near], "score": score, "cell": cells[near], "above": above})
                both = new if held is None else pd.concat([held, new])
                held = both.sort_values(["query", "score", "near"], ascending=[True, False, True], kind="stable").groupby("query").head(k)
        if held is not None:
            yield pa.RecordBatch.from_pandas(held, preserve_index=False)

    best = Window.partitionBy("query").orderBy(F.desc("score"), "near")
    near = indexed.mapInArrow(compare, "query long, near long, score double, cell long, above double").withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k).toPandas()  # TRIED times k rows
    index.calibrate(tried, [near["cell"].to_numpy(np.int64)[near["query"] == i] for i in range(len(tried))])
    index.loosen(near["above"].to_numpy(np.float64))
    shared = spark.sparkContext.broadcast(index)
    counts = {r["cell"]: r["count"] for r in indexed.groupBy("cell").count().collect()}  # CELLS rows at most
    homes = grouped(counts)
    groups_of = {cell: range(first, first + parts) for cell, first, parts in homes}

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = np.asarray(batch.column("vec_id").to_pylist(), np.int64), matrix(batch.column("embedding"))
            for at in range(0, len(ids), 256):
                cells = shared.value.probe(x[at : at + 256])
                homes = [sorted({g for c in row for g in groups_of.get(c, ())}) for row in cells.tolist()]
                place = np.repeat(np.arange(at, at + len(homes)), list(map(len, homes)))
                yield pa.RecordBatch.from_arrays([pa.array([g for h in homes for g in h], pa.int64()), pa.array(ids[place]), raw(x[place])], names=["home", "query_id", "query"])

    queries = asked.mapInArrow(probe, "home long, query_id long, query binary")
    parts = max(1, -(-asked.count() // QUERY_ROWS))
    placed = F.broadcast(spark.createDataFrame(homes, "cell long, first long, parts long"))  # CELLS rows at most
    v_rows = indexed.join(placed, "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts")).alias("home"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("lot"), "cell", "vec_id", "code", "error", "vector"
    )
    q_rows = queries.select(F.col("home").alias("q_home"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("q_lot"), "query_id", "query")

    def meet(here: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(here) and len(asked):
            here = here.sort_values("vec_id", kind="stable")
            ids, cells = here["vec_id"].to_numpy(), here["cell"].to_numpy()
            codes = np.frombuffer(b"".join(here["code"]), np.uint8).reshape(len(ids), -1)
            x = np.frombuffer(b"".join(here["vector"]), kind).reshape(len(ids), -1).astype(np.float64)
            asking = asked["query_id"].to_numpy()
            q = np.frombuffer(b"".join(asked["query"]), kind).reshape(len(asking), -1)
            for at in range(0, len(q), 128):
                query, places, score = ranked(shared.value, q[at : at + 128].astype(np.float64), asking[at : at + 128], ids, cells, codes, here["error"].to_numpy(), x, k)
                out.append((asking[at + query], ids[places], score))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    found = v_rows.groupBy("home", "lot").cogroup(q_rows.groupBy("q_home", "q_lot")).applyInPandas(meet, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
