"""Hidden Markov language model.

A state emits a bucket of words (a hash of the word; the text's end has its
own), and a bucket emits its words by add-one counts, so the model is a proper
distribution over words while what a state holds stays bounded:
P(word | state) = P(bucket | state) * P(word | bucket). States start apart by
a seed; then every training document passes whole through Baum-Welch, PASSES
times, and each task's expected counts are added up across tasks and give the
next parameters. A text's probability is exact, by the scaled forward
recursion over its whole length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import chunk_rows, numbered, unsqueeze, word_rows
from .common import staged

STATES, BUCKETS = 8, 1 << 15
#: Baum-Welch passes over all training documents.
PASSES = 4
#: How likely a state follows itself at the start: documents keep to their states, which parts these in few passes.
STAY = 0.99
#: Weight of the overall bucket distribution in each state's.
SMOOTH = 3000.0
#: Bytes of text in a chunk, about; the forward pass needs memory beside it.
CHUNK_BYTES = 16_000_000
#: Tokens whose forward probabilities are held at once.
HELD_TOKENS = 200_000
FOLDS, HELD_FOLD = 7, 2
SEED = 5


def fold(key: int | None) -> int:
    return zlib.crc32(b"" if key is None else b"%d" % key) % FOLDS


def trains(key: int | None) -> bool:
    return fold(key) != HELD_FOLD


def words_of(data: bytes) -> list[bytes]:
    """Lower-cased words, then the end as the empty word."""
    words = data.lower().split()
    words.append(b"")
    return words


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word) % (BUCKETS - 1) + 1 if word else 0


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # BUCKETS x STATES


class Batch:
    """Documents of bucket numbers, laid out step by step, longest first."""

    def __init__(self, docs: list[np.ndarray]):
        lengths = np.array([len(d) for d in docs])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        joined = np.concatenate([docs[i] for i in self.order])
        first = np.cumsum(lengths) - lengths
        step = np.arange(len(joined)) - np.repeat(first, lengths)
        doc = np.repeat(np.arange(len(docs)), lengths)
        by_step = np.argsort(step, kind="stable")
        self.tokens, self.doc = joined[by_step], doc[by_step]
        self.active = np.bincount(step)
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        self.n_docs = len(docs)

    def forward(self, m: Model, keep: bool = True) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        """Forward probabilities, what each token emits, and each token's scale."""
        emitted = m.emit[self.tokens]
        alpha = np.empty_like(emitted) if keep else None
        scale = np.empty(len(self.tokens))
        offset, now = self.offset.tolist(), None
        for t in range(len(self.active)):
            a, b = offset[t], offset[t + 1]
            now = emitted[a:b] * (m.start if now is None else now[: b - a] @ m.move)
            s = now.sum(axis=1)
            now /= s[:, None]
            scale[a:b] = s
            if keep:
                alpha[a:b] = now
        return alpha, emitted, scale

    def log10(self, m: Model) -> np.ndarray:
        """log10 probability of each document, in the order given."""
        _, _, scale = self.forward(m, keep=False)
        out = np.empty(self.n_docs)
        out[self.order] = np.bincount(self.doc, np.log10(scale), self.n_docs)
        return out

    def expect(self, m: Model, total: np.ndarray) -> None:
        """Add expected counts to total: BUCKETS rows of emissions, STATES rows of moves, one row of starts."""
        alpha, emitted, scale = self.forward(m)
        beta, offset, back = np.ones_like(alpha), self.offset.tolist(), m.move.T.copy()
        emitted /= scale[:, None]
        for t in range(len(self.active) - 2, -1, -1):
            a, b, c = offset[t], offset[t + 1], offset[t + 2]
            beta[a : a + c - b] = (emitted[b:c] * beta[b:c]) @ back
        later = self.offset[1]
        prior = np.concatenate([[0], np.repeat(self.offset[:-2], self.active[1:])])[1:] + (np.arange(later, len(alpha)) - np.repeat(self.offset[1:-1], self.active[1:]))
        emitted *= beta
        total[BUCKETS : BUCKETS + STATES] += m.move * (alpha[prior].T @ emitted[later:])
        alpha *= beta
        total[-1] += alpha[:later].sum(axis=0)
        for k in range(STATES):
            total[:BUCKETS, k] += np.bincount(self.tokens, alpha[:, k], BUCKETS)


def batches_of(docs: list[np.ndarray]) -> Iterator[list[int]]:
    """Places of documents in lots of about HELD_TOKENS tokens; like lengths share a lot, so few steps have few documents."""
    lot, held = [], 0
    for i in np.argsort([-len(d) for d in docs], kind="stable").tolist():
        lot.append(i)
        held += len(docs[i])
        if held >= HELD_TOKENS:
            yield lot
            lot, held = [], 0
    if lot:
        yield lot


def maximise(total: np.ndarray, prior: np.ndarray) -> Model:
    """Parameters from expected counts; prior is the overall bucket distribution."""
    emit = total[:BUCKETS] + SMOOTH * prior[:, None]
    move = total[BUCKETS : BUCKETS + STATES] + 0.1
    start = total[-1] + 0.1
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def initial(docs: list[np.ndarray], prior: np.ndarray) -> Model:
    """States that start apart by a seed, and PASSES of Baum-Welch on documents at hand, if any."""
    rng = np.random.default_rng(SEED)
    emit = prior[:, None] * rng.gamma(2.0, 0.5, (BUCKETS, STATES))
    move = np.full((STATES, STATES), (1 - STAY) / (STATES - 1))
    np.fill_diagonal(move, STAY)
    model = Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))
    if not docs:
        return model
    batch = Batch(docs)
    for _ in range(PASSES):
        total = np.zeros((BUCKETS + STATES + 1, STATES))
        batch.expect(model, total)
        model = maximise(total, prior)
    return model


def _documents(row: dict, buckets: np.ndarray) -> list[np.ndarray]:
    return np.split(buckets[unsqueeze(row["places"])], np.cumsum(unsqueeze(row["lengths"]))[:-1])


def train(chunks: DataFrame, prior: np.ndarray) -> Model:
    """chunks: chunk, doc_ids, lengths, places, tags (buckets of the chunk's words in order)."""
    spark = chunks.sparkSession
    model = initial([], prior)
    for _ in range(PASSES):
        shared = spark.sparkContext.broadcast(model)  # bounded: BUCKETS x STATES

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros((BUCKETS + STATES + 1, STATES))
            for batch in batches:
                for row in batch.to_pylist():
                    docs = [d for k, d in zip(row["doc_ids"], _documents(row, unsqueeze(row["tags"])), strict=True) if trains(k)]
                    for lot in batches_of(docs):
                        Batch([docs[i] for i in lot]).expect(shared.value, total)
            used = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array(total[used, k]) for k in range(STATES))], names=["at", *(f"g{k}" for k in range(STATES))])

        counted = chunks.select("doc_ids", "lengths", "places", "tags").mapInArrow(count, "at long, " + ", ".join(f"g{k} double" for k in range(STATES)))
        summed = counted.groupBy("at").agg(*(F.sum(f"g{k}").alias(f"g{k}") for k in range(STATES))).toPandas()  # BUCKETS + STATES + 1 rows at most
        total = np.zeros((BUCKETS + STATES + 1, STATES))
        total[summed["at"].to_numpy()] = summed[[f"g{k}" for k in range(STATES)]].to_numpy()
        model = maximise(total, prior)
    return model


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame) -> DataFrame:
    """Base and model log10 probability of every document, held out or not.

    Null and empty texts are scored as the end alone. Repeated rows count and
    are scored as often as they occur; a null key trains as the empty key's
    fold says. Without training documents every word is unknown and all states
    are alike. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = staged(numbered(docs, words_of, trains, bucket_of, CHUNK_BYTES), "hmm-chunks")
    words, chunks = word_rows(rows), chunk_rows(rows)
    bucket = F.when(F.length("word") == 0, F.lit(0)).otherwise(F.crc32("word") % (BUCKETS - 1) + 1)
    counts = staged(words.filter("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "hmm-counts")
    per_bucket = counts.groupBy(bucket.alias("bucket")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toPandas()  # BUCKETS rows at most
    c, v = np.zeros(BUCKETS), np.zeros(BUCKETS)
    c[per_bucket["bucket"]], v[per_bucket["bucket"]] = per_bucket["c"], per_bucket["v"]
    tokens, distinct = int(c.sum()), int(v.sum())
    model = train(chunks, (c + v + 1) / (c + v + 1).sum())
    shared = spark.sparkContext.broadcast((model, c + v + 1))  # bounded by BUCKETS

    def score(key: tuple, chunk: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        m, mass = shared.value
        out = []
        for _, row in chunk.iterrows():
            buckets = unsqueeze(row["tags"])
            count = np.zeros(len(buckets))
            count[known["idx"].to_numpy()] = known["c"].to_numpy()
            base = np.log10(count + 1) - np.log10(tokens + distinct + 1)
            inside = np.log10(count + 1) - np.log10(mass[buckets])
            places, lengths = unsqueeze(row["places"]), unsqueeze(row["lengths"])
            starts = np.cumsum(lengths) - lengths
            total = lambda x: np.add.reduceat(x[places], starts)  # noqa: E731  every document has its end at least
            found = np.split(buckets[places], starts[1:])
            likely = np.empty(len(found))
            for lot in batches_of(found):
                likely[lot] = Batch([found[i] for i in lot]).log10(m)
            keys = row["doc_ids"]
            out.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.array([None if k is None or k != k else int(k) for k in keys], "Int64"),
                        "held_out": [not trains(None if k is None or k != k else int(k)) for k in keys],
                        "n_tokens": lengths.astype(np.int64),
                        "n_known": total((count > 0).astype(np.int64)),
                        "train_tokens": tokens,
                        "base_score": total(base),
                        "score": likely + total(inside),
                    }
                )
            )
        return pd.concat(out) if out else pd.DataFrame(columns=[x.split()[0] for x in SCORES.split(", ")])

    known = words.join(counts, "word").select(F.col("chunk").alias("of"), "idx", "c")
    return chunks.groupBy("chunk").cogroup(known.groupBy("of")).applyInPandas(score, SCORES)
