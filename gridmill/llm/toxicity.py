"""Convolutional text classifier in numpy.

A word is the sum of hashed embeddings of itself, its beginnings and its
endings, so inflected forms share parts. Filters of several widths run over the
word sequence; each filter's maximum over the whole text feeds a logistic
output. Training takes every labelled row outside the held-out fold, whole:
rows are dealt to lots by a hash, and rounds of 1, 2, 4, 8 ... lots each start
from the weights of the round before, learn their lots side by side and bring
back the mean of the changes. Scoring covers every document whole. Thresholds
by language are calibrated on all those rows too, each scored by weights that
have not met it yet; they are reported beside the score and never enter it.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks, crc_mod, staged

SLOT_BITS, DIM, WIDTHS, FILTERS = 16, 16, (1, 2, 3), 16
SLOTS = 1 << SLOT_BITS
#: Rows and bytes of text in a lot, about; a worker holds up to twice as many (or one row) at once.
LOT_ROWS, LOT_BYTES = 4096, 16_000_000
#: Most tasks of a round; a task learns its lots one by one, each from the round's first weights.
TASKS = 256
#: Rows seen in the first lot, over all passes: few rows are passed over more often, within bounds.
SEEN_ROWS, PASSES = 36_000, (8, 24)
#: Passes over every later lot, which starts from weights that have learnt.
LATER = 2
THRESHOLD = 0.3
#: Slope of a filter's response below zero; keeps filters learning.
LEAK = 0.1
#: Scores are told apart by steps of 1 / STEPS where thresholds are chosen.
STEPS = 4096
SEED = 17
# ASCII punctuation, which separates words here.
_MARKS = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
_NON_ASCII = re.compile(rb"[\x80-\xff]")


def words_of(data: bytes) -> list[bytes]:
    data = data.translate(_MARKS)
    return (data.decode().lower().encode() if _NON_ASCII.search(data) else data.lower()).split()


#: Beginnings and endings of a word, in bytes, that have embeddings of their own.
HEADS, TAILS = (3, 4, 5, 6), (4,)
PARTS = 1 + len(HEADS) + len(TAILS)


def parts_of(words: list[bytes]) -> np.ndarray:
    """Slots of each word's parts, a row for each word; slot 0 is no part."""
    if not words:
        return np.zeros((0, PARTS), np.int32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.array(words, "S8").view("<u8")
    keys = [np.fromiter(map(zlib.crc32, words), np.uint64, len(words))]
    keys += [np.where(size > k, first & np.uint64((1 << 8 * k) - 1), 0) for k in HEADS]
    keys += [np.where(size > k, np.array([w[-k:] for w in words], "S8").view("<u8"), 0) for k in TAILS]
    out = np.empty((len(words), PARTS), np.int32)
    for i, key in enumerate(keys):
        mixed = (key + np.uint64(i)) * np.uint64(0x9E3779B97F4A7C15)
        out[:, i] = np.where(key > 0, np.maximum(mixed >> np.uint64(64 - SLOT_BITS), 1), 0)
    return out


def index_words(texts: Iterable[list[bytes]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Parts of each distinct word, and each text as places of its words."""
    seen: defaultdict[bytes, int] = defaultdict()
    seen.default_factory = seen.__len__
    coded = [np.fromiter(map(seen.__getitem__, words), np.int32, len(words)) for words in texts]
    return parts_of(list(seen)), coded


def active(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, LEAK * x)


@dataclass
class Classifier:
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    by_lang: dict[str, float] = field(default_factory=dict)

    def rows(self, parts: np.ndarray) -> np.ndarray:
        """What each word adds to each filter at each place under it, one block of FILTERS for each."""
        vectors = self.embed[parts[:, 0]]
        for k in range(1, parts.shape[1]):
            vectors = vectors + self.embed[parts[:, k]]
        return vectors @ np.concatenate([w.reshape(-1, DIM) for w in self.filters]).T

    def pool(self, added: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of every filter over a text, and where its window starts."""
        top, place, at = [], [], 0
        pad = max(WIDTHS) - 1
        added = np.concatenate([added, np.zeros((pad, added.shape[1]), added.dtype)])
        n = len(added) - pad
        for width in WIDTHS:
            sums = added[:n, at : at + FILTERS]
            for j in range(1, width):
                sums = sums + added[j : n + j, at + j * FILTERS : at + (j + 1) * FILTERS]
            if n:
                where = sums.argmax(axis=0)
                top.append(sums[where, np.arange(FILTERS)])
            else:
                where = np.zeros(FILTERS, np.int64)
                top.append(np.zeros(FILTERS, added.dtype))
            place.append(where)
            at += width * FILTERS
        return np.concatenate(top), np.concatenate(place)

    def peaks(self, added: np.ndarray) -> np.ndarray:
        """Largest response of every filter over a text; windows end with zeros, as in pool()."""
        pad, at, top = max(WIDTHS) - 1, 0, []
        n = len(added)
        if not n:
            return np.zeros(FILTERS * len(WIDTHS), np.float32)
        added = np.concatenate([added, np.zeros((pad, added.shape[1]), added.dtype)])
        for width in WIDTHS:
            sums = added[:n, at : at + FILTERS]
            for j in range(1, width):
                sums = sums + added[j : n + j, at + j * FILTERS : at + (j + 1) * FILTERS]
            top.append(sums.max(axis=0))
            at += width * FILTERS
        return np.concatenate(top)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return self.coded_scores(*index_words(words_of(t) for t in texts))

    def coded_scores(self, parts: np.ndarray, coded: list[np.ndarray]) -> np.ndarray:
        table = self.rows(parts) if len(parts) else np.zeros((0, sum(WIDTHS) * FILTERS), np.float32)
        pooled = np.array([self.peaks(table[c]) for c in coded], np.float32).reshape(len(coded), -1)
        hidden = active(pooled + self.bias)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.shift, -30, 30).astype(np.float64)))


def _new(rng: np.random.Generator, base: float) -> Classifier:
    # Small, so that words that training never met hardly respond, however long a text is.
    embed = rng.normal(0, 0.02, (SLOTS, DIM)).astype(np.float32)
    embed[0] = 0
    filters = [rng.normal(0, 0.5 / width, (width, FILTERS, DIM)).astype(np.float32) for width in WIDTHS]
    n = FILTERS * len(WIDTHS)
    return Classifier(embed, filters, np.zeros(n, np.float32), rng.normal(0, 0.3, n).astype(np.float32), base)


#: Rows of a learner's state: a row for each slot, then the other weights and what they have spent, DIM in a row.
DENSE = -(-(DIM * FILTERS * sum(WIDTHS) + 2 * FILTERS * len(WIDTHS) + 1) // DIM)
STATE = SLOTS + 2 * DENSE


@dataclass
class Learner:
    """A classifier with the sums of squares by which its steps shrink (Adagrad), and how often each slot moved."""

    model: Classifier
    spent: list[np.ndarray]
    spent_embed: np.ndarray
    spent_shift: float = 1e-3
    moved: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS, np.int64))

    @classmethod
    def new(cls, share: float) -> Learner:
        share = min(max(share, 0.01), 0.99)
        model = _new(np.random.default_rng(SEED), float(np.log(share / (1 - share))))
        return cls(model, [np.full_like(w, 1e-3) for w in (*model.filters, model.bias, model.out)], np.full(SLOTS, 1e-3, np.float32))

    @classmethod
    def of(cls, state: np.ndarray) -> Learner:
        learner = cls.new(0.5)
        model = learner.model
        model.embed[:] = state[:SLOTS, :DIM]
        learner.spent_embed[:] = state[:SLOTS, DIM]
        for rows, into in ((state[SLOTS:-DENSE], (*model.filters, model.bias, model.out)), (state[-DENSE:], learner.spent)):
            flat, at = rows[:, :DIM].reshape(-1), 0
            for w in into:
                w[...] = flat[at : at + w.size].reshape(w.shape)
                at += w.size
        model.shift, learner.spent_shift = (float(rows[:, :DIM].reshape(-1)[at]) for rows in (state[SLOTS:-DENSE], state[-DENSE:]))
        return learner

    def state(self) -> np.ndarray:
        out, model = np.zeros((STATE, DIM + 1)), self.model
        out[:SLOTS, :DIM], out[:SLOTS, DIM] = model.embed, self.spent_embed
        for start, weights, last in ((SLOTS, (*model.filters, model.bias, model.out), model.shift), (SLOTS + DENSE, self.spent, self.spent_shift)):
            flat = np.concatenate([*(w.reshape(-1) for w in weights), [last]])
            out[start : start + DENSE, :DIM] = np.pad(flat, (0, DENSE * DIM - len(flat))).reshape(DENSE, DIM)
        return out

    def run(self, parts: np.ndarray, coded: list[np.ndarray], labels: np.ndarray, passes: int, rng: np.random.Generator, done: float = 0.0, share: float = 1.0) -> None:
        """Pass over texts by mini-batches; done and share: what of all training lies behind and in these passes."""
        model = self.model
        dense, starts = [*model.filters, model.bias, model.out], np.cumsum([0, *WIDTHS])
        for epoch in range(passes):
            rate = 0.1 / (1 + 4 * (done + share * epoch / passes))
            for batch in np.array_split(rng.permutation(len(coded)), max(1, len(coded) // 32)):
                used, place = np.unique(np.concatenate([coded[d] for d in batch]), return_inverse=True)
                if not len(used):
                    continue
                part, table, at = parts[used], model.rows(parts[used]), 0
                step = [np.zeros_like(w) for w in dense]
                d_table = np.zeros_like(table)
                d_shift = 0.0
                for d in batch:
                    here = place[at : at + len(coded[d])]
                    at += len(here)
                    top, where = model.pool(table[here])
                    raw = top + model.bias
                    hidden = active(raw)
                    p = 1 / (1 + np.exp(-float(np.clip(hidden @ model.out + model.shift, -30, 30))))
                    error = np.float32((p - labels[d]) / len(batch))
                    back = np.where(raw > 0, error * model.out, LEAK * error * model.out).astype(np.float32)
                    step[-1] += error * hidden
                    step[-2] += back
                    d_shift += float(error)
                    if not len(here):
                        continue
                    for w, width in enumerate(WIDTHS):
                        own = slice(w * FILTERS, (w + 1) * FILTERS)
                        for j in range(width):
                            spot = where[own] + j
                            ok = spot < len(here)
                            np.add.at(d_table, (here[np.where(ok, spot, 0)], (starts[w] + j) * FILTERS + np.arange(FILTERS)), back[own] * ok)
                stacked = np.concatenate([w.reshape(-1, DIM) for w in model.filters])
                d_vectors = d_table @ stacked
                hit = np.flatnonzero(np.abs(d_table).max(axis=1) > 0)
                vectors = model.embed[part[hit]].sum(axis=1)
                d_stacked = d_table[hit].T @ vectors
                for w, width in enumerate(WIDTHS):
                    step[w] = d_stacked[starts[w] * FILTERS : starts[w + 1] * FILTERS].reshape(width, FILTERS, DIM)
                for weight, grad, old in zip(dense, step, self.spent, strict=True):
                    old += grad * grad
                    weight -= rate * grad / np.sqrt(old)
                self.spent_shift += d_shift * d_shift
                model.shift -= rate * d_shift / self.spent_shift**0.5
                slots, back_to = np.unique(part[hit], return_inverse=True)
                grad = np.zeros((len(slots), DIM), np.float32)
                np.add.at(grad, back_to.reshape(-1), np.repeat(d_vectors[hit], PARTS, axis=0))
                grad[slots == 0] = 0
                self.spent_embed[slots] += (grad * grad).mean(axis=1)
                model.embed[slots] -= rate * grad / np.sqrt(self.spent_embed[slots])[:, None]
                self.moved[slots[slots > 0]] += 1


def train(texts: list[bytes], labels: np.ndarray) -> Classifier:
    """Fit by mini-batches with per-weight step sizes (Adagrad); deterministic."""
    learner = Learner.new(labels.mean() if len(labels) else 0.0)
    if len(set(labels.tolist())) == 2:
        learner.run(*index_words(words_of(t) for t in texts), labels, passes_of(len(texts)), np.random.default_rng(SEED))
    return learner.model


def passes_of(rows: int) -> int:
    return min(PASSES[1], max(PASSES[0], SEEN_ROWS // max(1, rows)))


def lots_of(rows: int, size: int) -> int:
    """Lots for so many rows with so many bytes of text."""
    return max(1, -(-rows // LOT_ROWS), -(-size // LOT_BYTES))


def rounds_of(lots: int) -> list[tuple[int, int]]:
    """First lot and end of each round: 1, 2, 4, 8 ... lots, until none is left."""
    return [((1 << r) - 1, min((2 << r) - 1, lots)) for r in range(lots.bit_length())]


def study(state: np.ndarray, texts: list[bytes], labels: np.ndarray, seed: list[int], round_at: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Learn a lot from the state: scores of its rows by weights that have not met them, how much each row of the state counts, its change.

    Rows of the first round, which nothing has learnt before, are scored by halves: each by a learner of the other half.
    """
    parts, coded = index_words(words_of(t) for t in texts)
    where = (round_at / rounds, 1 / rounds)
    passes = LATER if round_at else passes_of(len(coded))
    learner = Learner.of(state)
    if round_at:
        scores = learner.model.coded_scores(parts, coded)
    else:
        scores = np.empty(len(coded))
        for half in (0, 1):
            other = Learner.of(state)
            other.run(parts, coded[1 - half :: 2], labels[1 - half :: 2], passes, np.random.default_rng(seed), *where)
            scores[half::2] = other.model.coded_scores(parts, coded[half::2])
    learner.run(parts, coded, labels, passes, np.random.default_rng(seed), *where)
    counts = np.concatenate([learner.moved, np.full(2 * DENSE, len(coded))]).astype(np.float64)
    return scores, counts, learner.state() - state


def best_threshold(scores: np.ndarray, labels: np.ndarray, rows: np.ndarray | None = None) -> float:
    """The threshold of highest F1; THRESHOLD where there is nothing to choose from. Many rows of one score: labels sums theirs, rows counts them."""
    if not labels.sum():
        return THRESHOLD
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(labels[order])
    f1 = 2 * right / (np.cumsum(np.ones(len(order)) if rows is None else rows[order]) + labels.sum())
    k = int(np.argmax(f1))
    low = scores[order[k + 1]] if k + 1 < len(order) else 0.0
    return float((scores[order[k]] + low) / 2)


def thresholds(tally: dict[str, np.ndarray]) -> dict[str, float]:
    """Thresholds by language; tally: rows and toxic rows of each step of the score."""
    out = {}
    for lang in sorted(tally):
        at = np.flatnonzero(tally[lang][0])
        out[lang] = best_threshold(at / STEPS, tally[lang][1][at], tally[lang][0][at])
    return out


def within(rows: list[tuple], most: int = LOT_BYTES) -> list[int]:
    """Keys of rows (key, bytes, label): in hash order, as many of each label as its share of `most` bytes holds, one at least. For a caller who trains on a part by choice: fit() takes all rows."""
    order = sorted(rows, key=lambda r: (zlib.crc32(b"%d" % r[0]), r[0]))
    total, spent, out = max(1, sum(r[1] for r in rows)), {0: 0, 1: 0}, []
    share = {c: most * sum(r[1] for r in rows if r[2] == c) / total for c in (0, 1)}
    for key, size, label in order:
        if total <= most or not spent[label] or spent[label] + size <= share[label]:
            out.append(key)
        spent[label] += max(1, size)
    return out


def counted(langs: list[str], scores: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Rows and toxic rows of each language by steps of the score."""
    steps, names = np.rint(scores * STEPS).astype(np.int64), np.array(langs, object)
    return {x: np.array([np.bincount(steps[names == x], w, STEPS + 1) for w in (np.ones((names == x).sum()), labels[names == x])]) for x in sorted(set(langs))}


def learn(rows: list[tuple], prior: float) -> Classifier:
    """As fit(), on rows (key, bytes, lang, label) at hand, all of them. prior: the share of label 1 among all labels."""
    labels = np.array([r[3] for r in rows], np.float64)
    share = labels.mean() if len(rows) else 0.0
    state, tally = Learner.new(share).state(), {}
    lots = lots_of(len(rows), sum(len(r[1]) for r in rows))
    dealt = defaultdict(list)
    for r in sorted(rows, key=lambda r: (_hash(r), r[0], r[1], r[2] or "")):
        dealt[_hash(r) % lots].append(r)
    for i, (first, end) in enumerate(rounds := rounds_of(lots) if len(set(labels.tolist())) == 2 else []):
        weights, change = np.zeros(STATE), np.zeros_like(state)
        for lot in range(first, end):
            known = np.array([r[3] for r in dealt[lot]], np.float32)
            scores, w, moved = study(state, [r[1] for r in dealt[lot]], known, [SEED, lot, 0], i, len(rounds))
            weights += w
            change += w[:, None] * moved
            for x, n in counted([r[2] or "" for r in dealt[lot]], scores, known).items():
                tally[x] = tally.get(x, 0) + n
        state += change / np.maximum(weights, 1)[:, None]
    model = Learner.of(state).model
    if len(set(labels.tolist())) == 2:
        # Where the rows hold another share of toxic ones than all labels do, odds go back to the labels' share.
        model.shift += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    model.by_lang = thresholds(tally)
    return model


def _hash(row: tuple) -> int:
    return zlib.crc32(b"%d %s" % row[:2])


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple]]]:
    """Lots of sorted rows, and which part of the lot; copies of one row, which no hash parts, are cut at twice a lot's bounds."""
    held, size, at, part = [], 0, None, 0
    for batch in batches:
        columns = [as_bytes(batch.column("text")), *(batch.column(x).to_pylist() for x in ("lang", "toxic", "lot"))]
        for text, lang, label, lot in zip(*columns, strict=True):
            if held and (lot != at or len(held) >= 2 * LOT_ROWS or size + len(text) > 2 * LOT_BYTES):
                yield at, part, held
                held, size, part = [], 0, part + 1 if lot == at else 0
            held.append((text, lang, label))
            size, at = size + len(text), lot
    if held:
        yield at, part, held


def one_round(rows: DataFrame, state: np.ndarray, lots: int, round_at: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The state after a round, and the tally of its rows' scores."""
    first, end = rounds_of(lots)[round_at]
    rounds, shared = lots.bit_length(), rows.sparkSession.sparkContext.broadcast(state)  # bounded: STATE x (DIM + 1)
    lot = F.col("h") % lots
    dealt = rows.withColumn("lot", lot).filter((F.col("lot") >= first) & (F.col("lot") < end))
    tasks = min(TASKS, end - first)
    dealt = dealt.repartitionById(tasks, ((F.col("lot") - first) % tasks).cast("int")).sortWithinPartitions("lot", "h", "doc_id", "text", "lang")

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot, part, held in _lots(batches):
            known = np.array([r[2] for r in held], np.float32)
            scores, w, moved = study(shared.value, [r[0] for r in held], known, [SEED, lot, part], round_at, rounds)
            used = np.flatnonzero(w)
            columns = [pa.nulls(len(used), pa.string()), pa.array(used, pa.int64()), pa.array(w[used]), *(pa.array(w[used] * moved[used, k]) for k in range(DIM + 1))]
            names = ["lang", "at", "w", *(f"g{k}" for k in range(DIM + 1))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            for lang, n in counted([r[1] for r in held], scores, known).items():
                at = np.flatnonzero(n[0])
                columns = [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[0][at]), pa.array(n[1][at]), *(pa.nulls(len(at), pa.float64()) for _ in range(DIM))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    told = dealt.select("text", "lang", "toxic", "lot").mapInArrow(learnt, "lang string, at long, w double, " + ", ".join(f"g{k} double" for k in range(DIM + 1)))
    summed = told.groupBy("lang", "at").agg(F.sum("w").alias("w"), *(F.sum(f"g{k}").alias(f"g{k}") for k in range(DIM + 1)))
    summed = summed.toPandas()  # STATE rows at most, and STEPS + 1 for each language
    weights, state = summed[summed["lang"].isna()], state.copy()
    state[weights["at"].to_numpy()] += weights[[f"g{k}" for k in range(DIM + 1)]].to_numpy() / weights["w"].to_numpy()[:, None]
    tally = {}
    for lang, part in summed[summed["lang"].notna()].groupby("lang"):
        tally[lang] = np.zeros((2, STEPS + 1))
        tally[lang][:, part["at"].to_numpy()] = part[["w", "g0"]].to_numpy().T
    shared.unpersist()
    return state, tally


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Train on every labelled row outside the held-out fold, whole, of any length.

    A document that any of its labels calls toxic is so; rows of documents that
    share a doc_id share its label, and each is learnt. The rows are joined and
    staged once; every round reads its lots from there.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 4) != 2)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = docs.filter(F.col("doc_id").isNotNull() & (crc_mod("doc_id", 4) != 2)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    found = own.join(known.hint("shuffle_hash"), "doc_id")  # the labels grow with the table
    key = F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.col("text")).cast("binary")
    rows = staged(found.select(F.crc32(key).alias("h"), "doc_id", F.octet_length("text").alias("size"), "text", "lang", "toxic"), "toxicity-rows")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("toxic").alias("bad")).first()
    n, bad = total["n"], total["bad"] or 0
    learner, tally = Learner.new(bad / max(1, n)), {}
    if 0 < bad < n:
        state, lots = learner.state(), lots_of(n, total["size"])
        for i in range(len(rounds_of(lots))):
            state, met = one_round(rows, state, lots, i)
            for lang, counts in met.items():
                tally[lang] = tally.get(lang, 0) + counts
        learner = Learner.of(state)
    learner.model.by_lang = thresholds(tally)
    return learner.model


def toxicity(docs: DataFrame, labels: DataFrame, model: Classifier | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, and the calibrated verdict: lang_threshold, flagged.

    Null and empty texts get the score of a text without words. Labels other
    than 0 and 1 and labels without a document are passed over; a document with
    several labels is toxic if one of them says so. Without both labels every
    score is the labels' share. Repeated rows give repeated results, a null
    doc_id stays null and is never learnt from, columns of other names are not
    read, and an empty table gives no rows.
    """
    model = model or fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: SLOTS x DIM weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for block in blocks(batches):
            scores = m.scores(as_bytes(block.column("text")))
            limits = np.array([m.by_lang.get(x or "", THRESHOLD) for x in block.column("lang").to_pylist()], np.float64)
            held = [zlib.crc32(b"" if k is None else b"%d" % k) % 4 == 2 for k in block.column("doc_id").to_pylist()]
            columns = {"held_out": held, "score": scores, "predicted": (scores >= THRESHOLD).astype(np.int32), "lang_threshold": limits, "flagged": scores >= limits}
            yield pa.RecordBatch.from_pydict({"doc_id": block.column("doc_id").cast(pa.int64())} | columns)

    return docs.select("doc_id", "text", "lang").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int, lang_threshold double, flagged boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns, whatever their names.

    Rows are judged one by one by their texts, so repeated rows stay or go
    together and null keys and texts are scored like any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield block.filter(pa.array(shared.value.scores(as_bytes(block.column("text"))) < THRESHOLD, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
