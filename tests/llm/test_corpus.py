"""Language model, near duplicates, personal data, nearest vectors and the pipeline against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from gridmill.llm import ann, hmm, pii, simhash, stages
from gridmill.llm.queries import QUERIES, tokenizer_path

from .conftest import SF, TEXTS
from .test_near_copies import brute

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# --- language model ------------------------------------------------------------------------------


def base_scores(docs):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base of each row."""
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    tokens = [[*WORD.findall(lowered(t)), ""] for _, t in docs]
    counts = Counter(w for (k, _), ws in zip(docs, tokens, strict=True) if not held(k) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(k, held(k), len(ws), sum(w in counts for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for (k, _), ws in zip(docs, tokens, strict=True)]


def close(rows, want):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=str)
    want = sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])


def test_op1(spark):
    rows = QUERIES["op1_hmm_score"](spark, SF).collect()
    close(rows, base_scores(documents(spark)))
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op1_odd(odd, empty):
    rows = hmm.score_documents(odd).collect()
    close(rows, base_scores(TEXTS))
    assert hmm.score_documents(empty).collect() == []


def small_model(rng):
    emit = rng.dirichlet(np.ones(hmm.BUCKETS), hmm.STATES).T
    return hmm.Model(rng.dirichlet(np.ones(hmm.STATES)), rng.dirichlet(np.ones(hmm.STATES), hmm.STATES), emit)


def test_forward_is_exact():
    rng = np.random.default_rng(0)
    m = small_model(rng)
    docs = [rng.integers(0, hmm.BUCKETS, n) for n in (1, 3, 2, 3)]

    def brute(doc):
        at = m.start * m.emit[doc[0]]
        for w in doc[1:]:
            at = np.array([sum(at[i] * m.move[i, j] for i in range(hmm.STATES)) * m.emit[w, j] for j in range(hmm.STATES)])
        return math.log10(at.sum())

    assert np.allclose(hmm.Batch(docs).log10(m), [brute(d) for d in docs])


def test_training_never_lowers_likelihood():
    rng = np.random.default_rng(1)
    docs = [np.concatenate([rng.choice([5, 6, 7] if i % 2 else [100, 101], 12), [0]]) for i in range(40)]
    prior = np.bincount(np.concatenate(docs), minlength=hmm.BUCKETS) + 1e-3
    m, last = small_model(rng), -np.inf
    batch = hmm.Batch(docs)
    for _ in range(6):
        total = np.zeros((hmm.BUCKETS + hmm.STATES + 1, hmm.STATES))
        batch.expect(m, total)
        assert np.isclose(total[: hmm.BUCKETS].sum(), sum(map(len, docs))) and np.isclose(total[-1].sum(), len(docs))
        assert np.isclose(total[hmm.BUCKETS : -1].sum(), sum(len(d) - 1 for d in docs))
        now = batch.log10(m).sum()
        assert now >= last - 1e-9
        last = now
        t = total + 1e-12
        m = hmm.Model(t[-1] / t[-1].sum(), t[hmm.BUCKETS : -1] / t[hmm.BUCKETS : -1].sum(axis=1, keepdims=True), t[: hmm.BUCKETS] / t[: hmm.BUCKETS].sum(axis=0))
    assert hmm.initial([], prior / prior.sum()).emit.shape == (hmm.BUCKETS, hmm.STATES)


def test_training_takes_all_documents_whole(spark):
    rng = np.random.default_rng(2)
    topics = [[f"{t}{i}" for i in range(40)] for t in "abcd"]
    # Sources in order; long documents change their topic after 400 words.
    rows = [(k, " ".join([*rng.choice(topics[k // 25], 420), *rng.choice(topics[-1 - k // 25], 300)])) for k in range(100)]
    rows_df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(6, "doc_id")
    chunks = hmm.chunk_rows(hmm.staged(hmm.numbered(rows_df, hmm.words_of, hmm.trains, hmm.bucket_of, 30_000), "test-chunks"))
    docs = [np.array([hmm.bucket_of(w) for w in hmm.words_of(t.encode())]) for k, t in rows if hmm.trains(k)]
    prior = np.bincount(np.concatenate(docs), minlength=hmm.BUCKETS) + 1.0
    got, want = hmm.train(chunks, prior / prior.sum()), hmm.initial(docs, prior / prior.sum())
    assert chunks.count() > 4
    assert all(np.allclose(x, y, rtol=1e-6) for x, y in ((got.start, want.start), (got.move, want.move), (got.emit, want.emit)))


# --- near duplicates -----------------------------------------------------------------------------


def print_of(text):
    words = WORD.findall(lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Root (an index) of each fingerprint, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def expected(docs):
    prints = [print_of(t) for _, t in docs]
    roots = components(prints)
    least = {r: min((k for (k, _), x in zip(docs, roots, strict=True) if x == r and k is not None), default=None) for r in roots}
    return sorted(((k, f"{p:016x}", least[r]) for (k, _), p, r in zip(docs, prints, roots, strict=True)), key=str)


def test_op6(spark):
    assert sorted(map(tuple, QUERIES["op6_simhash"](spark, SF).collect()), key=str) == expected(documents(spark))


def test_op6_odd(odd, empty):
    assert sorted(map(tuple, simhash.near_duplicates(odd).collect()), key=str) == expected(TEXTS)
    assert simhash.near_duplicates(empty).collect() == []


def dense(rng, n):
    """Fingerprints in tight bunches, chains and far apart."""
    out = {rng.getrandbits(64) for _ in range(n)}
    for center in list(out)[:5]:
        for _ in range(n):
            center ^= reduce(lambda a, b: a | b, (1 << rng.randrange(64) for _ in range(rng.randint(1, 3))))
            out.add(center)
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
def test_index_finds_every_link(seed):
    rng = random.Random(seed)
    base = dense(rng, 60 if seed % 2 else 4)
    values = np.array(base, np.uint64)
    index = simhash.GrayIndex(values)
    got = {tuple(sorted((int(index.values[a]), int(index.values[b])))) for left, right in index.links() for a, b in zip(left, right, strict=True)}
    assert got == {(a, b) for i, a in enumerate(base) for b in base[i + 1 :] if (a ^ b).bit_count() <= 2}
    assert len(simhash.forest(values)) == len(base) - len(set(components(base)))


def test_hot_groups_are_dealt_again(spark):
    rng = random.Random(3)
    base = dense(rng, 40)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in base], "fp long")
    edges = simhash.links(df, group=4)
    pairs = [(r.a, r.b) for r in edges.collect()]
    place = {x - (1 << 64) if x >> 63 else x: i for i, x in enumerate(base)}
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 for a, b in pairs)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    roots = components(base)
    groups = {}
    for fp, i in place.items():
        groups.setdefault(roots[i], set()).add(got.get(fp, fp))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_gray_rank():
    codes = np.array([i ^ i >> 1 for i in range(1000)], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(1000))


# --- personal data -------------------------------------------------------------------------------

PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def base_spans(text):
    text, out = text or "", []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 0 or kind == 1 and all(int(x) <= 255 for x in m.group().split(".")) or kind == 2 and 12 <= len(digits) <= 19 and luhn(digits) or kind == 3 and 9 <= len(digits) <= 15:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def shown(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def check_pii(rows, texts):
    assert len(rows) == len(texts)
    for row, text in zip(rows, texts, strict=True):
        spans = base_spans(text)
        assert row.base_sha256 == hashlib.sha256(shown(spans).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(filter(None, shown(spans).split(","))) <= set(filter(None, row.spans.split(",")))


def test_op7(spark):
    docs = sorted(documents(spark))
    check_pii(QUERIES["op7_pii"](spark, SF).orderBy("doc_id").collect(), [t for _, t in docs])


PRIVATE = [
    None, "", "é a@b.c_d@e.f-g.h x@y z@w.", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 999999999999999999999.1.1.1 0.0.0.0", "4111 1111 1111 1111 and 4111-1111-1111-1111, 4111111111111112",
    "+1 (974) 555-3436 +49.30.12345678 +1 2 +123456789012345678", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "a" * 30000 + "@x.de " + "7" * 40000, "😀 +33 1 23 45 67 89 😀 me@x.fr", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188"', "5555555555554444" * 2, "0000000000000",
]


def test_op7_odd(spark):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(PRIVATE)], "doc_id long, text string, found int, kept string")
    rows = pii.find_pii(df).orderBy("doc_id").collect()
    check_pii(rows, PRIVATE)
    assert "secret:0:" in rows[9].spans
    assert pii.find_pii(df.limit(0)).collect() == []


def test_guarded_matches_lie_where_they_match(spark):
    key = "token = '04dbebab91ab85687d33'"
    texts = ["Fax +1-555-123-4567, tel 555-123-4567.", f"é😀 my{key}, {key} and {key}", "none", "555-123-4567"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.row.doc_id: [(s.start, s.end) for s in r.found if s.kind in (3, 4) and not s.base] for r in pii.spans_with_votes(df).collect()}
    secrets = [(m.start(), m.end()) for m in re.finditer("(?<!my)" + key, texts[1])]
    assert len(secrets) == 2 and found == {0: [(25, 37)], 1: secrets, 2: [], 3: [(0, 12)]}


def test_op7_runs_no_python(spark):
    plan = QUERIES["op7_pii"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_masking(spark):
    df = spark.createDataFrame([(1, "é mail a@b.de, 1.2.3.4!", "en", "s", 23), (2, None, "en", "s", None), (3, "clean", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [(r.text, r.n_chars) for r in pii.mask_pii(df).orderBy("doc_id").collect()] == [("é mail [EMAIL], [IP]!", 21), (None, None), ("clean", 5)]


def test_reliabilities():
    votes = [(1, 1, 1, 50), (-1, -1, -1, 50), (1, 1, 0, 20), (-1, -1, 1, 20), (1, -1, 0, 3)]
    rows = [{"kind": 2, "strict": a, "listed": b, "context": c, "n": n, "left": 0, "right": 0, "size": 4, "cue": 0, "shape": 0, "code": i} for i, (a, b, c, n) in enumerate(votes)]
    posterior, rates = pii.reliabilities(rows)
    assert posterior[2, 1, 1, 1] > 0.95 and posterior[2, -1, -1, -1] < 0.05
    assert rates[2, 0, 1][1] > rates[2, 2, 1][1]
    assert {0, 2} <= set(pii.decisions(rows)) and 1 not in pii.decisions(rows)


# --- nearest vectors -----------------------------------------------------------------------------


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_op10(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = QUERIES["op10_ann"](spark, folder).orderBy("query_id", "rank").collect()
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        scores[q] = -np.inf
        want = ids[np.lexsort((ids, -scores))[:20]]
        mine = [r for r in got if r.query_id == ids[q]]
        assert [r.rank for r in mine] == list(range(1, 21)) and all(math.isclose(r.score, scores[np.flatnonzero(ids == r.vec_id)[0]]) for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits += len({r.vec_id for r in mine} & set(want.tolist()))
    assert hits >= 0.9 * len(got)


def test_clustered_vectors_are_pruned():
    """Where vectors lie in bunches, few cells are probed and still hold the nearest."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(60, 32)), 50, axis=0) + 0.1 * rng.normal(size=(3000, 32))
    index = ann.fit(x[rng.permutation(len(x))], len(x))
    cell, codes = index.encode(x)
    assert index.probes <= 0.2 * len(index.centers)
    rough, hits = index.by_table(x[:100], cell, codes), 0
    for i in range(100):
        hits += len(set(np.argsort(-rough[i])[:100].tolist()) & set(np.argsort(-(x @ x[i]))[:20].tolist()))
    assert hits >= 0.9 * 2000


def odd_vectors(kind):
    rng = np.random.default_rng(6)
    x, bunch = rng.normal(size=(4000, 64)) / 8, rng.integers(0, 20, 4000)
    centers = rng.normal(size=(20, 64)) / 8
    if kind == "queries unlike the rest":
        x[1:] = np.where(np.arange(1, 4000)[:, None] % 20 == 0, x[1:], (centers[bunch] + 0.15 * x)[1:])
    elif kind == "bunches of unlike spread":
        x = centers[bunch] + 10.0 ** -rng.uniform(0, 4, 20)[bunch, None] * x
    elif kind == "copies":
        x = centers[bunch]
    return x.astype(np.float32)


@pytest.mark.parametrize("kind", ["queries unlike the rest", "bunches of unlike spread", "copies"])
def test_nearest_vectors_of_other_rows(spark, kind):
    """At least 0.95 of the nearest, ties to the smaller vec_id, whatever the rows look like."""
    x = odd_vectors(kind)
    got = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).toPandas()
    hits, exact = 0, x.astype(np.float64)
    for q, mine in got.groupby("query_id"):
        scores = (exact * exact[q]).sum(axis=1)
        scores[q] = -np.inf
        assert len(mine) == 20 and np.allclose(mine["score"], scores[mine["vec_id"]], rtol=1e-12)
        hits += len(set(np.lexsort((np.arange(4000), -scores))[:20].tolist()) & set(mine["vec_id"].tolist()))
    assert hits >= 0.95 * 20 * 200


def test_cells_are_probed_for_what_the_queries_need():
    index = ann.Index(np.eye(30), [], 30)
    tried = np.tile(np.arange(30, 0, -1.0), (10, 1))
    index.calibrate(tried, [np.zeros(20, np.int64)] * 10)
    assert index.probes == ann.LEAST_PROBED
    index.calibrate(tried, [np.arange(20)] * 9 + [np.r_[np.zeros(17, np.int64), 24, 24, 24]])
    assert index.probes == 25
    index.calibrate(tried, [np.zeros(0, np.int64)] * 10)
    assert index.probes == 30


def test_groups_hold_a_bounded_number_of_vectors():
    rng = np.random.default_rng(4)
    counts = {c: int(n) for c, n in enumerate(rng.integers(1, 900, 200))} | {200: 5 * ann.GROUP_ROWS + 1}
    held = Counter()
    for cell, first, parts in ann.grouped(counts):
        for g in range(first, first + parts):
            held[g] += -(-counts[cell] // parts)
    assert max(held.values()) <= ann.GROUP_ROWS and len(ann.grouped(counts)) == len(counts)
    assert len(held) < 2 * sum(counts.values()) / ann.GROUP_ROWS + 2


def test_rows_that_share_a_query_id_ask_as_the_least(spark):
    rows = [(0, [2.0, 1.0]), (0, [1.0, 2.0]), (1, [5.0, 0.0]), (2, [0.0, 6.0])]
    for order in (rows, rows[::-1]):
        got = ann.search(spark.createDataFrame(order, "vec_id long, embedding array<double>")).orderBy("rank").collect()
        assert [tuple(r) for r in got] == [(0, 1, 2, 12.0), (0, 2, 1, 5.0)]


def test_op10_odd(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [-2.0, 0.5]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, cell int, rank int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 1.0), (0, 4, 8, -2.0), (20, 1, 0, 1.0), (20, 2, 0, 1.0), (20, 3, 1, 1.0), (20, 4, 2, 1.0), (20, 5, 8, -1.5)]
    assert ann.search(df.limit(0)).collect() == []


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.cache(), stage(spark, docs, SF).cache()
        if name != "packing":
            assert docs.columns == names
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
            assert set(kept[name]) <= {r.doc_id for r in before.select("doc_id").collect()}
    before = sorted(kept["toxicity"].items())
    assert set(kept["near duplicates"]) == {before[i][0] for i in brute([t for _, t in before])}
    assert all(not base_spans(t) for t in kept["personal data"].values())
    assert {r.doc_id for r in docs.collect()} == set(kept["personal data"])
    assert len(kept["quality rules"]) > 0.6 * spark.read.parquet(f"{SF}/documents.parquet").count()


def test_one_of_repeated_rows_stays(odd):
    left = [(r.doc_id, r.text) for r in stages.simhash_stage(odd.sparkSession, odd, SF).collect()]
    assert sum(k == 8 for k, _ in left) == 1 and {1, 2, 5, 9, 10} <= {k for k, _ in left} and 6 not in {k for k, _ in left} and tokenizer_path("word_bpe_49k.json")
