"""Places of personal data in long texts, masking, and columns whose names clash."""

import random

import pytest
import regex

from gridmill.llm import pii, stages

from .conftest import SF
from .test_corpus import base_spans

PARTS = ["word", "ünit", "😀", "a@b.de,", "1.2.3.4", "4111 1111 1111 1111", "+49 30 1234567", "tel 555-123-4567", "xtoken = '04dbebab91ab85687d33'", "token = '04dbebab91ab85687d33'", "\n"]
#: The patterns with look-behinds that can refuse an earlier occurrence.
GUARDED = {3: pii.LOCAL_PHONE, 4: pii.SECRET}


def mixed(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(PARTS) for _ in range(n))


def test_every_kind_by_brute_force(spark):
    texts = [mixed(k, 40 * (k + 1)) for k in range(12)] + [mixed(99, 3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.spans_with_votes(df).collect():
        text = texts[row.row.doc_id]
        assert [(s.start, s.kind, s.end) for s in row.found if s.base] == base_spans(text)
        for kind, pattern in GUARDED.items():
            want = [m.span() for m in regex.finditer(pattern, text)]
            got = [(s.start, s.end) for s in row.found if s.kind == kind and not s.base]
            assert got == want


def test_running_values_over_many_blocks(spark):
    values = [random.Random(1).randrange(50) for _ in range(3 * pii.RUN + 5)]
    for n in (0, 1, pii.RUN, pii.RUN + 1, len(values)):
        df = spark.createDataFrame([(values[:n],)], "v array<int>")
        added, largest = df.selectExpr(pii._running("v", "{a} + {x}"), pii._running("v", "greatest({a}, {x})")).first()
        assert added == [sum(values[: i + 1]) for i in range(n)]
        assert largest == [max(values[: i + 1]) for i in range(n)]


@pytest.mark.parametrize("text", ["x@" + "a." * 50_000 + "b", "1 " * 50_000, "1.2.3.4 " * 20_000, "a.a." * 20_000 + "@x.de", "+1(" * 30_000], ids=range(5))
def test_long_texts_end(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.find_pii(df).first()
    assert row.n_ip == text.count("1.2.3.4") and row.n_email == int("@" in text)


def masked(text, spans):
    """The text with merged spans named by their first."""
    out, at = "", 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += text[at:start] + f"[{pii.KINDS[kind].upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_masking_by_brute_force(spark):
    texts = [mixed(k, 60 * (k + 1)) for k in range(8)] + [mixed(7, 2500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: [(int(a), pii.KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)] for r in pii.find_pii(df).collect()}
    got = {r.doc_id: r.text for r in pii.mask_pii(df).collect()}
    assert got == {k: masked(t, spans[k]) for k, t in enumerate(texts)}


def test_clashing_columns_repeats_and_empty_tables(spark):
    names = ["email", "t", "found", "kept", "row", "m_ip", "segments", "text_hash", "covered", "a.b"]
    rows = [(1, "mail a@b.de", *names), (1, "mail a@b.de", *names), (None, None, *names), (2, "", *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = stages.pii_stage(spark, df, SF)
    assert out.columns == df.columns
    want = [(1, "mail [EMAIL]", *names)] * 2 + [(2, "", *names), (None, None, *names)]
    assert sorted(map(tuple, out.collect()), key=str) == want
    assert stages.pii_stage(spark, df.limit(0), SF).collect() == []
