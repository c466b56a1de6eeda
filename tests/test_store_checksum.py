import hashlib

import pytest
from pyspark.sql import functions as F

from gridmill.operators import checksum, store


def test_first_and_conflicts(spark):
    df = spark.createDataFrame([("a", 1, "x", 0), ("a", 1, "x", 1), ("b", 2, "y", 2), ("b", 2, None, 3), ("c", 3, None, 4), ("c", 3, None, 5)], "k string, n int, s string, o int")
    assert {r.k: r.n_rows for r in store.conflicts_within(df, ["k"], "o").collect()} == {"b": 2}
    assert {r.k: r.s for r in store.first_rows(df, ["k"], "o").collect()} == {"a": "x", "b": "y", "c": None}
    assert {r.k: r.o for r in store.latest_rows(df, ["k"], "o").collect()} == {"a": 1, "b": 3, "c": 5}
    only_keys = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert sorted(r.k for r in store.first_rows(only_keys, ["k"]).collect()) == [1, 2]
    assert {r.k: r.n for r in store.duplicates(only_keys, ["k"]).collect()} == {1: 2}


def test_append(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS kept")
    spark.sql(f"CREATE TABLE kept (k STRING, n INT) USING parquet LOCATION '{tmp_path}/kept'")
    rows = lambda *x: spark.createDataFrame(list(x), "k string, n int")
    store.append_or_conflict(spark, "kept", rows(("foo", 2), ("foo", 2), ("Foo", 2)), ["k"])
    store.append_or_conflict(spark, "kept", rows(("foo", 2), ("bar", None)), ["k"])
    assert sorted(map(tuple, spark.table("kept").collect())) == [("Foo", 2), ("bar", None), ("foo", 2)]
    with pytest.raises(store.RowMismatchError) as e:
        store.append_or_conflict(spark, "kept", rows(("foo", 3)), ["k"])
    assert "-n: 2" in e.value.rowdiff() and "+n: 3" in e.value.rowdiff()
    clash = store.append_or_conflict(spark, "kept", rows(("foo", 3), ("bar", 1), ("new", 1), ("two", 1), ("two", 2)), ["k"], mode="report")
    assert sorted(r.k for r in clash.collect()) == ["bar", "foo", "two"] or spark.table("kept").filter("k = 'new'").count() == 1
    assert spark.table("kept").count() == 4
    spark.sql("DROP TABLE kept")


def test_changed_columns(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1.0)], "k int, s string, d double")
    new = spark.createDataFrame([(1, "a", None), (2, "B", None), (3, "c", 0.0)], "k int, s string, d double")
    assert [(r.k, r.changed) for r in store.conflicts_between(old, new, ["k"]).collect()] == [(2, ["s", "d"])]
    assert [r.k for r in store.new_rows(old, new, ["k"]).collect()] == [3]


@pytest.mark.parametrize("algorithm", list(checksum.ALGORITHMS.values()))
def test_digests(spark, algorithm):
    want = getattr(hashlib, algorithm)(b"AAAAA").hexdigest()
    row = spark.createDataFrame([(b"AAAAA", want)], "c binary, h string").select(checksum.digest(F.col("c"), algorithm), checksum.algorithm_of(F.col("h")), checksum.digest_as(F.col("c"), F.col("h"))).first()
    assert tuple(row) == (want, algorithm, want)


def test_lines(spark):
    h = hashlib.md5(b"x").hexdigest()
    lines = spark.createDataFrame([(f"{h.upper()} *a b.txt",), (f"{h}  c",), ("",)], "value string")
    assert [tuple(r) for r in checksum.parse_lines(lines).collect()] == [(h, True, "a b.txt", None), (h, False, "c", None)]
    assert [r.binflag for r in checksum.parse_lines(lines, binflag=True).collect()] == [True, True]
    assert [r[0] for r in spark.range(3).select(checksum.code_name(F.col("id").cast("int"))).collect()] == ["NONE", "SKIP", "NEEDSVALIDATE"]
    bad = spark.createDataFrame([("abc *x",), (f"{h}*x",), (f"{h} *ok",)], "value string")
    assert [r.fn for r in checksum.parse_lines(bad, strict=False).collect()] == ["ok"]
    with pytest.raises(Exception, match="bad manifest line"):
        checksum.parse_lines(bad).collect()


def files(spark, rows):
    return spark.createDataFrame([(i, fn, code, None) for i, (fn, code) in enumerate(rows)], "ord int, fn string, code string, msg string")


def sums(spark, rows):
    return spark.createDataFrame([(i, fn, h) for i, (fn, h) in enumerate(rows)], "ord int, fn string, hsh string")


def coded(df):
    return sorted((r.fn, r.code) for r in df.collect())


def test_reconcile(spark):
    f = files(spark, [("/t/a", "NONE"), ("/t/b", "NONE"), ("/t/c", "NONE"), ("/t/link", "SKIP")])
    s = sums(spark, [("/t/a", "11"), ("/t/a", "11"), ("/t/b", "22"), ("/t/b", "33"), ("/t/gone", "44"), ("/t/gone", "44"), ("/t/gone", "55")])
    want = [("/t/a", "NEEDSVALIDATE"), ("/t/b", "BADINPUT"), ("/t/b", "UNKNOWN"), ("/t/c", "NOSUM"), ("/t/gone", "MISSING"), ("/t/gone", "MISSING"), ("/t/link", "SKIP")]
    assert coded(checksum.reconcile(s, f)) == want


def test_reconcile_by_name(spark):
    f = files(spark, [("/x/a", "NONE"), ("/y/a", "NONE"), ("/z/a", "NONE"), ("/x/b", "NONE"), ("/x/d", "NONE"), ("/y/d", "NONE")])
    s = sums(spark, [("q/a", "11"), ("p/b", "22"), ("p/e", "33"), ("q/e", "44")])
    got = coded(checksum.reconcile(s, f, ignore_path=True))
    assert got == [("/x/b", "NEEDSVALIDATE"), ("/y/d", "NOSUM"), ("/z/a", "UNKNOWN"), ("a", "DUPEFN"), ("a", "DUPEFN"), ("d", "DUPEFN"), ("e", "BADINPUT"), ("e", "MISSING")]


def test_validate(spark):
    h = hashlib.sha1(b"one").hexdigest()
    f = files(spark, [("/a", "NONE"), ("/b", "NONE")])
    met = checksum.reconcile(sums(spark, [("/a", h), ("/b", h)]), f)
    contents = spark.createDataFrame([("/a", b"one"), ("/b", b"two")], "fn string, content binary")
    out = {r.fn: r for r in checksum.validate(met, contents).collect()}
    assert out["/a"].code == "SUMOK" and out["/b"].code == "SUMMISMATCH" and h in out["/b"].msg
    assert [checksum.CODES.index(c) for c in ("NONE", "UNKNOWN")] == [0, 9]


def test_manifest_orders(spark):
    df = spark.createDataFrame([("b", b"1"), ("a", b"2"), ("c", b"1")], "fn string, content binary")
    names = lambda sort: [r.value.rpartition("*")[2] for r in checksum.generate_manifest(df, "md5", sort).collect()]
    assert names("BY_FILE") == ["a", "b", "c"] and names("BY_LINE") == ["b", "c", "a"] and names("NO_SORT") == ["b", "a", "c"]
    with pytest.raises(ValueError):
        checksum.generate_manifest(df, "md5", "OTHER")
