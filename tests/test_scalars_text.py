import pytest
from pyspark.sql import functions as F

from gridmill.functions import filenames, scalars, text
from gridmill.functions.sql import register_sql


def values(spark, expr, items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_deltaparse(spark):
    good = {"2h 5m": 7500, "40 5d 3h 2d 2s": 7 * 86400 + 3 * 3600 + 42, "5D30H5S": 5 * 86400 + 30 * 3600 + 5, " ": 0, "7": 7, " 3 m ": 180, "1 2": 3, "1m1": 61}
    assert values(spark, scalars.deltaparse, list(good)) == list(good.values())
    bad = ["", "x", "-1h", "1y", "1hh", "h", "1.5h", "1h,2m"]
    assert values(spark, scalars.deltaparse, [*bad, None]) == [None] * (len(bad) + 1)
    with pytest.raises(Exception, match="invalid duration"):
        values(spark, lambda c: scalars.deltaparse(c, strict=True), ["nope"])


def test_lsb_obo(spark):
    pairs = [("1.23", "1.24", True), ("1.24", "1.23", True), ("1.2", "1.21", True), ("1.2", "1.3", True), ("9.99", "10.00", True), ("1028", "1029", False), ("1028", "1028.1", True), ("1.2", "1.2", False), ("1", "x", None), ("-1", "0", None), ("1.", "1", None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    assert [r[0] for r in df.select(scalars.lsb_obo(F.col("a"), F.col("b"))).collect()] == [x for *_, x in pairs]


def test_epoch(spark):
    same = ["2021-06-18 23:00:00Z", "2021-06-18T23:00:00Z", "2021-06-18 23:00Z", "2021-06-19 01:00:00+02:00", "2021-06-18T18:30-04:30"]
    got = values(spark, scalars.epoch_key, [*same, "2021-06-18 23:00:00", "x", None])
    assert len(set(got[: len(same)])) == 1 and got[len(same) :] == [None] * 3
    assert values(spark, scalars.epoch_text, got[:1], "bigint") == ["2021-06-18 23:00:00Z"]


def test_names(spark):
    assert scalars.common_parent(["/a/b/c", "/a/b/d/e"]) == "/a/b"
    assert scalars.quote("a`b") == "`a``b`"
    for bad in ("a\0b", "a\ud800"):
        with pytest.raises(ValueError):
            scalars.quote(bad)
    register_sql(spark)
    assert spark.sql("select epoch_text(0), grapheme_clusters('éx'), path_basename('a/b')").first()[:] == ("1970-01-01 00:00:00Z", ["é", "x"], "b")


def test_graphemes(spark):
    assert values(spark, text.graphemes, ["éa\r\n", "한", ""]) == [["é", "a", "\r\n"], ["한"], []]
    assert values(spark, lambda c: F.array_join(text.uncommon(c, ["ä"]), "|"), ["aäßß\n"]) == ["ß"]
    assert values(spark, text.is_common_ascii, ["a", "\r\n", "\x7f", "ab", "ä", "\t"]) == [True, True, False, False, False, True]


def test_controls(spark):
    items = ["a\rb\nc\r\nd\x00\x01\x85\t", "plain", "x\ny\n"]
    got = [values(spark, lambda c, k=k: text.control_counts(c)[k], items) for k in ("cr", "lf", "crlf", "nul", "ctrl")]
    assert [list(x) for x in zip(*got, strict=True)] == [[1, 1, 1, 1, 2], [0] * 5, [0, 2, 0, 0, 0]]
    assert values(spark, text.control_report, items) == ["1 CR, 1 LF, 1 CRLF, 1 NUL, 2 control, MIXED CR/LF", "", "2 LF"]


def test_encodings(spark):
    items = [b"abc", "ä".encode(), b"\xe4", b"\x81", b""]
    want = [["ASCII", "UTF-8", "ISO-8859-1", "CP1252"], ["UTF-8", "ISO-8859-1", "CP1252"], ["ISO-8859-1", "CP1252"], ["ISO-8859-1"], ["ASCII", "UTF-8", "ISO-8859-1", "CP1252"]]
    assert values(spark, text.decodable, items, "binary") == want
    assert values(spark, text.first_encoding, items, "binary") == [w[0] for w in want]
    assert values(spark, text.decodable_as(["ascii", "utf-16-le"]), [b"ab", b"a"], "binary") == [["ascii", "utf-16-le"], ["ascii"]]


def test_character_functions(spark):
    assert values(spark, text.character_names, ["aä", "\x01", None]) == ["U+0061 LATIN SMALL LETTER A + U+00E4 LATIN SMALL LETTER A WITH DIAERESIS", "U+0001 (unnamed)", None]
    assert values(spark, text.composed, ["é"]) == ["é"]
    assert values(spark, text.casefold, ["STRAßE"]) == ["strasse"]


def test_windows_names(spark):
    bad = ["Com1.tar.gz", "lpt3", "NUL.TXT", "a?b", "tab\tx", "dot.", "space ", "a:b", "x|y"]
    good = ["com10", "console", "a.b", "lpt", "ä", "nulx.txt"]
    assert values(spark, filenames.bad_on_windows, bad + good) == [True] * len(bad) + [False] * len(good)


def test_name_problems(spark):
    rows = [(1, "d", "File"), (2, "d", "file"), (3, "e", "FILE"), (4, "d", "nul"), (5, "d", "größe"), (6, "d", "x✓")]
    df = spark.createDataFrame(rows, "ord int, loc string, name string")
    got = [tuple(r) for r in filenames.name_problems(df, "name", "ord", ["loc"], filenames.GERMAN).select("ord", "problem").orderBy("ord").collect()]
    assert got == [(2, "case collision: FILE, file"), (4, "bad Windows name"), (6, "characters: ✓")]
