import decimal
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridmill.functions.types import BigInt, Ignore, NonNegInt, Num, OnlyNan, TimestampNoTz, TimestampWithTz, cast_all, infer_type, infer_types, parse_type, type_violations

VECTORS = [
    (Num(5, 2), ["1", "-1", "123", "123.45", "-.5", "5.", "nan", "NaN", "000.00"], ["", "-", ".", "-.", "1234", "1.234", "+1", "1e5", " 1", "1\n"]),
    (Num(3), ["123", "-123", "1.", "1.000", "NAN"], ["1234", "1.1", ""]),
    (Num(2, 2), [".12", "0.1", "00.1", "-.01"], ["1", "1.1", ".123"]),
    (Num(), ["12345678901234567890.123", "-0", ".1"], ["abc", "1..2", "--1"]),
    (NonNegInt(), ["0", "1", "2147483647", "nan"], ["-1", "01", "2147483648", "1.0", "", "99999999999999999999"]),
    (BigInt(), ["0", "-0", "-9223372036854775808", "9223372036854775807", "NaN"], ["9223372036854775808", "01", "-01", "1.5", "--1"]),
    (TimestampNoTz(), ["2021-06-18 23:00:00", "2019-13-45 99:99:99", "nan"], ["2021-06-18T23:00:00", "2021-06-18 23:00", "2021-06-18 23:00:00Z", "2021-06-18 23:00:00\n"]),
    (TimestampWithTz(), ["2021-06-18 23:00:00Z", "2021-06-18 23:00:00+02:00", "2021-06-18 23:00:00 -04:30"], ["2021-06-18 23:00:00", "2021-06-18 23:00:00 Z", "2021-06-18 23:00:00z", "2021-06-18 23:00:00+0200"]),
    (OnlyNan(), ["nan", "NAN"], ["", "0"]),
    (Ignore(), ["", "anything"], []),
]


@pytest.mark.parametrize(("kind", "good", "bad"), VECTORS, ids=lambda x: repr(x) if not isinstance(x, list) else "")
def test_check(spark, kind, good, bad):
    df = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], "v string, want boolean")
    assert df.filter(kind.check(F.col("v")) != F.col("want")).collect() == []


def test_null_is_of_no_type(spark):
    df = spark.createDataFrame([(None,)], "v string")
    assert [df.select(t.check(F.col("v"))).first()[0] for t in (Num(), NonNegInt(), BigInt(), TimestampNoTz(), OnlyNan())] == [False] * 5


def test_casts(spark):
    df = spark.createDataFrame([("1.5", "7", "-3", "2021-06-18 23:00:00"), ("nan", "nan", "nan", "2019-13-45 00:00:00"), ("x", "-1", "1.5", "x")], "a string, b string, c string, d string")
    out = cast_all(df, {"a": Num(5, 2), "b": NonNegInt(), "c": BigInt(), "d": TimestampNoTz()}).collect()
    assert (out[0].a, out[0].b, out[0].c, str(out[0].d)) == (decimal.Decimal("1.50"), 7, -3, "2021-06-18 23:00:00")
    assert all(x is None for r in out[1:] for x in r)
    with pytest.raises(Exception, match="not a Num"):
        cast_all(df, {"a": Num(5, 2)}, strict=True).collect()


def test_time_zones(spark):
    df = spark.createDataFrame([("2021-03-28 02:30:00",), ("2021-10-31 02:30:00",)], "v string")
    got = [str(r[0]) for r in df.select(TimestampNoTz().to_utc(F.col("v"), "Europe/Berlin")).collect()]
    assert got == ["2021-03-28 01:30:00", "2021-10-31 00:30:00"]
    one = spark.createDataFrame([("2021-06-18 23:00:00 -04:30",)], "v string")
    assert str(one.select(TimestampWithTz().cast(F.col("v")).cast("timestamp_ntz")).first()[0]) == "2021-06-19 03:30:00"


@pytest.mark.parametrize("text", ["Num", "Num(5)", "Num(5,2)", "NonNegInt", "BigInt", "TimestampNoTz", "TimestampWithTz", "OnlyNan", "Ignore"])
def test_names(text):
    assert repr(parse_type(text)) == text


@pytest.mark.parametrize("text", ["Num()", "Num( 1, 5 )", "Num(3,)", "Foo", "num", ""])
def test_bad_names(text):
    with pytest.raises(ValueError):
        parse_type(text)


def test_parameters_and_order():
    for bad in (lambda: Num(0), lambda: Num(1001), lambda: Num(3, 4), lambda: Num(3, -1)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        Num(None, 1)
    assert Num(3) != Num(3, 0) and Num(3, 2) == Num(3, 2)
    assert Num(3, 1) < Num(4, 2) and not Num(3, 1) < Num(4, 1) and Num(3, 1) <= Num(4, 1) and Num(5, 3) > Num(4, 2)
    with pytest.raises(TypeError):
        _ = Num(3) < Num(4)
    with pytest.raises(TypeError):
        _ = Num(3, 1) < 5


INFER = [
    (["nan", "NaN"], "OnlyNan"),
    (["0", "12", "nan"], "NonNegInt"),
    (["-1", "12"], "BigInt"),
    (["2147483648"], "BigInt"),
    (["2021-06-18 23:00:00"], "TimestampNoTz"),
    (["2021-06-18 23:00:00Z", "nan"], "TimestampWithTz"),
    (["1.0", "3.4"], "Num(2,1)"),
    (["1234", "123", "-123456", "12345.6"], "Num(6,1)"),
    (["01", "2"], "Num(2)"),
    (["1", "x"], None),
    ([], None),
]


@pytest.mark.parametrize(("values", "want"), INFER)
def test_infer(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert infer_type(df, "v").first()[0] == want


def test_infer_safe_and_columns(spark):
    df = spark.createDataFrame([("1234", "a"), ("1.25", "b")], "x string, y string")
    assert infer_type(df, "x", safe=True).first()[0] == "Num(6,2)"
    assert {r.name: r.reftype for r in infer_types(df).collect()} == {"x": "Num(4,2)", "y": None}


def test_violations(spark):
    df = spark.createDataFrame([(1, "1", "x"), (2, "-1", None)], "id int, a string, b string")
    assert [tuple(r) for r in type_violations(df, {"a": NonNegInt(), "b": Num()}, ["id"]).orderBy("id").collect()] == [(1, "b", "x"), (2, "a", "-1")]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.from_regex(r"-?[0-9]{0,4}\.?[0-9]{0,3}", fullmatch=True), min_size=1, max_size=40))
def test_numbers_by_rule(spark, values):
    def ok(v):
        m = re.fullmatch(r"-?([0-9]*)(?:\.([0-9]*))?", v)
        return bool(m and re.search("[0-9]", v)) and len(m[1]) <= 3 and len(m[2] or "") <= 2

    got = spark.createDataFrame([(v,) for v in values], "v string").select(Num(5, 2).check(F.col("v"))).collect()
    assert [r[0] for r in got] == [ok(v) for v in values]
