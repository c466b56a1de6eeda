from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridmill.functions.quality import basic_quality, with_quality
from gridmill.functions.timeseries import Interval, check_timeseq, in_range, missing_slots, outside_ranges, overlapping

FLOORS = {
    Interval.MIN15: "2021-07-15 13:45:00",
    Interval.MIN30: "2021-07-15 13:30:00",
    Interval.HOUR1: "2021-07-15 13:00:00",
    Interval.DAY1: "2021-07-15 00:00:00",
    Interval.WEEK1: "2021-07-12 00:00:00",
    Interval.MONTH1: "2021-07-01 00:00:00",
}


def stamps(spark, values):
    df = spark.createDataFrame([(i, str(v)) for i, v in enumerate(values)], "ord int, v string")
    return df.select("ord", F.col("v").cast("timestamp_ntz").alias("ts"))


@pytest.mark.parametrize("interval", FLOORS)
def test_floor(spark, interval):
    got = stamps(spark, ["2021-07-15 13:58:59.123456"]).select(interval.floor(F.col("ts"))).first()[0]
    assert str(got) == FLOORS[interval]


def test_undefined():
    with pytest.raises(ValueError):
        _ = Interval.UNDEF.delta
    with pytest.raises(ValueError):
        Interval.UNDEF.floor(None)


def series(spark, interval, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    return [str(x)[:16] for x in df.select(interval.series(F.col("a"), F.col("b"))).first()[0]]


def test_series(spark):
    assert series(spark, Interval.MIN30, "2021-01-01 00:00:00", "2021-01-01 01:30:00") == ["2021-01-01 00:00", "2021-01-01 00:30", "2021-01-01 01:00"]
    assert series(spark, Interval.MONTH1, "2021-01-31 00:00:00", "2021-05-01 00:00:00") == ["2021-01-31 00:00", "2021-02-28 00:00", "2021-03-28 00:00", "2021-04-28 00:00"]
    assert series(spark, Interval.DAY1, "2021-01-02 00:00:00", "2021-01-01 00:00:00") == []
    assert series(spark, Interval.MONTH1, "2021-01-02 00:00:00", "2021-01-02 00:00:00") == []


def classes(spark, values, interval):
    df = stamps(spark, values).withColumn("s", F.lit(1))
    return [r.quality for r in check_timeseq(df, "ts", "ord", interval, ["s"]).orderBy("ord").collect()]


def test_gaps(spark):
    h = [datetime(2021, 7, 15, 12) + timedelta(hours=k) for k in range(8)]
    assert classes(spark, [h[0], h[1], h[3], h[2], h[3], h[3]], Interval.HOUR1) == ["GOOD", "GOOD", "UNUSUAL", "BAD", "GOOD", "BAD"]
    assert classes(spark, [h[0] + timedelta(minutes=1), h[1], h[2] + timedelta(seconds=1), h[3]], Interval.HOUR1) == ["BAD", "GOOD", "BAD", "GOOD"]
    assert classes(spark, [h[0]], Interval.HOUR1) == []
    assert classes(spark, ["2021-01-01 00:00:00", "2021-02-01 00:00:00", "2021-04-01 00:00:00"], Interval.MONTH1) == ["GOOD", "GOOD", "UNUSUAL"]


def test_missing(spark):
    df = stamps(spark, ["2021-01-01 05:00:00", "2021-01-04 06:00:00", "2021-01-02 01:00:00"]).withColumn("s", F.lit("x"))
    assert [str(r.slot)[:10] for r in missing_slots(df, "ts", Interval.DAY1, ["s"]).collect()] == ["2021-01-03"]


def ranges(spark, rows):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "ord int, a int, b int")
    day = lambda c: (F.lit("2021-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.col(c))).cast("timestamp_ntz")
    return df.select("ord", day("a").alias("start"), day("b").alias("end"))


@pytest.mark.parametrize(
    ("pair", "hit"),
    [
        (((0, 10), (0, 10)), False), (((0, 10), (0, 20)), False), (((0, 20), (0, 10)), True), (((5, 10), (0, 10)), False), (((0, 10), (5, 10)), True),
        (((0, 10), (10, 20)), False), (((0, 10), (2, 8)), True), (((2, 8), (0, 10)), True), (((0, 10), (5, 15)), True),
        (((5, None), (0, 10)), True), (((0, 10), (5, None)), True), (((0, None), (0, 10)), False), (((5, None), (5, None)), True), (((5, None), (6, None)), False),
    ],
)
def test_overlap(spark, pair, hit):
    assert (overlapping(ranges(spark, pair)).count() > 0) == hit


def test_membership(spark):
    df = stamps(spark, ["2021-01-01 00:00:00", "2021-01-03 00:00:00", "2021-01-03 00:00:01", "2021-01-09 00:00:00"])
    assert [r.ord for r in outside_ranges(df, "ts", ranges(spark, [(0, 2), (8, None)])).orderBy("ord").collect()] == [2]
    assert df.filter(in_range(F.col("ts"), F.lit("2021-01-03").cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz"))).count() == 1


def test_quality(spark):
    rows = [("", 7999.0, 1), (" \t", -7999.0, 7999), ("NaN", float("nan"), -7999), ("inf", float("inf"), None), ("7999", None, 0), ("7999.0", 1.5, 2), (None, -0.0, 3)]
    out = with_quality(spark.createDataFrame(rows, "s string, d double, i int"), "s", "d", "i").collect()
    assert [r.s_quality for r in out] == ["UNUSUAL", "UNUSUAL", "BAD", "GOOD", "UNUSUAL", "GOOD", "BAD"]
    assert [r.d_quality for r in out] == ["UNUSUAL", "UNUSUAL", "BAD", "BAD", "BAD", "GOOD", "GOOD"]
    assert [r.i_quality for r in out] == ["GOOD", "UNUSUAL", "UNUSUAL", "BAD", "GOOD", "GOOD", "GOOD"]


def test_quality_by_type(spark):
    df = spark.sql("select cast(7999 as decimal(6,2)) as d, timestamp_ntz'2021-01-01' as t, true as b, array(1) as a")
    got = {c: df.select(basic_quality(F.col(c), df.schema[c].dataType)).first()[0] for c in df.columns}
    assert got == {"d": "UNUSUAL", "t": "GOOD", "b": "GOOD", "a": "BAD"}
    assert df.select(basic_quality(F.col("d"), df.schema["d"].dataType, strict_compat=True)).first()[0] == "BAD"
