"""Regular time series on wall-clock time: grids, gaps, ranges."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sizes import small

GOOD, UNUSUAL, BAD = "GOOD", "UNUSUAL", "BAD"


class Interval(Enum):
    """Sampling interval; the value is its SQL interval, None where undefined."""

    UNDEF = None
    MIN15 = "INTERVAL 15 MINUTES"
    MIN30 = "INTERVAL 30 MINUTES"
    HOUR1 = "INTERVAL 1 HOUR"
    DAY1 = "INTERVAL 1 DAY"
    WEEK1 = "INTERVAL 7 DAYS"
    MONTH1 = "INTERVAL 1 MONTH"

    @property
    def delta(self) -> Column:
        if self.value is None:
            raise ValueError("an undefined interval has no length")
        return F.expr(self.value)

    def floor(self, ts: Column) -> Column:
        """The last grid point at or before a wall-clock time; weeks start on Monday."""
        if self.value is None:
            raise ValueError("an undefined interval has no grid")
        units = {Interval.HOUR1: "HOUR", Interval.DAY1: "DAY", Interval.WEEK1: "WEEK", Interval.MONTH1: "MONTH"}
        if self in units:
            return F.date_trunc(units[self], ts).cast("timestamp_ntz")
        minutes = 15 if self is Interval.MIN15 else 30
        past = F.floor(F.minute(ts) / minutes) * minutes
        return F.date_trunc("HOUR", ts).cast("timestamp_ntz") + F.make_dt_interval(mins=past.cast("int"))

    def series(self, start: Column, stop: Column) -> Column:
        """Array of start, start + delta, ... before stop; months add up step by step, so a month's end drifts."""
        empty = F.array().cast("array<timestamp_ntz>")
        if self is Interval.MONTH1:
            steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.months_between(stop, start)).cast("int") + 1))
            chain = F.aggregate(steps, F.array(start), lambda done, _: F.array_append(done, F.element_at(done, -1) + self.delta))
            return F.filter(chain, lambda t: t < stop)
        points = F.sequence(start, stop, self.delta)
        return F.when(start < stop, F.filter(points, lambda t: t < stop)).otherwise(empty)


def check_timeseq(df: DataFrame, ts: str, ordinal: str, interval: Interval, series: list[str], out: str = "quality") -> DataFrame:
    """Class of each element against the one before it in `ordinal` order, within each series.

    Off the grid is BAD; the expected time is GOOD, a later one UNUSUAL (a gap),
    an earlier one BAD. A series of one element has no rows.
    """
    order = Window.partitionBy(*series).orderBy(ordinal)
    now, before = F.col(ts), F.lag(ts).over(order)
    expected = interval.floor(before) + interval.delta
    quality = (
        F.when(now != interval.floor(now), BAD)
        .when(F.row_number().over(order) == 1, GOOD)
        .when(now == expected, GOOD)
        .when(now > expected, UNUSUAL)
        .otherwise(BAD)
    )
    size = F.count(F.lit(1)).over(Window.partitionBy(*series))
    return df.withColumns({out: quality, "_size": size}).filter("_size > 1").drop("_size")


def missing_slots(df: DataFrame, ts: str, interval: Interval, series: list[str]) -> DataFrame:
    """series, slot of every grid point between a series' first and last time that has no observation."""
    seen = df.select(*series, interval.floor(F.col(ts)).alias("slot")).distinct()
    ends = seen.groupBy(*series).agg(F.min("slot").alias("first"), F.max("slot").alias("last"))
    grid = ends.select(*series, F.explode(interval.series(F.col("first"), F.col("last"))).alias("slot"))
    return grid.join(seen, [*series, "slot"], "left_anti")


def in_range(ts: Column, start: Column, end: Column) -> Column:
    """Closed membership; an open end is the start itself (an instant)."""
    return ts.between(start, F.coalesce(end, start))


def outside_ranges(df: DataFrame, ts: str, ranges: DataFrame) -> DataFrame:
    """Rows whose time lies in none of the ranges (start, end): anti range join with a declared list."""
    r = small(ranges.select(F.col("start").alias("_start"), F.col("end").alias("_end")))
    return df.join(r, in_range(F.col(ts), F.col("_start"), F.col("_end")), "left_anti")


def overlapping(ranges: DataFrame, strict_order: bool = True) -> DataFrame:
    """i, j of pairs of ranges (ord, start, end) that collide, i before j.

    With strict_order the test depends on the order, as declared lists are
    checked: a range collides with a later one that starts or ends strictly
    inside it, or that holds all of it strictly inside; an instant with a range
    around it or with itself. Otherwise any shared stretch counts.
    """
    a = ranges.select(F.col("ord").alias("i"), F.col("start").alias("a1"), F.coalesce("end", "start").alias("a2"), F.col("end").isNull().alias("a_point"))
    b = ranges.select(F.col("ord").alias("j"), F.col("start").alias("b1"), F.coalesce("end", "start").alias("b2"), F.col("end").isNull().alias("b_point"))
    inside = lambda x, of: (F.col(f"{of}1") < F.col(x)) & (F.col(x) < F.col(f"{of}2"))
    same_point = F.col("a_point") & F.col("b_point") & (F.col("a1") == F.col("b1"))
    if strict_order:
        hit = inside("b1", "a") | inside("b2", "a") | (inside("a1", "b") & inside("a2", "b")) | same_point
    else:
        hit = (F.col("a1") < F.col("b2")) & (F.col("b1") < F.col("a2")) | same_point
    # Ranges that collide share a stretch or an instant, so they meet in a slot of time they both touch: slots as wide as the mean range.
    width = ranges.agg(F.avg(F.unix_seconds(F.coalesce("end", "start").cast("timestamp")) - F.unix_seconds(F.col("start").cast("timestamp"))).alias("w")).first()["w"]
    slot = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / max(1.0, width or 0.0))
    dealt = lambda df, x: df.withColumn("slot", F.explode(F.sequence(F.least(slot(f"{x}1"), slot(f"{x}2")), F.greatest(slot(f"{x}1"), slot(f"{x}2")))))
    met = dealt(a, "a").join(dealt(b, "b"), "slot").filter((F.col("i") < F.col("j")) & hit)
    # A pair that shares several slots counts in the first.
    return met.filter(F.col("slot") == F.greatest(slot("a1"), slot("b1"))).select("i", "j")
