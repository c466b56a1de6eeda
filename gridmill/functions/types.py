"""Restrictive types of string columns: check, cast and infer, as column expressions.

Columns are strings; "nan" in any case is accepted by every type and casts to
null. A value that fails its check casts to null too (`strict=True` raises).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STAMP = r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}"


def _whole(column: Column, pattern: str) -> Column:
    return column.rlike(rf"\A(?:{pattern})\z")


def _digits(column: Column, pattern: str) -> Column:
    """A whole number, null where the form differs; only texts of the form are cast, as failing casts are slow."""
    return F.when(_whole(column, pattern), column).try_cast("bigint")


def is_nan(column: Column) -> Column:
    return F.lower(column) == "nan"


@dataclass(frozen=True)
class RefType:
    """A type without parameters; subclasses say what they accept."""

    spark_type = T.StringType()

    @property
    def postgres(self) -> str | None:
        return None

    def accepts(self, column: Column) -> Column:
        raise NotImplementedError

    def convert(self, column: Column) -> Column:
        raise NotImplementedError

    def check(self, column: Column) -> Column:
        """Whether the value is of this type; null is not."""
        return F.coalesce(is_nan(column) | self.accepts(column), F.lit(False))

    def cast(self, column: Column, strict: bool = False) -> Column:
        bad = F.raise_error(F.concat(F.lit(f"not a {self!r}: "), column)).cast(self.spark_type) if strict else F.lit(None).cast(self.spark_type)
        return F.when(column.isNull() | is_nan(column), F.lit(None).cast(self.spark_type)).when(self.check(column), self.convert(column)).otherwise(bad)

    def __repr__(self) -> str:
        return type(self).__name__


@dataclass(frozen=True, repr=False)
class Num(RefType):
    """A decimal number; at most `scale` fraction digits and `precision - scale` integer digits."""

    precision: int | None = None
    scale: int | None = None

    def __post_init__(self) -> None:
        if self.precision is None and self.scale is not None:
            raise TypeError("a scale needs a precision")
        if self.precision is not None and not (1 <= self.precision <= 1000 and 0 <= (self.scale or 0) <= self.precision):
            raise ValueError("precision is 1 to 1000, scale 0 to precision")

    @property
    def spark_type(self) -> T.DataType:  # type: ignore[override]
        return T.DecimalType(self.precision, self.scale or 0) if self.precision and self.precision <= 38 else T.DoubleType()

    @property
    def postgres(self) -> str:
        return repr(self).upper().replace("NUM", "NUMERIC")

    def accepts(self, column: Column) -> Column:
        digits = lambda most: "[0-9]*" if most is None else f"[0-9]{{0,{most}}}" if most else "0*"
        scale = None if self.precision is None else self.scale or 0
        room = None if self.precision is None else self.precision - scale
        return _whole(column, rf"-?{digits(room)}(?:[.]{digits(scale)})?") & column.rlike("[0-9]")

    def convert(self, column: Column) -> Column:
        return column.try_cast(self.spark_type)

    def _both(self, other: object) -> tuple[Num, Num]:
        if not isinstance(other, Num):
            raise TypeError("Num compares with Num only")
        if None in (self.precision, self.scale, other.precision, other.scale):
            raise TypeError("Num without precision and scale has no order")
        return self, other

    def __lt__(self, other: object) -> bool:
        a, b = self._both(other)
        return a.precision < b.precision and a.scale < b.scale

    def __le__(self, other: object) -> bool:
        a, b = self._both(other)
        return a.precision <= b.precision and a.scale <= b.scale

    def __gt__(self, other: object) -> bool:
        a, b = self._both(other)
        return b < a

    def __ge__(self, other: object) -> bool:
        a, b = self._both(other)
        return b <= a

    def __repr__(self) -> str:
        inside = ",".join(str(x) for x in (self.precision, self.scale) if x is not None)
        return f"Num({inside})" if inside else "Num"


@dataclass(frozen=True, repr=False)
class NonNegInt(RefType):
    spark_type = T.IntegerType()
    postgres = "INTEGER"

    def accepts(self, column: Column) -> Column:
        return F.coalesce(_digits(column, "0|[1-9][0-9]*") < 2**31, F.lit(False))

    def convert(self, column: Column) -> Column:
        return column.try_cast("int")


@dataclass(frozen=True, repr=False)
class BigInt(RefType):
    spark_type = T.LongType()
    postgres = "BIGINT"

    def accepts(self, column: Column) -> Column:
        return _digits(column, "-?(?:0|[1-9][0-9]*)").isNotNull()

    def convert(self, column: Column) -> Column:
        return column.try_cast("bigint")


@dataclass(frozen=True, repr=False)
class TimestampNoTz(RefType):
    """By its form only: a date that the calendar lacks is accepted, and casts to null."""

    spark_type = T.TimestampNTZType()
    postgres = "TIMESTAMP"

    def accepts(self, column: Column) -> Column:
        return _whole(column, _STAMP)

    def convert(self, column: Column) -> Column:
        return column.try_cast("timestamp_ntz")

    def to_utc(self, column: Column, zone: str) -> Column:
        """The instant of a wall-clock time in a zone, as wall-clock time in UTC."""
        return F.to_utc_timestamp(self.cast(column).cast("timestamp"), zone).cast("timestamp_ntz")


@dataclass(frozen=True, repr=False)
class TimestampWithTz(RefType):
    spark_type = T.TimestampType()
    postgres = "TIMESTAMP WITH TIME ZONE"

    def accepts(self, column: Column) -> Column:
        return _whole(column, _STAMP + "(?:Z| ?[+-][0-9]{2}:[0-9]{2})")

    def convert(self, column: Column) -> Column:
        return F.try_to_timestamp(F.regexp_replace(column, " (?=[+-])", ""), F.lit("yyyy-MM-dd HH:mm:ssXXX"))


@dataclass(frozen=True, repr=False)
class OnlyNan(RefType):
    spark_type = T.DoubleType()

    def accepts(self, column: Column) -> Column:
        return F.lit(False)

    def convert(self, column: Column) -> Column:
        return F.lit(None).cast("double")


@dataclass(frozen=True, repr=False)
class Ignore(RefType):
    """Anything; kept as it is."""

    def check(self, column: Column) -> Column:
        return F.lit(True)

    def cast(self, column: Column, strict: bool = False) -> Column:
        return column


PLAIN = {t.__name__: t for t in (NonNegInt, BigInt, TimestampNoTz, TimestampWithTz, OnlyNan, Ignore, Num)}


def parse_type(name: str) -> RefType:
    if name in PLAIN:
        return PLAIN[name]()
    if found := re.fullmatch(r"Num\(([0-9]+)(?:,([0-9]+))?\)", name):
        return Num(int(found[1]), None if found[2] is None else int(found[2]))
    raise ValueError(f"no such type: {name!r}")


#: Candidates in the order in which the first that fits every value is taken.
CANDIDATES: tuple[RefType, ...] = (OnlyNan(), NonNegInt(), BigInt(), TimestampNoTz(), TimestampWithTz(), Num())


def _number(column: Column) -> Column:
    """The value if it is a number; others are turned away by their first character."""
    return F.when(F.substring(column, 1, 1).isin(*"0123456789-.") & Num().accepts(column), column)


def _facts(column: Column, number: Column) -> dict[str, Column]:
    """What inference needs of one value: which candidates fit, and a number's digits. number: the value's _number().

    Whole numbers and times are told by cheap tests first: one by being a
    number, the other by length and first dash, so few values meet a pattern.
    """
    dated = (F.length(column) >= 19) & (F.substring(column, 5, 1) == "-")
    likely = {NonNegInt: number.isNotNull() & (F.length(column) <= 10), BigInt: number.isNotNull() & (F.length(column) <= 20), TimestampNoTz: dated, TimestampWithTz: dated}
    whole, fraction = F.split_part(number, F.lit("."), F.lit(1)), F.split_part(number, F.lit("."), F.lit(2))
    sizes = {"scale": F.length(fraction), "whole": F.length(F.ltrim(whole, F.lit("-")))}
    fits = lambda t: number.isNotNull() if isinstance(t, Num) else F.when(likely[type(t)], F.coalesce(t.accepts(column), F.lit(False))).otherwise(False) if type(t) in likely else F.lit(False)
    return {f"fits_{i}": F.coalesce(is_nan(column), F.lit(False)) | fits(t) for i, t in enumerate(CANDIDATES)} | sizes


def _inferred(safe: bool) -> Column:
    """Aggregate over _facts() columns: the name of the narrowest type of all values."""
    scale = F.max("scale")
    digits = F.max("whole") + scale if safe else F.max(F.col("whole") + F.col("scale"))
    named = F.when(scale > 0, F.format_string("Num(%d,%d)", digits, scale)).otherwise(F.format_string("Num(%d)", digits))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, t in enumerate(CANDIDATES):
        out = out.when(F.bool_and(f"fits_{i}"), named if isinstance(t, Num) else F.lit(repr(t)))
    return out.otherwise(F.lit(None).cast("string"))


def infer_type(df: DataFrame, column: str, safe: bool = False) -> DataFrame:
    """One row, reftype: the narrowest type of all values; null if none fits or there are none.

    A number's precision is the most digits of any value and its scale the most
    fraction digits, each taken by itself; with safe, the precision holds the
    longest integer and fraction parts together.
    """
    value = df.select(F.col(column).cast("string").alias("value")).withColumn("number", _number(F.col("value")))
    return value.select(*(c.alias(n) for n, c in _facts(F.col("value"), F.col("number")).items())).agg(_inferred(safe).alias("reftype"))


def infer_types(df: DataFrame, safe: bool = False) -> DataFrame:
    """name, reftype of every column, in one pass; cells become rows, and each task sends one row a column."""
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in df.columns))
    value = df.select(F.inline(cells)).withColumn("number", _number(F.col("value")))
    facts = value.select("name", *(c.alias(n) for n, c in _facts(F.col("value"), F.col("number")).items()))
    return facts.groupBy("name").agg(_inferred(safe).alias("reftype"))


def type_violations(df: DataFrame, types: dict[str, RefType], keys: list[str]) -> DataFrame:
    """keys, name, value of every cell that fails its column's type; null cells are absent, not wrong."""
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value"), (F.col(c).isNull() | t.check(F.col(c))).alias("ok")) for c, t in types.items()))
    return df.select(*keys, F.explode(F.filter(cells, lambda x: ~x["ok"])).alias("x")).select(*keys, "x.name", "x.value")


def cast_all(df: DataFrame, types: dict[str, RefType], strict: bool = False) -> DataFrame:
    """Every typed column cast; the others stay strings."""
    return df.select(*(types[c].cast(F.col(c), strict).alias(c) if c in types else F.col(c) for c in df.columns))
