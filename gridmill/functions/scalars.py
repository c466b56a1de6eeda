"""Scalar helpers: durations, off-by-one decimals, epoch keys, paths, quoting."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F


def deltaparse(column: Column, strict: bool = False) -> Column:
    """Seconds of a duration such as "2h 5m"; numbers without a unit are seconds, parts add up.

    White space alone is 0. Anything else that is no duration, the empty text
    included, is null, or an error with strict.
    """
    part = r"[0-9]+\s*[dhmsDHMS]?"
    # Between parts: white space, or nothing after a unit.
    sound = column.rlike(rf"\A\s*(?:{part}(?:(?<=[dhmsDHMS])\s*|\s+|\s*\z))+\z")
    pieces = F.regexp_extract_all(column, F.lit(r"([0-9]+)\s*([dhmsDHMS]?)"), F.lit(0))
    unit = lambda p: F.lower(F.regexp_extract(p, "[A-Za-z]", 0))
    size = lambda p: F.when(unit(p) == "d", 86400).when(unit(p) == "h", 3600).when(unit(p) == "m", 60).otherwise(1)
    total = F.aggregate(pieces, F.lit(0).cast("long"), lambda a, p: a + F.regexp_extract(p, "[0-9]+", 0).cast("long") * size(p))
    wrong = F.raise_error(F.concat(F.lit("invalid duration: "), column)).cast("long") if strict else F.lit(None).cast("long")
    return F.when(column.isNull(), F.lit(None).cast("long")).when(column.rlike(r"\A\s+\z"), F.lit(0)).when(sound, total).otherwise(wrong)


def lsb_obo(a: Column, b: Column) -> Column:
    """Whether two unsigned decimals differ by one in the last place of the longer fraction; null if one is none.

    An integer counts as having one fraction digit, so 1028 and 1029 do not.
    """
    sound = lambda x: x.rlike(r"\A[0-9]+(?:[.][0-9]+)?\z")
    fraction = lambda x: F.when(F.contains(x, F.lit(".")), F.split_part(x, F.lit("."), F.lit(2))).otherwise("0")
    places = F.greatest(F.length(fraction(a)), F.length(fraction(b)))
    scaled = lambda x: F.concat(F.split_part(x, F.lit("."), F.lit(1)), F.rpad(fraction(x), places, F.lit("0"))).try_cast("decimal(38,0)")
    return F.when(sound(a) & sound(b), F.abs(scaled(a) - scaled(b)) == 1)


def epoch_key(column: Column) -> Column:
    """Seconds since the epoch of a time with an offset; null if it is none. Space or T, seconds optional."""
    form = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?(?:Z|[+-][0-9]{2}:[0-9]{2})\z"
    plain = F.regexp_replace(F.regexp_replace(column, "T", " "), r"^(.{16})(?=Z|[+-])", "$1:00")
    return F.when(column.rlike(form), F.unix_timestamp(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ssXXX"))))


def epoch_text(column: Column) -> Column:
    """A key of epoch seconds as text in UTC (the session's zone is UTC)."""
    return F.date_format(F.timestamp_seconds(column), "yyyy-MM-dd HH:mm:ss'Z'")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def common_parent(paths: list[str]) -> str:
    """The deepest folder that holds all paths; a path that is no folder counts as its own folder's."""
    return os.path.commonpath([p if os.path.isdir(p) or not os.path.lexists(p) else os.path.dirname(p) for p in paths])


def relative_to(path: Column, parent: Column) -> Column:
    """A path below a folder, without the folder; null if it is not below it."""
    stem = F.rtrim(parent, F.lit("/"))
    return F.when(path == parent, F.lit(".")).when(F.startswith(path, F.concat(stem, F.lit("/"))), F.substr(path, F.length(stem) + 2))


def as_posix(path: Column) -> Column:
    """A path with slashes for backslashes."""
    return F.translate(path, "\\", "/")


def normalized(path: Column) -> Column:
    """A path without empty and . parts, and with .. taken back; links are not followed."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    absolute = F.startswith(path, F.lit("/"))
    step = lambda done, x: F.when((x == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).when((x == "..") & absolute, done).otherwise(F.array_append(done, x))
    kept = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(absolute, F.concat(F.lit("/"), kept)).when(kept == "", F.lit(".")).otherwise(kept)


def quote(name: str) -> str:
    """A name as a quoted SQL identifier; NUL and lone surrogates are refused."""
    if "\0" in name:
        raise ValueError("NUL in an identifier")
    name.encode("utf-8")
    return "`" + name.replace("`", "``") + "`"
