"""Records of catalog tables: layouts scattered to full rows, views, environment matching, imports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sizes import small
from ..functions.types import TimestampNoTz, cast_all, type_violations
from ..plans.catalog import Logger, Table


def full_rows(df: DataFrame, layout: list[str], columns: list[str]) -> DataFrame:
    """Columns of one layout put in the places of the full table; absent ones are null."""
    return df.select(*((F.col(c) if c in layout else F.lit(None).cast("string")).alias(c) for c in columns))


def union_layouts(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, (full_rows(f, f.columns, columns) for f in frames))


def view(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """old -> new names, in order."""
    return df.select(*(F.col(old).alias(new) for old, new in pairs))


def table_view(df: DataFrame, table: Table, name: str) -> DataFrame:
    return view(df, [(f"`{old.name}`", new.name) for old, new in table.views[name]])


def typed(df: DataFrame, table: Table, strict: bool = False, zoned: bool = False) -> DataFrame:
    """Rows cast as the catalog declares, by SQL names. Wall-clock times stay as they are, or with zoned are instants in the logger's zone."""
    rest = [c for c in df.columns if c.startswith("_")]
    named = df.select(*(F.col(f"`{c.name}`").alias(c.header.sql) for c in table.columns), *rest)
    types = {c.header.sql: c.type for c in table.columns if c.type}
    out = cast_all(named, types, strict)
    if not zoned:
        return out
    zone = str(table.logger.tz) if table.logger.tz else "UTC"
    wall = {k for k, t in types.items() if isinstance(t, TimestampNoTz)}
    # Texts of the same rows, so that casts and conversions read the same value.
    return named.select(*(types[c].to_utc(F.col(c), zone).alias(c) if c in wall else types[c].cast(F.col(c), strict).alias(c) if c in types else F.col(c) for c in out.columns))


def typed_utc(df: DataFrame, table: Table) -> DataFrame:
    """As typed(), with numbers as doubles and wall-clock times converted to UTC; every column must have a type."""
    zone = str(table.logger.tz) if table.logger.tz else "UTC"
    out = []
    for c in table.columns:
        if c.type is None:
            raise TypeError(f"column {c.name} has no type")
        value = c.type.to_utc(F.col(f"`{c.name}`"), zone) if isinstance(c.type, TimestampNoTz) else c.type.cast(F.col(f"`{c.name}`"))
        out.append((value.cast("double") if isinstance(value, Column) and isinstance(c.type.spark_type, T.DecimalType) else value).alias(c.header.sql))
    return df.select(*out)


def violations(df: DataFrame, table: Table) -> DataFrame:
    """source, name, value of every cell that fails its declared type."""
    named = df.select(*(F.col(f"`{c.name}`").alias(c.header.sql) for c in table.columns), source_text(F.col("_src")).alias("source"))
    return type_violations(named, {c.header.sql: c.type for c in table.columns if c.type}, ["source"])


def source_text(src: Column) -> Column:
    """file:line, or (chain of files):line for an archive's member."""
    files = F.array_join(src["files"], " -> ")
    return F.concat(F.when(F.size(src["files"]) > 1, F.concat(F.lit("("), files, F.lit(")"))).otherwise(files), F.lit(":"), src["line"].cast("string"))


def match_environment(env: DataFrame, patterns: DataFrame, columns: list[str], name: str = "logger", strict: bool = False) -> DataFrame:
    """Each distinct environment with its rows (n_rows), how many patterns match it (n_matches), and the least of them.

    A pattern's nulls match anything. Every file of a logger repeats its
    environment, so rows are counted first and patterns meet each distinct one
    once. With strict an environment that several patterns match raises.
    """
    known = env.groupBy(*env.columns).agg(F.count(F.lit(1)).alias("n_rows"))
    p = small(patterns.select(name, *(F.col(c).alias(f"_p_{c}") for c in columns)).distinct())
    fits = reduce(lambda a, b: a & b, (F.col(f"_p_{c}").isNull() | (F.col(f"_p_{c}") == F.col(c)) for c in columns))
    out = known.join(p, fits, "left").groupBy(*known.columns).agg(F.count(name).alias("n_matches"), F.min(name).alias(name))
    if not strict:
        return out
    several = F.raise_error(F.concat(F.lit("several loggers fit: "), F.to_json(F.struct(*env.columns)))).cast("string")
    return out.withColumn(name, F.when(F.col("n_matches") > 1, several).otherwise(F.col(name)))


def apply_catalog(df: DataFrame, logger: Logger, ts: str) -> DataFrame:
    """Extension: drops rows before the logger's first time and in its ranges to skip. ts is a wall-clock column in UTC."""
    at = F.col(ts)
    out = df
    if logger.min_datetime:
        out = out.filter(at >= F.lit(logger.min_datetime.replace(tzinfo=None)))
    for r in logger.skip_records:
        start, end = (x.replace(tzinfo=None) for x in (r.start, r.end or r.start))
        out = out.filter(~at.between(F.lit(start), F.lit(end)))
    return out
