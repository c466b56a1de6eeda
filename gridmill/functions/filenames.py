"""Audit of file names: names Windows refuses, unusual characters, names that differ in case alone."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.trees import ArchiveDataSource
from .text import graphemes

# Device names and characters that Windows reserves; letters of languages that may be allowed.
DEVICES = "CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]"
RESERVED = r'[<>:"/\\|?*\x00-\x1F]'
# French is without its ligature of a and e, which is rarer there than in wrongly decoded text.
GERMAN, FRENCH, SPANISH = list("äüöÄÜÖßẞÉé"), list("ÀàÂâÇçÉéÈèÊêËëÎîÏïÔôŒœÙùÛûÜüŸÿ"), list("ÑñáéíóúýüÁÉÍÓÚÝÜ")


def bad_on_windows(name: Column) -> Column:
    return name.rlike(rf"(?i)\A(?:{DEVICES})(?:\.|\z)") | name.rlike(RESERVED) | name.rlike(r"[ .]\z")


def strange_characters(name: Column, allowed: list[str] | None = None) -> Column:
    """Sorted distinct clusters beyond printable ASCII and the allowed ones."""
    strange = F.filter(graphemes(name), lambda g: ~g.rlike(r"\A[\x20-\x7E]\z"))
    return F.array_sort(F.array_except(F.array_distinct(strange), F.array(*map(F.lit, allowed or [])).cast("array<string>")))


def case_collisions(df: DataFrame, name: str, ordinal: str, location: list[str]) -> DataFrame:
    """Rows of which an upper, lower or folded form was one of an earlier row's in the same location, with those forms."""
    forms = F.array_distinct(F.array(F.upper(name), F.lower(name), F.lower(F.upper(F.col(name)))))
    each = df.select(*location, ordinal, name, F.explode(forms).alias("form"))
    seen = F.min(ordinal).over(Window.partitionBy(*location, "form")) < F.col(ordinal)
    hits = each.withColumn("seen", seen).filter("seen")
    return hits.groupBy(*location, ordinal, name).agg(F.array_sort(F.collect_set("form")).alias("forms"))


def name_problems(df: DataFrame, name: str, ordinal: str, location: list[str], allowed: list[str] | None = None) -> DataFrame:
    """location, ordinal, name, problem: a bad name or else its strange characters, then its collisions."""
    own = F.when(bad_on_windows(F.col(name)), F.lit("bad Windows name")).when(
        F.size(strange_characters(F.col(name), allowed)) > 0, F.concat(F.lit("characters: "), F.array_join(strange_characters(F.col(name), allowed), " "))
    )
    first = df.select(*location, ordinal, name, own.alias("problem")).filter(F.col("problem").isNotNull())
    second = case_collisions(df, name, ordinal, location).select(*location, ordinal, name, F.concat(F.lit("case collision: "), F.array_join("forms", ", ")).alias("problem"))
    return first.unionByName(second)


def audit_entries(entries: DataFrame, ignore_compressed: bool = False, ignore_symlinks: bool = False, allowed: list[str] | None = None) -> DataFrame:
    """names, problem of entries (names, kind) as the archive_entries source gives them.

    Judged are an entry's kind, its name (inside an archive every part of its
    name), and whether a form of its name in another case is that of an entry
    before it, by name, in the same place.
    """
    last, packed = F.element_at("names", -1), F.size("names") > 1
    df = entries.filter(~packed) if ignore_compressed else entries
    df = df.select("names", "kind", last.alias("name"), F.when(packed, F.slice("names", F.lit(1), F.size("names") - 1)).otherwise(F.array().cast("array<string>")).alias("place"))
    parts = F.when(F.size("names") > 1, F.filter(F.split("name", "/"), lambda x: x != "")).otherwise(F.array(F.element_at(F.split("name", "/"), -1)))
    odd = ~F.col("kind").isin("file", "directory", "archive") & (~F.lit(ignore_symlinks) | (F.col("kind") != "symlink"))
    kinds = df.filter(odd).select("names", F.col("kind").alias("problem"))
    each = df.select("names", F.explode(F.array_distinct(parts)).alias("part"))
    strange = strange_characters(F.col("part"), allowed)
    said = F.when(bad_on_windows(F.col("part")), F.concat(F.lit("bad Windows name: "), "part")).when(F.size(strange) > 0, F.concat(F.lit("characters: "), F.array_join(strange, " ")))
    named = each.select("names", said.alias("problem")).filter(F.col("problem").isNotNull())
    clashes = case_collisions(df.select("place", "name", "names"), "name", "names", ["place"])
    return kinds.unionByName(named).unionByName(clashes.select("names", F.concat(F.lit("case collision: "), F.array_join("forms", ", ")).alias("problem")))


def audit_tree(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Problems of all names below the paths and inside archives; options as for audit_entries()."""
    spark.dataSource.register(ArchiveDataSource)
    return audit_entries(spark.read.format("archive_entries").option("paths", json.dumps(paths)).option("content", "false").load(), **options)
