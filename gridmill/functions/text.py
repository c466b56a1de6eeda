"""Unicode profiles of texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Control characters beyond TAB, CR, LF and NUL; bytes that Windows-1252 lacks.
CONTROLS = r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
CP1252_GAPS = "81|8D|8F|90|9D"
COMMON_ASCII = r"\A(?:[\t\n\r\x20-\x7E]|\r\n)\z"


def graphemes(text: Column) -> Column:
    """Extended grapheme clusters in order."""
    return F.regexp_extract_all(text, F.lit(r"(?s)\X"), F.lit(0))


def is_common_ascii(cluster: Column) -> Column:
    return cluster.rlike(COMMON_ASCII)


def uncommon(text: Column, allowed: list[str] | None = None) -> Column:
    """Sorted distinct clusters that are neither common ASCII nor allowed."""
    strange = F.filter(graphemes(text), lambda g: ~is_common_ascii(g))
    return F.array_sort(F.array_except(F.array_distinct(strange), F.array(*map(F.lit, allowed or [])).cast("array<string>")))


def control_counts(text: Column) -> dict[str, Column]:
    """Counts of lone CR, lone LF, CRLF, NUL and other control characters."""
    patterns = {"cr": r"\r(?!\n)", "lf": r"(?<!\r)\n", "crlf": r"\r\n", "nul": r"\x00", "ctrl": CONTROLS}
    return {k: F.regexp_count(text, F.lit(p)).cast("long") for k, p in patterns.items()}


def control_report(text: Column) -> Column:
    """The counts that are not zero as text; more than one kind of line end is said to be mixed."""
    n = control_counts(text)
    kinds = sum((n[k] > 0).cast("int") for k in ("cr", "lf", "crlf"))
    named = [("cr", "CR"), ("lf", "LF"), ("crlf", "CRLF"), ("nul", "NUL"), ("ctrl", "control")]
    parts = [F.when(n[k] > 0, F.concat(n[k].cast("string"), F.lit(f" {name}"))) for k, name in named]
    return F.concat_ws(", ", *parts, F.when(kinds > 1, "MIXED CR/LF"))


def decodable(data: Column) -> Column:
    """The usual encodings that decode the bytes strictly, in order of trial."""
    pairs = F.hex(data)
    bytes_like = lambda one: pairs.rlike(rf"\A(?:{one})*\z")
    ascii_only = bytes_like("[0-7][0-9A-F]")
    cp1252 = bytes_like(rf"(?!{CP1252_GAPS})[0-9A-F]{{2}}")
    tests = [("ASCII", ascii_only), ("UTF-8", F.is_valid_utf8(data.cast("string"))), ("ISO-8859-1", F.lit(True)), ("CP1252", cp1252)]
    return F.array_compact(F.array(*(F.when(t, name) for name, t in tests)))


def first_encoding(data: Column) -> Column:
    return F.try_element_at(decodable(data), F.lit(1))


def decodable_as(encodings: list[str]):
    """Arrow UDF like decodable() for any list of encodings Python knows."""

    def tried(data: bytes | None) -> list[str]:
        out = []
        for name in encodings:
            try:
                (data or b"").decode(name)
                out.append(name)
            except UnicodeDecodeError:
                continue
        return out

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def udf(column: pd.Series) -> pd.Series:
        return column.map(tried)

    return udf


def _named(text: str | None) -> str | None:
    return None if text is None else " + ".join(f"U+{ord(c):04X} {unicodedata.name(c, '(unnamed)')}" for c in text)


@F.pandas_udf(T.StringType())
def character_names(column: pd.Series) -> pd.Series:
    """Code points with their names, which no built-in function has."""
    return column.map(_named)


@F.pandas_udf(T.StringType())
def composed(column: pd.Series) -> pd.Series:
    """Normal form C."""
    return column.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def casefold(column: pd.Series) -> pd.Series:
    return column.map(lambda x: None if x is None else x.casefold())
