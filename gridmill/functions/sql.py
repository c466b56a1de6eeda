"""The library's functions for plain SQL, as temporary SQL functions that the optimizer sees through."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quality, scalars, text
from .types import CANDIDATES, Num, _facts, _number


def sql_of(spark: SparkSession, column: Column, arguments: str) -> str:
    """SQL text of a column expression over arguments (name type, ...); not for expressions with lambda functions."""
    plan = spark.createDataFrame([], arguments).select(column.alias("out"))._jdf.queryExecution().analyzed()
    return plan.expressions().head().child().sql()


_DURATION = r"""CASE WHEN x IS NULL THEN NULL WHEN x RLIKE r'\A\s+\z' THEN 0
 WHEN x RLIKE r'\A\s*(?:[0-9]+\s*[dhmsDHMS]?(?:(?<=[dhmsDHMS])\s*|\s+|\s*\z))+\z' THEN aggregate(regexp_extract_all(x, r'([0-9]+)\s*([dhmsDHMS]?)', 0), 0L,
  (a, p) -> a + cast(regexp_extract(p, '[0-9]+', 0) AS BIGINT) * CASE lower(regexp_extract(p, '[A-Za-z]', 0)) WHEN 'd' THEN 86400 WHEN 'h' THEN 3600 WHEN 'm' THEN 60 ELSE 1 END) END"""


def _inference(spark: SparkSession) -> str:
    """The narrowest type of all values of an array: as infer_type() finds it for a column."""
    facts = {k: sql_of(spark, c, "v STRING") for k, c in _facts(F.col("v"), _number(F.col("v"))).items()}
    largest = lambda e: f"array_max(transform(xs, v -> {e}))"
    scale, digits = largest(facts["scale"]), largest(f"({facts['whole']}) + ({facts['scale']})")
    named = f"CASE WHEN {scale} > 0 THEN concat('Num(', {digits}, ',', {scale}, ')') ELSE concat('Num(', {digits}, ')') END"
    cases = " ".join(f"WHEN forall(xs, v -> {facts[f'fits_{i}']}) THEN " + (named if isinstance(t, Num) else f"'{t!r}'") for i, t in enumerate(CANDIDATES))
    return f"CASE WHEN size(xs) = 0 THEN NULL {cases} END"


def register_sql(spark: SparkSession) -> None:
    """Register deltaparse, lsb_obo, basic_quality, control_char_report, infer_reftype and others for this session's SQL."""
    x = F.col("x")
    made = {
        "epoch_text(x BIGINT) RETURNS STRING": sql_of(spark, scalars.epoch_text(x), "x BIGINT"),
        "grapheme_clusters(x STRING) RETURNS ARRAY<STRING>": r"regexp_extract_all(x, r'(?s)\X', 0)",
        "path_basename(x STRING) RETURNS STRING": "element_at(split(x, '/'), -1)",
        "deltaparse(x STRING) RETURNS BIGINT": _DURATION,
        "lsb_obo(a STRING, b STRING) RETURNS BOOLEAN": sql_of(spark, scalars.lsb_obo(F.col("a"), F.col("b")), "a STRING, b STRING"),
        "basic_quality(x STRING) RETURNS STRING": sql_of(spark, quality.basic_quality(x, T.StringType()), "x STRING"),
        "basic_quality_number(x DOUBLE) RETURNS STRING": sql_of(spark, quality.basic_quality(x, T.DoubleType()), "x DOUBLE"),
        "control_char_report(x STRING) RETURNS STRING": sql_of(spark, text.control_report(x), "x STRING"),
        "infer_reftype(xs ARRAY<STRING>) RETURNS STRING": _inference(spark),
    }
    for signature, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
