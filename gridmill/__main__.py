"""Command line: python -m gridmill infer|check|delta|json|catalog|manifest|verify|names|text ..."""

from __future__ import annotations

import argparse
import glob
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import filenames, scalars, text
from .functions.types import infer_type, parse_type
from .operators import checksum
from .plans.catalog import load_logger
from .plans.jsonschema_subset import load_schema, validate_json
from .sources.trees import list_hashable


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines without the white space around them, of every kind."""
    return spark.read.text(paths).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("value"))


def _expanded(paths: list[str]) -> list[str]:
    """Paths with patterns filled in; none at all is the current folder."""
    return [x for p in paths for x in (sorted(glob.glob(p)) or [p])] or ["."]


def _show(df: DataFrame) -> int:
    n = 0
    for n, row in enumerate(df.toLocalIterator(), 1):  # noqa: B007
        print(*(x for x in row if x is not None), sep="\t")
    return n


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridmill", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, about, *more in (
        ("infer", "narrowest type of all lines", "paths"),
        ("check", "lines that are not of a type", "type", "paths"),
        ("delta", "seconds of durations", "paths"),
        ("json", "whether documents fit a schema", "schema", "paths"),
        ("catalog", "whether catalogs are sound", "paths"),
        ("manifest", "checksum lines of files and folders", "paths"),
        ("verify", "files and folders against a manifest", "manifest", "paths"),
        ("names", "problems of file names below folders and in archives", "paths"),
        ("text", "encodings and control characters of files below a folder", "folder"),
    ):
        command = commands.add_parser(name, help=about)
        for m in more:
            command.add_argument(m, nargs=("*" if name in ("manifest", "verify", "names") else "+") if m == "paths" else None)
        if name == "manifest":
            command.add_argument("--algorithm", default="sha512", choices=list(checksum.ALGORITHMS.values()))
            command.add_argument("--sort", default="NO_SORT", choices=["NO_SORT", "BY_LINE", "BY_HASH", "BY_FILE", "BY_PATH"])
            command.add_argument("-o", "--outfile", help="write there instead, to a new file")
        if name == "verify":
            command.add_argument("-p", "--ignorepath", action="store_true", help="match files by their last name alone")
        if name == "names":
            command.add_argument("-L", "--ignore-symlinks", action="store_true")
            command.add_argument("-Z", "--ignore-compressed", action="store_true")
            command.add_argument("-a", "--allowed-chars", action="append", default=[], help="characters that are allowed beyond ASCII")
            for language in ("german", "french", "spanish"):
                command.add_argument(f"--{language}", action="store_true", help=f"allow the letters of {language.title()}")
        if name == "text":
            command.add_argument("--size-limit", type=int, default=10_000_000)
    given = parser.parse_args(args)
    if given.command == "json":
        schema = load_schema(given.schema)
        bad = [p for p in given.paths if validate_json(schema, p) is None]
        print(*bad, sep="\n")
        return int(bool(bad))
    if given.command == "catalog":
        for p in given.paths:
            print(p, load_logger(p).name)
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "infer":
        found = infer_type(_lines(spark, given.paths), "value").first()["reftype"]
        print(found)
        return int(found is None)
    if given.command == "check":
        return int(_show(_lines(spark, given.paths).filter(~parse_type(given.type).check(F.col("value")))) > 0)
    if given.command == "delta":
        _show(_lines(spark, given.paths).select("value", scalars.deltaparse(F.col("value"), strict=True)))
        return 0
    if given.command == "manifest":
        files = list_hashable(spark, _expanded(given.paths)).withColumn("ord", F.monotonically_increasing_id())
        hashed = checksum.hash_files(files, given.algorithm).filter("code <> 'SKIP'").select(F.col("hashed").alias("fn"), "hsh", "ord")
        lines = checksum.manifest_of(hashed, given.sort)
        n = checksum.write_manifest(lines, given.outfile) if given.outfile else _show(lines)
        print(f"{n} digests", file=sys.stderr)
        return 0
    if given.command == "verify":
        sums = checksum.parse_lines(spark.read.text(given.manifest)).withColumn("ord", F.monotonically_increasing_id())
        results = checksum.check_hashes(checksum.match_files(spark, sums, _expanded(given.paths), given.ignorepath))
        return int(_show(results.filter("code not in ('SUMOK', 'SKIP')")) > 0)
    if given.command == "names":
        letters = [c for language in ("german", "french", "spanish") if getattr(given, language) for c in getattr(filenames, language.upper())]
        found = filenames.audit_tree(spark, _expanded(given.paths), ignore_compressed=given.ignore_compressed, ignore_symlinks=given.ignore_symlinks, allowed=[*"".join(given.allowed_chars), *letters])
        return int(_show(found.select(F.array_join("names", " -> "), "problem")) > 0)
    small = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(given.folder).filter(F.col("length") <= given.size_limit)
    known = small.select("path", F.array_join(text.decodable(F.col("content")), ",").alias("encodings"), F.when(F.is_valid_utf8(F.col("content").cast("string")), text.control_report(F.col("content").cast("string"))))
    _show(known)
    return 0


if __name__ == "__main__":
    sys.exit(main())
