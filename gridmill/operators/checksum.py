"""Checksum manifests: lines, digests, and reconciling a manifest with files."""

from __future__ import annotations

import hashlib
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalars import common_parent
from ..sources.shared import kept
from ..sources.trees import list_hashable, open_file

# Result codes in order; digest sizes in bytes.
CODES = ("NONE", "SKIP", "NEEDSVALIDATE", "SUMOK", "BADINPUT", "SUMMISMATCH", "NOSUM", "MISSING", "DUPEFN", "UNKNOWN")
ALGORITHMS = {16: "md5", 20: "sha1", 28: "sha224", 32: "sha256", 48: "sha384", 64: "sha512"}


def code_number(name: Column) -> Column:
    return F.element_at(F.create_map(*[x for i, c in enumerate(CODES) for x in (F.lit(c), F.lit(i))]), name)


def code_name(number: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, CODES)), number + 1)


def digest(content: Column, algorithm: str) -> Column:
    """Lower-case hex digest of bytes."""
    if algorithm == "md5":
        return F.md5(content)
    if algorithm == "sha1":
        return F.sha1(content)
    return F.sha2(content, int(algorithm.removeprefix("sha")))


def algorithm_of(hex_digest: Column) -> Column:
    """The algorithm that makes digests of this length; null if none does."""
    return F.try_element_at(F.create_map(*[x for n, a in ALGORITHMS.items() for x in (F.lit(2 * n), F.lit(a))]), F.length(hex_digest))


def digest_as(content: Column, hex_digest: Column) -> Column:
    """The digest of content by the algorithm of another digest."""
    out = F.lit(None).cast("string")
    for n, a in ALGORITHMS.items():
        out = F.when(F.length(hex_digest) == 2 * n, digest(content, a)).otherwise(out)
    return out


def to_line(hsh: Column, fn: Column, binary: Column | None = None) -> Column:
    mark = F.lit("*") if binary is None else F.when(binary, "*").otherwise(" ")
    return F.concat(F.lower(hsh), F.lit(" "), mark, fn)


LINE = r"(?d)\A([0-9A-Fa-f]+) ([ *])(\S.*)\z"


def parse_lines(df: DataFrame, line: str = "value", strict: bool = True, binflag: bool | None = None) -> DataFrame:
    """hsh, binflag (as given, or as in the line), fn, valid (not known yet) of manifest lines.

    Bad lines and digests of no known length raise, or with strict off are dropped; blank lines are passed over.
    """
    hsh = F.lower(F.regexp_extract(line, LINE, 1))
    good = F.col(line).rlike(LINE) & algorithm_of(hsh).isNotNull()
    out = df.filter(F.col(line).rlike(r"\S"))
    if strict:
        wrong = F.raise_error(F.concat(F.lit("bad manifest line: "), F.col(line)))
        out = out.withColumn(line, F.when(good, F.col(line)).otherwise(wrong))
    else:
        out = out.filter(good)
    marked = F.regexp_extract(line, LINE, 2) == "*" if binflag is None else F.lit(binflag)
    return out.select(hsh.alias("hsh"), marked.alias("binflag"), F.regexp_extract(line, LINE, 3).alias("fn"), F.lit(None).cast("boolean").alias("valid"))


def reconcile(sums: DataFrame, files: DataFrame, ignore_path: bool = False) -> DataFrame:
    """Full outer match of sums (ord, fn, hsh) and files (ord, fn, code, msg): fn, code, hsh, msg.

    Files with code SKIP pass through. With ignore_path files meet by their last
    name: later ones of a name are DUPEFN, and the name is UNKNOWN. Of sums that
    repeat wholly the first counts; one with another digest for the same name
    is BADINPUT and makes the name UNKNOWN. Without ignore_path a sum whose name
    is no file is MISSING for each distinct line.
    """
    key = F.element_at(F.split("fn", "/"), -1) if ignore_path else F.col("fn")
    skipped = files.filter("code = 'SKIP'").select("fn", "code", F.lit(None).cast("string").alias("hsh"), "msg")
    # One row for each key and side, from map-side counts, so a name that very many files share stays small.
    plain = files.filter("code <> 'SKIP'").select(key.alias("key"), "fn", "ord")
    left = plain.groupBy("key").agg(F.max_by("fn", "ord").alias("file"), (F.count(F.lit(1)) > 1).alias("doubled"), F.min_by("fn", "ord").alias("first_fn"), F.min("ord").alias("first_ord"))
    again = plain.join(left.filter("doubled").select("key", "first_fn", "first_ord"), "key").filter("ord > first_ord")
    doubled = again.select(F.col("key").alias("fn"), F.lit("DUPEFN").alias("code"), F.lit(None).cast("string").alias("hsh"), F.format_string("one name for %s and %s", "first_fn", "fn").alias("msg"))
    left = left.drop("first_fn", "first_ord")
    lines = sums.groupBy("fn", "hsh").agg(F.min("ord").alias("ord")).withColumn("key", key)
    first = lines.groupBy("key").agg(F.min_by("hsh", "ord").alias("first_hsh"), F.min_by("fn", "ord").alias("line_fn"), (F.min("hsh") != F.max("hsh")).alias("differs"))
    met = left.join(first, "key", "full_outer")
    present, expected = F.col("file").isNotNull(), F.col("first_hsh").isNotNull()
    code = (
        F.when(present & expected, F.when(F.coalesce("doubled", F.lit(False)) | F.col("differs"), "UNKNOWN").otherwise("NEEDSVALIDATE")).when(present, "NOSUM").otherwise("MISSING")
    )
    hsh = F.when(code == "NEEDSVALIDATE", F.col("first_hsh"))
    matched = met.filter(present | F.lit(ignore_path)).select(
        F.coalesce("file", "key").alias("fn"), code.alias("code"), hsh.alias("hsh"), F.when(code == "MISSING", F.lit("no such file")).alias("msg")
    )
    facts = lines.join(first, "key").join(left.select("key", "file"), "key", "left")
    known = F.col("file").isNotNull() | F.lit(ignore_path)
    bad = facts.filter(known & (F.col("hsh") != F.col("first_hsh"))).select(
        F.col("key").alias("fn"), F.lit("BADINPUT").alias("code"), F.lit(None).cast("string").alias("hsh"), F.format_string("two digests for one name: %s and %s", "first_hsh", "hsh").alias("msg")
    )
    out = skipped.unionByName(doubled).unionByName(matched).unionByName(bad)
    if not ignore_path:
        lost = facts.filter("file is null").select("fn", F.lit("MISSING").alias("code"), F.lit(None).cast("string").alias("hsh"), F.lit("no file of this name").alias("msg"))
        out = out.unionByName(lost)
    return out


def validate(results: DataFrame, contents: DataFrame) -> DataFrame:
    """NEEDSVALIDATE rows become SUMOK or SUMMISMATCH by the contents (fn, content); others pass. One row out for each row in."""
    held = results.join(contents.select("fn", "content"), "fn", "left")
    got = F.when(F.col("code") == "NEEDSVALIDATE", digest_as(F.col("content"), F.col("hsh")))
    checked = held.withColumn("got", got)
    asked = F.col("code") == "NEEDSVALIDATE"
    return checked.select(
        "fn",
        F.when(asked & (F.col("got") == F.col("hsh")), "SUMOK").when(asked, "SUMMISMATCH").otherwise(F.col("code")).alias("code"),
        "hsh",
        F.when(asked & (F.col("got") != F.col("hsh")), F.format_string("digest is %s, listed is %s", "got", "hsh")).otherwise(F.col("msg")).alias("msg"),
    )


def _file_digest(path: str, algorithm: str) -> str:
    """Digest of a file of any size, read in parts."""
    made = hashlib.new(algorithm)
    with open_file(path) as f:
        while part := f.read(1 << 20):
            made.update(part)
    return made.hexdigest()


@F.pandas_udf(T.StringType())
def file_digest(path: pd.Series, algorithm: pd.Series) -> pd.Series:
    """Digest of each file; null where no algorithm is asked for, so such files are not read."""
    return pd.Series([None if a is None or p is None else _file_digest(p, a) for p, a in zip(path, algorithm, strict=True)], dtype=object)


def _spread(df: DataFrame) -> DataFrame:
    """Files dealt to all tasks before they are read."""
    return df.repartition(F.col("fn"))


def hash_files(results: DataFrame, algorithm: str = "sha512", check_code: bool = True) -> DataFrame:
    """Results (fn, origfn, code, and hsh, valid if there are any) with hsh, valid and hashed, the name for the manifest.

    Rows of code SKIP stay as they are; codes other than NONE and SUMOK raise.
    A valid digest of the same algorithm is kept without reading the file. With
    check_code off every row is hashed.
    """
    df = results
    for name, kind in (("hsh", "string"), ("valid", "boolean")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    skip = F.lit(check_code) & (F.col("code") == "SKIP")
    wrong = F.lit(check_code) & ~F.col("code").isin("SKIP", "NONE", "SUMOK")
    has = F.coalesce(F.col("valid") & (algorithm_of(F.col("hsh")) == algorithm), F.lit(False))
    asked = F.when(wrong, F.raise_error(F.concat(F.lit("cannot hash a result of code "), "code"))).when(~skip & ~has, F.lit(algorithm))
    df = _spread(df).withColumn("got", file_digest(F.col("fn"), asked))
    new = F.col("got").isNotNull()
    return df.withColumns({"hashed": F.when(new, F.col("origfn")), "valid": F.when(new, F.lit(True)).otherwise(F.col("valid")), "hsh": F.coalesce("got", "hsh")}).drop("got")


def validate_files(hashed: DataFrame, force: bool = False, fail_soft: bool = False) -> DataFrame:
    """Manifest entries (fn, hsh, valid, ...) with valid as the files say, and got, the digest found.

    What is valid already is not read again unless forced. An entry that fails
    raises; with fail_soft it comes back with valid false.
    """
    kept = F.coalesce(F.col("valid"), F.lit(False)) & ~F.lit(force)
    df = _spread(hashed).withColumn("got", file_digest(F.col("fn"), F.when(~kept, algorithm_of(F.col("hsh")))))
    df = df.withColumn("got", F.when(kept, F.col("hsh")).otherwise(F.col("got")))
    same = F.col("got") == F.lower("hsh")
    wrong = F.raise_error(F.concat(F.lit("failed to validate "), "fn", F.lit(": listed is "), "hsh", F.lit(", found is "), "got")).cast("boolean")
    return df.withColumn("valid", F.when(same, F.lit(True)).otherwise(F.lit(False) if fail_soft else wrong))


def rehash(hashed: DataFrame, algorithm: str | None = None) -> DataFrame:
    """Manifest entries with the digest their files have now, by their own algorithm or another one."""
    asked = F.lit(algorithm) if algorithm else algorithm_of(F.col("hsh"))
    return _spread(hashed).withColumn("hsh", file_digest(F.col("fn"), asked)).withColumn("valid", F.lit(True))


def check_hashes(results: DataFrame) -> DataFrame:
    """As validate(), by the files themselves, of any size: one row out for each row in."""
    asked = F.col("code") == "NEEDSVALIDATE"
    df = _spread(results).withColumn("got", file_digest(F.col("fn"), F.when(asked, algorithm_of(F.col("hsh")))))
    same = F.col("got") == F.lower("hsh")
    said = F.when(asked & ~same, F.format_string("digest is %s, listed is %s", "got", "hsh")).otherwise(F.col("msg"))
    return df.withColumns({"code": F.when(asked & same, "SUMOK").when(asked, "SUMMISMATCH").otherwise(F.col("code")), "msg": said}).drop("got")


def match_files(spark: SparkSession, sums: DataFrame, paths: list[str], ignore_path: bool = False, report_dirs: bool = False) -> DataFrame:
    """reconcile() of manifest entries (ord, fn, hsh) with the files below all paths.

    Relative names are meant below the deepest folder that holds all paths;
    names are resolved, so other spellings and links to a file's folder meet it.
    """
    if not paths:
        raise ValueError("no paths are given")
    parent = common_parent([os.path.realpath(p, strict=True) for p in paths])
    if not os.path.isdir(parent):
        parent = os.path.dirname(parent)

    @F.pandas_udf("string")
    def resolved(names: pd.Series) -> pd.Series:
        def one(name: str) -> str:
            whole = os.path.join(parent, name)
            return os.path.realpath(whole) if os.path.exists(whole) else whole

        return names.map(one)

    # The tree is listed once, and names are resolved once: both sides are read several times below.
    files = kept(list_hashable(spark, paths, report_dirs).withColumn("ord", F.monotonically_increasing_id()), "listing")
    return reconcile(sums if ignore_path else kept(sums.withColumn("fn", resolved("fn")), "sums"), files, ignore_path)


def generate_manifest(contents: DataFrame, algorithm: str = "sha512", sort: str = "NO_SORT") -> DataFrame:
    """value: manifest lines of (fn, content, and ord if there is one), in an order of sorted_entries()."""
    rest = ["ord"] if "ord" in contents.columns else []
    return manifest_of(contents.select("fn", *rest, digest(F.col("content"), algorithm).alias("hsh")), sort)


def sorted_entries(hashed: DataFrame, sort: str = "NO_SORT") -> DataFrame:
    """Manifest entries (fn, hsh, ...) sorted BY_LINE (digest, name), BY_HASH, BY_FILE or BY_PATH (part by part).

    Equal ones keep their order: by ord, or else by name.
    """
    last = "ord" if "ord" in hashed.columns else "fn"
    orders = {"NO_SORT": [], "BY_LINE": ["hsh", "fn", last], "BY_HASH": ["hsh", last], "BY_FILE": ["fn", last], "BY_PATH": [F.split("fn", "/"), last]}
    if sort not in orders:
        raise ValueError(f"no such order: {sort}")
    return hashed.orderBy(*orders[sort]) if orders[sort] else hashed


def manifest_of(hashed: DataFrame, sort: str = "NO_SORT") -> DataFrame:
    binary = F.col("binflag") if "binflag" in hashed.columns else None
    return sorted_entries(hashed, sort).select(to_line(F.col("hsh"), F.col("fn"), binary).alias("value"))


def write_manifest(lines: DataFrame, path: str) -> int:
    """Write manifest lines to one file, in their order, through this process; returns how many."""
    n = 0
    with open(path, "x", encoding="utf-8", newline="\n") as f:
        for n, row in enumerate(lines.toLocalIterator(), 1):  # noqa: B007
            f.write(row["value"] + "\n")
    return n


#: Ranges into which rows are dealt to number them, and keys looked at to find their borders, about.
RANGES, LOOKED_AT = 256, 20_000


def with_ordinal(df: DataFrame, columns: list[str], out: str = "ordinal") -> DataFrame:
    """Adds each row's place in the order of columns, from 1, without gathering the rows in one task.

    Borders of ranges come from the keys of lowest hash, so every evaluation
    finds the same ones; rows are numbered inside a range, and only the ranges'
    counts are summed up in one place.
    """
    key = F.struct(*columns)
    total = df.count()
    if total > LOOKED_AT:
        low = df.filter(F.pmod(F.xxhash64(*columns), F.lit(total // LOOKED_AT)) == 0)
        border = low.select(key.alias("k")).distinct().orderBy("k").collect()  # LOOKED_AT rows, about
        borders = [border[len(border) * i // RANGES]["k"] for i in range(1, RANGES)] if len(border) > RANGES else []
    else:
        borders = []
    kinds = [df.schema[c].dataType.simpleString() for c in columns]
    listed = F.array(*(F.struct(*(F.lit(v).cast(t).alias(c) for v, t, c in zip(b, kinds, columns, strict=True))) for b in borders))
    ranged = df.withColumn("_range", F.size(F.filter(listed, lambda b: b <= key)) if borders else F.lit(0))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    skipped = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*columns))
    return ranged.withColumn("_inside", inside).join(skipped, "_range").withColumn(out, F.col("_skip") + F.col("_inside")).drop("_range", "_inside", "_skip")
