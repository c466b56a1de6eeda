"""TOA5 logger files as a Spark data source, matched against a catalog.

    spark.dataSource.register(Toa5DataSource)
    spark.read.format("toa5").option("catalog", json).option("table", "Hourly").load(folder)

Small files share a partition; rows have the table's columns as strings (absent
ones null) and a provenance struct. Files are listed and read through Hadoop's
file systems only where a plain path is not given: see read_toa5().
"""

from __future__ import annotations

import csv
import glob
import io
import json
import os
import warnings
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.catalog import ENVIRONMENT, Header, Logger, Table, load_logger
from .trees import given_paths, open_file

#: Bytes of files that one task reads, about.
TASK_BYTES = 64_000_000
# Status tables that such loggers keep.
STATUS_TABLES = ("DataTableInfo", "Public", "Status")


class Toa5Error(RuntimeError):
    """The header is not that of a TOA5 file."""


class DataImportError(RuntimeError):
    """A file does not fit the catalog."""


class NoMetadataMatch(DataImportError):
    pass


class NoTableMatch(DataImportError):
    def __init__(self, what: str, logger: Logger | None = None, table: str = ""):
        super().__init__(what)
        self.logger, self.table = logger, table


class NoVariantMatch(DataImportError):
    pass


class RecordError(DataImportError):
    """A row is broken."""


def read_header(rows: Iterator[list[str]]) -> tuple[dict[str, str], tuple[Header, ...]]:
    """Environment and columns from the first four rows of a strict CSV reader."""
    head: list[list[str]] = []
    for what in ("environment line", "names", "units", "processes"):
        try:
            head.append(next(rows))
        except StopIteration:
            raise Toa5Error(f"the file ends before its {what}") from None
        except csv.Error as e:
            raise Toa5Error(f"{what}: {e}") from e
        if len(head) == 1 and (len(head[0]) != 1 + len(ENVIRONMENT) or head[0][0] != "TOA5"):
            raise Toa5Error("no TOA5 environment line")
    names, units, processes = head[1:]
    if not len(names) == len(units) == len(processes):
        raise Toa5Error("header rows differ in length")
    if len(set(names)) < len(names):
        raise Toa5Error("a column name repeats")
    return dict(zip(ENVIRONMENT, head[0][1:], strict=True)), tuple(map(Header, names, units, processes))


def match_header(env: dict[str, str], columns: tuple[Header, ...], loggers: Iterable[Logger]) -> tuple[Table, tuple[int, ...]]:
    """The table, and the place in it of each of the file's columns."""
    fitting = [x for x in loggers if x.matches(env)]
    if not fitting:
        raise NoMetadataMatch(f"no logger fits {env}")
    if len(fitting) > 1:
        raise RuntimeError(f"several loggers fit {env}: {[x.name for x in fitting]}")
    table = fitting[0].tables.get(env["table_name"])
    if table is None:
        raise NoTableMatch(f"logger {fitting[0].name} has no table {env['table_name']}", fitting[0], env["table_name"])
    if columns not in table.layouts:
        raise NoVariantMatch(f"no layout of {table.ident} has these columns: {[c.csv for c in columns]}")
    return table, table.layouts[columns]


def decide_filetype(name: str, head: bytes) -> str:
    """TOA5, CSV or UNKNOWN (with a warning), by the name's ending and the first bytes."""
    if name.lower().endswith(".csv"):
        return "CSV"
    if name.lower().endswith(".dat") and head.startswith((b'"TOA5",', b"TOA5,")):
        return "TOA5"
    warnings.warn(f"unknown kind of file: {name}", stacklevel=2)
    return "UNKNOWN"


ENV_TYPE = T.StructType([T.StructField(k, T.StringType()) for k in ENVIRONMENT])
SOURCE_TYPE = T.StructType([T.StructField("files", T.ArrayType(T.StringType())), T.StructField("line", T.IntegerType()), T.StructField("filetype", T.StringType()), T.StructField("env", ENV_TYPE)])


def records_of(files: list[str], data: bytes, loggers: list[Logger], mode: str = "FAILFAST", skip_other_tables: bool = True) -> Iterator[tuple[Table, list, tuple, str | None]]:
    """Table, full row, provenance, and the error of a broken row, for all rows of one file.

    Files of tables that the catalog lacks are passed over with
    skip_other_tables; unknown loggers and layouts are always errors. With mode
    PERMISSIVE broken rows come back empty with their error.
    """
    kind = decide_filetype(files[-1], data[:8])
    if kind == "CSV":
        raise NotImplementedError("plain CSV files have no reader yet")
    if kind != "TOA5":
        return
    # Read as Latin-1, so that a byte beyond ASCII breaks its own row only.
    rows = csv.reader(io.StringIO(data.decode("latin-1"), newline=""), strict=True)
    env, columns = read_header(rows)
    if not all(x.isascii() for c in columns for x in (c.name, c.unit, c.prc)) or not all(map(str.isascii, env.values())):
        raise Toa5Error("the header is not ASCII")
    try:
        table, layout = match_header(env, columns, loggers)
    except NoTableMatch:
        if skip_other_tables:
            return
        raise
    names = [env[k] for k in ENVIRONMENT]
    while True:
        error, broken, full = None, False, [None] * len(table.columns)
        try:
            row = next(rows)
            if len(row) != len(layout):
                raise RecordError(f"{files}:{rows.line_num}: {len(row)} fields, not {len(layout)}")
            if not all(map(str.isascii, row)):
                raise RecordError(f"{files}:{rows.line_num}: not ASCII")
            for place, value in zip(layout, row, strict=True):
                full[place] = value
        except StopIteration:
            return
        except (csv.Error, RecordError) as e:
            if mode != "PERMISSIVE":
                raise e if isinstance(e, RecordError) else RecordError(f"{files}:{rows.line_num}: {e}") from e
            error, broken = str(e), isinstance(e, csv.Error)
        yield table, full, (files, rows.line_num, "TOA5", tuple(names)), error
        if broken:  # the reader cannot tell where the next row starts
            return


def file_rows(files: list[str], data: bytes, loggers: list[Logger], table: Table, mode: str = "FAILFAST", skip_other_tables: bool = True) -> Iterator[tuple]:
    """Rows of one file that belong to the table: its columns, provenance, error."""
    for found, full, source, error in records_of(files, data, loggers, mode, skip_other_tables):
        if found is not table and found.ident != table.ident:
            return
        yield (*full, source, error)


def row_schema(table: Table) -> T.StructType:
    """String columns of the table by physical name, provenance, error."""
    return T.StructType([*(T.StructField(c.name, T.StringType()) for c in table.columns), T.StructField("_src", SOURCE_TYPE), T.StructField("_error", T.StringType())])


class Toa5DataSource(DataSource):
    """Options: catalog (JSON text or a list of them), table, mode; path is a file, folder or pattern, or paths a JSON list of such."""

    @classmethod
    def name(cls) -> str:
        return "toa5"

    def _setup(self) -> tuple[list[Logger], Table]:
        js = json.loads(self.options["catalog"])
        loggers = [load_logger(x) for x in (js if isinstance(js, list) else [js])]
        wanted = self.options["table"]
        found = [t for x in loggers for t in x.tables.values() if wanted in (t.name, t.ident)]
        if len(found) != 1:
            raise ValueError(f"{len(found)} tables are called {wanted!r}")
        return loggers, found[0]

    def schema(self) -> T.StructType:
        return row_schema(self._setup()[1])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Toa5Reader(self.options, *self._setup())


class _Toa5Reader(DataSourceReader):
    def __init__(self, options: dict, loggers: list[Logger], table: Table):
        self.paths, self.mode = given_paths(options), options.get("mode", "FAILFAST").upper()
        self.loggers, self.table = loggers, table

    def partitions(self) -> list[InputPartition]:
        inside = lambda path: [os.path.join(d, f) for d, _, names in os.walk(path) for f in names] if os.path.isdir(path) else glob.glob(path)
        found = {os.path.realpath(f) for path in self.paths for f in inside(path)}
        out, held = [[]], 0
        for f in sorted(found):
            if out[-1] and held + os.path.getsize(f) > TASK_BYTES:
                out.append([])
                held = 0
            out[-1].append(f)
            held += os.path.getsize(f)
        return [InputPartition(x) for x in out]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for name in partition.value:
            with open(name, "rb") as f:
                yield from file_rows([name], f.read(), self.loggers, self.table, self.mode)


def read_toa5(spark: SparkSession, path: str | list[str], logger: Logger, table: Table, mode: str = "FAILFAST") -> DataFrame:
    """Rows of all files under any path, or paths, Spark reads: contents come as binary files, parsed in Arrow batches."""
    schema = row_schema(table)

    def parse(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = [r for p, c in zip(batch["path"], batch["content"], strict=True) for r in file_rows([p], c, [logger], table, mode)]
            yield pd.DataFrame(rows, columns=schema.names)

    logger_free = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return logger_free.mapInPandas(parse, schema)


RECORDS = T.StructType([T.StructField("table", T.StringType()), T.StructField("fullrow", T.ArrayType(T.StringType())), T.StructField("_src", SOURCE_TYPE), T.StructField("_error", T.StringType())])


def read_records(spark: SparkSession, paths: str | list[str], loggers: list[Logger], mode: str = "FAILFAST", typecheck: bool = True) -> DataFrame:
    """table, fullrow, _src, _error of all rows of all tables, each file being read once.

    With typecheck a cell that fails its declared type raises, or with mode
    PERMISSIVE makes its row's _error.
    """

    def parse(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = [(t.ident, full, src, error) for p, c in zip(batch["path"], batch["content"], strict=True) for t, full, src, error in records_of([p], c, loggers, mode)]
            yield pd.DataFrame(rows, columns=RECORDS.names)

    given = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(given).select("path", "content")
    out = files.mapInPandas(parse, RECORDS)
    if not typecheck:
        return out
    wrong = F.lit(None).cast("string")
    for t in (t for x in loggers for t in x.tables.values()):
        cells = [F.when(F.col("fullrow")[i].isNotNull() & ~c.type.check(F.col("fullrow")[i]), F.concat(F.lit(f"{c.name} is no {c.type!r}: "), F.col("fullrow")[i])) for i, c in enumerate(t.columns) if c.type]
        if cells:
            wrong = F.when(F.col("table") == t.ident, F.coalesce(*cells, wrong)).otherwise(wrong)
    if mode == "PERMISSIVE":
        return out.withColumn("_error", F.coalesce("_error", wrong))
    place = F.concat(F.element_at("_src.files", -1), F.lit(":"), F.col("_src.line").cast("string"), F.lit(": "))
    return out.withColumn("_error", F.when(wrong.isNotNull(), F.raise_error(F.concat(place, wrong)).cast("string")).otherwise(F.col("_error")))


def table_records(records: DataFrame, table: Table) -> DataFrame:
    """The rows of one table of read_records(), with its columns."""
    own = records.filter(F.col("table") == table.ident)
    return own.select(*(F.col("fullrow")[i].alias(c.name) for i, c in enumerate(table.columns)), "_src", "_error")


def write_rows(table: Table, rows: Iterable[tuple]) -> str:
    """A file of the table's layout with all columns, as text."""
    out = io.StringIO()
    for i, row in enumerate(table.header_rows() + list(rows)):
        csv.writer(out, quoting=csv.QUOTE_ALL if i < 4 else csv.QUOTE_MINIMAL, lineterminator="\r\n").writerow(["" if x is None else x for x in row])
    return out.getvalue()


def merge_environments(df: DataFrame, separator: str = "|", fields: Iterable[str] = ENVIRONMENT, keys: Iterable[str] = ()) -> DataFrame:
    """Each environment field's distinct values, sorted and joined: one row, or one for each of the keys."""
    return df.groupBy(*keys).agg(*(F.array_join(F.array_sort(F.collect_set(k)), separator).alias(k) for k in fields))


def inferred_frame(spark: SparkSession, path: str, csv_names: bool = True) -> DataFrame:
    """A file with inferred types, for exploring; its first column must be TIMESTAMP. NAN is missing.

    The header alone is read here; the rows are read by the tasks.
    """
    with open_file(path) as f:
        reader = io.TextIOWrapper(io.BufferedReader(f) if not isinstance(f, io.BufferedIOBase) else f, encoding="ascii", newline="")
        head = [next(reader, "") for _ in range(4)]
    _, columns = read_header(csv.reader(iter(head), strict=True))
    if columns[0].name != "TIMESTAMP":
        raise Toa5Error("the first column is not TIMESTAMP")
    names = [c.csv if csv_names else c.name for c in columns]
    body = spark.read.text(path).filter(~F.col("value").isin([x.rstrip("\r\n") for x in head]))
    return spark.read.csv(body.rdd.map(lambda r: r[0]), inferSchema=True, nullValue="NAN", nanValue="NAN").toDF(*names)
