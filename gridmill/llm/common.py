"""Helpers shared by the training-data operators: staging, Arrow columns, words."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: U+0020 and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Most characters of text that a Python worker holds decoded at once.
BLOCK_CHARS = 4_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, or a folder in its warehouse where it names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.staging"
    return folder.rstrip("/")


def _remove(store, target) -> None:
    try:
        store.delete(target, True)
    except (Py4JError, OSError):  # the JVM has gone before
        return


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors. Removed at exit, when the session may have ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    atexit.register(_remove, target.getFileSystem(spark._jsc.hadoopConfiguration()), target)
    return spark.read.schema(df.schema).parquet(path)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value of a string column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a block holds about `most` bytes of text, one row at least."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts: sizes buckets in proportion to the input."""
    return df.select(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def crc_mod(column: str, modulus: int):
    """crc32 of a key written as text, modulo modulus; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
