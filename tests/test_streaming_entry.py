import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gridmill.functions.timeseries import Interval
from gridmill.streaming.ingest import gap_check, ingest, interval_rollup

SF = "/root/testdata/sf0.001"


def test_gap_check_stream(spark, tmp_path):
    rows = [("a", 1, "2021-01-01 00:00:00"), ("a", 2, "2021-01-01 01:00:00"), ("a", 3, "2021-01-01 03:00:00"), ("a", 4, "2021-01-01 03:00:00"), ("b", 1, "2021-01-01 00:00:01")]
    spark.createDataFrame(rows, "s string, o long, t string").select("s", "o", F.col("t").cast("timestamp_ntz").alias("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s string, o long, t timestamp_ntz").parquet(str(tmp_path / "in"))
    q = gap_check(stream, "s", "t", "o", Interval.HOUR1).writeStream.format("memory").queryName("gaps").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("gaps").collect())) == [("a", 1, "GOOD"), ("a", 2, "GOOD"), ("a", 3, "UNUSUAL"), ("a", 4, "BAD"), ("b", 1, "BAD")]


def test_ingest_stream(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS streamed")
    spark.sql(f"CREATE TABLE streamed (k INT, v STRING) USING parquet LOCATION '{tmp_path}/t'")
    clashes = []
    for i, rows in enumerate(([(1, "a"), (2, "b")], [(2, "b"), (3, "c"), (1, "X")])):
        spark.createDataFrame(rows, "k int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k int, v string").parquet(str(tmp_path / "in"))
        q = ingest(stream, "streamed", ["k"], str(tmp_path / "c"), lambda df, _: clashes.extend(r.k for r in df.collect())).start()
        q.processAllAvailable()
        q.stop()
        spark.catalog.refreshTable("streamed")
        assert spark.table("streamed").count() == 2 + i
    assert clashes == [1]
    spark.sql("DROP TABLE streamed")


def test_rollup_stream(spark, tmp_path):
    def rollup(i, rows):
        spark.createDataFrame(rows, "s string, t string, x double").select("s", F.col("t").cast("timestamp").alias("t"), "x").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("s string, t timestamp, x double").parquet(str(tmp_path / "in"))
        q = interval_rollup(stream, "s", "t", "x", Interval.HOUR1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
        return sorted((r.s, r.slot.strftime("%d %H:%M"), r.n, r.mean) for r in spark.read.parquet(str(tmp_path / "out")).select(F.col("series").alias("s"), "slot", "n", "mean").collect())

    day = "2021-01-01 "
    assert rollup(0, [("a", day + "00:10:00", 1.0), ("a", day + "00:50:00", 3.0), ("b", day + "00:59:59", 5.0)]) == []
    closed = rollup(1, [("a", day + "03:00:00", 9.0)])
    assert closed == [("a", "01 00:00", 2, 2.0), ("b", "01 00:00", 1, 5.0)]
    assert rollup(2, [("a", day + "00:20:00", 100.0)]) == closed  # too late
    with pytest.raises(ValueError):
        interval_rollup(spark.range(1), "s", "t", "x", Interval.MONTH1)


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["user_id", "quality", "n"] and out.count() > 0


LIBRARY = [q for q in __spark_entry__.queries() if not q.startswith("op") and q != "pipeline"]


@pytest.mark.parametrize("name", LIBRARY)
def test_query_has_rows(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).limit(1).count() >= (name not in ("dup_names", "typecheck_violations"))


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
