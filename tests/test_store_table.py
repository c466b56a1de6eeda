"""Stores with a declared key, staged builds, environments, sizes, SQL functions, and readers of whole catalogs."""

import os

import pytest
from pyspark.sql import functions as F

from gridmill.functions import sizes
from gridmill.functions.sql import register_sql
from gridmill.functions.timeseries import overlapping
from gridmill.operators import records
from gridmill.operators.store import RowMismatchError, StoreColumn, StoreTable, building
from gridmill.plans.catalog import CatalogError, load_logger
from gridmill.sources import toa5

C = StoreColumn


@pytest.mark.parametrize(
    "table",
    [StoreTable("t", ()), StoreTable("t", (C("a"),)), StoreTable("t", (C("a", key=True), C("b", key=True))), StoreTable("t", (C("a", key=True), C("A"))), StoreTable("t", (C("a", key=True, comment="x\ny"),)), StoreTable("t", (C("a", "STRING", True),), key_is_time=True)],
)
def test_unsound_tables(table):
    with pytest.raises(ValueError):
        table.validate()


def test_store_by_text(spark, tmp_path):
    t = StoreTable("by_text", (C("k", key=True), C("n", "INT", comment="it's a 'count'")))
    spark.sql("DROP TABLE IF EXISTS by_text")
    t.create(spark, f"{tmp_path}/t")
    rows = lambda *x: spark.createDataFrame(list(x), "n int, k string")
    t.append(spark, rows((2, "foo"), (2, "foo"), (2, "Foo")))
    t.append(spark, rows((2, "foo"), (None, "bar")))
    with pytest.raises(RowMismatchError):
        t.append(spark, rows((3, "foo")))
    assert [tuple(r) for r in t.scan(spark).collect()] == [("Foo", 2), ("bar", None), ("foo", 2)]
    assert [tuple(r) for r in t.lookup(spark, "bar").collect()] == [("bar", None)] and t.lookup(spark, "none").count() == 0
    for change in ("DELETE FROM by_text", "UPDATE by_text SET n = 1"):
        with pytest.raises(Exception, match="UNSUPPORTED|not support"):
            spark.sql(change)
    spark.sql("DROP TABLE by_text")


def test_store_by_time(spark, tmp_path):
    t = StoreTable("by_time", (C("at", "BIGINT", True), C("s")), key_is_time=True)
    spark.sql("DROP TABLE IF EXISTS by_time")
    t.create(spark, f"{tmp_path}/t")
    rows = lambda *x: spark.createDataFrame(list(x), "at string, s string")
    t.append(spark, rows(("2021-06-18 23:00:00Z", "a"), ("2021-06-19T01:00+02:00", "a"), ("2021-06-18 22:00Z", "b")))
    assert [tuple(r) for r in t.scan(spark).collect()] == [("2021-06-18 22:00:00Z", "b"), ("2021-06-18 23:00:00Z", "a")]
    assert [tuple(r) for r in t.lookup(spark, "2021-06-19 00:00:00+02:00").collect()] == [("2021-06-18 22:00:00Z", "b")]
    with pytest.raises(RowMismatchError):
        t.append(spark, rows(("2021-06-19 01:00:00+02:00", "c")))
    with pytest.raises(Exception, match="no time with an offset"):
        t.append(spark, rows(("2021-06-19 01:00:00", "c")))
    assert t.select(spark).count() == 2
    spark.sql("DROP TABLE by_time")


def test_building(spark, tmp_path):
    path = str(tmp_path / "built")
    with building(spark, path, ["k"], file_rows=50) as staging:
        for i in range(4):
            spark.range(i * 25, i * 25 + 25).select((100 - F.col("id")).alias("k")).write.mode("append").parquet(staging)
        assert not os.path.exists(path)
    assert [r.k for r in spark.read.parquet(path).orderBy("k").collect()] == list(range(1, 101))
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) == 2 and os.listdir(tmp_path) == ["built"]
    with pytest.raises(FileExistsError), building(spark, path):
        raise AssertionError("the block must not run")
    with pytest.raises(RuntimeError, match="stop"), building(spark, str(tmp_path / "other")) as staging:
        spark.range(1).write.parquet(staging)
        raise RuntimeError("stop")
    assert os.listdir(tmp_path) == ["built"]


def test_repeated_environments(spark):
    env = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), ("b", 1), ("c", None)], "name string, region int")
    patterns = spark.createDataFrame([("any1", None, 1), ("any1", None, 1), ("b", "b", None)], "logger string, name string, region int")
    got = {r.name: (r.n_rows, r.n_matches, r.logger) for r in records.match_environment(env, patterns, ["name", "region"]).collect()}
    assert got == {"a": (3, 1, "any1"), "b": (1, 2, "any1"), "c": (1, 0, None)}
    assert records.match_environment(env.filter("name <> 'b'"), patterns, ["name", "region"], strict=True).count() == 2
    with pytest.raises(Exception, match="several loggers fit"):
        records.match_environment(env, patterns, ["name", "region"], strict=True).collect()


def test_broadcasts_are_checked(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(sizes.small(spark.range(5), 5)) and not hinted(sizes.small(spark.range(6), 5))


def test_overlaps_by_brute_force(spark):
    import random
    from datetime import datetime, timedelta

    r = random.Random(2)
    day = lambda n: datetime(2024, 1, 1) + timedelta(hours=n)
    spans = []
    for i in range(60):
        a = r.randrange(200)
        spans.append((i, day(a), None if i % 5 == 0 else day(a + r.choice([1, 2, 3, 90]))))
    df = spark.createDataFrame(spans, "ord int, start timestamp_ntz, end timestamp_ntz")
    hit = lambda a, b: a[1] == b[1] if a[2] is None and b[2] is None else (a[1] < (b[2] or b[1]) and b[1] < (a[2] or a[1]))
    want = {(a[0], b[0]) for a in spans for b in spans if a[0] < b[0] and hit(a, b)}
    got = [tuple(x) for x in overlapping(df, strict_order=False).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_sql_functions(spark):
    register_sql(spark)
    row = spark.sql("select deltaparse(''), deltaparse(' '), deltaparse('2h 5m'), lsb_obo('1028', '1029'), basic_quality(''), basic_quality_number(double('inf')), infer_reftype(array('1', '-2.50')), infer_reftype(array('nan')), infer_reftype(array('x'))").first()
    assert tuple(row) == (None, 0, 7500, False, "UNUSUAL", "BAD", "Num(3,2)", "OnlyNan", None)


def station(**more):
    columns = [{"name": "TIMESTAMP", "unit": "TS", "type": "TimestampNoTz"}, {"name": "RECORD", "unit": "RN", "type": "NonNegInt"}, {"name": "Level", "unit": "m", "prc": "Avg", "type": "Num(4,2)"}]
    tables = {"Fast": {"interval": "15min", "columns": columns}, "Slow": {"interval": "1day", "columns": columns[:2]}}
    return {"logger_name": "Weir", "tz": "+01:00", "toa5_env_match": {"station_name": "Weir"}, "tables": tables} | more


@pytest.fixture
def files(tmp_path):
    logger = load_logger(station())
    for name, rows in (("Fast", [("2024-03-01 00:00:00", "0", "1.25"), ("2024-03-01 00:15:00", "1", "NAN")]), ("Slow", [("2024-03-01 00:00:00", "7")])):
        (tmp_path / f"{name}.dat").write_text(toa5.write_rows(logger.tables[name], rows), newline="")
    return tmp_path, logger


def test_all_tables_in_one_read(spark, files):
    folder, logger = files
    every = toa5.read_records(spark, [str(folder)], [logger])
    assert {r.table: r["count"] for r in every.groupBy("table").count().collect()} == {"Weir/Fast": 2, "Weir/Slow": 1}
    fast = records.typed(toa5.table_records(every, logger.tables["Fast"]), logger.tables["Fast"], zoned=True).orderBy("record")
    assert [(str(r.at), r.record) for r in fast.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("at"), "record").collect()] == [("2024-02-29 23:00", 0), ("2024-02-29 23:15", 1)]
    (folder / "bad.dat").write_text(toa5.write_rows(logger.tables["Fast"], [("2024-03-01 00:30:00", "2", "123.4")]), newline="")
    with pytest.raises(Exception, match="Level is no"):
        toa5.read_records(spark, str(folder), [logger]).collect()
    assert toa5.read_records(spark, str(folder), [logger], typecheck=False).count() == 4
    errors = [r._error for r in toa5.read_records(spark, str(folder), [logger], mode="PERMISSIVE").collect() if r._error]
    assert len(errors) == 1 and "123.4" in errors[0]


@pytest.mark.parametrize(
    "more",
    [{"min_datetime": "2024-01-01"}, {"min_datetime": "2024-01-01T00:00:00Z"}, {"known_gaps": []}, {"skip_records": []}, {"ignore_tables": []}, {"known_gaps": [{"time": "yesterday", "why": "x"}]}, {"$comment": 1}, {"sensors": {"x y": "z"}}],
)
def test_catalogs_that_the_schema_refuses(more):
    with pytest.raises(CatalogError):
        load_logger(station(**more))


def test_catalogs_that_the_schema_takes():
    assert load_logger(station(variants=[], sensors={}, **{"$comment": "note"})).variants == ()
    assert load_logger(station(known_gaps=[{"time": "open", "end": "2024-01-01 00:00:00Z", "why": "before"}], min_datetime="2024-01-01 00:00:00")).min_datetime.tzinfo is not None
    issue = {"type": "bad", "cols": ["Level", "Level"], "when": {"time": "2024-01-01 00:00:00", "why": "ice"}}
    broken = station()
    broken["tables"]["Fast"]["known_issues"] = [issue]
    with pytest.raises(CatalogError):
        load_logger(broken)
