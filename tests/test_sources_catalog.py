import io
import json
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from gridmill.operators import records
from gridmill.plans import jsonschema_subset as js
from gridmill.plans.catalog import Catalog, CatalogError, Header, TimeRange, load_logger, validate_ranges
from gridmill.sources import toa5, trees

COLUMNS = [
    {"name": "TIMESTAMP", "unit": "TS", "type": "TimestampNoTz"},
    {"name": "RECORD", "unit": "RN", "type": "NonNegInt"},
    {"name": "Supply_Min", "unit": "Volts", "prc": "Min", "type": "Num(4,2)"},
    {"name": "Mast(42)", "unit": "Deg C", "prc": "Smp", "type": "Num(5,2)", "var": "north", "sens": "s1"},
    {"name": "Dew_Avg", "unit": "Deg C", "prc": "Avg", "type": "Num(5,2)", "var": "south", "sens": "s1"},
]


def document(**changes):
    base = {
        "logger_name": "Test",
        "tz": "UTC",
        "toa5_env_match": {"station_name": "Test", "logger_model": "CR1"},
        "variants": ["north", "south"],
        "sensors": {"s1": "a sensor"},
        "min_datetime": "2023-01-01 00:00:00",
        "skip_records": [{"time": "2023-05-02 07:00:00Z", "why": "bad"}],
        "ignore_tables": ["Other"],
        "tables": {"Hourly": {"interval": "1hour", "columns": COLUMNS, "mappings": {"Air": {"type": "view", "map": [{"old": {"name": "Dew_Avg", "unit": "Deg C", "prc": "Avg"}, "new": {"name": "Air"}}, {"old": {"name": "TIMESTAMP", "unit": "TS"}, "new": {"name": "When"}}]}}}},
    }
    return base | changes


def test_load():
    logger = load_logger(json.dumps(document()).encode())
    t = logger.tables["Hourly"]
    assert list(t.layouts.values()) == [(0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 2, 3, 4)]
    assert t.prikey == 0 and t.sql == "test_hourly" and t.ident == "Test/Hourly" and t.view_indexes("Air") == (4, 0)
    assert [c.header.csv for c in t.columns] == ["TIMESTAMP", "RECORD", "Supply_Min[V]", "Mast(42)/Smp[°C]", "Dew_Avg[°C]"]
    assert t.schema()["mast_42"].metadata == {"unit": "Deg C", "prc": "Smp", "reftype": "Num(5,2)", "sens": "s1"}
    assert t.header_rows()[0] == ("TOA5", "Test", "CR1", None, None, None, None, "Hourly")


def table(**changes):
    return {"Hourly": document()["tables"]["Hourly"] | changes}


BROKEN = {
    "no name": {"logger_name": "x"},
    "unknown key": {"foo": 1},
    "no match": {"toa5_env_match": {}},
    "ignored": {"ignore_tables": ["Hourly"]},
    "unused variant": {"variants": ["north", "south", "west"]},
    "unused sensor": {"sensors": {"s1": "a", "s2": "b"}},
    "empty sensor": {"sensors": {"s1": " "}},
    "unknown variant": {"variants": ["north"]},
    "key": {"tables": table(prikey=9)},
    "no key": {"tables": table(columns=[{"name": "AA"}]), "variants": ["north"], "sensors": {"s1": "a"}},
    "twice": {"tables": table(columns=[*COLUMNS, {"name": "record"}])},
    "view": {"tables": table(mappings={"Air": {"type": "view", "map": [{"old": {"name": "Nope"}, "new": {"name": "Air"}}]}})},
    "issue": {"tables": table(known_issues=[{"type": "bad", "cols": ["Mast(42)"], "when": {"time": "2023-05-04 00:00:00Z", "why": "x"}}])},
    "type": {"tables": table(columns=[*COLUMNS, {"name": "XX", "type": "Foo"}])},
    "gaps": {"known_gaps": [{"time": "2023-04-01 00:00:00", "end": "2023-04-05 00:00:00", "why": "a"}, {"time": "2023-04-02 00:00:00", "why": "b"}]},
    "backwards": {"known_gaps": [{"time": "2023-04-05 00:00:00", "end": "2023-04-01 00:00:00", "why": "a"}]},
    "no reason": {"known_gaps": [{"time": "2023-04-05 00:00:00", "why": " "}]},
}


@pytest.mark.parametrize("what", BROKEN)
def test_broken(what):
    with pytest.raises(ValueError):
        load_logger(document(**BROKEN[what]))


def test_zones():
    doc = document(tz="-04:30")
    with pytest.warns(UserWarning, match="outside UTC"):
        assert str(load_logger(doc).min_datetime) == "2023-01-01 00:00:00-04:30"
    del doc["tz"]
    with pytest.raises(CatalogError):
        load_logger(doc)


def test_ranges():
    r = lambda a, b=None: TimeRange.of({"time": a, "why": "w"} | ({"end": b} if b else {}))
    whole = r("open", "open")
    assert r("2023-01-01 00:00:00Z").start in whole
    assert str(r("2023-01-01 00:00:00Z", "2023-01-02 00:00:00Z")) == "TimeRange[2023-01-01T00:00:00Z to 2023-01-02T00:00:00Z because w]"
    validate_ranges([r("2023-01-01 00:00:00Z", "2023-01-02 00:00:00Z"), r("2023-01-02 00:00:00Z", "2023-01-03 00:00:00Z")])
    with pytest.raises(CatalogError):
        TimeRange.of({"time": "2023-01-01 00:00:00", "why": "no zone"})


def test_collection():
    one, two = load_logger(document()), load_logger(document(logger_name="Other"))
    both = Catalog([one, two, one])
    assert len(both) == 2 and both.table("Test/Hourly") is one.tables["Hourly"] and "Hourly" not in both and "other_hourly" in both
    with pytest.raises(CatalogError):
        both.table("Nope")


ENV = '"TOA5","Test","CR1","1","os","prog","sig","Hourly"'
NORTH = '"TIMESTAMP","RECORD","Supply_Min","Mast(42)"\r\n"TS","RN","Volts","Deg C"\r\n"","","Min","Smp"'
SOUTH = '"TIMESTAMP","RECORD","Supply_Min","Dew_Avg"\r\n"TS","RN","Volts","Deg C"\r\n"","","Min","Avg"'


def text(head, *rows, env=ENV):
    return "\r\n".join([env, head, *rows, ""])


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.dat").write_text(text(NORTH, '"2023-05-01 11:00:00",1,13.1,20.5', '"2023-05-02 07:00:00",2,"NAN",21'))
    (tmp_path / "b.dat").write_text(text(SOUTH, '"2023-05-01 12:00:00",3,13.2,22.25'))
    (tmp_path / "status.dat").write_text(text('"X"\r\n""\r\n""', "1", env=ENV.replace("Hourly", "Status")))
    (tmp_path / "notes.txt").write_text("hello")
    return tmp_path


@pytest.mark.filterwarnings("ignore:unknown kind")
def test_read(spark, folder):
    logger = load_logger(document())
    t = logger.tables["Hourly"]
    spark.dataSource.register(toa5.Toa5DataSource)
    source = spark.read.format("toa5").option("catalog", json.dumps(document())).option("table", "Hourly").load(str(folder))
    for df in (source, toa5.read_toa5(spark, str(folder), logger, t)):
        rows = records.typed(df, t).orderBy("record").collect()
        assert [(str(r.timestamp), r.record, r.supply_min and float(r.supply_min), r.mast_42 and float(r.mast_42), r.dew_avg and float(r.dew_avg)) for r in rows] == [
            ("2023-05-01 11:00:00", 1, 13.1, 20.5, None), ("2023-05-02 07:00:00", 2, None, 21.0, None), ("2023-05-01 12:00:00", 3, 13.2, None, 22.25),
        ]
        assert records.violations(df, t).count() == 0
    first = source.orderBy("RECORD").select(records.source_text(F.col("_src")), "_src.line", "_src.env.logger_os").first()
    assert first[0].endswith("a.dat:5") and first[1:] == (5, "os")
    assert records.table_view(source, t, "Air").columns == ["Air", "When"]
    assert records.apply_catalog(records.typed(source, t), logger, "timestamp").count() == 2
    assert [f.dataType.simpleString() for f in records.typed_utc(source, t).schema] == ["timestamp_ntz", "int", "double", "double", "double"]
    assert toa5.merge_environments(source.select("_src.env.*")).first().table_name == "Hourly"
    frame = toa5.inferred_frame(spark, str(folder / "a.dat"))
    assert frame.columns[2:] == ["Supply_Min[V]", "Mast(42)/Smp[°C]"] and frame.count() == 2


HEADS = {
    "empty": "",
    "blank": "\n\n\n",
    "magic": text(NORTH, env=ENV.replace("TOA5", "TOA6")),
    "fields": text(NORTH, env=ENV + ',"x"'),
    "quote": '"TOA5,"x\n',
    "names only": ENV + '\r\n"A","B"\r\n',
    "missing": ENV + '\r\n"A","B"\r\n"x"\r\n"",""\r\n',
    "twice": ENV + '\r\n"A","A"\r\n"",""\r\n"",""\r\n',
}


@pytest.mark.parametrize("what", HEADS)
def test_bad_heads(what):
    import csv

    with pytest.raises(toa5.Toa5Error):
        toa5.read_header(csv.reader(io.StringIO(HEADS[what], newline=""), strict=True))


def rows_of(data, **options):
    logger = load_logger(document())
    return list(toa5.file_rows(["x.dat"], data.encode(), [logger], logger.tables["Hourly"], **options))


def test_bad_rows():
    for bad in ("1,2,3", "", '"2021,1,2,3', "ä,1,2,3"):
        data = text(NORTH, '"2023-05-01 11:00:00",1,13.1,20.5', bad)
        with pytest.raises(toa5.RecordError):
            rows_of(data)
        got = rows_of(data, mode="PERMISSIVE")
        assert len(got) >= 1 and got[-1][-1]
    with pytest.raises(toa5.NoVariantMatch):
        rows_of(text('"A"\r\n""\r\n""'))
    with pytest.raises(toa5.NoMetadataMatch):
        rows_of(text(NORTH, env=ENV.replace('"CR1"', '"CR2"')))
    with pytest.raises(toa5.NoTableMatch):
        rows_of(text(NORTH, env=ENV.replace("Hourly", "Nope")), skip_other_tables=False)
    with pytest.raises(NotImplementedError):
        logger = load_logger(document())
        list(toa5.file_rows(["x.csv"], b"a,b", [logger], logger.tables["Hourly"]))


def test_write_and_read_again():
    logger = load_logger(document())
    t = logger.tables["Hourly"]
    made = toa5.write_rows(t, [("2023-05-01 11:00:00", "1", "13.1", None, "2")])
    assert [r[:5] for r in toa5.file_rows(["x.dat"], made.encode(), [logger], t)] == [("2023-05-01 11:00:00", "1", "13.1", "", "2")]
    assert Header.of({"name": "AA"}) == Header("AA")


def test_several_loggers():
    logger = load_logger(document())
    with pytest.raises(RuntimeError, match="several"):
        toa5.match_header({"station_name": "Test", "logger_model": "CR1", "table_name": "Hourly"}, (), [logger, load_logger(document(logger_name="Two"))])


def test_environment_match(spark):
    env = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "name string, region int")
    patterns = spark.createDataFrame([("any1", None, 1), ("b", "b", None)], "logger string, name string, region int")
    got = {r.name: (r.n_matches, r.logger) for r in records.match_environment(env, patterns, ["name", "region"]).collect()}
    assert got == {"a": (1, "any1"), "b": (2, "any1"), "c": (0, None)}


def test_file_tree(spark, tmp_path):
    for name, content in (("a.txt", "A"), ("d/b.txt", "B"), ("d/.hidden", "C")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content)
    os.symlink(tmp_path / "a.txt", tmp_path / "link")
    os.mkfifo(tmp_path / "pipe")
    spark.dataSource.register(trees.FileTreeDataSource)
    got = {os.path.basename(r.fn): r.code for r in spark.read.format("file_tree").load(str(tmp_path)).collect()}
    assert got == {"a.txt": "NONE", "b.txt": "NONE", ".hidden": "NONE", "link": "SKIP", "pipe": "SKIP"}
    assert "d" in {os.path.basename(f) for f, *_ in trees.list_files(str(tmp_path), report_dirs=True)}
    with pytest.raises(FileNotFoundError):
        list(trees.list_files(str(tmp_path / "none")))


def test_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x/y.txt", "hi")
    with tarfile.open(tmp_path / "t.tgz", "w:gz") as t:
        info = tarfile.TarInfo("in.zip")
        info.size = len(inner.getvalue())
        t.addfile(info, io.BytesIO(inner.getvalue()))
    spark.dataSource.register(trees.ArchiveDataSource)
    got = [(r.names[1:], r.kind, r.content and bytes(r.content)) for r in spark.read.format("archive_entries").load(str(tmp_path)).collect()]
    assert got == [([], "archive", None), (["in.zip"], "archive", None), (["in.zip", "x/y.txt"], "file", b"hi")]


def test_schema():
    schema = js.load_schema(json.dumps({"type": "object", "required": ["foo"], "additionalProperties": False, "properties": {"foo": {"type": "object", "propertyNames": {"pattern": "^[a-z]+$"}, "additionalProperties": {"type": "string"}}, "bar": {"type": "array", "uniqueItems": True, "items": {"$ref": "#/$defs/n"}}}, "$defs": {"n": {"type": "integer", "minimum": 0}}}).encode())
    good = [{"foo": {"a": "b"}}, {"foo": {}, "bar": [1, 2]}]
    bad = [{}, {"foo": {"A": "b"}}, {"foo": {"a": 1}}, {"foo": {}, "bar": [1, 1]}, {"foo": {}, "bar": [-1]}, {"foo": {}, "baz": 1}, []]
    assert [js.validate_json(schema, json.dumps(d).encode()) for d in good] == good
    assert [js.validate_json(schema, json.dumps(d).encode()) for d in bad] == [None] * len(bad)
    for wrong in ({"type": "thing"}, {"foo": 1}, []):
        with pytest.raises(js.SchemaError):
            js.load_schema(json.dumps(wrong).encode())
    frozen = js.freeze({"a": [1, {"b": None}]})
    assert json.dumps(frozen, cls=js.FrozenEncoder) == '{"a": [1, {"b": null}]}'
    with pytest.raises(TypeError):
        js.freeze({"a": {1}})
