"""Catalog of loggers: tables, layouts of their files, views, ranges. Driver-side, loaded from JSON."""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta, timezone, tzinfo
from itertools import combinations
from zoneinfo import ZoneInfo

from pyspark.sql import types as T

from ..functions.timeseries import Interval
from ..functions.types import RefType, TimestampNoTz, TimestampWithTz, parse_type
from .jsonschema_subset import errors, load_json

# Short forms of units, names of intervals and of the logger's own types.
SHORT_UNITS = {
    "meters/second": "m/s",
    "Deg C": "°C",
    "oC": "°C",
    "Volts": "V",
    "m^3/m^3": "m³/m³",
    "W/m^2": "W/m²",
    "Watts/meter^2": "W/m²",
    "nSec": "ns",
    "uSec": "μs",
    "hours": "hr",
    "micrometer": "μm",
    "degrees": "°",
    "Deg": "°",
    "unitless": "",
}
INTERVALS = {"15min": Interval.MIN15, "30min": Interval.MIN30, "1hour": Interval.HOUR1, "1day": Interval.DAY1, "1week": Interval.WEEK1, "1month": Interval.MONTH1}
LOGGER_TYPES = ("FP2", "IEEE4", "TS", "Int")
ENVIRONMENT = ("station_name", "logger_model", "logger_serial", "logger_os", "program_name", "program_sig", "table_name")
# What names, units and processes may hold.
IDENTIFIER = r"[A-Za-z_][A-Za-z_0-9]{1,254}"
COLUMN_NAME = r"[A-Za-z_][A-Za-z_0-9]{1,250}(?:\([0-9]{1,3}\))?"
UNIT = r"[^\[\]\\\x00-\x1F\x7F-\U0010FFFF]{0,64}"
PROCESS = r"[A-Za-z_0-9\- .]{0,32}"

DATE_TIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(?:Z|[+-][0-9]{2}:[0-9]{2})?"

_ident = {"type": "string", "pattern": f"^{IDENTIFIER}$"}
_colname = {"type": "string", "pattern": f"^{COLUMN_NAME}$"}
_text = {"type": "string"}
_time = {"type": "string", "pattern": f"^{DATE_TIME}$"}
_bound = {"type": "string", "pattern": f"^(?:{DATE_TIME}|open)$"}
_range = {"type": "object", "required": ["time", "why"], "additionalProperties": False, "properties": {"time": _bound, "end": _bound, "why": _text}}
_column = {"type": "object", "required": ["name"], "additionalProperties": False, "properties": {"name": _colname, "unit": _text, "prc": _text}}
_full_column = _column | {"properties": _column["properties"] | {"type": _text, "lodt": {"enum": list(LOGGER_TYPES)}, "var": _ident, "desc": _text, "plotgrp": _ident, "sens": _ident}}
_issue = {"type": "object", "required": ["type", "cols", "when"], "additionalProperties": False, "properties": {"type": {"enum": ["bad", "unusual"]}, "cols": {"type": "array", "minItems": 1, "uniqueItems": True, "items": _colname}, "when": _range}}
_mapping = {
    "type": "object",
    "required": ["type", "map"],
    "additionalProperties": False,
    "properties": {"type": {"enum": ["view"]}, "map": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["old", "new"], "additionalProperties": False, "properties": {"old": _column, "new": _column}}}},
}
_table = {
    "type": "object",
    "required": ["columns"],
    "additionalProperties": False,
    "properties": {
        "prikey": {"type": "integer", "minimum": 0},
        "interval": {"enum": list(INTERVALS)},
        "columns": {"type": "array", "minItems": 1, "items": _full_column},
        "mappings": {"type": "object", "propertyNames": _ident, "additionalProperties": _mapping},
        "known_issues": {"type": "array", "items": _issue},
        "$comment": _text,
    },
}
SCHEMA = {
    "type": "object",
    "required": ["logger_name", "toa5_env_match", "tables"],
    "additionalProperties": False,
    "properties": {
        "logger_name": _ident,
        "toa5_env_match": {"type": "object", "minProperties": 1, "additionalProperties": False, "properties": {k: _text for k in ENVIRONMENT[:-1]}},
        "tz": _text,
        "min_datetime": _time,
        "variants": {"type": "array", "uniqueItems": True, "items": _ident},
        "sensors": {"type": "object", "propertyNames": _ident, "additionalProperties": _text},
        "known_gaps": {"type": "array", "minItems": 1, "items": _range},
        "skip_records": {"type": "array", "minItems": 1, "items": _range},
        "ignore_tables": {"type": "array", "minItems": 1, "uniqueItems": True, "items": _ident},
        "$comment": _text,
        "tables": {"type": "object", "minProperties": 1, "propertyNames": _ident, "additionalProperties": _table},
    },
}


class CatalogError(ValueError):
    """A catalog contradicts itself."""


def _need(ok: object, what: str) -> None:
    if not ok:
        raise CatalogError(what)


def _unique(values: Iterable, what: str) -> None:
    twice = [v for v, n in Counter(values).items() if n > 1]
    _need(not twice, f"{what} repeats: {twice}")


@dataclass(frozen=True)
class Header:
    """A physical column of a file: name, unit and process, empty where there is none."""

    name: str
    unit: str = ""
    prc: str = ""

    @classmethod
    def of(cls, js: dict) -> Header:
        return cls(js["name"], js.get("unit") or "", js.get("prc") or "")

    @property
    def csv(self) -> str:
        """Name with its process and short unit, as exports call it."""
        process = f"/{self.prc}" if self.prc and not self.name.endswith(self.prc) else ""
        plain = (self.name, self.unit) in (("TIMESTAMP", "TS"), ("RECORD", "RN"))
        unit = "" if plain else SHORT_UNITS.get(self.unit, self.unit)
        return self.name + process + (f"[{unit}]" if unit else "")

    @property
    def sql(self) -> str:
        return re.sub(r"\(([0-9]+)\)$", r"_\1", self.name).lower()

    def validate(self) -> None:
        for value, pattern, what in ((self.name, COLUMN_NAME, "name"), (self.unit, UNIT, "unit"), (self.prc, PROCESS, "process")):
            _need(re.fullmatch(pattern, value), f"column {self.name!r}: bad {what} {value!r}")


@dataclass(frozen=True)
class TimeRange:
    """A closed range, or an instant where end is None, with the reason for it."""

    why: str
    start: datetime
    end: datetime | None = None

    @classmethod
    def of(cls, js: dict, tz: tzinfo | None = None) -> TimeRange:
        def time(text: str, open_end: datetime) -> datetime:
            if text == "open":
                return open_end
            at = datetime.fromisoformat(text)
            return at if at.tzinfo or tz is None else at.replace(tzinfo=tz)

        out = cls(js["why"], time(js["time"], datetime.min.replace(tzinfo=UTC)), time(js["end"], datetime.max.replace(tzinfo=UTC)) if "end" in js else None)
        out.validate()
        return out

    def validate(self) -> None:
        _need(self.why.strip(), "a range needs a reason")
        _need(self.start.tzinfo and (self.end is None or self.end.tzinfo), "a range needs time zones")
        _need(self.end is None or self.start < self.end, f"a range ends after it starts: {self}")

    def __contains__(self, at: datetime) -> bool:
        return self.start <= at <= (self.end or self.start)

    def __str__(self) -> str:
        shown = " to ".join(x.isoformat().replace("+00:00", "Z") for x in (self.start, self.end) if x)
        return f"TimeRange[{shown} because {self.why}]"

    def collides(self, later: TimeRange) -> bool:
        """Whether a range later in a list overlaps this one, as lists of ranges are checked."""
        inside = lambda x, r: r.end is not None and r.start < x < r.end
        if self.end is None and later.end is None:
            return self.start == later.start
        ends = [x for x in (later.start, later.end) if x]
        return any(inside(x, self) for x in ends) or all(inside(x, later) for x in (self.start, self.end or self.start))


def validate_ranges(ranges: Iterable[TimeRange]) -> None:
    for a, b in combinations(ranges, 2):
        _need(not a.collides(b), f"ranges overlap: {a} and {b}")


@dataclass(frozen=True)
class Column:
    header: Header
    type: RefType | None = None
    lodt: str | None = None
    var: str | None = None
    desc: str | None = None
    plotgrp: str | None = None
    sens: str | None = None

    @classmethod
    def of(cls, js: dict) -> Column:
        rest = {k: js.get(k) for k in ("lodt", "var", "desc", "plotgrp", "sens")}
        return cls(Header.of(js), parse_type(js["type"]) if js.get("type") else None, **rest)

    @property
    def name(self) -> str:
        return self.header.name

    def field(self) -> T.StructField:
        """Spark column of the cast value, with all that the catalog says as metadata."""
        about = {"unit": self.header.unit, "prc": self.header.prc, "reftype": repr(self.type) if self.type else None} | {k: getattr(self, k) for k in ("lodt", "desc", "plotgrp", "sens")}
        return T.StructField(self.header.sql, self.type.spark_type if self.type else T.StringType(), True, {k: v for k, v in about.items() if v})


@dataclass
class KnownIssue:
    type: str
    cols: tuple[str, ...]
    when: TimeRange


@dataclass
class Table:
    name: str
    prikey: int
    interval: Interval
    columns: list[Column]
    layouts: dict[tuple[Header, ...], tuple[int, ...]]
    views: dict[str, list[tuple[Header, Header]]] = field(default_factory=dict)
    known_issues: list[KnownIssue] = field(default_factory=list)
    logger: Logger | None = field(default=None, repr=False, compare=False)

    @property
    def sql(self) -> str:
        return f"{self.logger.name}_{self.name}".lower()

    @property
    def ident(self) -> str:
        return f"{self.logger.name}/{self.name}"

    def schema(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])

    def types(self) -> dict[str, RefType]:
        return {c.name: c.type for c in self.columns if c.type}

    def view_indexes(self, view: str) -> tuple[int, ...]:
        place = {c.header: i for i, c in enumerate(self.columns)}
        return tuple(place[old] for old, _ in self.views[view])

    def header_rows(self) -> list[tuple[str | None, ...]]:
        """The four header rows of a file of this table."""
        env = tuple(self.logger.env_match.get(k) for k in ENVIRONMENT[:-1])
        return [("TOA5", *env, self.name), *(tuple(getattr(c.header, k) for c in self.columns) for k in ("name", "unit", "prc"))]

    def validate(self) -> None:
        _need(0 <= self.prikey < len(self.columns), f"table {self.name}: no column {self.prikey} for a key")
        for c in self.columns:
            c.header.validate()
        headers = [c.header for c in self.columns]
        _unique(headers, f"table {self.name}: column")
        for what in ("name", "sql", "csv"):
            _unique((getattr(h, what) for h in headers), f"table {self.name}: {what}")
        for issue in self.known_issues:
            for c in issue.cols:
                _need(c in {h.name for h in headers}, f"known issue of unknown column {c!r}")
                _need(re.fullmatch(IDENTIFIER, c), f"known issue: not an identifier: {c!r}")
        for view, pairs in self.views.items():
            _need(re.fullmatch(IDENTIFIER, view), f"not an identifier: {view!r}")
            for old, new in pairs:
                _need(old in headers, f"view {view}: unknown column {old}")
                _need(new not in headers, f"view {view}: new name {new} exists")
                old.validate()
                new.validate()
            _unique((new for _, new in pairs), f"view {view}: target")


@dataclass
class Logger:
    name: str
    env_match: dict[str, str]
    tables: dict[str, Table]
    tz: tzinfo | None = None
    min_datetime: datetime | None = None
    variants: tuple[str, ...] = ()
    sensors: dict[str, str] = field(default_factory=dict)
    known_gaps: tuple[TimeRange, ...] = ()
    skip_records: tuple[TimeRange, ...] = ()
    ignore_tables: frozenset[str] = frozenset()

    def matches(self, env: dict[str, str]) -> bool:
        """Whether a file's environment fits; what the catalog leaves out fits anything."""
        return all(env.get(k) == v for k, v in self.env_match.items())

    def validate(self) -> None:
        validate_ranges(self.known_gaps)
        validate_ranges(self.skip_records)
        _need(not self.ignore_tables & self.tables.keys(), "a table is both declared and ignored")
        for key, what in self.sensors.items():
            _need(what.strip(), f"sensor {key} has no description")
        _unique(self.sensors.values(), "sensor")
        columns = [c for t in self.tables.values() for c in t.columns]
        for c in columns:
            _need(c.var is None or c.var in self.variants, f"column {c.name}: unknown variant {c.var}")
            _need(c.sens is None or c.sens in self.sensors, f"column {c.name}: unknown sensor {c.sens}")
        # The first variant is the default; it need not be named by a column.
        unused = {*self.variants[1:]} - {c.var for c in columns} | {*self.sensors} - {c.sens for c in columns}
        _need(not unused, f"never used: {sorted(unused)}")
        if self.tz is None and not any(isinstance(c.type, TimestampNoTz) for c in columns):
            warnings.warn(f"logger {self.name} has no time zone", stacklevel=2)
        for t in self.tables.values():
            t.validate()
            naive, aware = (any(isinstance(c.type, kind) for c in t.columns) for kind in (TimestampNoTz, TimestampWithTz))
            _need(self.tz or not naive, f"table {t.name} has wall-clock times, but the logger has no time zone")
            if naive and aware:
                warnings.warn(f"table {t.name} mixes times with and without zones", stacklevel=2)
            if naive and self.tz.tzname(None) != "UTC":
                warnings.warn(f"table {t.name} has wall-clock times outside UTC", stacklevel=2)


def _zone(text: str) -> tzinfo:
    if found := re.fullmatch(r"([+-])([0-9]{2}):([0-9]{2})", text):
        away = timedelta(hours=int(found[2]), minutes=int(found[3]))
        return timezone(-away if found[1] == "-" else away)
    return ZoneInfo(text)


def _layouts(columns: list[Column], variants: tuple[str, ...]) -> dict[tuple[Header, ...], tuple[int, ...]]:
    """Accepted files: one layout without variants; else the first and each used variant, then all columns."""
    used = {c.var for c in columns if c.var}
    picks = [[i for i, c in enumerate(columns) if c.var in (None, v)] for v in variants if v in used or v == variants[0]] if used else []
    out = {}
    for pick in [*picks, list(range(len(columns)))]:
        out[tuple(columns[i].header for i in pick)] = tuple(pick)
    return out


def load_logger(source: object) -> Logger:
    """A logger of a JSON file (name, bytes, open file) or a parsed document."""
    js = source if isinstance(source, dict) else load_json(source)
    if wrong := errors(js, SCHEMA):
        raise CatalogError("; ".join(wrong))
    tz = _zone(js["tz"]) if "tz" in js else None
    ranges = lambda key: tuple(TimeRange.of(x, tz) for x in js.get(key, ()))
    variants = tuple(js.get("variants", ()))
    tables = {}
    for name, t in js["tables"].items():
        columns = [Column.of(c) for c in t["columns"]]
        key = t.get("prikey", 0 if columns[0].header == Header("TIMESTAMP", "TS") else None)
        _need(key is not None, f"table {name} declares no key")
        views = {v: [(Header.of(m["old"]), Header.of(m["new"])) for m in d["map"]] for v, d in t.get("mappings", {}).items()}
        issues = [KnownIssue(i["type"], tuple(i["cols"]), TimeRange.of(i["when"], tz)) for i in t.get("known_issues", ())]
        tables[name] = Table(name, key, INTERVALS.get(t.get("interval"), Interval.UNDEF), columns, _layouts(columns, variants), views, issues)
    least = datetime.fromisoformat(js["min_datetime"]) if "min_datetime" in js else None
    if least and least.tzinfo is None and tz:
        least = least.replace(tzinfo=tz)
    out = Logger(js["logger_name"], dict(js["toa5_env_match"]), tables, tz, least, variants, dict(js.get("sensors", {})), ranges("known_gaps"), ranges("skip_records"), frozenset(js.get("ignore_tables", ())))
    for t in tables.values():
        t.logger = out
    out.validate()
    return out


class Catalog:
    """Loggers in order, each once; tables by full name, or by short name where it is unique."""

    def __init__(self, loggers: Iterable[Logger]):
        self.loggers: list[Logger] = []
        for x in loggers:
            if not any(x is y or x == y for y in self.loggers):
                self.loggers.append(x)
        _unique((x.name for x in self.loggers), "logger")

    def __iter__(self) -> Iterator[Logger]:
        return iter(self.loggers)

    def __len__(self) -> int:
        return len(self.loggers)

    def __getitem__(self, i: int) -> Logger:
        return self.loggers[i]

    def __contains__(self, name: str) -> bool:
        try:
            return self.table(name) is not None
        except CatalogError:
            return False

    @property
    def tables(self) -> list[Table]:
        return [t for x in self.loggers for t in x.tables.values()]

    def table(self, name: str) -> Table:
        found = [t for t in self.tables if name in (t.ident, t.name, t.sql)]
        _need(found, f"no table {name!r}")
        _need(len(found) == 1, f"several tables {name!r}")
        return found[0]
