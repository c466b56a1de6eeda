"""All registered queries of the library with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filenames, scalars, text
from ..functions.quality import basic_quality
from ..functions.timeseries import Interval, check_timeseq, missing_slots, outside_ranges, overlapping
from ..functions.types import BigInt, NonNegInt, Num, TimestampNoTz, TimestampWithTz, cast_all, infer_types, type_violations
from ..operators import checksum, records, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function by its name, with its oracle SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- time series ---------------------------------------------------------------------------------

_DAILY = """
WITH e AS (SELECT user_id, event_id, date_trunc('day', ts)::TIMESTAMP AS slot FROM events WHERE user_id IS NOT NULL),
w AS (SELECT *, lag(slot) OVER (PARTITION BY user_id ORDER BY event_id) AS prev, count(*) OVER (PARTITION BY user_id) AS n,
 row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM e),
q AS (SELECT user_id, event_id, CASE WHEN rn = 1 THEN 'GOOD' WHEN slot = prev + INTERVAL 1 DAY THEN 'GOOD'
 WHEN slot > prev + INTERVAL 1 DAY THEN 'UNUSUAL' ELSE 'BAD' END AS quality FROM w WHERE n > 1)
"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("user_id is not null")
    e = e.select("user_id", "event_id", Interval.DAY1.floor(F.col("ts")).alias("slot"))
    return check_timeseq(e, "slot", "event_id", Interval.DAY1, ["user_id"])


@query(_DAILY + "SELECT user_id, event_id, quality FROM q")
def timeseq_gap_daily(spark, sf_dir):
    return _daily(spark, sf_dir).select("user_id", "event_id", "quality")


@query(_DAILY + "SELECT user_id, quality, count(*) AS n FROM q GROUP BY ALL")
def timeseq_summary(spark, sf_dir):
    return _daily(spark, sf_dir).groupBy("user_id", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH w AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS prev, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE user_id IS NOT NULL)
SELECT user_id, event_id, CASE WHEN ts <> date_trunc('hour', ts)::TIMESTAMP THEN 'BAD' WHEN prev IS NULL THEN 'GOOD'
 WHEN ts = date_trunc('hour', prev)::TIMESTAMP + INTERVAL 1 HOUR THEN 'GOOD' WHEN ts > date_trunc('hour', prev)::TIMESTAMP + INTERVAL 1 HOUR THEN 'UNUSUAL' ELSE 'BAD' END AS quality
FROM w WHERE n > 1""")
def timeseq_raw_hourly(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("user_id is not null")
    return check_timeseq(e, "ts", "event_id", Interval.HOUR1, ["user_id"]).select("user_id", "event_id", "quality")


@query("""
SELECT event_id, time_bucket(INTERVAL 15 MINUTES, ts) AS min15, time_bucket(INTERVAL 30 MINUTES, ts) AS min30, date_trunc('hour', ts)::TIMESTAMP AS hour1,
 date_trunc('day', ts)::TIMESTAMP AS day1, date_trunc('week', ts)::TIMESTAMP AS week1, date_trunc('month', ts)::TIMESTAMP AS month1 FROM events""")
def time_floor_all(spark, sf_dir):
    kinds = (Interval.MIN15, Interval.MIN30, Interval.HOUR1, Interval.DAY1, Interval.WEEK1, Interval.MONTH1)
    return table(spark, sf_dir, "events").select("event_id", *(k.floor(F.col("ts")).alias(k.name.lower()) for k in kinds))


def _span(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("user_id is not null").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return e.select("user_id", Interval.DAY1.floor(F.col("a")).alias("a"), Interval.DAY1.floor(F.col("b")).alias("b"))


_SPAN = "WITH s AS (SELECT user_id, date_trunc('day', min(ts))::TIMESTAMP AS a, date_trunc('day', max(ts))::TIMESTAMP AS b FROM events WHERE user_id IS NOT NULL GROUP BY user_id)"


@query(_SPAN + "SELECT user_id, slot FROM (SELECT user_id, b, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS slot FROM s) WHERE slot < b")
def interval_series_day(spark, sf_dir):
    return _span(spark, sf_dir).select("user_id", F.explode(Interval.DAY1.series(F.col("a"), F.col("b"))).alias("slot"))


@query("""
WITH RECURSIVE s AS (SELECT o_orderkey, TIMESTAMP '2023-10-31' AS slot, TIMESTAMP '2023-10-31' + INTERVAL (o_orderkey % 200 + 1) DAY AS b FROM orders
 UNION ALL SELECT o_orderkey, slot + INTERVAL 1 MONTH, b FROM s WHERE slot + INTERVAL 1 MONTH < b)
SELECT o_orderkey, slot FROM s""")
def interval_series_month(spark, sf_dir):
    start = F.lit("2023-10-31").cast("timestamp_ntz")
    o = table(spark, sf_dir, "orders").select("o_orderkey", (start + F.make_dt_interval(days=(F.col("o_orderkey") % 200 + 1).cast("int"))).alias("b"))
    return o.select("o_orderkey", F.explode(Interval.MONTH1.series(start, F.col("b"))).alias("slot"))


@query("""
WITH o AS (SELECT DISTINCT user_id, date_trunc('day', ts)::TIMESTAMP AS slot FROM events WHERE user_id IS NOT NULL),
s AS (SELECT user_id, min(slot) AS a, max(slot) AS b FROM o GROUP BY user_id),
g AS (SELECT user_id, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS slot FROM s)
SELECT user_id, slot FROM g WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = g.user_id AND o.slot = g.slot)""")
def missing_slots_daily(spark, sf_dir):
    return missing_slots(table(spark, sf_dir, "events").filter("user_id is not null"), "ts", Interval.DAY1, ["user_id"])


_RANGES = [(0, "2024-01-03 00:00:00", "2024-01-05 12:00:00"), (1, "2024-01-05 00:00:00", "2024-01-07 00:00:00"), (2, "2024-01-10 06:00:00", None), (3, "2024-01-10 00:00:00", "2024-01-11 00:00:00"), (4, "2024-01-07 00:00:00", "2024-01-08 00:00:00"), (5, "2024-01-10 06:00:00", None)]
_RANGES_SQL = "WITH r(ord, a, b) AS (VALUES " + ", ".join(f"({o}, TIMESTAMP '{a}', " + (f"TIMESTAMP '{b}'" if b else "NULL::TIMESTAMP") + ")" for o, a, b in _RANGES) + ")"


def _ranges(spark: SparkSession) -> DataFrame:
    r = spark.createDataFrame(_RANGES, "ord int, start string, end string")
    return r.select("ord", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"))


@query(_RANGES_SQL + "SELECT event_id, ts FROM events e WHERE NOT EXISTS (SELECT 1 FROM r WHERE e.ts BETWEEN r.a AND coalesce(r.b, r.a))")
def skip_ranges(spark, sf_dir):
    return outside_ranges(table(spark, sf_dir, "events"), "ts", _ranges(spark)).select("event_id", "ts")


@query(_RANGES_SQL + """SELECT x.ord AS i, y.ord AS j FROM r x JOIN r y ON x.ord < y.ord AND (
 (x.a < y.a AND y.a < coalesce(x.b, x.a)) OR (x.a < coalesce(y.b, y.a) AND coalesce(y.b, y.a) < coalesce(x.b, x.a))
 OR (y.a < x.a AND x.a < coalesce(y.b, y.a) AND y.a < coalesce(x.b, x.a) AND coalesce(x.b, x.a) < coalesce(y.b, y.a)) OR (x.b IS NULL AND y.b IS NULL AND x.a = y.a))""")
def range_overlaps(spark, sf_dir):
    return overlapping(_ranges(spark))


# --- typed strings -------------------------------------------------------------------------------

_LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_NUMBER = "regexp_full_match(v, '-?[0-9]*([.][0-9]*)?') AND regexp_matches(v, '[0-9]')"
_INFER = """
, f AS (SELECT name, bool_and(lower(v) = 'nan') AS only_nan,
 bool_and(lower(v) = 'nan' OR regexp_full_match(v, '0|[1-9][0-9]*') AND coalesce(try_cast(v AS BIGINT) < 2147483648, false)) AS nonneg,
 bool_and(lower(v) = 'nan' OR regexp_full_match(v, '-?(0|[1-9][0-9]*)') AND try_cast(v AS BIGINT) IS NOT NULL) AS big,
 bool_and(lower(v) = 'nan' OR regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}')) AS ntz,
 bool_and(lower(v) = 'nan' OR regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(Z| ?[+-][0-9]{2}:[0-9]{2})')) AS tz,
 bool_and(lower(v) = 'nan' OR NUMBER) AS num,
 max(CASE WHEN NUMBER THEN length(regexp_replace(v, '[^0-9]', '', 'g')) END) AS digits, max(CASE WHEN NUMBER THEN length(split_part(v, '.', 2)) END) AS scale FROM v GROUP BY name)
SELECT name, CASE WHEN only_nan THEN 'OnlyNan' WHEN nonneg THEN 'NonNegInt' WHEN big THEN 'BigInt' WHEN ntz THEN 'TimestampNoTz' WHEN tz THEN 'TimestampWithTz'
 WHEN num AND scale > 0 THEN 'Num(' || digits || ',' || scale || ')' WHEN num THEN 'Num(' || digits || ')' END AS reftype FROM f
""".replace("NUMBER", _NUMBER)


def _strings(df: DataFrame) -> DataFrame:
    return df.select(*(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t.startswith("timestamp") else F.col(c).cast("string").alias(c) for c, t in df.dtypes))


def _sql_text(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')" if column.endswith("date") else f"{column}::VARCHAR"


@query("WITH v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, {_sql_text(c)} AS v FROM lineitem" for c in _LINEITEM) + ")" + _INFER)
def infer_types_lineitem(spark, sf_dir):
    return infer_types(_strings(table(spark, sf_dir, "lineitem").select(*_LINEITEM)))


_ORDER_TYPES = {"o_orderkey": NonNegInt(), "o_totalprice": Num(8, 2), "o_orderstatus": BigInt(), "o_orderdate": TimestampNoTz()}


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey::VARCHAR AS k, o_totalprice::VARCHAR AS p, o_orderstatus AS s, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS d FROM orders),
c AS (SELECT o_orderkey AS id, 'o_orderkey' AS name, k AS value, regexp_full_match(k, '0|[1-9][0-9]*') AND coalesce(try_cast(k AS BIGINT) < 2147483648, false) AS ok FROM o
 UNION ALL SELECT o_orderkey, 'o_totalprice', p, regexp_full_match(p, '-?[0-9]{0,6}([.][0-9]{0,2})?') AND regexp_matches(p, '[0-9]') FROM o
 UNION ALL SELECT o_orderkey, 'o_orderstatus', s, regexp_full_match(s, '-?(0|[1-9][0-9]*)') AND try_cast(s AS BIGINT) IS NOT NULL FROM o
 UNION ALL SELECT o_orderkey, 'o_orderdate', d, regexp_full_match(d, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') FROM o)
SELECT id, name, value FROM c WHERE value IS NOT NULL AND NOT (lower(value) = 'nan' OR ok)""")
def typecheck_violations(spark, sf_dir):
    o = _strings(table(spark, sf_dir, "orders"))
    return type_violations(o.withColumn("id", F.col("o_orderkey").cast("long")), _ORDER_TYPES, ["id"])


@query("""
SELECT o_orderkey::INTEGER AS o_orderkey, try_cast(o_totalprice AS DECIMAL(12,2))::DOUBLE AS o_totalprice, o_orderdate::TIMESTAMP AS o_orderdate, o_orderpriority,
 (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '+02:00')::TIMESTAMPTZ::TIMESTAMP AS with_tz FROM (SELECT o_orderkey, o_totalprice, date_trunc('second', o_orderdate)::TIMESTAMP AS o_orderdate, o_orderpriority FROM orders)""")
def cast_typed(spark, sf_dir):
    o = _strings(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority")).withColumn("with_tz", F.concat("o_orderdate", F.lit(" +02:00")))
    o = cast_all(o, {"o_orderkey": NonNegInt(), "o_totalprice": Num(12, 2), "o_orderdate": TimestampNoTz(), "with_tz": TimestampWithTz()})
    return o.withColumns({"with_tz": F.col("with_tz").cast("timestamp_ntz"), "o_totalprice": F.col("o_totalprice").cast("double")})


@query("""
SELECT o_orderkey, timezone('Europe/Berlin', date_trunc('second', o_orderdate)::TIMESTAMP) AT TIME ZONE 'UTC' AS utc FROM orders""")
def wall_clock_to_utc(spark, sf_dir):
    o = _strings(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))
    return o.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), TimestampNoTz().to_utc(F.col("o_orderdate"), "Europe/Berlin").alias("utc"))


# --- quality -------------------------------------------------------------------------------------

_MARKED = "CASE c_custkey % 7 WHEN 0 THEN 7999.0 WHEN 1 THEN -7999.0 WHEN 2 THEN 'NaN'::DOUBLE WHEN 3 THEN 'inf'::DOUBLE WHEN 4 THEN NULL ELSE c_acctbal END"
_NUMBER_QUALITY = "CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 'BAD' WHEN x IN (7999, -7999) THEN 'UNUSUAL' ELSE 'GOOD' END"


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, nan, inf = F.col("c_custkey") % 7, F.lit(float("nan")), F.lit(float("inf"))
    x = F.when(m == 0, 7999.0).when(m == 1, -7999.0).when(m == 2, nan).when(m == 3, inf).when(m == 4, F.lit(None)).otherwise(F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").withColumn("x", x)


@query(f"SELECT c_custkey, {_NUMBER_QUALITY} AS quality FROM (SELECT c_custkey, {_MARKED} AS x FROM customer)")
def basic_quality_numeric(spark, sf_dir):
    df = _marked(spark, sf_dir)
    return df.select("c_custkey", basic_quality(F.col("x"), df.schema["x"].dataType).alias("quality"))


@query(f"SELECT c_mktsegment, {_NUMBER_QUALITY} AS quality, count(*) AS n FROM (SELECT c_mktsegment, {_MARKED} AS x FROM customer) GROUP BY ALL")
def quality_rollup(spark, sf_dir):
    df = _marked(spark, sf_dir)
    return df.groupBy("c_mktsegment", basic_quality(F.col("x"), df.schema["x"].dataType).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_partkey, CASE WHEN x IS NULL OR lower(x) = 'nan' THEN 'BAD' WHEN regexp_full_match(x, '\\s+') OR x IN ('', '7999', '-7999') THEN 'UNUSUAL' ELSE 'GOOD' END AS quality
FROM (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN '7999' WHEN 3 THEN 'nAn' WHEN 4 THEN '7999.0' WHEN 5 THEN NULL WHEN 6 THEN 'inf' ELSE p_name END AS x FROM part)""")
def basic_quality_string(spark, sf_dir):
    m = F.col("p_partkey") % 8
    x = F.when(m == 0, "").when(m == 1, "  ").when(m == 2, "7999").when(m == 3, "nAn").when(m == 4, "7999.0").when(m == 5, F.lit(None)).when(m == 6, "inf").otherwise(F.col("p_name"))
    df = table(spark, sf_dir, "part").withColumn("x", x)
    return df.select("p_partkey", basic_quality(F.col("x"), df.schema["x"].dataType).alias("quality"))


# --- records -------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, NULL::VARCHAR AS o_orderpriority, o_custkey::VARCHAR AS o_custkey FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey::VARCHAR, NULL, o_orderpriority, o_custkey::VARCHAR FROM orders WHERE o_orderkey % 2 = 1""")
def variant_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string").alias("o_custkey"))
    odd = F.col("o_orderkey").cast("long") % 2 == 1
    return records.union_layouts([o.filter(~odd).drop("o_orderpriority"), o.filter(odd).drop("o_orderstatus")], ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey"])


@query("SELECT o_orderdate AS \"Timestamp\", o_totalprice AS price, o_orderkey AS id FROM orders")
def mapped_view(spark, sf_dir):
    return records.view(table(spark, sf_dir, "orders"), [("o_orderdate", "Timestamp"), ("o_totalprice", "price"), ("o_orderkey", "id")])


_PATTERNS = [("any_region0", None, 0), ("any_region1", None, 1), ("named", "NATION_3", None), ("both", "NATION_3", 3)]


@query("""
WITH p(logger, name, region) AS (VALUES ('any_region0', NULL, 0), ('any_region1', NULL, 1), ('named', 'NATION_3', NULL), ('both', 'NATION_3', 3)),
e AS (SELECT n_name AS name, n_regionkey AS region FROM nation JOIN customer ON c_nationkey = n_nationkey), d AS (SELECT name, region, count(*) AS n_rows FROM e GROUP BY ALL)
SELECT d.name, d.region, n_rows, count(logger) AS n_matches, min(logger) AS logger
FROM d LEFT JOIN p ON (p.name IS NULL OR p.name = d.name) AND (p.region IS NULL OR p.region = d.region) GROUP BY ALL""")
def env_match(spark, sf_dir):
    """Environments as files bring them: each nation once for each of its customers."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    env = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return records.match_environment(env, spark.createDataFrame(_PATTERNS, "logger string, name string, region int"), ["name", "region"])


@query("SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS c_mktsegment FROM customer GROUP BY c_nationkey")
def env_merge(spark, sf_dir):
    from ..sources.toa5 import merge_environments

    return merge_environments(table(spark, sf_dir, "customer"), fields=["c_mktsegment"], keys=["c_nationkey"])


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


# --- store ---------------------------------------------------------------------------------------

_COPY = "SELECT o_orderkey AS k, o_orderstatus AS s, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 3 <> 0"
_ALL = "SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 4 <> 0"


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    changed = o.withColumn("p", F.when(F.col("k") % 10 == 0, F.lit(None)).otherwise(F.col("p")))
    return o.filter("k % 4 <> 0"), changed.filter("k % 3 <> 0")


@query(f"WITH a AS ({_ALL}), b AS ({_COPY}) SELECT b.k, CASE WHEN a.s IS DISTINCT FROM b.s THEN 's' ELSE '' END || CASE WHEN a.p IS DISTINCT FROM b.p THEN 'p' ELSE '' END AS changed FROM b JOIN a USING (k) WHERE a.s IS DISTINCT FROM b.s OR a.p IS DISTINCT FROM b.p")
def pk_conflicts(spark, sf_dir):
    old, new = _stored(spark, sf_dir)
    return store.conflicts_between(old, new, ["k"]).select("k", F.array_join("changed", "").alias("changed"))


@query(f"WITH u AS ({_ALL} UNION ALL {_COPY}) SELECT k, count(*) AS n_rows FROM (SELECT DISTINCT k, s, p FROM u) GROUP BY k HAVING count(*) > 1")
def pk_conflicts_within(spark, sf_dir):
    old, new = _stored(spark, sf_dir)
    return store.conflicts_within(old.unionByName(new), ["k"])


@query(f"WITH u AS (SELECT 0 AS o, * FROM ({_COPY}) UNION ALL SELECT 1, * FROM ({_ALL})) SELECT k, s, p FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY o) = 1")
def pk_dedup(spark, sf_dir):
    old, new = _stored(spark, sf_dir)
    return store.first_rows(new.withColumn("o", F.lit(0)).unionByName(old.withColumn("o", F.lit(1))), ["k"], "o")


@query(f"WITH u AS (SELECT 0 AS o, * FROM ({_COPY}) UNION ALL SELECT 1, * FROM ({_ALL})) SELECT k, s, p FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY o DESC) = 1")
def pk_latest(spark, sf_dir):
    old, new = _stored(spark, sf_dir)
    return store.latest_rows(new.withColumn("o", F.lit(0)).unionByName(old.withColumn("o", F.lit(1))), ["k"], "o").drop("o")


@query(f"WITH a AS ({_ALL}), b AS ({_COPY}) SELECT k, s, p FROM b WHERE k NOT IN (SELECT k FROM a)")
def pk_append_new(spark, sf_dir):
    old, new = _stored(spark, sf_dir)
    return store.new_rows(old, new, ["k"])


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def dup_names(spark, sf_dir):
    return store.duplicates(table(spark, sf_dir, "part"), ["p_name"])


@query("SELECT o_orderkey, epoch(date_trunc('minute', o_orderdate))::BIGINT - 7200 AS pk, strftime(date_trunc('minute', o_orderdate)::TIMESTAMP - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%SZ') AS shown FROM orders")
def epoch_pk_roundtrip(spark, sf_dir):
    spelled = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"), F.lit("+02:00"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", scalars.epoch_key(spelled).alias("pk"))
    return o.withColumn("shown", scalars.epoch_text(F.col("pk")))


@query("""
SELECT strftime(TIMESTAMP '2000-01-01' + to_minutes(o_orderkey), '%Y-%m-%d %H:%M:%SZ') AS at, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def store_roundtrip(spark, sf_dir):
    """A store with a time as key: created, filled twice with overlap and conflicts, scanned by key."""
    import uuid

    from ..sources.shared import shared_folder

    t = store.StoreTable(f"kept_{uuid.uuid4().hex}", (store.StoreColumn("at", "BIGINT", key=True), store.StoreColumn("status"), store.StoreColumn("price", "DOUBLE", comment="total")), key_is_time=True)
    t.create(spark, shared_folder(spark, "store"))
    o = table(spark, sf_dir, "orders")
    minute = lambda zone: F.timestamp_seconds(F.col("o_orderkey") * 60 + 946684800 + zone * 3600)
    spelled = lambda zone, end: F.concat(F.date_format(minute(zone), "yyyy-MM-dd HH:mm:ss"), F.lit(end)).alias("at")
    rows = lambda df, at, price: df.select(at, F.col("o_orderstatus").alias("status"), price.alias("price"))
    t.append(spark, rows(o.filter("o_orderkey % 2 = 0"), spelled(0, "Z"), F.col("o_totalprice")))
    changed = F.when(F.col("o_orderkey") % 30 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    t.append(spark, rows(o.filter("o_orderkey % 3 = 0"), spelled(2, "+02:00"), changed), mode="report")
    return t.scan(spark)


# --- checksums -----------------------------------------------------------------------------------


def _hashes(algorithm: str, oracle: str | None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", checksum.digest(F.col("text").cast("binary"), algorithm).alias("digest"))

    run.__name__ = f"hash_documents_{algorithm}"
    return query(f"SELECT doc_id, {oracle}(text) AS digest FROM documents" if oracle else None)(run)


for _algorithm, _oracle in (("md5", "md5"), ("sha1", "sha1"), ("sha256", "sha256"), ("sha224", None), ("sha384", None), ("sha512", None)):
    _hashes(_algorithm, _oracle)

_FILES = "SELECT doc_id AS ord, 'tree/' || source || '/' || doc_id || '.txt' AS fn, text FROM documents"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    fn = F.concat(F.lit("tree/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), fn.alias("fn"), "text")


@query(f"SELECT sha256(text) || ' *' || fn AS value FROM ({_FILES})")
def manifest_lines(spark, sf_dir):
    return checksum.generate_manifest(_files(spark, sf_dir).select("fn", F.col("text").cast("binary").alias("content")), "sha256")


@query(f"""SELECT lower(regexp_extract(v, '^([0-9A-Fa-f]+) ([ *])(.+)$', 1)) AS hsh, regexp_extract(v, '^([0-9A-Fa-f]+) ([ *])(.+)$', 2) = '*' AS binflag, regexp_extract(v, '^([0-9A-Fa-f]+) ([ *])(.+)$', 3) AS fn
FROM (SELECT upper(sha1(text)) || CASE WHEN ord % 2 = 0 THEN '  ' ELSE ' *' END || fn AS v FROM ({_FILES}))""")
def manifest_parse(spark, sf_dir):
    f = _files(spark, sf_dir)
    line = F.concat(F.upper(F.sha1(F.col("text").cast("binary"))), F.when(F.col("ord") % 2 == 0, "  ").otherwise(" *"), F.col("fn"))
    return checksum.parse_lines(f.select(line.alias("value"))).drop("valid")


def _sums(f: DataFrame) -> DataFrame:
    """A manifest that lacks some files, has some that are gone, and some stale digests."""
    stale = F.when(F.col("ord") % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    named = F.when(F.col("ord") % 13 == 0, F.concat(F.lit("gone/"), F.col("fn"))).otherwise(F.col("fn"))
    return f.filter("ord % 7 <> 0").select("ord", named.alias("fn"), F.sha2(stale.cast("binary"), 256).alias("hsh"))


@query(f"""
WITH f AS ({_FILES}), s AS (SELECT CASE WHEN ord % 13 = 0 THEN 'gone/' || fn ELSE fn END AS fn, sha256(CASE WHEN ord % 11 = 0 THEN text || 'x' ELSE text END) AS hsh FROM f WHERE ord % 7 <> 0)
SELECT coalesce(f.fn, s.fn) AS fn, CASE WHEN f.fn IS NULL THEN 'MISSING' WHEN s.fn IS NULL THEN 'NOSUM' WHEN sha256(f.text) = s.hsh THEN 'SUMOK' ELSE 'SUMMISMATCH' END AS code
FROM f FULL OUTER JOIN s ON f.fn = s.fn""")
def reconcile_manifest(spark, sf_dir):
    f = _files(spark, sf_dir)
    files = f.select("ord", "fn", F.lit("NONE").alias("code"), F.lit(None).cast("string").alias("msg"))
    met = checksum.reconcile(_sums(f), files)
    return checksum.validate(met, f.select("fn", F.col("text").cast("binary").alias("content"))).select("fn", "code")


@query("""
WITH f AS (SELECT p_partkey AS ord, 'd' || p_partkey || '/' || p_name AS fn, p_name AS key FROM part),
s AS (SELECT p_partkey AS ord, p_name AS key, md5(p_brand) AS hsh FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 1000000 + p_partkey, 'x' || p_name, md5(p_brand) FROM part WHERE p_partkey % 50 = 0),
d AS (SELECT key AS fn, 'DUPEFN' AS code FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) > 1),
l AS (SELECT key, count(*) > 1 AS doubled, arg_max(fn, ord) AS fn FROM f GROUP BY key),
u AS (SELECT DISTINCT key, hsh, min(ord) OVER (PARTITION BY key, hsh) AS ord FROM s),
a AS (SELECT key, arg_min(hsh, ord) AS first_hsh, count(DISTINCT hsh) > 1 AS differs FROM u GROUP BY key),
b AS (SELECT u.key AS fn, 'BADINPUT' AS code FROM u JOIN a USING (key) WHERE u.hsh <> a.first_hsh),
m AS (SELECT coalesce(l.fn, a.key) AS fn, CASE WHEN l.key IS NULL THEN 'MISSING' WHEN a.key IS NULL THEN 'NOSUM' WHEN l.doubled OR a.differs THEN 'UNKNOWN' ELSE 'NEEDSVALIDATE' END AS code FROM l FULL OUTER JOIN a ON l.key = a.key)
SELECT fn, code FROM d UNION ALL SELECT fn, code FROM b UNION ALL SELECT fn, code FROM m""")
def reconcile_dupes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    files = p.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("d"), F.col("p_partkey").cast("string"), F.lit("/"), "p_name").alias("fn"), F.lit("NONE").alias("code"), F.lit(None).cast("string").alias("msg"))
    sums = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("some/"), "p_name").alias("fn"), F.md5("p_brand").alias("hsh"))
    more = p.filter("p_partkey % 50 = 0").select((F.col("p_partkey") + 1000000).alias("ord"), F.concat(F.lit("x"), "p_name").alias("fn"), F.md5("p_brand").alias("hsh"))
    return checksum.reconcile(sums.unionByName(more), files, ignore_path=True).select("fn", "code")


def _sorted_manifest(name: str, columns: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = _files(spark, sf_dir).select("fn", F.md5(F.col("text").cast("binary")).alias("hsh"), F.col("ord").alias("place"))
        return checksum.with_ordinal(f, columns).select("fn", "hsh", "ordinal")

    run.__name__ = name
    keys = ", ".join({"place": "ord"}.get(c, c) for c in columns)
    return query(f"SELECT fn, hsh, row_number() OVER (ORDER BY {keys}) AS ordinal FROM (SELECT fn, md5(text) AS hsh, ord FROM ({_FILES}))")(run)


for _name, _keys in (("sort_by_line", ["hsh", "fn", "place"]), ("sort_by_hash", ["hsh", "place"]), ("sort_by_file", ["fn", "place"])):
    _sorted_manifest(_name, _keys)


@query("""
WITH d AS (SELECT doc_id AS k, source || '/' || doc_id || '.txt' AS fn FROM documents)
SELECT CASE WHEN k % 13 = 0 AND k % 7 <> 0 THEN 'gone/' || fn ELSE fn END AS fn, CASE WHEN k % 7 = 0 THEN 'NOSUM' WHEN k % 13 = 0 THEN 'MISSING' WHEN k % 11 = 0 THEN 'SUMMISMATCH' ELSE 'SUMOK' END AS code FROM d
UNION ALL SELECT fn, 'NOSUM' FROM d WHERE k % 13 = 0 AND k % 7 <> 0
UNION ALL SELECT 'links/' || k, 'SKIP' FROM d WHERE k % 20 = 0 UNION ALL SELECT 'pipes/' || k, 'SKIP' FROM d WHERE k % 50 = 0""")
def checksum_tree(spark, sf_dir):
    """Documents as real files with links and pipes beside them, listed, matched with a manifest and read again for their digests.

    Needs a shared folder that is mounted.
    """
    import os

    from ..sources.shared import plain, shared_folder, write_file

    root = os.path.realpath(plain(shared_folder(spark, "tree")))
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), name.alias("fn"), "text")

    def write(batches):
        for batch in batches:
            # Texts go from the batch to their files, one by one: no copy of a batch is made.
            for k, fn, text in zip(batch["ord"].to_pylist(), batch["fn"].to_pylist(), batch["text"], strict=True):
                write_file(f"{root}/{fn}", text.as_buffer() or b"")
                for kind, every, make in (("links", 20, lambda p: os.symlink("nowhere", p)), ("pipes", 50, os.mkfifo)):
                    if k % every == 0:
                        os.makedirs(f"{root}/{kind}", exist_ok=True)
                        if not os.path.lexists(f"{root}/{kind}/{k}"):
                            make(f"{root}/{kind}/{k}")
            yield batch.select(["ord"])

    d.mapInArrow(write, "ord long").count()
    sums = _sums(d).withColumn("hsh", F.col("hsh"))
    results = checksum.check_hashes(checksum.match_files(spark, sums, [root]))
    return results.select(scalars.relative_to(F.col("fn"), F.lit(root)).alias("fn"), "code")


# --- texts and names -----------------------------------------------------------------------------


@query("SELECT doc_id, length_grapheme(text)::BIGINT AS n FROM documents")
def grapheme_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.graphemes(F.col("text"))).cast("long").alias("n"))


@query("""
SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(string_split(text, ''), lambda x: NOT regexp_full_match(x, '[\\t\\n\\r\\x20-\\x7E]')))), ' '), '') AS strange FROM documents""")
def nonascii_graphemes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.uncommon(F.col("text")), " ").alias("strange"))


_ENDS = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, chr(10), chr(13)) WHEN 2 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE replace(text, chr(10), chr(1) || chr(10) || chr(13) || chr(13) || chr(10)) END"


@query(f"""
WITH d AS (SELECT doc_id, {_ENDS} AS t FROM documents),
c AS (SELECT doc_id, (length(t) - length(replace(t, chr(13), '')))::BIGINT AS cr, (length(t) - length(replace(t, chr(10), '')))::BIGINT AS lf, ((length(t) - length(replace(t, chr(13) || chr(10), ''))) // 2)::BIGINT AS crlf,
 (length(t) - length(replace(t, chr(1), '')))::BIGINT AS ctrl FROM d),
n AS (SELECT doc_id, cr - crlf AS cr, lf - crlf AS lf, crlf, 0::BIGINT AS nul, ctrl FROM c)
SELECT *, concat_ws(', ', CASE WHEN cr > 0 THEN cr || ' CR' END, CASE WHEN lf > 0 THEN lf || ' LF' END, CASE WHEN crlf > 0 THEN crlf || ' CRLF' END, CASE WHEN ctrl > 0 THEN ctrl || ' control' END,
 CASE WHEN (cr > 0)::INT + (lf > 0)::INT + (crlf > 0)::INT > 1 THEN 'MIXED CR/LF' END) AS report FROM n""")
def control_char_report(spark, sf_dir):
    m, t = F.col("doc_id") % 4, F.col("text")
    ends = F.when(m == 0, t).when(m == 1, F.replace(t, F.lit("\n"), F.lit("\r"))).when(m == 2, F.replace(t, F.lit("\n"), F.lit("\r\n"))).otherwise(F.replace(t, F.lit("\n"), F.lit("\x01\n\r\r\n")))
    d = table(spark, sf_dir, "documents").select("doc_id", ends.alias("t"))
    return d.select("doc_id", *(n.alias(k) for k, n in text.control_counts(F.col("t")).items()), text.control_report(F.col("t")).alias("report"))


@query()
def encodings_ascii_utf8(spark, sf_dir):
    data = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode(F.regexp_replace("text", "[^\\x00-\\xFF]", "?"), "ISO-8859-1"))
    d = table(spark, sf_dir, "documents").select("doc_id", data.alias("data"))
    return d.select("doc_id", F.array_join(text.decodable(F.col("data")), ",").alias("encodings"), text.first_encoding(F.col("data")).alias("first"))


@query()
def character_names(spark, sf_dir):
    strange = F.array_join(text.uncommon(F.col("text")), "")
    return table(spark, sf_dir, "documents").select("doc_id", text.character_names(strange).alias("names"), text.composed("text").eqNullSafe(F.col("text")).alias("is_nfc"))


_CASED = "SELECT p_partkey AS ord, p_brand AS loc, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN lower(p_name) ELSE p_name END AS name FROM part"


@query(f"""
WITH p AS ({_CASED}), f AS (SELECT DISTINCT ord, loc, name, unnest([upper(name), lower(name)]) AS form FROM p),
s AS (SELECT *, min(ord) OVER (PARTITION BY loc, form) < ord AS seen FROM f)
SELECT loc, ord, name, string_agg(form, ', ' ORDER BY form) AS forms FROM s WHERE seen GROUP BY loc, ord, name""")
def case_collisions(spark, sf_dir):
    m = F.col("p_partkey") % 3
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("loc"), F.when(m == 0, F.upper("p_name")).when(m == 1, F.lower("p_name")).otherwise(F.col("p_name")).alias("name"))
    hits = filenames.case_collisions(p, "name", "ord", ["loc"])
    return hits.select("loc", "ord", "name", F.array_join("forms", ", ").alias("forms"))


@query("""
WITH p AS (SELECT page_id, unnest(string_split(url, '/')) AS part FROM pages),
d AS (SELECT DISTINCT page_id, part FROM p WHERE part <> '' UNION ALL SELECT page_id, 'com' || (page_id % 11) || '.txt' FROM pages UNION ALL SELECT page_id, 'name ' FROM pages WHERE page_id % 5 = 0),
q AS (SELECT page_id, part, regexp_matches(part, '(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\\.|$)') OR regexp_matches(part, '[<>:"/\\\\|?*\\x00-\\x1F]') OR regexp_matches(part, '[ .]$') AS bad FROM d)
SELECT page_id, part FROM q WHERE bad""")
def bad_filenames(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    parts = pages.select("page_id", F.explode(F.array_distinct(F.split("url", "/"))).alias("part")).filter("part <> ''")
    more = pages.select("page_id", F.concat(F.lit("com"), (F.col("page_id") % 11).cast("string"), F.lit(".txt")).alias("part"))
    last = pages.filter("page_id % 5 = 0").select("page_id", F.lit("name ").alias("part"))
    return parts.unionByName(more).unionByName(last).filter(filenames.bad_on_windows(F.col("part")))


@query()
def filename_problems(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    parts = pages.select("page_id", F.explode(F.array_distinct(F.split("url", "/"))).alias("part")).filter("part <> ''")
    return filenames.name_problems(parts.withColumn("loc", F.lit("all")), "part", "page_id", ["loc"], filenames.GERMAN).select("page_id", "part", "problem")


# --- scalars -------------------------------------------------------------------------------------


@query("SELECT p_partkey, (p_size * 3600 + p_size * 60 + CASE WHEN p_partkey % 2 = 0 THEN p_size * 86400 + p_size ELSE 0 END)::BIGINT AS seconds FROM part")
def delta_seconds(spark, sf_dir):
    n = F.col("p_size").cast("string")
    spelled = F.when(F.col("p_partkey") % 2 == 0, F.concat(n, F.lit(" "), n, F.lit("D "), n, F.lit("h"), n, F.lit(" m"))).otherwise(F.concat(F.lit(" "), n, F.lit("h "), n, F.lit("m ")))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.deltaparse(spelled).alias("seconds"))


@query("""
SELECT p_partkey, abs(a - b) = 0.01 AS obo FROM (SELECT p_partkey, p_retailprice::DECIMAL(12,2) AS a, p_retailprice::DECIMAL(12,2) + CASE p_partkey % 3 WHEN 0 THEN 0.01 WHEN 1 THEN 0.02 ELSE 0 END AS b FROM part)""")
def lsb_obo_pairs(spark, sf_dir):
    a = F.col("p_retailprice").cast("decimal(12,2)")
    m = F.col("p_partkey") % 3
    b = (a + F.when(m == 0, F.lit(0.01).cast("decimal(12,2)")).when(m == 1, F.lit(0.02).cast("decimal(12,2)")).otherwise(F.lit(0).cast("decimal(12,2)"))).cast("decimal(12,2)")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.lsb_obo(a.cast("string"), b.cast("string")).alias("obo"))


@query("SELECT page_id, '/a/' || page_id || '/c' AS path, page_id || '/c' AS below, 'x/' || page_id AS posix FROM pages")
def path_forms(spark, sf_dir):
    k = F.col("page_id").cast("string")
    path = scalars.normalized(F.concat(F.lit("/../a//"), k, F.lit("/./b/../c/")))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), scalars.relative_to(path, F.lit("/a/")).alias("below"), scalars.as_posix(F.concat(F.lit("x\\"), k)).alias("posix"))


@query("""
SELECT p_partkey, (p_size * 3660)::BIGINT AS seconds, p_partkey % 2 = 0 AS obo, CASE p_partkey % 3 WHEN 0 THEN 'UNUSUAL' WHEN 1 THEN 'GOOD' ELSE 'BAD' END AS quality,
 CASE WHEN p_partkey % 2 = 0 THEN '1 LF, 1 CRLF, MIXED CR/LF' ELSE '2 CR' END AS report, CASE WHEN p_partkey % 4 = 0 THEN 'NonNegInt' ELSE 'Num(' || (length(floor(p_retailprice)::BIGINT::VARCHAR) + 2) || ',2)' END AS reftype FROM part""")
def sql_functions(spark, sf_dir):
    """The library's functions called from SQL."""
    from ..functions.sql import register_sql

    register_sql(spark)
    p = table(spark, sf_dir, "part").withColumn("price", F.col("p_retailprice").cast("decimal(12,2)"))
    return p.selectExpr(
        "p_partkey",
        "deltaparse(concat(p_size, 'h ', p_size, 'm')) AS seconds",
        "lsb_obo(cast(price AS STRING), cast(cast(price + if(p_partkey % 2 = 0, 0.01, 0.03) AS DECIMAL(12,2)) AS STRING)) AS obo",
        "basic_quality(CASE p_partkey % 3 WHEN 0 THEN '7999' WHEN 1 THEN p_name ELSE 'NaN' END) AS quality",
        r"control_char_report(if(p_partkey % 2 = 0, concat(p_name, '\r\n', p_name, '\n'), concat(p_name, '\r', p_name, '\r'))) AS report",
        "infer_reftype(if(p_partkey % 4 = 0, array(cast(p_size AS STRING)), array(cast(p_size AS STRING), cast(price AS STRING)))) AS reftype",
    )


@query("SELECT page_id, string_split(url, '/')[-1] AS name FROM pages")
def path_basename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.basename(F.col("url")).alias("name"))


# --- sources -------------------------------------------------------------------------------------


@query("SELECT date_trunc('second', o_orderdate)::TIMESTAMP AS \"timestamp\", o_orderkey::BIGINT AS record, o_totalprice::DECIMAL(12,2) AS price FROM orders")
def toa5_roundtrip(spark, sf_dir):
    """Orders written as logger files into the shared folder, read back by read_toa5() and typed.

    Needs a shared folder that is mounted.
    """
    from pyspark import TaskContext

    from ..sources.shared import plain, shared_folder, write_file
    from ..sources.toa5 import read_toa5, write_rows
    from .catalog import load_logger

    columns = [{"name": "TIMESTAMP", "unit": "TS", "type": "TimestampNoTz"}, {"name": "RECORD", "unit": "RN", "type": "NonNegInt"}, {"name": "Price", "unit": "Volts", "prc": "Avg", "type": "Num(12,2)"}]
    logger = load_logger({"logger_name": "Orders", "tz": "UTC", "toa5_env_match": {"station_name": "Orders"}, "tables": {"Hourly": {"interval": "1hour", "columns": columns}}})
    t = logger.tables["Hourly"]
    folder = shared_folder(spark, "toa5")
    root, head = plain(folder), write_rows(t, [])
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("o_orderkey").cast("string").alias("k"), F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("price"))

    def write(batches):
        task = TaskContext.get().partitionId()
        for n, batch in enumerate(batches):
            body = "".join(f'"{at}",{k},{price}\r\n' for at, k, price in zip(batch["at"], batch["k"], batch["price"], strict=True))
            write_file(f"{root}/orders-{task}-{n}.dat", (head + body).encode("ascii"))
            yield batch[["k"]]

    o.mapInPandas(write, "k string").count()
    return records.typed(read_toa5(spark, folder, logger, t), t).select("timestamp", "record", "price")
