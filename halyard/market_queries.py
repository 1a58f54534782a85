"""Queries over market data made from the driver's tables: payloads, facts, rules, real-time functions, serving, operations.

Orders give hourly demand and day-ahead prices, lineitems generation and zones, events (moved to the orders' years) the
real-time log. The SQL beside each query makes the same data and says what the contract asks for.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import audit
from halyard.functions.identity import event_id
from halyard.functions.typing import typed
from halyard.operators import realtime, series, serving
from halyard.plans import evidence, quality, runs
from halyard.plans.contracts import CONTRACTS, LINEAGE, PRICES, Contract
from halyard.plans.store import VersionedTable
from halyard.queries import query
from halyard.session import scratch_folder, table
from halyard.sources import catalog, delimited, documents, landing
from halyard.streaming import outbox

#: Days between the events and the orders that they are put beside.
SHIFT = 9131
MONEY = "decimal(18,2)"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}"


def _plain(df: DataFrame) -> DataFrame:
    """df with dates and times as strings and decimals as doubles, as the SQL gives them."""
    kinds = dict(df.dtypes)
    cast = {c: "string" if kinds[c] in ("date", "timestamp") else "double" for c in df.columns if kinds[c] in ("date", "timestamp") or kinds[c].startswith("decimal")}
    return df.withColumns({c: F.col(c).cast(kind) for c, kind in cast.items()})


# -- facts

_DEMAND = """demand AS (SELECT CAST(o_orderdate AS DATE) AS market_date, CAST(o_orderkey % 24 + 1 AS INT) AS hour_ending, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,3)) AS ontario_demand_mw,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) + count(*) AS DECIMAL(18,3)) AS market_demand_mw FROM orders GROUP BY 1, 2)"""
_GENERATION = """generation AS (SELECT CAST(l_shipdate AS DATE) AS market_date, CAST(l_orderkey % 24 + 1 AS INT) AS hour_ending, l_returnflag AS fuel_type, CAST(sum(CASE WHEN l_linenumber <> 3 THEN CAST(l_quantity AS DECIMAL(18,3)) END) AS DECIMAL(18,3)) AS output_mwh,
  CAST(min(l_linenumber) AS INT) AS output_quality_code FROM lineitem GROUP BY 1, 2, 3)"""
_DAY_AHEAD = """day_ahead AS (SELECT CAST(o_orderdate AS DATE) AS market_date, CAST(o_orderkey % 24 + 1 AS INT) AS hour_ending, min(CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS zonal,
  CAST(min(CASE WHEN o_orderstatus <> 'P' THEN -o_orderkey END) AS DECIMAL(18,2)) AS loss, CAST(max(o_custkey) AS DECIMAL(18,2)) AS congestion, min(o_orderstatus) AS flag FROM orders GROUP BY 1, 2)"""
_REALTIME = f"""realtime AS (SELECT CAST(ts AS DATE) - {SHIFT} AS delivery_date, CAST(hour(ts) + 1 AS INT) AS delivery_hour, CAST(minute(ts) // 5 + 1 AS INT) AS interval_no, max(CASE WHEN event_type <> 'error' THEN CAST(value AS DECIMAL(18,2)) END) AS zonal,
  CAST(min(user_id) AS DECIMAL(18,2)) AS loss, CAST(max(user_id) AS DECIMAL(18,2)) AS congestion, min(event_type) AS flag FROM events GROUP BY 1, 2, 3)"""
_ZONES = ", ".join(f"CASE WHEN l_linenumber <> {k} OR k % 5 <> 0 THEN k % {k + 2} END AS {z.lower()}" for k, z in enumerate(delimited.ZONES))


def _demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice").cast(MONEY)
    grouped = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("market_date"), (F.col("o_orderkey") % 24 + 1).cast("int").alias("hour_ending"))
    return grouped.agg(F.sum(price).cast("decimal(18,3)").alias("ontario_demand_mw"), (F.sum(price) + F.count(F.lit(1))).cast("decimal(18,3)").alias("market_demand_mw"))


def _generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("market_date"), (F.col("l_orderkey") % 24 + 1).cast("int").alias("hour_ending"), F.col("l_returnflag").alias("fuel_type"))
    return grouped.agg(F.sum(F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("decimal(18,3)"))).cast("decimal(18,3)").alias("output_mwh"), F.min("l_linenumber").cast("int").alias("output_quality_code"))


def _day_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("market_date"), (F.col("o_orderkey") % 24 + 1).cast("int").alias("hour_ending"))
    prices = [F.min(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice").cast(MONEY))), F.min(F.when(F.col("o_orderstatus") != "P", -F.col("o_orderkey"))), F.max("o_custkey")]
    return grouped.agg(*[x.cast(MONEY).alias(p) for x, p in zip(prices, PRICES, strict=True)], F.min("o_orderstatus").alias("_source_flag"))


def _slot_keys(ts: str = "ts") -> list[Column]:
    return [F.date_sub(F.to_date(ts), SHIFT).alias("delivery_date"), (F.hour(ts) + 1).cast("int").alias("delivery_hour"), (F.floor(F.minute(ts) / 5) + 1).cast("int").alias("interval")]


def _realtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "events").groupBy(*_slot_keys())
    prices = [F.max(F.when(F.col("event_type") != "error", F.col("value").cast(MONEY))), F.min("user_id"), F.max("user_id")]
    return grouped.agg(*[x.cast(MONEY).alias(p) for x, p in zip(prices, PRICES, strict=True)], F.min("event_type").alias("_source_flag"))


def _zonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide row for each lineitem: ten zones, their total, another measure, and a difference that is off at times."""
    k = F.col("l_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(k.alias("k"), "l_linenumber", F.col("l_suppkey").alias("ontario_demand"), *[F.when((F.col("l_linenumber") != i) | (k % 5 != 0), k % (i + 2)).alias(z.lower()) for i, z in enumerate(delimited.ZONES)])
    total = sum((F.coalesce(F.col(z.lower()), F.lit(0)) for z in delimited.ZONES), F.lit(0))
    return lines.withColumn("zone_total", total + F.when(F.col("k") % 11 == 0, 1).otherwise(0)).withColumn("diff", F.col("zone_total") - F.col("ontario_demand") + F.when(F.col("k") % 13 == 0, 1).otherwise(0))


# -- payloads: delimited

_RAW = """raw AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 101 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS date_raw, CAST(o_orderkey % 26 AS VARCHAR) AS hour_raw,
  CASE WHEN o_orderkey % 97 = 0 THEN 'N/A' WHEN o_orderkey % 89 = 0 THEN '' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS market_demand_raw,
  CASE WHEN o_orderkey % 83 = 0 THEN '' ELSE CAST(CAST(-o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS ontario_demand_raw, o_orderkey % 4 AS payload FROM orders)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), F.when(k % 101 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("").alias("date_raw"), (k % 26).cast("string").alias("hour_raw"),
        F.when(k % 97 == 0, "N/A").when(k % 89 == 0, "").otherwise(price.cast(MONEY).cast("string")).alias("market_demand_raw"), F.when(k % 83 == 0, "").otherwise((-price).cast(MONEY).cast("string")).alias("ontario_demand_raw"), (k % 4).alias("payload"),
    )


def _written(lines: DataFrame, payload: str, order: list[str], folder: str) -> str:
    """Writes lines (payload, order, line) as a folder for each payload, in order: its files are parts of it, as many as its size asks for.

    Returns a path of them all.
    """
    lines.repartitionByRange(payload, *order).sortWithinPartitions(payload, *order).select(payload, "line").write.partitionBy(payload).text(folder)
    return f"{folder}/*"


def _framed(body: DataFrame, before: Iterable[str], after: Iterable[str]) -> DataFrame:
    """body (payload, at, line) with fixed lines before and after each payload's own."""
    payloads = body.select("payload").distinct()
    ends = [(-1, k, x) for k, x in enumerate(before)] + [(1, k, x) for k, x in enumerate(after)]
    fixed = payloads.withColumn("e", F.explode(F.array(*[F.struct(F.lit(part).alias("part"), F.lit(k).cast("long").alias("at"), F.lit(x).alias("line")) for part, k, x in ends]))).select("payload", "e.*")
    return body.select("payload", F.lit(0).alias("part"), F.col("at").cast("long").alias("at"), "line").unionByName(fixed)


def _demand_files(spark: SparkSession, sf_dir: str) -> str:
    body = _raw(spark, sf_dir).select("payload", F.col("k").alias("at"), F.concat_ws(",", "date_raw", "hour_raw", "market_demand_raw", "ontario_demand_raw").alias("line"))
    head = ["\\\\Hourly demand", "\\\\Made of orders", "Date,Hour,Market Demand,Ontario Demand"]
    return _written(_framed(body, head, [""]), "payload", ["part", "at"], _folder(spark, "demand"))


@query(f"""
WITH {_RAW}
SELECT nullif(date_raw, '') AS date_raw, hour_raw, nullif(market_demand_raw, '') AS market_demand_raw, nullif(ontario_demand_raw, '') AS ontario_demand_raw, row_number() OVER (PARTITION BY payload ORDER BY k) AS _source_row_number, CAST(payload AS VARCHAR) AS payload FROM raw""")
def csv_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = delimited.read_demand(spark, _demand_files(spark, sf_dir), "file", parts=True)
    blank = {c: F.nullif(F.col(c), F.lit("")) for c in ("date_raw", "market_demand_raw", "ontario_demand_raw")}
    return rows.withColumns(blank).withColumn("payload", F.regexp_extract("file", r"payload=(\d+)", 1)).drop("file")


@query(f"""
WITH wide AS (SELECT l_orderkey AS k, l_linenumber, l_suppkey, {_ZONES} FROM (SELECT *, l_orderkey AS k FROM lineitem))
SELECT CAST(l_linenumber AS VARCHAR) AS hour_raw, zone, mw, count(*) AS n FROM (
  {" UNION ALL ".join(f"SELECT l_linenumber, '{z}' AS zone, CAST({z.lower()} AS VARCHAR) AS mw FROM wide" for z in delimited.ZONES)}) GROUP BY 1, 2, 3""")
def csv_zonal_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _zonal(spark, sf_dir)
    cells = [F.lit("2026-01-01"), F.col("l_linenumber"), F.col("ontario_demand"), *[F.coalesce(F.col(z.lower()).cast("string"), F.lit("")) for z in delimited.ZONES], F.col("zone_total"), F.col("diff")]
    body = wide.select((F.col("k") % 3).alias("payload"), F.col("k").alias("at"), F.concat_ws(",", *cells).alias("line"))
    head = ["\\\\Zonal demand", ",".join(["Date", "Hour", "Ontario Demand", *delimited.ZONES, "Zone Total", "Diff"])]
    read = delimited.read_zonal_demand(spark, _written(_framed(body, head, []), "payload", ["part", "at"], _folder(spark, "zonal")), parts=True)
    long = delimited.zonal_long(read, {z: f"{z.lower()}_raw" for z in delimited.ZONES})
    return long.groupBy("hour_raw", "zone", F.nullif("zonal_demand_mw", F.lit("")).alias("mw")).agg(F.count(F.lit(1)).alias("n"))


# -- payloads: documents

_GENERATION_LINES = "lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey % 4 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS place FROM lineitem)"


def _generation_files(spark: SparkSession, sf_dir: str) -> str:
    """A payload for each of four parts of the lineitems: a day for each, with an hour and a fuel in it."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    output = F.when(F.col("l_linenumber") == 3, "").otherwise(F.concat(F.lit("<Output>"), F.col("l_quantity").cast("int").cast("string"), F.lit("</Output>")))
    line = F.concat(
        F.lit("<DailyData><Day>"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("</Day><HourlyData><Hour>"), F.col("l_linenumber").cast("string"), F.lit("</Hour><FuelTotal><Fuel> "), F.col("l_returnflag"),
        F.lit(" </Fuel><EnergyValue><OutputQuality>0</OutputQuality>"), output, F.lit("</EnergyValue></FuelTotal></HourlyData></DailyData>"),
    )
    body = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 4).alias("payload"), F.lit(0).alias("part"), *order, line.alias("line"))
    ends = [(-1, '<?xml version="1.0"?><Document xmlns="http://example.com/generation"><DocHeader><CreatedAt>2026-01-01T00:00:00</CreatedAt></DocHeader><DocBody>'), (1, "</DocBody></Document>")]
    fixed = spark.range(4).select(F.col("id").alias("payload"), F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(x).alias("line")) for p, x in ends])).alias("e")).select("payload", "e.*")
    return _written(body.unionByName(fixed, allowMissingColumns=True), "payload", ["part", *order], _folder(spark, "generation"))


@query(f"""
WITH {_GENERATION_LINES}
SELECT strftime(l_shipdate, '%Y-%m-%d') AS date_raw, CAST(l_linenumber AS VARCHAR) AS hour_raw, l_returnflag AS fuel_type_raw, CASE WHEN l_linenumber <> 3 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS output_raw, '0' AS output_quality_raw,
       place AS _source_record_number, CAST(l_orderkey % 4 AS VARCHAR) AS payload FROM lines""")
def xml_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents.read_generation(spark, _generation_files(spark, sf_dir), "file", parts=True)
    return rows.withColumn("payload", F.regexp_extract("file", r"payload=(\d+)", 1)).drop("file")


@query("""
SELECT 'element' AS kind, element AS name, n FROM (
  SELECT unnest(['DailyData', 'Day', 'HourlyData', 'Hour', 'FuelTotal', 'Fuel', 'EnergyValue', 'OutputQuality']) AS element, (SELECT count(*) FROM lineitem) AS n
  UNION ALL SELECT 'Output', (SELECT count(*) FROM lineitem WHERE l_linenumber <> 3) UNION ALL SELECT unnest(['Document', 'DocHeader', 'DocBody', 'CreatedAt']), 4)
UNION ALL SELECT 'namespace', 'http://example.com/generation', 1""")
def xml_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags, spaces = documents.tags_and_namespaces(spark, _generation_files(spark, sf_dir), parts=True)
    said = tags.select(F.lit("element").alias("kind"), F.col("element").alias("name"), "n")
    return said.unionByName(spaces.select(F.lit("namespace").alias("kind"), F.col("uri").alias("name"), F.lit(1).cast("long").alias("n")))


@query("""
SELECT strftime(min(o_orderdate) OVER (PARTITION BY o_orderkey % 5), '%Y-%m-%d') AS market_date_raw, CAST(o_orderkey % 24 + 1 AS VARCHAR) AS hour_ending_raw, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(CAST(-o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS zonal_price_raw,
       CAST(NULL AS VARCHAR) AS loss_price_raw, '0.00' AS congestion_price_raw, o_orderstatus AS source_flag_raw, row_number() OVER (PARTITION BY o_orderkey % 5 ORDER BY o_orderkey) AS _source_record_number FROM orders""")
def xml_day_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("payload", F.col("o_orderkey") % 5)
    price = F.when(F.col("o_orderkey") % 7 != 0, (-F.col("o_totalprice")).cast(MONEY).cast("string")).otherwise("")
    line = F.concat(F.lit("<HourlyPriceComponents><PricingHour>"), (F.col("o_orderkey") % 24 + 1).cast("string"), F.lit("</PricingHour><ZonalPrice>"), price, F.lit("</ZonalPrice><LossPriceCapped/><CongestionPriceCapped>0.00</CongestionPriceCapped><Flag>"), F.col("o_orderstatus"), F.lit("</Flag></HourlyPriceComponents>"))
    days = orders.groupBy("payload").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("day"))
    head = days.select("payload", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("at"), F.concat(F.lit("<Document><DocBody><DeliveryDate>"), "day", F.lit("</DeliveryDate>")).alias("line"))
    tail = days.select("payload", F.lit(1).alias("part"), F.lit(0).cast("long").alias("at"), F.lit("</DocBody></Document>").alias("line"))
    body = orders.select("payload", F.lit(0).alias("part"), F.col("o_orderkey").alias("at"), line.alias("line"))
    return documents.read_day_ahead(spark, _written(body.unionByName(head).unionByName(tail), "payload", ["part", "at"], _folder(spark, "day_ahead")), parts=True)


@query("""
SELECT '2026-01-01' AS delivery_date_raw, CAST(hour(ts) + 1 AS VARCHAR) AS delivery_hour_raw, CAST(minute(ts) // 5 + 1 AS VARCHAR) AS interval_raw, event_type AS flag_raw, CASE WHEN event_type <> 'error' THEN CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS lmp_cap_raw,
       '0.10' AS loss_price_cap_raw, CAST(NULL AS VARCHAR) AS cong_price_cap_raw, '2026-01-01T' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':00:00' AS created_at_raw, row_number() OVER (PARTITION BY hour(ts) ORDER BY event_id) AS _source_record_number FROM events""")
def xml_realtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("payload", F.hour("ts"))
    price = F.when(F.col("event_type") != "error", F.col("value").cast(MONEY).cast("string")).otherwise(" ")
    line = F.concat(F.lit("<ZonalPrice><Interval>"), (F.floor(F.minute("ts") / 5) + 1).cast("string"), F.lit("</Interval><Flag>"), "event_type", F.lit("</Flag><LmpCap>"), price, F.lit("</LmpCap><LossPriceCap>0.10</LossPriceCap></ZonalPrice>"))
    hours = events.select("payload").distinct()
    head = F.concat(F.lit("<Document><DocHeader><DocRevision>1</DocRevision><CreatedAt>2026-01-01T"), F.lpad(F.col("payload").cast("string"), 2, "0"), F.lit(":00:00</CreatedAt></DocHeader><DocBody><DeliveryDate>2026-01-01</DeliveryDate><DeliveryHour>"), (F.col("payload") + 1).cast("string"), F.lit("</DeliveryHour>"))
    fixed = lambda part, x: hours.select("payload", F.lit(part).alias("part"), F.lit(0).cast("long").alias("at"), x.alias("line"))
    body = events.select("payload", F.lit(0).alias("part"), F.col("event_id").alias("at"), line.alias("line"))
    every = body.unionByName(fixed(-1, head)).unionByName(fixed(1, F.lit("<AveragePrice><LmpCap>1</LmpCap></AveragePrice></DocBody></Document>")))
    return documents.read_realtime(spark, _written(every, "payload", ["part", "at"], _folder(spark, "realtime")), parts=True)


# -- rules of the contracts


def _said(rules: DataFrame) -> DataFrame:
    return rules.select("rule_id", "severity", F.col("records_checked").cast("long").alias("records_checked"), F.col("records_failed").cast("long").alias("records_failed"))


def _rules_sql(relation: str, rules: dict[str, tuple[str, str]], duplicates: str | None) -> str:
    """SQL of rule -> (severity when hit, condition) over a relation, and of rows beyond the first of each key."""
    parts = [f"SELECT '{rule}' AS rule_id, '{worst}' AS worst, (SELECT count(*) FROM {relation}) AS records_checked, (SELECT count(*) FROM {relation} WHERE {hit}) AS records_failed" for rule, (worst, hit) in rules.items()]
    if duplicates:
        parts.append(f"SELECT 'duplicate_business_key', 'FAIL', (SELECT count(*) FROM {relation}), (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {relation} GROUP BY {duplicates}))")
    return f"SELECT rule_id, CASE WHEN records_failed > 0 THEN worst ELSE 'PASS' END AS severity, records_checked, CAST(records_failed AS BIGINT) AS records_failed FROM ({' UNION ALL '.join(parts)})"


_TYPED = f"""{_RAW}, typed AS (SELECT *, TRY_CAST(nullif(trim(date_raw), '') AS DATE) AS market_date, TRY_CAST(hour_raw AS INT) AS hour_ending, TRY_CAST(nullif(market_demand_raw, '') AS DECIMAL(18,3)) AS market_demand_mw,
  TRY_CAST(nullif(ontario_demand_raw, '') AS DECIMAL(18,3)) AS ontario_demand_mw FROM raw)"""
_DEMAND_RULES = {
    "business_key_not_null": ("FAIL", "market_date IS NULL OR hour_ending IS NULL"), "hour_ending_domain": ("FAIL", "hour_ending NOT BETWEEN 1 AND 24"), "market_date_parses": ("FAIL", "nullif(trim(date_raw), '') IS NOT NULL AND market_date IS NULL"),
    "hour_ending_parses": ("FAIL", "hour_ending IS NULL"), "market_demand_mw_numeric": ("FAIL", "market_demand_raw <> '' AND market_demand_mw IS NULL"), "ontario_demand_mw_numeric": ("FAIL", "ontario_demand_raw <> '' AND ontario_demand_mw IS NULL"),
    "market_demand_mw_present": ("FAIL", "market_demand_raw = ''"), "ontario_demand_mw_present": ("FAIL", "ontario_demand_raw = ''"), "market_demand_mw_null": ("PASS", "market_demand_mw IS NULL"), "market_demand_mw_negative": ("PASS", "market_demand_mw < 0"),
    "ontario_demand_mw_null": ("PASS", "ontario_demand_mw IS NULL"), "ontario_demand_mw_negative": ("PASS", "ontario_demand_mw < 0"),
}
DEMAND = CONTRACTS["market_demand_hourly"]


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(_raw(spark, sf_dir), DEMAND.typing())


@query(f"WITH {_TYPED} {_rules_sql('typed', _DEMAND_RULES, 'market_date, hour_ending')}")
def dq_demand_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(quality.evaluate(_typed(spark, sf_dir), DEMAND))


@query(f"""
WITH {_TYPED}, d AS (SELECT market_date, count(*) AS n FROM typed WHERE market_date IS NOT NULL GROUP BY 1), x AS (SELECT *, market_date = (SELECT max(market_date) FROM d) AS latest FROM d)
SELECT 'historical_days_complete' AS rule_id, CASE WHEN n > 0 THEN 'WARN' ELSE 'PASS' END AS severity, days AS records_checked, n AS records_failed FROM (SELECT count(*) FILTER (WHERE n <> 24 AND NOT latest) AS n, count(*) AS days FROM x)
UNION ALL SELECT 'latest_day_complete', CASE WHEN n > 0 THEN 'WARN' ELSE 'PASS' END, days, n FROM (SELECT count(*) FILTER (WHERE n <> 24 AND latest) AS n, count(*) AS days FROM x)""")
def dq_demand_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(quality.coverage_rules(_typed(spark, sf_dir), "market_date", 24))


@query(f"""
WITH {_TYPED}, marked AS (SELECT *, count(*) OVER (PARTITION BY market_date, hour_ending) > 1 AND market_date IS NOT NULL AND hour_ending IS NOT NULL AS copy,
  {' OR '.join(f'coalesce({hit}, false)' for rule, (worst, hit) in _DEMAND_RULES.items() if worst == 'FAIL')} AS bad FROM typed)
SELECT k, NOT (bad OR copy) AS goes_on FROM marked""")
def dq_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = quality.split_quarantine(_typed(spark, sf_dir), DEMAND)
    return good.select("k", F.lit(True).alias("goes_on")).unionByName(bad.select("k", F.lit(False).alias("goes_on")))


@query(f"""
WITH {_TYPED}, l AS (SELECT max(market_date) AS day FROM typed)
SELECT CAST((SELECT day FROM l) AS VARCHAR) AS latest_day, max(hour_ending) AS latest_hour_ending, count(*) AS latest_day_rows, CAST(24 AS BIGINT) AS expected_rows, count(*) >= 24 AS is_complete,
       (SELECT max(date_raw) FROM typed WHERE market_date IS NOT NULL) AS last_created FROM typed WHERE market_date = (SELECT day FROM l)""")
def dq_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(quality.freshness(_typed(spark, sf_dir), "market_date", ["hour_ending"], 24, "date_raw").drop("last_ingested"))


_WIDE = f"""wide AS (SELECT *, {' + '.join(f'coalesce({z.lower()}, 0)' for z in delimited.ZONES)} + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS zone_total FROM (SELECT k, l_linenumber, l_suppkey AS ontario_demand, {_ZONES} FROM (SELECT *, l_orderkey AS k FROM lineitem)))"""


@query(f"""
WITH {_WIDE}, whole AS (SELECT *, CASE WHEN k % 23 <> 0 THEN zone_total - ontario_demand + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END END AS diff FROM (SELECT * REPLACE (CASE WHEN k % 19 <> 0 THEN zone_total END AS zone_total) FROM wide))
{_rules_sql('whole', {'parts_sum_to_total': ('WARN', 'coalesce(' + ' + '.join(f'coalesce({z.lower()}, 0)' for z in delimited.ZONES) + ' <> zone_total, true)'), 'difference_is_consistent': ('WARN', 'coalesce(zone_total - ontario_demand <> diff, true)')}, None)}""")
def dq_zonal_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    wide = _zonal(spark, sf_dir).withColumns({"zone_total": F.when(k % 19 != 0, F.col("zone_total")), "diff": F.when(k % 23 != 0, F.col("diff"))})
    return _said(quality.total_rules(wide, [z.lower() for z in delimited.ZONES], "zone_total", "ontario_demand", "diff"))


@query("SELECT 'required_columns' AS rule_id, 'FAIL' AS severity, CAST(10 AS BIGINT) AS records_checked, CAST(1 AS BIGINT) AS records_failed UNION ALL SELECT 'known_columns', 'WARN', 11, 2")
def dq_zonal_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [z for z in delimited.ZONES if z != "Essa"] + ["North", "Sudbury"]
    return _said(quality.header_rules(spark, found, delimited.ZONES))


@query(f"""
WITH {_GENERATION}
{_rules_sql('generation', {'fuel_type_known': ('WARN', "fuel_type NOT IN ('A', 'N')"), 'output_quality_code_known': ('WARN', 'output_quality_code NOT IN (1, 2, 3)')}, None)}""")
def dq_generation_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(quality.unseen_rules(_generation(spark, sf_dir), {"fuel_type": ["A", "N"], "output_quality_code": [1, 2, 3]}))


@query(f"""
WITH {_GENERATION}
{_rules_sql('generation', {'business_key_not_null': ('FAIL', 'market_date IS NULL OR fuel_type IS NULL'), 'hour_ending_domain': ('FAIL', 'hour_ending NOT BETWEEN 1 AND 24'), 'output_quality_code_present': ('FAIL', 'output_quality_code IS NULL'), 'output_mwh_null': ('PASS', 'output_mwh IS NULL'), 'output_mwh_negative': ('PASS', 'output_mwh < 0')}, 'market_date, hour_ending, fuel_type')}""")
def dq_generation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(quality.evaluate(_generation(spark, sf_dir), CONTRACTS["generation_hourly"]))


def _price_rules(keys: str, names: dict[str, str]) -> dict[str, tuple[str, str]]:
    filled = " + ".join(f"CASE WHEN {x} IS NULL THEN 0 ELSE 1 END" for x in names.values())
    each = {f"{p}_{what}": ("PASS", f"{x} {test}") for p, x in names.items() for what, test in (("null", "IS NULL"), ("negative", "< 0"))}
    return {"business_key_not_null": ("FAIL", keys)} | each | {"partially_populated": ("WARN", f"{filled} BETWEEN 1 AND 2"), "fully_empty": ("PASS", f"{filled} = 0")}


_COMPONENTS = dict(zip(PRICES, ("zonal", "loss", "congestion"), strict=True))


@query(f"WITH {_DAY_AHEAD} {_rules_sql('day_ahead', _price_rules('market_date IS NULL OR hour_ending IS NULL', _COMPONENTS) | {'hour_ending_domain': ('FAIL', 'hour_ending NOT BETWEEN 1 AND 24')}, 'market_date, hour_ending')}")
def dq_day_ahead_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(quality.evaluate(_day_ahead(spark, sf_dir), CONTRACTS["day_ahead_price_hourly"]))


@query(f"""
WITH {_REALTIME}
{_rules_sql('realtime', _price_rules('delivery_date IS NULL', _COMPONENTS) | {'delivery_hour_domain': ('FAIL', 'delivery_hour NOT BETWEEN 1 AND 24'), 'interval_domain': ('FAIL', 'interval_no NOT BETWEEN 1 AND 12')}, 'delivery_date, delivery_hour, interval_no')}""")
def dq_realtime_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(quality.evaluate(_realtime(spark, sf_dir), CONTRACTS["realtime_price_5min"]))


@query(f"WITH {_DAY_AHEAD} {_rules_sql('day_ahead', {'_source_flag_known': ('WARN', "flag NOT IN ('F', 'O')")}, None)}")
def dq_day_ahead_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(quality.unseen_rules(_day_ahead(spark, sf_dir), {"_source_flag": ["F", "O"]}))


@query(f"""
WITH {_REALTIME}, whole AS (SELECT delivery_date, delivery_hour, (2 * CAST(sum(zonal) * 100 AS BIGINT) + count(*)) // (2 * count(*)) / 100.0 AS c FROM realtime WHERE zonal IS NOT NULL AND loss IS NOT NULL AND congestion IS NOT NULL GROUP BY 1, 2),
reported AS (SELECT delivery_date, delivery_hour, max(zonal) AS r FROM realtime GROUP BY 1, 2)
SELECT CAST(p.delivery_date AS VARCHAR) AS delivery_date, p.delivery_hour, CAST(r AS DOUBLE) AS reported, CAST(c AS DOUBLE) AS calculated, round(CAST(r AS DOUBLE) - CAST(c AS DOUBLE), 2) AS difference FROM reported p LEFT JOIN whole w ON p.delivery_date = w.delivery_date AND p.delivery_hour = w.delivery_hour""")
def average_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots, key = _realtime(spark, sf_dir), ["delivery_date", "delivery_hour"]
    reported = slots.groupBy(*key).agg(*[F.max(p).alias(p) for p in PRICES])
    out = quality.average_differences(slots, list(PRICES), reported, key)
    named = {f"{kind}_{PRICES[0]}": kind for kind in ("reported", "calculated", "difference")}
    return _plain(out.select(*key, *[F.round(F.col(c).cast("double"), 2).alias(n) for c, n in named.items()]))


@query(f"""
WITH {_DEMAND}, target AS (SELECT * FROM demand WHERE hour_ending <> 5 UNION ALL SELECT * FROM demand WHERE hour_ending = 7), counts AS (SELECT (SELECT count(*) FROM demand) AS n, (SELECT count(*) FROM target) AS m, count_if(hour_ending = 5) AS five, count_if(hour_ending = 7) AS seven, count_if(hour_ending = 9) AS nine FROM demand)
SELECT fact, rule_id, records_failed, CASE WHEN records_failed > 0 THEN 'FAIL' ELSE 'PASS' END AS severity FROM (
  SELECT fact, unnest(['row_count_matches', 'missing_rows', 'unexpected_rows', 'duplicate_business_key', 'required_lineage']) AS rule_id, unnest([CAST(x AS BIGINT) FOR x IN [abs(n - m), five, seven, seven, CASE fact WHEN 'with lineage' THEN nine ELSE m END]]) AS records_failed FROM counts, (VALUES ('with lineage'), ('one column short'), ('without lineage')) f(fact)
  UNION ALL SELECT 'as its source', unnest(['row_count_matches', 'missing_rows', 'unexpected_rows', 'duplicate_business_key', 'required_lineage']), 0)""")
def dq_gold_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact whose rows and lineage differ, the same without one of the lineage columns and without any, and one that is as it should be."""
    source = _demand(spark, sf_dir)
    target = source.filter("hour_ending <> 5").unionByName(source.filter("hour_ending = 7"))
    lineage = {c: F.when(F.lit(c != "_run_id") | (F.col("hour_ending") != 9), F.lit("2026-01-01")).cast(kind) for c, kind in LINEAGE.items()}
    whole = {c: F.lit("2026-01-01").cast(kind) for c, kind in LINEAGE.items()}
    facts = {"with lineage": target.withColumns(lineage), "one column short": target.withColumns(lineage).drop("_source_hash"), "without lineage": target, "as its source": source.withColumns(whole)}
    return reduce(DataFrame.unionByName, [quality.five_rules(source, fact, DEMAND).select(F.lit(name).alias("fact"), "rule_id", "records_failed", "severity") for name, fact in facts.items()])


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a rule for each priority and status of the orders, of several runs."""
    o = table(spark, sf_dir, "orders")
    grouped = o.groupBy(F.col("o_orderpriority").alias("rule_id"), F.col("o_orderstatus").alias("dataset_name"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("records_checked"), F.count_if(F.col("o_totalprice") > 400000).alias("records_failed"))
    return grouped.select(
        F.concat(F.lit("run"), "y").alias("run_id"), F.lit("demand").alias("source_name"), "dataset_name", "rule_id", F.lit("CONTRACT").alias("rule_category"), F.when(F.col("records_failed") > 10, "FAIL").otherwise("PASS").alias("severity"), F.lit("COMPLETED").alias("status"),
        "records_checked", "records_failed", F.col("records_failed").cast("string").alias("observed_value"), F.lit("0 failures").alias("expected_value"), F.make_timestamp(F.col("y") - F.col("y") % 2, *[F.lit(x) for x in (1, 1, 0, 0, 0)]).alias("execution_timestamp"), F.lit(None).cast("string").alias("details"),
    )


_RESULTS = """grouped AS (SELECT o_orderpriority AS rule_id, o_orderstatus AS dataset_name, CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS records_checked, count(*) FILTER (WHERE o_totalprice > 400000) AS records_failed FROM orders GROUP BY 1, 2, 3),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_name, rule_id ORDER BY y - y % 2 DESC, 'run' || y DESC) AS rn FROM grouped) WHERE rn = 1)"""


@query(f"WITH {_RESULTS} SELECT dataset_name, rule_id, 'run' || y AS run_id, CASE WHEN records_failed > 10 THEN 'FAIL' ELSE 'PASS' END AS severity, records_checked, records_failed FROM latest")
def dq_latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    serving.register_views(spark, {}, _results(spark, sf_dir))
    return catalog.scan(spark, "vw_latest_dq_result", ["dataset_name", "rule_id", "run_id", "severity", "records_checked", "records_failed"])


@query(f"""
WITH {_RESULTS}
SELECT 'demand' AS source_name, dataset_name, rule_id, 'CONTRACT' AS rule_category, CASE WHEN records_failed > 10 THEN 'FAIL' ELSE 'PASS' END AS rule_outcome, 'COMPLETED' AS execution_status, records_checked, records_failed, CAST(records_failed AS VARCHAR) AS observed_value,
       '0 failures' AS expected_value, CAST(y - y % 2 AS VARCHAR) || '-01-01 00:00:00' AS evaluated_at, CAST(NULL AS VARCHAR) AS details, 'run' || y AS run_id FROM latest WHERE dataset_name = 'F'""")
def serve_dq_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    serving.register_views(spark, {}, _results(spark, sf_dir))
    serving.register_functions(spark)
    return _plain(catalog.call(spark, "fn_get_batch_dq_status", "F", None))


# -- real-time functions

_LOG_COLUMNS = ["event_schema_version", "event_type", "event_id", "observation_hash", "publication_state", "previous_event_id", "source_name", "source_file", "source_url", "source_hash", "bronze_first_seen_at_utc", "publisher_run_id", "poll_id"]


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a delivery log: errors withdraw, clicks come twice, the second time without their file and poll."""
    error, k = F.col("event_type") == "error", F.col("event_id")
    kind = F.when(error, series.INVALIDATION).otherwise(series.OBSERVATION)
    hashed = F.when(k % 7 != 0, F.concat(F.lit("h"), (k % 5).cast("string"))).otherwise("")
    first = table(spark, sf_dir, "events").select(
        F.lit("v1").alias("event_schema_version"), kind.alias("event_type"), k.cast("string").alias("event_id"), F.concat(F.lit("o"), k.cast("string")).alias("observation_hash"), *_slot_keys(),
        *[F.when(~error | (k % 3 == 0), x).cast("double").alias(p) for x, p in zip((F.col("value") - 20, F.when(k % 11 != 0, F.lit(0.1)), F.lit(0.2)), PRICES, strict=True)],
        F.when(error & (k % 4 != 0), series.INVALIDATED).otherwise(series.ELIGIBLE).alias("publication_state"), F.when(error & (k % 2 == 0), "p").alias("previous_event_id"), F.lit("rt").alias("source_name"), F.lit("f").alias("source_file"), F.lit("u").alias("source_url"),
        hashed.alias("source_hash"), F.lit("2026").alias("bronze_first_seen_at_utc"), F.lit("r").alias("publisher_run_id"), F.lit("q").alias("poll_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("event_created_at_utc"), (F.col("event_type") == "click").alias("_click"),
    ).withColumn("delivery_date", F.col("delivery_date").cast("string"))
    again = first.filter("_click").withColumns({"source_file": F.lit(""), "poll_id": F.lit(None).cast("string")})
    return first.unionByName(again).drop("_click")


_EVENTS = f"""log AS (
  SELECT *, CASE WHEN event_type = 'error' THEN 'RT_PRICE_INVALIDATION' ELSE 'RT_PRICE_OBSERVATION' END AS kind, CAST(CAST(ts AS DATE) - {SHIFT} AS VARCHAR) AS delivery_date, CAST(hour(ts) + 1 AS INT) AS delivery_hour, CAST(minute(ts) // 5 + 1 AS INT) AS interval_no,
         CASE WHEN event_type <> 'error' OR event_id % 3 = 0 THEN value - 20 END AS price, CASE WHEN (event_type <> 'error' OR event_id % 3 = 0) AND event_id % 11 <> 0 THEN 0.1 END AS loss,
         CASE WHEN event_type = 'error' AND event_id % 4 <> 0 THEN 'INVALIDATED' ELSE 'ELIGIBLE' END AS state, CASE WHEN event_id % 7 <> 0 THEN 'h' || (event_id % 5) ELSE '' END AS source_hash,
         (CAST(ts AS DATE) - {SHIFT} - DATE '1970-01-01') * 288 + hour(ts) * 12 + minute(ts) // 5 AS slot FROM events),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY delivery_date, delivery_hour, interval_no ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS rn FROM log) WHERE rn = 1),
current_state AS (SELECT * FROM latest WHERE state = 'ELIGIBLE')"""


@query(f"WITH {_EVENTS} SELECT CAST(event_id AS VARCHAR) AS event_id, kind AS event_type, 'f' AS source_file, 'q' AS poll_id, delivery_date, delivery_hour, interval_no FROM log")
def rt_price_event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return realtime.price_event_dedup(_log(spark, sf_dir)).select("event_id", "event_type", "source_file", "poll_id", "delivery_date", "delivery_hour", F.col("interval").alias("interval_no"))


@query(f"WITH {_EVENTS} SELECT delivery_date, delivery_hour, interval_no, CAST(event_id AS VARCHAR) AS event_id, round(price, 6) AS price, source_hash FROM current_state")
def rt_price_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return realtime.price_current(_log(spark, sf_dir)).select("delivery_date", "delivery_hour", F.col("interval").alias("interval_no"), "event_id", F.round(PRICES[0], 6).alias("price"), "source_hash")


_CHANGES = "changes AS (SELECT *, lag(price) OVER w AS previous_price, slot - lag(slot) OVER w AS slot_gap FROM current_state WINDOW w AS (ORDER BY slot))"
_CHANGE_COLUMNS = "delivery_date, delivery_hour, interval_no, round(price, 6) AS price, round(previous_price, 6) AS previous_price, slot_gap, CASE WHEN slot_gap = 1 THEN round(price - previous_price, 6) END AS interval_price_change, price < 0 AS is_negative_price"


def _six(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, kind in df.dtypes if kind == "double"})


@query(f"WITH {_EVENTS}, {_CHANGES} SELECT {_CHANGE_COLUMNS}, CAST(event_id AS VARCHAR) AS event_id, source_hash, epoch_us(ts) AS event_created_at_utc FROM changes")
def rt_price_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(realtime.price_change(_log(spark, sf_dir)))


def _window_sql(minutes: int, n: int) -> dict[str, str]:
    w = f"w{minutes}"
    whole, negative = f"count(price) OVER {w} = {n}", f"sum(CASE WHEN price < 0 THEN 1 ELSE 0 END) OVER {w}"
    out = {"matched_slots": f"count(price) OVER {w}", "window_complete": whole} | {f"rolling_{name}": f"CASE WHEN {whole} THEN round({f}(price) OVER {w}, 6) END" for name, f in (("avg", "avg"), ("min", "min"), ("max", "max"), ("stddev", "stddev_samp"))}
    return out | {"negative_price_count": f"CASE WHEN {whole} THEN CAST({negative} AS BIGINT) END", "negative_price_share": f"CASE WHEN {whole} THEN round({negative} / {n}.0, 6) END"}


_FRAMES = "WINDOW " + ", ".join(f"w{m} AS (ORDER BY slot RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for m, n in series.WINDOWS.items())
_ROLLING_SQL = " UNION ALL ".join(
    f"(SELECT delivery_date, delivery_hour, interval_no, {m} AS window_minutes, {n} AS expected_slots, {', '.join(f'{x} AS {c}' for c, x in _window_sql(m, n).items())}, CAST(event_id AS VARCHAR) AS event_id, source_hash, epoch_us(ts) AS event_created_at_utc FROM current_state {_FRAMES})"
    for m, n in series.WINDOWS.items()
)


@query(f"WITH {_EVENTS} {_ROLLING_SQL}")
def rt_price_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(realtime.price_rolling(_log(spark, sf_dir)))


def _metrics_sql() -> str:
    names = {"window_complete": "rolling_{}_complete"} | realtime.STATISTICS
    wide = [f"{x} AS {names[c].format(m)}" for m, n in series.WINDOWS.items() for c, x in _window_sql(m, n).items() if c in names]
    return f"SELECT {_CHANGE_COLUMNS}, {', '.join(wide)}, CAST(event_id AS VARCHAR) AS event_id, source_hash, epoch_us(ts) AS event_created_at_utc FROM changes {_FRAMES}"


@query(f"WITH {_EVENTS}, {_CHANGES} {_metrics_sql()}")
def rt_price_market_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(realtime.price_market_metrics(_log(spark, sf_dir)))


@query(f"""
WITH {_EVENTS}, m AS (
  SELECT 'RT-DQ-001' AS rule_id, 'WARN' AS criticality, (SELECT count(*) FROM log WHERE event_type = 'click') AS metric UNION ALL SELECT 'RT-DQ-002', 'WARN', (SELECT count(*) FROM log WHERE source_hash = '') + (SELECT count(*) FROM log WHERE source_hash = '' AND event_type = 'click')
  UNION ALL SELECT 'RT-DQ-003', 'FAIL', (SELECT count(*) FROM log WHERE source_hash = '') UNION ALL SELECT 'RT-DQ-004', 'FAIL', (SELECT count(*) FROM log WHERE event_type = 'error' AND state = 'ELIGIBLE')
  UNION ALL SELECT 'RT-DQ-005', 'FAIL', (SELECT count(*) FROM log WHERE event_type <> 'error' AND (price IS NULL OR loss IS NULL)) UNION ALL SELECT 'RT-DQ-006', 'FAIL', (SELECT count(*) FROM log WHERE event_type = 'error' AND event_id % 2 <> 0))
SELECT rule_id, rule_name, criticality AS severity, CASE WHEN metric = 0 THEN 'PASS' ELSE criticality END AS status, metric AS metric_value, true AS evaluated_today FROM m JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in realtime.RULES.items())}) names(rule_id, rule_name) USING (rule_id)""")
def rt_price_dq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = realtime.dq_summary(_log(spark, sf_dir))
    return said.withColumn("evaluated_today", F.abs(F.unix_seconds("evaluated_at_utc") - F.unix_seconds(F.current_timestamp())) < 86_400).drop("evaluated_at_utc")


@query(f"""
WITH {_EVENTS}
SELECT 'physical_rows' AS metric, (SELECT count(*) FROM log) + (SELECT count(*) FROM log WHERE event_type = 'click') AS value UNION ALL SELECT 'logical_events', (SELECT count(*) FROM log) UNION ALL SELECT 'duplicate_event_ids', (SELECT count(*) FROM log WHERE event_type = 'click')
UNION ALL SELECT 'logical_rows_missing_core_fields', (SELECT count(*) FROM log WHERE source_hash = '') UNION ALL SELECT 'current_eligible_rows', (SELECT count(*) FROM current_state)""")
def rt_metric_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return realtime.metric_union(_log(spark, sf_dir))


@query(f"WITH {_EVENTS} SELECT count(*) AS latest_business_keys, count(*) FILTER (WHERE state = 'ELIGIBLE') AS latest_eligible, count(*) FILTER (WHERE state = 'INVALIDATED') AS latest_invalidated FROM latest")
def rt_key_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return realtime.key_states(_log(spark, sf_dir))


@query(f"""
WITH {_EVENTS}
SELECT 'PHYSICAL_ROWS' AS "check", (SELECT count(*) FROM log) + (SELECT count(*) FROM log WHERE event_type = 'click') AS value, '' AS source_hash UNION ALL SELECT unnest(['LOGICAL_EVENTS', 'DISTINCT_EVENT_IDS']), (SELECT count(*) FROM log), ''
UNION ALL SELECT 'EVENTS_BY_SOURCE_HASH', count(*), source_hash FROM log GROUP BY source_hash""")
def rt_checks_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return realtime.checks_by_source(_log(spark, sf_dir))


@query(f"WITH {_EVENTS} SELECT CAST(event_id AS VARCHAR) AS event_id, kind AS event_type, state AS publication_state, 'f' AS source_file FROM log WHERE event_id = (SELECT min(event_id) FROM log WHERE event_type = 'click')")
def rt_event_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "events").filter("event_type = 'click'").agg(F.min("event_id")).first()[0]  # an id, as a caller would give it
    return realtime.of_event(_log(spark, sf_dir), str(wanted)).select("event_id", "event_type", "publication_state", "source_file")


@query("SELECT 'after_revision' AS scenario, 'v2' AS current_event_id, 'ELIGIBLE' AS publication_state")
def rt_invalidation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A revised and then withdrawn key is current after the revision and gone after the withdrawal."""
    rows = [("v1", "2099-01-01", 1, 1, "ELIGIBLE", 0), ("v2", "2099-01-01", 1, 1, "ELIGIBLE", 5), ("v3", "2099-01-01", 1, 1, "INVALIDATED", 10)]
    log = spark.createDataFrame(rows, "event_id string, delivery_date string, delivery_hour int, interval int, publication_state string, event_created_at_utc long")
    state = lambda name, df: realtime.price_current(df).select(F.lit(name).alias("scenario"), F.col("event_id").alias("current_event_id"), "publication_state")
    return state("after_revision", log.filter("event_id <> 'v3'")).unionByName(state("after_withdrawal", log))


@query(f"""
WITH {_EVENTS}, {_CHANGES}, {_DEMAND}, {_GENERATION}, g AS (SELECT market_date, hour_ending, sum(output_mwh) AS generation_mwh, count(*) AS fuel_types FROM generation GROUP BY 1, 2)
SELECT c.delivery_date AS market_date, c.delivery_hour AS hour_ending, interval_no, round(price, 6) AS price, round(price - previous_price, 6) AS interval_price_change, CAST(ontario_demand_mw AS DOUBLE) AS ontario_demand_mw, CAST(generation_mwh AS DOUBLE) AS generation_mwh, fuel_types
FROM changes c LEFT JOIN demand d ON CAST(c.delivery_date AS DATE) = d.market_date AND c.delivery_hour = d.hour_ending LEFT JOIN g ON CAST(c.delivery_date AS DATE) = g.market_date AND c.delivery_hour = g.hour_ending
WHERE slot_gap = 1 AND abs(price - previous_price) >= 50""")
def large_price_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = realtime.large_moves(realtime.price_change(_log(spark, sf_dir)), 50, _demand(spark, sf_dir), _generation(spark, sf_dir))
    return _six(_plain(moves))


# -- serving


def _day(spark: SparkSession, sf_dir: str) -> str:
    """The first day that has an order: a parameter, as a caller would give it."""
    return str(table(spark, sf_dir, "orders").agg(F.to_date(F.min("o_orderdate"))).first()[0])


_FIRST = "(SELECT min(CAST(o_orderdate AS DATE)) FROM orders)"


def _served(spark: SparkSession, sf_dir: str) -> None:
    facts = {"fact_market_demand_hourly": _demand, "fact_generation_hourly": _generation, "fact_day_ahead_price_hourly": _day_ahead, "fact_realtime_price_5min": _realtime}
    zonal = _demand(spark, sf_dir).select("market_date", "hour_ending", F.when(F.col("hour_ending") % 2 == 0, "West").otherwise("East").alias("zone"), F.col("ontario_demand_mw").alias("zonal_demand_mw"))
    serving.register_views(spark, {name: f(spark, sf_dir) for name, f in facts.items()} | {"fact_zonal_demand_hourly": zonal})
    serving.register_functions(spark)


_HOURS = "CAST(market_date AS VARCHAR) AS market_date, hour_ending, CAST(ontario_demand_mw AS DOUBLE) AS ontario_demand_mw, CAST(market_demand_mw AS DOUBLE) AS market_demand_mw"


@query(f"WITH {_DEMAND} SELECT {_HOURS} FROM demand WHERE market_date = {_FIRST}")
def serve_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    _served(spark, sf_dir)
    return _plain(spark.sql("SELECT * FROM fn_get_demand(:d, NULL)", {"d": _date(spark, sf_dir)}))


def _date(spark: SparkSession, sf_dir: str):
    return datetime.date.fromisoformat(_day(spark, sf_dir))


@query(f"WITH {_DEMAND} SELECT {_HOURS} FROM demand WHERE market_date = {_FIRST} AND ontario_demand_mw = (SELECT max(ontario_demand_mw) FROM demand WHERE market_date = {_FIRST})")
def serve_peak_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    _served(spark, sf_dir)
    return _plain(catalog.call(spark, "fn_get_peak_demand", _date(spark, sf_dir)))


@query(f"WITH {_DEMAND} SELECT CAST(market_date AS VARCHAR) AS market_date, hour_ending, 'West' AS zone, CAST(ontario_demand_mw AS DOUBLE) AS zonal_demand_mw FROM demand WHERE market_date = (SELECT min(market_date) FROM demand WHERE hour_ending % 2 = 0) AND hour_ending % 2 = 0")
def serve_zonal_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    _served(spark, sf_dir)
    day = _demand(spark, sf_dir).filter("hour_ending % 2 = 0").agg(F.min("market_date")).first()[0]  # the first that has the zone
    return _plain(spark.sql("SELECT * FROM fn_get_zonal_demand(:d, NULL, 'West')", {"d": day}))


@query(f"""
WITH {_GENERATION}, asked AS (SELECT market_date, hour_ending FROM generation WHERE fuel_type = 'N' ORDER BY 1, 2 LIMIT 1)
SELECT CAST(market_date AS VARCHAR) AS market_date, hour_ending, fuel_type, CAST(output_mwh AS DOUBLE) AS output_mwh, output_quality_code FROM generation WHERE (market_date, hour_ending) IN (SELECT (market_date, hour_ending) FROM asked) AND fuel_type = 'N'""")
def serve_generation_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    _served(spark, sf_dir)
    asked = _generation(spark, sf_dir).filter("fuel_type = 'N'").select("market_date", "hour_ending").orderBy("market_date", "hour_ending").first()
    return _plain(catalog.call(spark, "fn_get_generation_mix", asked.market_date, asked.hour_ending, " n "))


_PRICE_SQL = ", ".join(f"CAST({x} AS DOUBLE) AS {p}" for p, x in _COMPONENTS.items())


@query(f"WITH {_DAY_AHEAD} SELECT CAST(market_date AS VARCHAR) AS market_date, hour_ending, {_PRICE_SQL}, flag AS source_flag FROM day_ahead WHERE market_date = {_FIRST}")
def serve_day_ahead_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    _served(spark, sf_dir)
    return _plain(spark.sql("SELECT * FROM fn_get_day_ahead_price(:d, NULL)", {"d": _date(spark, sf_dir)}))


_KEYS = "keys AS (SELECT delivery_date AS market_date, delivery_hour AS hour_ending, interval_no FROM realtime UNION SELECT market_date, hour_ending, 1 FROM day_ahead)"
_COMPARED = f"""compared AS (SELECT CAST(k.market_date AS VARCHAR) AS market_date, k.hour_ending, k.interval_no, {", ".join(f"CAST({s}.{x} AS DOUBLE) AS {s}_{p}" for s in ("da", "rt") for p, x in _COMPONENTS.items())}, da.flag AS da_source_flag, rt.flag AS rt_source_flag,
  CASE WHEN da.market_date IS NULL AND rt.delivery_date IS NULL THEN 'MISSING_BOTH' WHEN da.market_date IS NULL THEN 'MISSING_DAY_AHEAD' WHEN rt.delivery_date IS NULL THEN 'MISSING_REALTIME'
       WHEN da.zonal IS NULL OR da.loss IS NULL OR da.congestion IS NULL OR rt.zonal IS NULL OR rt.loss IS NULL OR rt.congestion IS NULL THEN 'INCOMPLETE_PRICE_COMPONENTS' ELSE 'COMPARABLE' END AS comparison_state,
  {", ".join(f"CAST(rt.{x} - da.{x} AS DOUBLE) AS {x}_rt_minus_da_cad_per_mwh" for x in _COMPONENTS.values())}
  FROM keys k LEFT JOIN day_ahead da ON k.market_date = da.market_date AND k.hour_ending = da.hour_ending LEFT JOIN realtime rt ON k.market_date = rt.delivery_date AND k.hour_ending = rt.delivery_hour AND k.interval_no = rt.interval_no)"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    da, rt = _day_ahead(spark, sf_dir), _realtime(spark, sf_dir)
    keys = rt.select(F.col("delivery_date").alias("market_date"), F.col("delivery_hour").alias("hour_ending"), "interval").union(da.select("market_date", "hour_ending", F.lit(1).alias("interval"))).distinct()
    return serving.price_comparison(keys, da, rt)


@query(f"WITH {_DAY_AHEAD}, {_REALTIME}, {_KEYS}, {_COMPARED} SELECT * FROM compared")
def compare_da_vs_rt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_compared(spark, sf_dir)).withColumnRenamed("interval", "interval_no")


_ASKED = _KEYS.replace("keys AS (", "keys AS (SELECT DATE '1900-01-01' AS market_date, 1 AS hour_ending, 1 AS interval_no UNION ")


@query(f"WITH {_DAY_AHEAD}, {_REALTIME}, {_ASKED}, {_COMPARED} SELECT * FROM compared QUALIFY row_number() OVER (PARTITION BY comparison_state ORDER BY market_date, hour_ending, interval_no) = 1")
def serve_price_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The function called for the first key of each state, and for one that nothing has."""
    _served(spark, sf_dir)
    firsts = _compared(spark, sf_dir).groupBy("comparison_state").agg(F.min(F.struct("market_date", "hour_ending", "interval")).alias("k")).select("k.*").collect()  # a row a state
    asked = [*map(tuple, firsts), (datetime.date(1900, 1, 1), 1, 1)]
    rows = reduce(DataFrame.unionByName, [catalog.call(spark, "fn_compare_da_vs_rt_price", *key) for key in asked])
    return _plain(rows).withColumnRenamed("interval", "interval_no")


@query(f"WITH {_DAY_AHEAD}, {_REALTIME}, {_KEYS}, {_COMPARED} SELECT market_date, hour_ending, interval_no, zonal_rt_minus_da_cad_per_mwh FROM compared WHERE zonal_rt_minus_da_cad_per_mwh IS NOT NULL ORDER BY abs(zonal_rt_minus_da_cad_per_mwh) DESC, 1, 2, 3 LIMIT 10")
def largest_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = serving.largest_deviations(_compared(spark, sf_dir))
    return _plain(top.select("market_date", "hour_ending", F.col("interval").alias("interval_no"), "zonal_rt_minus_da_cad_per_mwh"))


@query(f"""
WITH {_DEMAND}, {_GENERATION}, peaks AS (SELECT d.* FROM demand d JOIN (SELECT market_date, max(ontario_demand_mw) AS top FROM demand GROUP BY 1) t ON d.market_date = t.market_date AND d.ontario_demand_mw = t.top)
SELECT CAST(p.market_date AS VARCHAR) AS market_date, p.hour_ending, CAST(ontario_demand_mw AS DOUBLE) AS ontario_demand_mw, fuel_type, CAST(output_mwh AS DOUBLE) AS output_mwh FROM peaks p JOIN generation g ON p.market_date = g.market_date AND p.hour_ending = g.hour_ending""")
def peak_generation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    _served(spark, sf_dir)
    return _plain(catalog.scan(spark, "vw_peak_generation_context", ["market_date", "hour_ending", "ontario_demand_mw", "fuel_type", "output_mwh"]))


# -- evidence

_HOURLY_STATE = "CASE WHEN n = 0 THEN 'INSUFFICIENT' WHEN blocked THEN 'BLOCKED_BY_DQ' WHEN hours < 24 THEN 'PARTIAL' ELSE 'SUFFICIENT' END"


@query(f"""
WITH {_DEMAND}, c AS (SELECT count(*) AS n, count(DISTINCT hour_ending) AS hours, min(hour_ending) AS lo, max(hour_ending) AS hi FROM demand WHERE market_date = {_FIRST})
SELECT n AS row_count, hours AS distinct_hour_count, lo AS min_hour, hi AS max_hour, CAST(0 AS BIGINT) AS null_metric_rows, CASE WHEN n = 0 THEN 'INSUFFICIENT' WHEN hours = 24 THEN 'SUFFICIENT' ELSE 'PARTIAL' END AS evidence_state,
       CASE WHEN n = 0 THEN 'NO_PRIMARY_EVIDENCE' WHEN hours = 24 THEN 'EVIDENCE_COMPLETE' ELSE 'INCOMPLETE_COVERAGE' END AS reason, hours = 24 AND lo = 1 AND hi = 24 AS coverage_complete FROM c""")
def investigate_demand_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = evidence.investigate_hours(_demand(spark, sf_dir), _day(spark, sf_dir), results=_results(spark, sf_dir))
    return said.select("row_count", "distinct_hour_count", "min_hour", "max_hour", "null_metric_rows", "evidence_state", F.col("reason_codes")[0].alias("reason"), "coverage_complete")


@query(f"""
WITH {_DEMAND}, {_TYPED}, h AS (SELECT min(hour_ending) AS h FROM demand WHERE market_date = {_FIRST}), bad AS (SELECT {' OR '.join(f"count_if({hit}) > 0" for rule, (worst, hit) in _DEMAND_RULES.items() if worst == 'FAIL')} AS fails FROM typed),
facts AS (
  SELECT 'rules of the raw rows' AS scope, count(*) AS n, true AS usable, (SELECT fails FROM bad) AS blocked FROM demand, h WHERE market_date = {_FIRST} AND hour_ending = h
  UNION ALL SELECT 'rules of the fact', count(*), true, false FROM demand, h WHERE market_date = {_FIRST} AND hour_ending = h
  UNION ALL SELECT 'a measure short', count(*), false, false FROM demand, h WHERE market_date = {_FIRST} AND hour_ending = h
  UNION ALL SELECT 'another day', count(*), true, false FROM demand WHERE market_date = DATE '1900-01-01')
SELECT scope, n AS rows, CASE WHEN n = 0 OR NOT usable THEN 'INSUFFICIENT' WHEN blocked THEN 'BLOCKED_BY_DQ' WHEN n = 1 THEN 'SUFFICIENT' ELSE 'PARTIAL' END AS evidence_state,
  CASE WHEN n = 0 THEN 'NO_PRIMARY_EVIDENCE' WHEN NOT usable THEN 'MISSING_REQUIRED_METRICS' WHEN blocked THEN 'DQ_BLOCKING_FAILURE' WHEN n = 1 THEN 'EVIDENCE_COMPLETE' ELSE 'INCOMPLETE_COVERAGE' END AS reason FROM facts""")
def investigate_demand_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hour under results of rules that fail on the raw rows, under those of the fact, of a fact that lacks a measure, and a day without any row."""
    fact, day = _demand(spark, sf_dir), _day(spark, sf_dir)
    results = lambda rows: quality.result_rows(spark, quality.evaluate(rows, DEMAND), "r", DEMAND).withColumn("dataset_name", F.lit(evidence.DATASET))
    hour = fact.filter(F.col("market_date") == day).agg(F.min("hour_ending")).first()[0]
    said = lambda name, df: df.select(F.lit(name).alias("scope"), "rows", "evidence_state", F.col("reason_codes")[0].alias("reason"))
    good = results(fact)
    scopes = {
        "rules of the raw rows": evidence.investigate_hours(fact, day, hour, results(_typed(spark, sf_dir))), "rules of the fact": evidence.investigate_hours(fact, day, hour, good),
        "a measure short": evidence.investigate_hours(fact.drop("market_demand_mw"), day, hour, good), "another day": evidence.investigate_hours(fact, "1900-01-01", 1, good),
    }
    return reduce(DataFrame.unionByName, [said(name, df) for name, df in scopes.items()])


@query(f"""
WITH {_EVENTS}, c AS (SELECT * FROM current_state WHERE price IS NOT NULL AND loss IS NOT NULL ORDER BY slot LIMIT 1)
SELECT CAST(1 AS BIGINT) AS rows, 'BLOCKED_BY_DQ' AS evidence_state, 'DQ_BLOCKING_FAILURE' AS reason, true AS blocking_dq_failure, false AS nonblocking_dq_warning FROM c""")
def investigate_price_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    current = realtime.price_current(log)
    key = current.filter(" AND ".join(f"{p} IS NOT NULL" for p in PRICES)).orderBy("delivery_date", "delivery_hour", "interval").select(*realtime.KEY).first()
    said = evidence.investigate_slot(current, realtime.dq_summary(log), *key)
    return said.select("rows", "evidence_state", F.col("reason_codes")[0].alias("reason"), "blocking_dq_failure", "nonblocking_dq_warning")


_CLEAN = """clean AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY delivery_date, delivery_hour, interval_no ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS rn FROM log WHERE event_type <> 'error' AND event_id % 11 <> 0 AND event_id % 7 <> 0) WHERE rn = 1),
failing AS (SELECT count_if(source_hash = '') + count_if(event_type = 'error' AND state = 'ELIGIBLE') + count_if(event_type <> 'error' AND (price IS NULL OR loss IS NULL)) + count_if(event_type = 'error' AND event_id % 2 <> 0) AS n FROM log)"""


@query(f"""
WITH {_EVENTS}, {_DEMAND}, {_CLEAN}, asked AS (SELECT delivery_date, delivery_hour, interval_no FROM clean c JOIN demand d ON CAST(c.delivery_date AS DATE) = d.market_date AND c.delivery_hour = d.hour_ending ORDER BY slot LIMIT 1),
anywhere AS (SELECT delivery_date, delivery_hour, interval_no FROM current_state WHERE price IS NOT NULL AND loss IS NOT NULL ORDER BY slot LIMIT 1), counts AS (
  SELECT (SELECT count(*) FROM clean JOIN asked USING (delivery_date, delivery_hour, interval_no)) AS prices, (SELECT count(*) FROM demand d JOIN asked a ON d.market_date = CAST(a.delivery_date AS DATE) AND d.hour_ending = a.delivery_hour) AS demands,
         (SELECT count(*) FROM current_state JOIN anywhere USING (delivery_date, delivery_hour, interval_no)) AS blocked_prices, (SELECT count(*) FROM demand d JOIN anywhere a ON d.market_date = CAST(a.delivery_date AS DATE) AND d.hour_ending = a.delivery_hour) AS blocked_demands, (SELECT n > 0 FROM failing) AS fails),
scenes AS (SELECT 'sufficient' AS scene, prices, prices AS metrics, demands, false AS fails FROM counts UNION ALL SELECT 'no demand', prices, prices, 0, false FROM counts UNION ALL SELECT 'no metrics', prices, 0, demands, false FROM counts
  UNION ALL SELECT 'no such slot', 0, 0, 0, false FROM counts UNION ALL SELECT 'blocked', blocked_prices, blocked_prices, blocked_demands, fails FROM counts)
SELECT scene, prices, metrics, demands, CASE WHEN prices = 0 THEN 'INSUFFICIENT' WHEN fails THEN 'BLOCKED_BY_DQ' ELSE 'SUFFICIENT' END AS realtime_price,
  CASE WHEN prices = 0 THEN 'INSUFFICIENT' WHEN fails THEN 'BLOCKED_BY_DQ' WHEN metrics <> 1 OR demands <> 1 THEN 'PARTIAL' ELSE 'SUFFICIENT' END AS evidence_state,
  CASE WHEN fails AND prices > 0 THEN 'CORE_RT_BLOCKED_BY_DQ' WHEN prices = 0 THEN 'CORE_RT_INSUFFICIENT' WHEN metrics <> 1 THEN 'RT_METRICS_UNAVAILABLE' WHEN demands <> 1 THEN 'HOURLY_DEMAND_CONTEXT_UNAVAILABLE' ELSE 'EVIDENCE_COMPLETE' END AS reason FROM scenes""")
def investigate_market_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite answer in each of its branches: over the log as it is, whose rules fail, and over the deliveries that break none."""
    base, log, demand = _folder(spark, "investigated"), _log(spark, sf_dir), _demand(spark, sf_dir)
    k = F.col("event_id").cast("long")
    sides = {"log": log, "clean": log.filter((F.col("event_type") == series.OBSERVATION) & (k % 11 != 0) & (k % 7 != 0))}
    made = {}
    for name, side in sides.items():
        for what, rows in (("current", realtime.price_current(side)), ("rules", realtime.dq_summary(side)), ("metrics", realtime.price_market_metrics(side))):
            rows.write.parquet(f"{base}/{name}/{what}")
        made[name] = tuple(spark.read.parquet(f"{base}/{name}/{what}") for what in ("current", "rules", "metrics"))
    first = lambda rows: rows.orderBy(*realtime.KEY).select(*realtime.KEY).first()
    whole, clean = made["log"], made["clean"]
    anywhere = first(whole[0].filter(" AND ".join(f"{p} IS NOT NULL" for p in PRICES)))
    hours = demand.select(F.col("market_date").cast("string").alias("delivery_date"), F.col("hour_ending").alias("delivery_hour"))
    asked = first(clean[0].join(hours, ["delivery_date", "delivery_hour"], "left_semi"))
    there = (F.col("market_date") == F.lit(asked.delivery_date).cast("date")) & (F.col("hour_ending") == asked.delivery_hour)
    scenes = {
        "sufficient": (*clean, demand, *asked), "no demand": (*clean, demand.filter(~there), *asked), "no metrics": (*clean[:2], clean[2].limit(0), demand, *asked),
        "no such slot": (*clean, demand, "1900-01-01", 1, 1), "blocked": (*whole, demand, *anywhere),
    }
    out = []
    for scene, given in scenes.items():
        said = evidence.investigate_event(*given)
        e, r = said["evidence"], said["result"]
        out.append((scene, len(r["realtime_price"]), len(r["realtime_metrics"]), len(r["hourly_demand_context"]), e["component_states"]["realtime_price"], e["evidence_state"], e["reason_codes"][0]))
    return spark.createDataFrame(out, "scene string, prices long, metrics long, demands long, realtime_price string, evidence_state string, reason string")


@query("""
SELECT p, u, b, c, CASE WHEN NOT (p AND u) THEN 'INSUFFICIENT' WHEN b THEN 'BLOCKED_BY_DQ' WHEN NOT c THEN 'PARTIAL' ELSE 'SUFFICIENT' END AS evidence_state,
       CASE WHEN NOT p THEN 'NO_PRIMARY_EVIDENCE' WHEN NOT u THEN 'MISSING_REQUIRED_METRICS' WHEN b THEN 'DQ_BLOCKING_FAILURE' WHEN NOT c THEN 'INCOMPLETE_COVERAGE' ELSE 'EVIDENCE_COMPLETE' END AS reason
FROM (SELECT k % 2 = 1 AS p, k // 2 % 2 = 1 AS u, k // 4 % 2 = 1 AS b, k // 8 = 1 AS c FROM range(16) t(k))""")
def evidence_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = spark.range(16).select(*[(F.shiftright("id", k) % 2 == 1).alias(c) for k, c in enumerate("pubc")])
    named = [F.col(c) for c in "pubc"]
    return facts.select(*"pubc", evidence.evidence_state(*named).alias("evidence_state"), evidence.reason_codes(*named)[0].alias("reason"))


# -- landing, outbox, stream, runs


def _payloads(spark: SparkSession, sf_dir: str) -> list[tuple[str, bytes, bytes]]:
    """The regions' names as payloads, and revised: what a source would have sent."""
    names = [r.r_name for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    return [(f"regions|alias={n}", n.encode(), n.lower().encode()) for n in names]


@query("""
SELECT 'regions|alias=' || r_name AS key, step, classification, reused FROM region,
  (VALUES (1, 'NEW', false), (2, 'UNCHANGED', true), (3, 'REVISED', false), (4, 'RECOVER', true)) v(step, classification, reused)""")
def landing_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, out = _folder(spark, "landing"), []
    registry = landing.Registry(spark, f"{base}/registry")
    for key, first, second in _payloads(spark, sf_dir):
        for step, payload in enumerate((first, first, second, second), 1):
            if step == 4:
                registry.fail(key, landing.payload_hash(second))
            said = landing.ingest(spark, registry, f"{base}/bronze", "regions", key, "r.txt", payload)
            out.append((key, step, said["classification"], said["reused_existing"]))
    return spark.createDataFrame(out, "key string, step int, classification string, reused boolean")


@query("SELECT sha256(p) AS source_hash, CASE WHEN k = 0 THEN 'OK' ELSE 'LENGTH_DIFFERS' END AS state FROM (SELECT r_name AS p, row_number() OVER (ORDER BY r_regionkey) - 1 AS k FROM region) UNION ALL SELECT repeat('0', 64), 'MISSING'")
def landing_file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, known = _folder(spark, "files"), []
    for k, (_, payload, _) in enumerate(_payloads(spark, sf_dir)):
        digest = landing.payload_hash(payload)
        landing.persist_once(spark, payload, landing.landing_path(base, digest, "r.txt"), digest)
        known.append((digest, len(payload) + k))
    registry = spark.createDataFrame([*known, ("0" * 64, 1)], "source_hash string, file_size long")
    return catalog.file_checks(landing.files_with_hash(spark, base), registry)


@query("SELECT * FROM (VALUES (0, 'd.xml'), (1, 'd_v1.xml'), (2, 'd_v2.xml'), (-1, 'missing: gone')) v(version, name)")
def folder_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _folder(spark, "probe")
    for name in ("d.xml", "d_v1.xml", "d_v2.xml", "other.xml"):
        landing.persist_once(spark, b"x", f"{base}/{name}", landing.payload_hash(b"x"))
    rows = catalog.probe_versions(spark, base, "d.xml") + [(-1, f"missing: {x}") for x in catalog.missing_folders(spark, base, ["d.xml", "gone"])]
    return spark.createDataFrame(rows, "version int, name string")


@query(f"""
WITH {_REALTIME}
SELECT sha256('rt_price_event_v1|' || CAST(delivery_date AS VARCHAR) || '|' || delivery_hour || '|' || interval_no || '|<NULL>|' || repeat('a', 64)) AS event_id, 'RT_PRICE_OBSERVATION' AS event_type, 'PENDING' AS status, CAST(0 AS BIGINT) AS attempt_count
FROM realtime WHERE zonal IS NOT NULL AND loss IS NOT NULL AND congestion IS NOT NULL""")
def outbox_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = outbox.Outbox(spark, _folder(spark, "outbox"))
    published = spark.createDataFrame([], "delivery_date date, delivery_hour int, interval int, event_id string, observation_hash string, publication_state string")
    outbox.publish(box, _realtime(spark, sf_dir), published, {"source_name": "rt", "source_hash": "a" * 64})
    return box.read().select("event_id", "event_type", "status", "attempt_count")


@query("""
WITH n AS (SELECT count(DISTINCT user_id) AS n FROM events)
SELECT status, attempt_count, k AS n FROM n, (SELECT 'SENT' AS status, CAST(1 AS BIGINT) AS attempt_count, n - 4 AS k FROM n UNION ALL SELECT 'SENT', 2, 1 FROM n UNION ALL SELECT 'SENDING', 1, 3 FROM n)""")
def outbox_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event a user: three leased and left, one that fails first, the others sent; then once more."""
    latest = series.latest_by(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"])
    events = latest.select(*[(F.sha2(F.col("user_id").cast("string"), 256) if c == "event_id" else F.lit(None)).cast(kind).alias(c) for c, kind in (x.split() for x in outbox.EVENT.split(", "))])
    box = outbox.Outbox(spark, _folder(spark, "lifecycle"))
    box.put(events)
    box.claims("gone", 3, "1 day")

    def broken(event: str, payload: str) -> None:
        raise ConnectionError("no line")

    try:
        box.dispatch(broken, most=1)
    except ConnectionError:
        pass
    box.dispatch_all(lambda event, payload: None)
    return box.read().groupBy("status", "attempt_count").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(hour(ts) + 1 AS INT) AS delivery_hour, value AS price, 1 + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS deliveries FROM events""")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as JSON into the landing folder, clicks twice, and through the stream into the log."""
    base, names = _folder(spark, "stream"), [c.split()[0] for c in outbox.EVENT.split(", ")]
    made = {"event_id": F.col("event_id").cast("string"), "event_type": F.col("event_type"), "delivery_hour": (F.hour("ts") + 1).cast("int"), PRICES[0]: F.col("value")}
    events = table(spark, sf_dir, "events").select(F.to_json(F.struct(*[made.get(c, F.lit(None).cast("string")).alias(c) for c in sorted(names)])).alias("value"), "event_type")
    events.select("value").write.mode("append").text(f"{base}/in")
    outbox.stream_to_log(spark, f"{base}/in", f"{base}/log", f"{base}/cp").awaitTermination()
    events.filter("event_type = 'click'").select("value").write.mode("append").text(f"{base}/in")
    outbox.stream_to_log(spark, f"{base}/in", f"{base}/log", f"{base}/cp").awaitTermination()
    log = spark.read.parquet(f"{base}/log")
    return log.groupBy("event_id", "event_type", "delivery_hour", F.col(PRICES[0]).alias("price")).agg(F.count(F.lit(1)).cast("int").alias("deliveries"))


@query("SELECT * FROM (VALUES (1, 'a', 'BOOTSTRAP'), (2, 'a', 'UNCHANGED'), (3, 'b', 'NEW_REVISION')) v(step, source_hash, gate)")
def source_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, out = outbox.SourceCheckpoints(spark, _folder(spark, "gate")), []
    for step, source_hash in enumerate("aab", 1):
        out.append((step, source_hash, points.gate("rt", source_hash)))
        points.polled("rt") if out[-1][2] == "UNCHANGED" else points.complete("rt", source_hash, "/x", "run")
    return spark.createDataFrame(out, "step int, source_hash string, gate string")


def _silver(rows: DataFrame) -> DataFrame:
    return rows.select(*DEMAND.columns)


@query(f"""
WITH {_DEMAND}, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE hour_ending = 1) AS one FROM demand)
SELECT * FROM (SELECT 1 AS step, 'SUCCESS' AS status, CAST(0 AS BIGINT) AS ending_version, n AS changed_keys, n AS cdf_rows FROM n UNION ALL SELECT 2, 'NO_CHANGE', 0, 0, 0 FROM n UNION ALL SELECT 3, 'SUCCESS', 1, one, 2 * one FROM n)""")
def incremental_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact that follows its source by watermark: all of it, nothing, and the revised hours."""
    base, out = _folder(spark, "facts"), []
    source, _ = runs.tables_of(spark, base, DEMAND)
    demand, facts = _silver(_demand(spark, sf_dir)), runs.IncrementalFacts(spark, base)
    source.create(demand)
    for step in (1, 2, 3):
        if step == 3:
            source.merge(demand.filter("hour_ending = 1").withColumn("market_demand_mw", (F.col("market_demand_mw") + 1).cast("decimal(18,3)")))
        said = facts.run(DEMAND.dataset)
        out.append((step, said["status"], said["ending_version"], said["changed_keys"], said["cdf_rows"]))
    return spark.createDataFrame(out, "step int, status string, ending_version long, changed_keys long, cdf_rows long")


@query("SELECT * FROM (VALUES ('one', 'SUCCESS', 3, NULL), ('two', 'FAILED', NULL, 'no line')) v(source_name, status, records_written, error_message)")
def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = runs.Runs(spark, _folder(spark, "runs"))

    def broken(run_id: str) -> int:
        raise ConnectionError("no line")

    steps = [("one", lambda: log.run("p", "one", lambda run_id: 3)), ("two", lambda: log.run("p", "two", broken)), ("three", lambda: log.run("p", "three", lambda run_id: 1))]
    runs.run_in_order(steps)
    return log.table.read().select("source_name", "status", F.col("records_written").cast("int").alias("records_written"), "error_message")


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority <> '1-URGENT'")
def unfinished_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat_ws("/", F.col("o_orderstatus"), F.col("o_orderkey").cast("string")).alias("run_id"), "o_orderstatus", "o_orderpriority")
    done = orders.filter("o_orderpriority = '1-URGENT'").select("run_id", F.when(F.col("o_orderstatus") != "P", "SUCCESS").otherwise("FAILED").alias("status"))
    return runs.unfinished_payloads(orders.select("k", "run_id"), done).select("k")


# -- tables: sinks, catalog


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast(MONEY).alias("price"))


def _store(spark: SparkSession) -> VersionedTable:
    return VersionedTable(spark, _folder(spark, "store"), ["o_orderkey"])


@query("SELECT o_orderkey, o_orderstatus, CAST(CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 0 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS DOUBLE) AS price FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 3 <> 0")
def store_append_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, orders = _store(spark), _orders(spark, sf_dir)
    store.create(orders.filter("o_orderstatus = 'F'"))
    store.append(orders.filter("o_orderstatus = 'O'"))
    store.insert_only(orders.filter("o_orderstatus <> 'O'"))
    store.update_where((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 2 == 0), {"price": F.lit(0)})
    store.delete_where((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0))
    return _plain(store.read())


@query("""
WITH c AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0) AS u FROM orders)
SELECT 0 AS version, 'create' AS operation, f AS inserted, CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS deleted FROM c UNION ALL SELECT 1, 'overwrite', o, 0, f FROM c UNION ALL SELECT 2, 'merge', 0, u, 0 FROM c UNION ALL SELECT 3, 'delete', 0, 0, o - u FROM c""")
def store_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, orders = _store(spark), _orders(spark, sf_dir)
    store.create(orders.filter("o_orderstatus = 'F'"))
    store.create(orders.filter("o_orderstatus = 'O'"))
    revised = orders.filter("o_orderstatus <> 'P'").withColumn("price", (F.col("price") + 1).cast(MONEY))
    store.merge(revised, update={"price": F.col("s.price")}, when=F.col("t.o_orderkey") % 2 == 0, insert=False)
    store.delete_where(F.col("o_orderkey") % 2 == 1)
    return store.history().withColumn("version", F.col("version").cast("int"))


def _ddl_rows(contract: Contract) -> str:
    return ", ".join(f"({k}, '{c}', '{t}')" for k, (c, t) in enumerate({**contract.columns, **LINEAGE}.items(), 1))


@query(f"SELECT * FROM (VALUES {_ddl_rows(CONTRACTS['zonal_demand_hourly'])}) v(position, column_name, data_type)")
def catalog_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"t_{uuid.uuid4().hex}"
    catalog.create_table(spark, name, CONTRACTS["zonal_demand_hourly"])
    out = catalog.described(spark, name).drop("nullable")
    catalog.drop(spark, name)
    return out


@query("""
WITH o AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3)
SELECT 'made' AS step, (SELECT count(*) FROM o) AS rows, true AS there UNION ALL SELECT 'feed', 1, true UNION ALL SELECT 'view', 2, true UNION ALL SELECT 'dropped', 0, false""")
def catalog_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as a select, a property of it, a view over it, and both dropped."""
    name = f"t_{uuid.uuid4().hex}"
    there = lambda n: n in [r.name for r in catalog.tables(spark).filter(F.col("name") == n).collect()]
    catalog.create_as(spark, name, table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 3)
    out = [("made", spark.table(name).count(), there(name))]
    catalog.set_property(spark, name, "halyard.change_feed", "true")
    out.append(("feed", 1, catalog.properties(spark, name).get("halyard.change_feed") == "true"))
    catalog.scan(spark, name).limit(2).createOrReplaceTempView(f"{name}_v")
    out.append(("view", spark.table(f"{name}_v").count(), there(f"{name}_v")))
    catalog.drop(spark, f"{name}_v")
    catalog.drop(spark, name)
    out.append(("dropped", 0, there(name) or there(f"{name}_v")))
    return spark.createDataFrame(out, "step string, rows long, there boolean")


# -- predicates, aggregates and joins


@query("SELECT p_partkey FROM part WHERE p_type LIKE 'PROMO%' OR p_size BETWEEN 10 AND 12 OR p_brand IN ('Brand#11', 'Brand#12')")
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_type").startswith("PROMO") | F.col("p_size").between(10, 12) | F.col("p_brand").isin("Brand#11", "Brand#12")).select("p_partkey")


@query("SELECT o_orderstatus, list_sort(list(DISTINCT o_orderpriority))[1] AS first_priority, len(list(DISTINCT o_orderpriority)) AS priorities FROM orders GROUP BY 1")
def collected_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = audit.collected(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderpriority")
    return sets.select("o_orderstatus", F.col("values")[0].alias("first_priority"), F.size("values").cast("long").alias("priorities"))


@query("SELECT o_orderkey, n, round(o_totalprice, 2) AS o_totalprice FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def one_to_one_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return audit.one_to_one(table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice")), lines, ["o_orderkey"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem" for c in ("l_quantity", "l_discount", "l_linenumber")))
def describe_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(audit.described(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_linenumber"]))


@query("""
SELECT 'p_brand' AS column_name, 'string' AS data_type, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_nulls, count(DISTINCT p_brand) AS n_distinct, count(*) FILTER (WHERE p_brand NOT LIKE 'Brand#1%') AS n_invalid, min(p_brand) AS min_value, max(p_brand) AS max_value FROM part
UNION ALL SELECT 'p_size', 'int', count(*), count(*) FILTER (WHERE p_size = 7), count(DISTINCT CASE WHEN p_size <> 7 THEN p_size END), count(*) FILTER (WHERE p_size > 40), CAST(min(CASE WHEN p_size <> 7 THEN p_size END) AS VARCHAR), CAST(max(p_size) AS VARCHAR) FROM part""")
def schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_brand", F.when(F.col("p_size") != 7, F.col("p_size")).alias("p_size"))
    return audit.schema_profile(part, ["p_brand", "p_size"], {"p_brand": F.col("p_brand").startswith("Brand#1"), "p_size": F.col("p_size") <= 40})


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("p"))
    return props.select("event_id", F.try_element_at("p", F.lit("k")).cast("long").alias("k"), F.try_element_at("p", F.lit("none")).alias("missing"))


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 1")
def queue_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy("ts", "event_id").limit(1).select("event_id")


@query("""
SELECT event_id, sha256('rt_price_event_v1|' || CAST(CAST(ts AS DATE) AS VARCHAR) || '|' || (hour(ts) + 1) || '|' || (minute(ts) // 5 + 1) || '|' || CASE WHEN event_id % 3 = 0 THEN '<NULL>' ELSE event_type END || '|' || repeat('b', 64)) AS id FROM events""")
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    created = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    parts = [F.to_date("ts"), F.hour("ts") + 1, F.floor(F.minute("ts") / 5) + 1, created, F.lit("b" * 64)]
    return table(spark, sf_dir, "events").select("event_id", event_id(outbox.EVENT_VERSION, parts).alias("id"))


@query("SELECT o_orderstatus, n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY 1)")
def distribution_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"))
    return audit.distribution(orders, ["o_orderstatus"])


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_returnflag = 'N')")
def orphan_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite keys of returned lines that no other line has."""
    lines = table(spark, sf_dir, "lineitem")
    return audit.missing_keys(lines, lines.filter("l_returnflag = 'N'"), ["l_partkey", "l_suppkey"])
