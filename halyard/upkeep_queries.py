"""Queries over tables that are kept up to date: change feeds, partitions, leases, keyed state, windows, ingestion, quarantine.

Each makes its tables of the driver's, changes them in steps, and lets what is tested follow; the SQL says where that must end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.market_queries import _CHANGES, _DAY_AHEAD, _DEMAND, _DEMAND_RULES, _EVENTS, _GENERATION, _REALTIME, _TYPED, DEMAND, MONEY, _day_ahead, _demand, _folder, _generation, _generation_files, _log, _metrics_sql, _plain, _raw, _realtime, _rules_sql, _said, _six, _typed, _written
from halyard.functions.sketches import QUARTILES, DailyProfiles
from halyard.functions.typing import typed
from halyard.operators import realtime, upkeep
from halyard.plans import quality
from halyard.plans.contracts import CONTRACTS
from halyard.plans.quarantine import Quarantine
from halyard.plans.store import VersionedTable
from halyard.queries import query
from halyard.session import table
from halyard.sources import delimited, documents
from halyard.streaming import change_feed, current, ingestion, outbox

# -- change feed


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast(MONEY).alias("price"))


def _revised(spark: SparkSession, sf_dir: str, name: str):
    """Most orders; after the first step some of them revised and the others added; then some deleted."""
    orders, k = _orders(spark, sf_dir), F.col("o_orderkey")
    source = VersionedTable(spark, _folder(spark, name), ["o_orderkey"])
    source.create(orders.filter(k % 10 != 9))
    yield source
    source.merge(orders.filter((k % 7 == 0) | (k % 10 == 9)).withColumn("price", (F.col("price") + F.when(k % 7 == 0, 1).otherwise(0)).cast(MONEY)))
    source.delete_where(k % 11 == 0)
    yield source


_PRICE = "CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END"


@query(f"SELECT o_orderkey, o_orderpriority, CAST({_PRICE} AS DOUBLE) AS price FROM orders WHERE o_orderkey % 11 <> 0")
def feed_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact that follows its source through updates and deletes, by a stream that is begun anew at each step."""
    base = _folder(spark, "feed_follow")
    fact = VersionedTable(spark, f"{base}/fact", ["o_orderkey"])
    for source in _revised(spark, sf_dir, "feed_source"):
        change_feed.follow(spark, source, fact, f"{base}/state").awaitTermination()
    return fact.read().withColumn("price", F.col("price").cast("double"))


@query(f"""
WITH o AS (SELECT o_orderkey AS k, o_totalprice, o_orderkey FROM orders), c AS (
  SELECT 0 AS _version, 'insert' AS _change_type, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM o WHERE k % 10 <> 9
  UNION ALL SELECT 1, 'insert', {_PRICE} FROM o WHERE k % 10 = 9 UNION ALL SELECT 1, 'update_preimage', CAST(o_totalprice AS DECIMAL(18,2)) FROM o WHERE k % 7 = 0 AND k % 10 <> 9
  UNION ALL SELECT 1, 'update_postimage', {_PRICE} FROM o WHERE k % 7 = 0 AND k % 10 <> 9 UNION ALL SELECT 2, 'delete', {_PRICE} FROM o WHERE k % 11 = 0)
SELECT _version, _change_type, count(*) AS n, CAST(sum(price) AS DOUBLE) AS price FROM c GROUP BY 1, 2""")
def feed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream delivers of each version, once, though it is stopped in between."""
    base = _folder(spark, "feed_changes")
    for source in _revised(spark, sf_dir, "feed_log"):
        stream = change_feed.changes(spark, source).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("_version", "_change_type").agg(F.count(F.lit(1)).alias("n"), F.sum("price").cast("double").alias("price"))


# -- merges that touch their partitions


@query("""
WITH parts AS (SELECT o_orderpriority AS part, count(*) AS n, count_if(o_orderkey % 3 = 0) AS revised FROM orders GROUP BY 1)
SELECT part, part IN ('1-URGENT', '5-LOW') AS rewritten, n AS rows, CASE WHEN part IN ('1-URGENT', '5-LOW') THEN revised ELSE 0 END::BIGINT AS revised FROM parts""")
def merge_touches_its_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of five priorities two are merged: which folders were written again, what every part holds, and what was revised."""
    orders = _orders(spark, sf_dir)
    store = VersionedTable(spark, _folder(spark, "parts"), ["o_orderpriority", "o_orderkey"], partition="o_orderpriority")
    store.create(orders.withColumn("revised", F.lit(0)))
    store.merge(orders.filter("o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderkey % 3 = 0").withColumn("revised", F.lit(1)))
    written = [store.read(parts=[p]).select(F.lit(p).alias("part"), F.lit(any(f.endswith(f"={p.replace(' ', '%20')}") or f.endswith(f"={p}") for f in store.manifest(1)["written"])).alias("rewritten"), "revised") for p in store.parts()]
    rows = written[0]
    for more in written[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("part", "rewritten").agg(F.count(F.lit(1)).alias("rows"), F.sum("revised").alias("revised"))


# -- leases as a log


@query("""
WITH n AS (SELECT count(DISTINCT user_id) AS n FROM events), log AS (
  SELECT unnest([0, 1, 2, 3, 4, 5]) AS version, unnest(['merge', 'append', 'append', 'append', 'append', 'compact']) AS operation, unnest([n, 3, 4, 3, 3, 0]) AS written FROM n)
SELECT CAST(version AS BIGINT) AS version, operation, CAST(written AS BIGINT) AS written, n - 9 AS pending, CAST(7 AS BIGINT) AS sending, CAST(2 AS BIGINT) AS sent, n AS folded FROM log, n""")
def outbox_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event a user: two claimers never share one, a claim or outcome writes rows of its own events only, and the log can be folded."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    events = users.select(*[(F.sha2(F.col("user_id").cast("string"), 256) if c == "event_id" else F.lit(None)).cast(kind).alias(c) for c, kind in ingestion.KINDS.items()])
    box = outbox.Outbox(spark, _folder(spark, "log"))
    box.put(events)
    one, two = box.claims("one", 3), box.claims("two", 4)
    if {e for e, _ in one} & {e for e, _ in two}:
        raise RuntimeError("two claimers share an event")
    ids = [e for e, _ in one]
    box.settle("one", ids[:2], ids[2], "no line")
    again = box.claims("one", 3, "1 day")
    box.compact()
    if ids[2] not in {e for e, _ in again}:
        raise RuntimeError("what was put back is not leased first")
    states = box.read().agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in (outbox.PENDING, outbox.SENDING, outbox.SENT)], F.count(F.lit(1)).alias("folded"))
    return box.table.history().select("version", "operation", F.col("inserted").alias("written")).crossJoin(F.broadcast(states))  # a row each


# -- keyed state and windows


@query(f"WITH {_EVENTS} SELECT delivery_date, delivery_hour, interval_no, CAST(event_id AS VARCHAR) AS event_id, round(price, 6) AS price, source_hash FROM current_state")
def state_follows_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current prices by keyed state, from deliveries that come in three parts, the latest first."""
    base, log = _folder(spark, "state"), _log(spark, sf_dir)
    kept = current.current_table(spark, f"{base}/current")
    for k in (2, 1, 0):
        log.filter(F.col("event_id").cast("long") % 3 == k).write.mode("append").parquet(f"{base}/log")
        current.follow(spark.readStream.schema(log.schema).parquet(f"{base}/log"), kept, f"{base}/checkpoint").awaitTermination()
    return kept.read().select("delivery_date", "delivery_hour", F.col("interval").alias("interval_no"), "event_id", F.round(realtime.PRICES[0], 6).alias("price"), "source_hash")


@query(f"WITH {_EVENTS}, {_CHANGES} {_metrics_sql()}")
def metrics_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change and windows of half the log, brought up to the whole log by what changed."""
    base, log = _folder(spark, "upkeep"), _log(spark, sf_dir)
    kept, metrics = current.current_table(spark, f"{base}/current"), upkeep.metrics_table(spark, f"{base}/metrics")
    kept.create(realtime.price_current(log.filter(F.col("event_id").cast("long") % 2 == 0)))
    upkeep.update(kept, metrics, -1)
    now = realtime.price_current(log).withColumn("_gone", F.lit(False))
    left = kept.read().join(now.select(*realtime.KEY), realtime.KEY, "left_anti").withColumn("_gone", F.lit(True))
    kept.merge(now.unionByName(left), gone="_gone")
    upkeep.update(kept, metrics, 0)
    return _six(metrics.read())


# -- ingestion with rejects, quarantine


@query("""
SELECT reason, count(*) AS lines, count(DISTINCT event_id) AS events FROM (
  SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'NOT_JSON' WHEN event_id % 17 = 0 THEN 'MISSING: event_id' WHEN event_id % 19 = 0 THEN 'TYPE: delivery_hour' WHEN event_id % 23 = 0 THEN 'EMPTY' ELSE 'taken' END AS reason FROM events) GROUP BY 1""")
def ingestion_with_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a line, some of them malformed, in two parts; the first part's batch is played twice."""
    base, k = _folder(spark, "ingestion"), F.col("event_id")
    made = F.to_json(F.struct(F.when(k % 17 != 0, k.cast("string")).alias("event_id"), "event_type", F.when(k % 19 == 0, "one").otherwise((F.hour("ts") + 1).cast("string")).alias("delivery_hour"), F.col("value").alias(realtime.PRICES[0])))
    line = F.when(k % 13 == 0, F.substring(made, 1, 9)).when((k % 23 == 0) & (k % 17 != 0) & (k % 19 != 0), " ").otherwise(made)
    lines = table(spark, sf_dir, "events").select(line.alias("line"), F.lit("f").alias("_file"), k.alias("_k"))
    into = ingestion.Ingestion(spark, f"{base}/log", f"{base}/rejected")
    for part, batch in ((0, 0), (0, 0), (1, 1)):
        into.take(lines.filter(F.col("_k") % 2 == part).drop("_k"), batch)
    lost = into.rejected.read().groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))
    taken = into.events.read().agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("event_id").alias("events")).withColumn("reason", F.lit("taken"))
    return lost.withColumn("events", F.col("lines")).unionByName(taken)


_RULES_HIT = ", ".join(f"CASE WHEN coalesce({hit}, false) THEN '{rule}' END" for rule, (worst, hit) in _DEMAND_RULES.items() if worst == "FAIL")


@query(f"""
WITH {_TYPED}, marked AS (SELECT *, list_filter([{_RULES_HIT}, CASE WHEN count(*) OVER (PARTITION BY market_date, hour_ending) > 1 AND market_date IS NOT NULL AND hour_ending IS NOT NULL THEN 'duplicate_business_key' END], lambda x: x IS NOT NULL) AS rules FROM typed)
SELECT CASE WHEN len(rules) = 0 THEN 'ADMITTED' WHEN k % 3 = 0 THEN 'RELEASED' ELSE 'HELD' END AS state, CASE WHEN len(rules) = 0 OR k % 3 = 0 THEN '' ELSE array_to_string(rules, ',') END AS rules, count(*) AS n FROM marked GROUP BY 1, 2""")
def quarantine_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that break a rule are held; a third of them comes again corrected, under keys of their own, and goes on."""
    base, raw = _folder(spark, "quarantine"), _raw(spark, sf_dir)
    held, target = Quarantine(spark, f"{base}/held", DEMAND, beside=["k"]), VersionedTable(spark, f"{base}/target", list(DEMAND.keys))
    said = held.admit(raw.drop("payload"), target, "first")
    k = F.col("k").cast("long")
    # A day and hour of its own for each key, beyond the days of orders: years have more than four digits.
    day = F.date_add(F.lit("10000-01-01").cast("date"), F.floor(k / 24).cast("int")).cast("string")
    corrected = held.waiting().filter(k % 3 == 0).select("payload_hash", k.alias("k"), day.alias("date_raw"), (F.pmod(k, F.lit(24)) + 1).cast("string").alias("hour_raw"), F.lit("1.5").alias("market_demand_raw"), F.lit("1").alias("ontario_demand_raw"))
    held.replay(corrected, target, "second")
    states = held.table.read().groupBy("state", F.array_join("rules", ",").alias("rules")).agg(F.count(F.lit(1)).alias("n"))
    admitted = spark.createDataFrame([("ADMITTED", "", said["admitted"])] if said["admitted"] else [], "state string, rules string, n long")
    released = states.filter("state = 'RELEASED'").agg(F.sum("n")).first()[0] or 0
    if target.read().count() != said["admitted"] + released:
        raise RuntimeError("what was released is not in the target")
    return states.unionByName(admitted)


# -- profiles of days


def _profiles(spark: SparkSession, sf_dir: str, name: str) -> DailyProfiles:
    """The events' days, sketched in two parts, and a third time for the days of the second."""
    events, day = table(spark, sf_dir, "events"), F.to_date("ts")
    out = DailyProfiles(spark, _folder(spark, name), ["value", "user_id"], ["user_id", "event_id"], ["event_type"])
    days = sorted(r[0] for r in events.select(day.cast("string")).distinct().collect())  # a row a day
    out.update(events.withColumn("value", F.col("value") + 1), day)
    out.update(events, day, days[: len(days) // 2])
    out.update(events, day, days[len(days) // 2 :])
    return out


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, true AS quartiles_hold FROM events" for c in ("value", "user_id")))
def describe_by_merged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """describe with quartiles from the days' sketches; quartiles hold if they lie between the exact quantiles one per cent below and above."""
    said = _profiles(spark, sf_dir, "described").described()
    near = [F.lit(p + e) for p in QUARTILES.values() for e in (-0.01, 0.01)]
    events = table(spark, sf_dir, "events")
    exact = events.agg(*[F.percentile(c, F.array(*near)).alias(c) for c in ("value", "user_id")]).unpivot([], ["value", "user_id"], "column_name", "p")
    both = said.join(F.broadcast(exact), "column_name")  # a row a column
    hold = [(F.col("p")[2 * k] <= F.col(q)) & (F.col(q) <= F.col("p")[2 * k + 1]) for k, q in enumerate(QUARTILES)]
    return _six(both.select("column_name", "n", "mean", "stddev", "min", "max", (hold[0] & hold[1] & hold[2]).alias("quartiles_hold")))


@query("""
SELECT 'user_id' AS column_name, count(DISTINCT user_id) AS n_exact, true AS within FROM events UNION ALL SELECT 'event_id', count(DISTINCT event_id), true FROM events
UNION ALL SELECT 'user_id, a week', count(DISTINCT user_id), true FROM events WHERE CAST(ts AS DATE) BETWEEN (SELECT min(CAST(ts AS DATE)) FROM events) AND (SELECT min(CAST(ts AS DATE)) + 6 FROM events)""")
def distinct_by_merged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts from the days' sketches, and whether they are within three per cent of the exact ones."""
    profiles, events = _profiles(spark, sf_dir, "distinct"), table(spark, sf_dir, "events")
    since = events.agg(F.to_date(F.min("ts")).alias("d")).select(F.col("d").cast("string"), F.date_add("d", 6).cast("string")).first()
    week = profiles.distinct(*since).filter("column_name = 'user_id'").withColumn("column_name", F.lit("user_id, a week"))
    exact = events.agg(F.count_distinct("user_id").alias("user_id"), F.count_distinct("event_id").alias("event_id"), F.count_distinct(F.when(F.to_date("ts").between(*since), F.col("user_id"))).alias("user_id, a week"))
    rows = exact.unpivot([], exact.columns, "column_name", "n_exact").join(profiles.distinct().unionByName(week), "column_name")
    return rows.select("column_name", "n_exact", (F.abs(F.col("n_distinct") - F.col("n_exact")) <= F.greatest(F.col("n_exact") * 0.03, F.lit(1.0))).alias("within"))


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def frequent_by_merged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir, "frequent").frequent("event_type", 3)


# -- freshness, and rules over raw strings

_FRESH = {"demand": ("demand", "market_date", "hour_ending * 60", 24, 60), "generation": ("generation", "market_date", "hour_ending * 60", 72, 60), "zonal_demand": ("demand", "market_date", "hour_ending * 60", 240, 60), "day_ahead_price": ("day_ahead", "market_date", "hour_ending * 60", 24, 1440), "realtime_price": ("realtime", "delivery_date", "(delivery_hour - 1) * 60 + interval_no * 5", 288, 5)}
_NOW = "(SELECT max(CAST(o_orderdate AS TIMESTAMP)) + INTERVAL 30 HOUR FROM orders)"


@query(f"WITH {_DEMAND}, {_GENERATION}, {_DAY_AHEAD}, {_REALTIME} " + " UNION ALL ".join(
    f"""SELECT '{name}' AS source_name, CAST(max({day}) AS VARCHAR) AS latest_day, CAST(count(*) AS BIGINT) AS latest_day_rows, CAST({expected} AS BIGINT) AS expected_rows, count(*) >= {expected} AS is_complete, strftime(max({day})::TIMESTAMP + to_minutes(CAST(max({reaches}) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS reached_at,
  CAST(epoch({_NOW} - (max({day})::TIMESTAMP + to_minutes(CAST(max({reaches}) AS BIGINT)))) // 60 AS BIGINT) AS lag_minutes, CAST({cadence} AS BIGINT) AS cadence_minutes, epoch({_NOW} - (max({day})::TIMESTAMP + to_minutes(CAST(max({reaches}) AS BIGINT)))) // 60 > 2 * {cadence} AS is_late,
  CAST(max({day}) AS VARCHAR) AS last_created, CAST(max({day}) + 1 AS VARCHAR) AS last_ingested FROM {relation} WHERE {day} = (SELECT max({day}) FROM {relation})"""
    for name, (relation, day, reaches, expected, cadence) in _FRESH.items()
))
def dq_freshness_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sources at one time, thirty hours after the last order's day began."""
    made = {"demand": _demand, "generation": _generation, "day_ahead": _day_ahead, "realtime": lambda *a: _realtime(*a).withColumnRenamed("interval", "interval_no")}
    sources = {}
    for name, (relation, day, reaches, expected, cadence) in _FRESH.items():
        rows = made[relation](spark, sf_dir).withColumns({"_made": F.col(day).cast("string"), "_taken": F.date_add(day, 1).cast("string")})
        sources[name] = quality.Freshness(rows, day, F.expr(reaches), expected, cadence, "_made", "_taken")
    now = table(spark, sf_dir, "orders").agg(F.max("o_orderdate").cast("timestamp")).first()[0]
    return _plain(quality.freshness_by_source(sources, F.lit(now) + F.expr("INTERVAL 30 HOURS")))


_ZONAL_RAW = """zonal AS (SELECT CASE WHEN l_orderkey % 101 <> 0 THEN CAST(l_shipdate AS DATE) END AS market_date, CAST(l_orderkey % 26 AS INT) AS hour_ending, CASE WHEN l_linenumber <> 6 THEN l_returnflag END AS zone, CASE WHEN l_orderkey % 89 <> 0 THEN CAST(l_quantity - 5 AS DECIMAL(18,3)) END AS zonal_demand_mw FROM lineitem)"""
_ZONAL_RULES = {
    "business_key_not_null": ("FAIL", "market_date IS NULL OR hour_ending IS NULL OR zone IS NULL"), "hour_ending_domain": ("FAIL", "hour_ending NOT BETWEEN 1 AND 24"), "zonal_demand_mw_present": ("FAIL", "zonal_demand_mw IS NULL"),
    "zonal_demand_mw_null": ("PASS", "zonal_demand_mw IS NULL"), "zonal_demand_mw_negative": ("PASS", "zonal_demand_mw < 0"),
}


@query(f"WITH {_ZONAL_RAW} {_rules_sql('zonal', _ZONAL_RULES, 'market_date, hour_ending, zone')}")
def dq_zonal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zonal contract over lineitems: missing keys and values, hours out of their domain, zones that come twice in an hour."""
    k = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select(F.when(k % 101 != 0, F.to_date("l_shipdate")).alias("market_date"), (k % 26).cast("int").alias("hour_ending"), F.when(F.col("l_linenumber") != 6, F.col("l_returnflag")).alias("zone"), F.when(k % 89 != 0, F.col("l_quantity") - 5).cast("decimal(18,3)").alias("zonal_demand_mw"))
    return _said(quality.evaluate(rows, CONTRACTS["zonal_demand_hourly"]))


_GENERATION_RAW = """raw AS (SELECT CASE WHEN l_orderkey % 101 = 0 THEN 'soon' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date_raw, CAST(l_orderkey % 26 AS VARCHAR) AS hour_raw, l_returnflag AS fuel_type_raw, CASE WHEN l_orderkey % 97 = 0 THEN 'N/A' WHEN l_linenumber = 3 THEN ' ' ELSE CAST(CAST(l_quantity AS DECIMAL(18,3)) AS VARCHAR) END AS output_raw,
  CASE WHEN l_orderkey % 83 = 0 THEN '' WHEN l_orderkey % 79 = 0 THEN 'x' ELSE CAST(l_linenumber AS VARCHAR) END AS output_quality_raw FROM lineitem), generation AS (SELECT *, TRY_CAST(date_raw AS DATE) AS market_date, TRY_CAST(hour_raw AS INT) AS hour_ending, TRY_CAST(nullif(trim(output_raw), '') AS DECIMAL(18,3)) AS output_mwh, TRY_CAST(nullif(output_quality_raw, '') AS INT) AS output_quality_code FROM raw)"""
_GENERATION_RULES = {
    "business_key_not_null": ("FAIL", "market_date IS NULL OR hour_ending IS NULL OR fuel_type_raw IS NULL"), "hour_ending_domain": ("FAIL", "hour_ending NOT BETWEEN 1 AND 24"), "market_date_parses": ("FAIL", "market_date IS NULL"), "hour_ending_parses": ("FAIL", "hour_ending IS NULL"),
    "output_mwh_numeric": ("FAIL", "trim(output_raw) <> '' AND output_mwh IS NULL"), "output_quality_code_numeric": ("FAIL", "output_quality_raw <> '' AND output_quality_code IS NULL"), "output_quality_code_present": ("FAIL", "output_quality_raw = ''"),
    "output_mwh_null": ("PASS", "output_mwh IS NULL"), "output_mwh_negative": ("PASS", "output_mwh < 0"),
}


@query(f"WITH {_GENERATION_RAW} {_rules_sql('generation', _GENERATION_RULES, 'market_date, hour_ending, fuel_type_raw')}")
def dq_generation_raw_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generation contract over raw strings: an empty output is permitted, one that is there must be a number."""
    k = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(k % 101 == 0, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date_raw"), (k % 26).cast("string").alias("hour_raw"), F.col("l_returnflag").alias("fuel_type_raw"),
        F.when(k % 97 == 0, "N/A").when(F.col("l_linenumber") == 3, " ").otherwise(F.col("l_quantity").cast("decimal(18,3)").cast("string")).alias("output_raw"), F.when(k % 83 == 0, "").when(k % 79 == 0, "x").otherwise(F.col("l_linenumber").cast("string")).alias("output_quality_raw"),
    )
    contract = CONTRACTS["generation_hourly"]
    return _said(quality.evaluate(typed(rows, contract.typing()), contract))


@query(f"""
WITH {_TYPED}, now AS (SELECT * FROM typed WHERE k % 5 <> 0), first AS ({_rules_sql('typed', _DEMAND_RULES, 'market_date, hour_ending')}), second AS ({_rules_sql('now', _DEMAND_RULES, 'market_date, hour_ending')})
SELECT run_id, rule_id, severity, records_checked, CASE WHEN worst <> 'PASS' THEN records_failed END AS records_failed, CAST(records_failed AS VARCHAR) AS observed_value FROM (SELECT 'again' AS run_id, * FROM second UNION ALL SELECT 'once', * FROM first)
JOIN (VALUES ('duplicate_business_key', 'FAIL'), {', '.join(f"('{rule}', '{worst}')" for rule, (worst, _) in _DEMAND_RULES.items())}) w(rule_id, worst) USING (rule_id)""")
def dq_results_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two runs; the second is evaluated twice, the later time over fewer rows, and its rows are replaced."""
    rows, store = _typed(spark, sf_dir), quality.results_table(spark, _folder(spark, "results"))
    for run, seen in (("once", rows), ("again", rows), ("again", rows.filter(F.col("k") % 5 != 0))):
        store.merge(quality.result_rows(spark, quality.evaluate(seen, DEMAND), run, DEMAND))
    return store.read().select("run_id", "rule_id", "severity", "records_checked", "records_failed", "observed_value")


@query(f"WITH {_TYPED} {_rules_sql('typed', _DEMAND_RULES, None)}")
def dq_rules_with_the_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the demand contract, counted while its rows are written."""
    rows, results = quality.observed(_typed(spark, sf_dir), DEMAND)
    rows.write.parquet(f"{_folder(spark, 'observed')}/rows")
    return _said(results())


# -- records with line breaks in quotes


@query("""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) AS _source_row_number, sha256(t) AS text_sha256, length(t) AS n_chars, len(string_split(t, chr(10))) AS n_lines FROM (SELECT doc_id, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents)""")
def csv_quoted_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as quoted fields of three files below a preamble, read by blocks and records."""
    text = F.coalesce(F.col("text"), F.lit(""))
    body = table(spark, sf_dir, "documents").select((F.col("doc_id") % 3).alias("payload"), F.lit(0).alias("part"), F.col("doc_id").alias("at"), F.concat(F.col("doc_id").cast("string"), F.lit(',"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')).alias("line"))
    head = [(-1, 0, 'It says "hello'), (-1, 1, "Id,Text")]
    fixed = body.select("payload").distinct().withColumn("e", F.explode(F.array(*[F.struct(F.lit(part).alias("part"), F.lit(k).cast("long").alias("at"), F.lit(x).alias("line")) for part, k, x in head]))).select("payload", "e.*")
    rows = delimited.read_after_header(spark, _written(body.unionByName(fixed), "payload", ["part", "at"], _folder(spark, "quoted")), {"Id": "doc_id", "Text": "text"}, quoted=True, parts=True)
    said = F.coalesce("text", F.lit(""))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "_source_row_number", F.sha2(said, 256).alias("text_sha256"), F.length(said).cast("long").alias("n_chars"), F.size(F.split(said, "\n")).cast("long").alias("n_lines"))


@query("""
WITH p AS (SELECT l_orderkey % 4 AS payload, count(*) AS n, count_if(l_linenumber <> 3) AS m FROM lineitem GROUP BY 1), c AS (
  SELECT payload, unnest(['Document', 'Document/DocHeader', 'Document/DocHeader/CreatedAt', 'Document/DocBody']) AS path, 1 AS n FROM p
  UNION ALL SELECT payload, unnest(['', '/Day', '/HourlyData', '/HourlyData/Hour', '/HourlyData/FuelTotal', '/HourlyData/FuelTotal/Fuel', '/HourlyData/FuelTotal/EnergyValue', '/HourlyData/FuelTotal/EnergyValue/OutputQuality']), n FROM p
  UNION ALL SELECT payload, '/HourlyData/FuelTotal/EnergyValue/Output', m FROM p)
SELECT payload, CASE WHEN path LIKE 'Document%' THEN path ELSE 'Document/DocBody/DailyData' || path END AS path, CAST(n AS BIGINT) AS n FROM c""")
def xml_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by path, from blocks of the files."""
    found = documents.path_counts(spark, _generation_files(spark, sf_dir), parts=True)
    return found.select(F.regexp_extract("file", r"payload=(\d+)", 1).cast("long").alias("payload"), "path", "n")
