"""The engine's queries over the driver's tables, and the SQL that says the same.

The tables stand in for market data: events are a revisable series (a key of user and day, slots of five minutes),
orders and lineitems are two sources of one measure, customers and parts are what lookups go to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import audit
from halyard.functions.identity import canonical_decimal, canonical_text, event_id, observation_hash
from halyard.operators import series, serving
from halyard.plans.evidence import evidence_state
from halyard.plans.store import VersionedTable, read_increment, reconcile
from halyard.session import scratch_folder, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _round(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def _day(c: str) -> Column:
    return F.to_date(F.col(c))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each slot, its value around zero."""
    rows = _events(spark, sf_dir).select(series.slot_of_timestamp(F.col("ts")).alias("slot"), "ts", "event_id", (F.col("value") - 250).alias("value"))
    return series.latest_by(rows, ["slot"], ["ts", "event_id"]).select("slot", "value")


_SLOTS = """slots AS (
  SELECT slot, value FROM (
    SELECT epoch_us(ts) // 300000000 AS slot, value - 250 AS value,
           row_number() OVER (PARTITION BY epoch_us(ts) // 300000000 ORDER BY ts DESC, event_id DESC) AS rn FROM events)
  WHERE rn = 1)"""


# -- state, change, windows


@query("""
SELECT user_id, day, event_id, event_type, value FROM (
  SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id, event_type, round(value, 6) AS value,
         row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1 AND event_type <> 'error'""")
def series_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", _day("ts").cast("string").alias("day"), "event_id", "event_type", "value", "ts")
    current = series.current_state(rows, ["user_id", "day"], ["ts", "event_id"], F.col("event_type") != "error")
    return _round(current.drop("ts"), ["value"])


@query(f"""
WITH {_SLOTS}, lagged AS (
  SELECT slot, value, lag(slot) OVER (ORDER BY slot) AS previous_slot, lag(value) OVER (ORDER BY slot) AS previous_value FROM slots)
SELECT slot, round(value, 6) AS value, previous_slot, round(previous_value, 6) AS previous_value, slot - previous_slot AS slot_gap,
       CASE WHEN slot - previous_slot = 1 THEN round(value - previous_value, 6) END AS change FROM lagged""")
def series_gap_safe_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(series.gap_safe_change(_slots(spark, sf_dir), "slot", "value"), ["value", "previous_value", "change"])


def _rolling_sql(columns: str) -> str:
    parts, frames = [], []
    for minutes, n in series.WINDOWS.items():
        w, whole = f"w{minutes}", f"count(value) OVER w{minutes} = {n}"
        frames.append(f"{w} AS (ORDER BY slot RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")
        negative = f"sum(CASE WHEN value < 0 THEN 1 ELSE 0 END) OVER {w}"
        parts += [
            f"count(value) OVER {w} AS r{minutes}_count", f"{whole} AS r{minutes}_complete",
            *[f"CASE WHEN {whole} THEN round({f}(value) OVER {w}, 6) END AS r{minutes}_{c}" for f, c in (("avg", "avg"), ("min", "min"), ("max", "max"), ("stddev_samp", "stddev"))],
            f"CASE WHEN {whole} THEN CAST({negative} AS BIGINT) END AS r{minutes}_negative_count", f"CASE WHEN {whole} THEN round({negative} / {n}.0, 6) END AS r{minutes}_negative_share",
        ]
    return f"SELECT {columns}, {', '.join(parts)} FROM slots WINDOW {', '.join(frames)}"


_ROLLED = [f"r{m}_{c}" for m in series.WINDOWS for c in ("avg", "min", "max", "stddev", "negative_share")]


@query(f"WITH {_SLOTS} {_rolling_sql('slot, round(value, 6) AS value')}")
def series_rolling_15_30_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(series.rolling(_slots(spark, sf_dir), "slot", "value"), ["value", *_ROLLED])


@query(f"""
WITH {_SLOTS}, rolled AS ({_rolling_sql('slot, value')}),
lagged AS (SELECT slot, value, lag(slot) OVER (ORDER BY slot) AS p, lag(value) OVER (ORDER BY slot) AS v FROM slots)
SELECT l.slot, round(l.value, 6) AS value, l.slot - p AS slot_gap, CASE WHEN l.slot - p = 1 THEN round(l.value - v, 6) END AS change,
       l.value < 0 AS is_negative, r15_complete, r15_avg, r30_complete, r30_avg, r60_complete, r60_avg, r60_stddev, r60_negative_share
FROM lagged l JOIN rolled r ON l.slot = r.slot""")
def series_market_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.market_metrics(_slots(spark, sf_dir), "slot", "value")
    kept = ["slot", "value", "slot_gap", "change", "is_negative", "r15_complete", "r15_avg", "r30_complete", "r30_avg", "r60_complete", "r60_avg", "r60_stddev", "r60_negative_share"]
    return _round(out.select(*kept), ["value", "change", "r15_avg", "r30_avg", "r60_avg", "r60_stddev", "r60_negative_share"])


@query(f"""
WITH {_SLOTS}, specs AS (SELECT * FROM (VALUES (15, 3), (30, 6), (60, 12)) AS v(window_minutes, expected_slots)),
wanted AS (SELECT slot, window_minutes, expected_slots, slot - unnest(range(expected_slots)) AS s FROM slots, specs)
SELECT w.slot, window_minutes, expected_slots, count(v.value) AS present_slots, count(v.value) = expected_slots AS window_complete,
       CASE WHEN count(v.value) = expected_slots THEN round(avg(v.value), 6) END AS rolling_avg
FROM wanted w LEFT JOIN slots v ON v.slot = w.s GROUP BY w.slot, window_minutes, expected_slots""")
def series_rolling_by_expected_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(series.rolling_long(_slots(spark, sf_dir), "slot", "value"), ["rolling_avg"])


# -- deliveries and events


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once, and clicks again without their value."""
    first = _events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value", "props", F.lit(1).alias("delivery"))
    again = first.filter("event_type = 'click'").withColumn("value", F.lit(None).cast("double")).withColumn("delivery", F.lit(2))
    return first.unionByName(again)


_DELIVERIES = """deliveries AS (
  SELECT event_id, ts, user_id, event_type, value, props, 1 AS delivery FROM events
  UNION ALL SELECT event_id, ts, user_id, event_type, NULL, props, 2 FROM events WHERE event_type = 'click')"""


@query(f"""
WITH {_DELIVERIES}
SELECT event_id, user_id, event_type, value, delivery FROM (
  SELECT event_id, user_id, event_type, round(value, 6) AS value, delivery, row_number() OVER (PARTITION BY event_id ORDER BY
    (CASE WHEN ts IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN user_id IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END
     + CASE WHEN event_type IS NOT NULL AND event_type <> '' THEN 1 ELSE 0 END + CASE WHEN props IS NOT NULL AND props <> '' THEN 1 ELSE 0 END) DESC, delivery DESC) AS rn
  FROM deliveries) WHERE rn = 1""")
def event_dedup_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = series.dedup_deliveries(_deliveries(spark, sf_dir), "event_id", ["ts", "user_id", "value", "event_type", "props"], ["delivery"])
    return _round(best.select("event_id", "user_id", "event_type", "value", "delivery"), ["value"])


def _log(df: DataFrame) -> DataFrame:
    error = F.col("event_type") == "error"
    return df.select(
        "event_id", F.when(error, series.INVALIDATION).otherwise(series.OBSERVATION).alias("event_type"),
        F.when(error & (F.col("event_id") % 5 != 0), series.INVALIDATED).otherwise(series.ELIGIBLE).alias("publication_state"),
        F.col("value").alias("zonal_price"), F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.col("user_id").cast("string")).alias("source_hash"),
        F.when(error & (F.col("event_id") % 2 == 0), F.col("event_id").cast("string")).alias("previous_event_id"), "delivery",
    )


@query(f"""
WITH {_DELIVERIES}, log AS (
  SELECT event_id, CASE WHEN event_type = 'error' THEN 'RT_PRICE_INVALIDATION' ELSE 'RT_PRICE_OBSERVATION' END AS event_type,
         CASE WHEN event_type = 'error' AND event_id % 5 <> 0 THEN 'INVALIDATED' ELSE 'ELIGIBLE' END AS publication_state, value AS zonal_price,
         CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS source_hash,
         CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) END AS previous_event_id, delivery FROM deliveries),
logical AS (SELECT * FROM log WHERE delivery = 1),
metrics AS (
  SELECT 'RT-DQ-001' AS rule_id, 'technical_duplicates' AS rule_name, 'WARN' AS criticality, (SELECT count(*) - count(DISTINCT event_id) FROM log) AS metric
  UNION ALL SELECT 'RT-DQ-002', 'physical_missing_core', 'WARN', (SELECT count(*) FROM log WHERE coalesce(source_hash, '') = '')
  UNION ALL SELECT 'RT-DQ-003', 'logical_missing_core', 'FAIL', (SELECT count(*) FROM logical WHERE coalesce(source_hash, '') = '')
  UNION ALL SELECT 'RT-DQ-004', 'invalid_type_state_pair', 'FAIL', (SELECT count(*) FROM logical WHERE NOT ((event_type = 'RT_PRICE_OBSERVATION' AND publication_state = 'ELIGIBLE') OR (event_type = 'RT_PRICE_INVALIDATION' AND publication_state = 'INVALIDATED')))
  UNION ALL SELECT 'RT-DQ-005', 'observation_missing_price', 'FAIL', (SELECT count(*) FROM logical WHERE event_type = 'RT_PRICE_OBSERVATION' AND zonal_price IS NULL)
  UNION ALL SELECT 'RT-DQ-006', 'invalidation_without_previous', 'FAIL', (SELECT count(*) FROM logical WHERE event_type = 'RT_PRICE_INVALIDATION' AND coalesce(previous_event_id, '') = ''))
SELECT rule_id, rule_name, criticality, CAST(metric AS BIGINT) AS metric, CASE WHEN metric = 0 THEN 'PASS' ELSE criticality END AS outcome FROM metrics""")
def rt_dq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(_deliveries(spark, sf_dir))
    # A delivery without its value is the less complete one, so the first of each event is the logical one.
    return series.event_rules(log, series.dedup_deliveries(log, "event_id", ["zonal_price"], []), ["event_id", "source_hash"], ["zonal_price"])


@query("""
WITH latest AS (
  SELECT user_id, event_id, event_type, value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1),
published AS (
  SELECT user_id, CAST(event_id AS VARCHAR) AS event_id, CAST(floor(value) AS BIGINT) AS h, CASE WHEN event_type = 'error' THEN 'INVALIDATED' ELSE 'ELIGIBLE' END AS state
  FROM latest WHERE event_type <> 'view'),
incoming AS (SELECT user_id, CAST(floor(value) AS BIGINT) + CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS h, value >= 20 AS eligible FROM latest)
SELECT i.user_id, CAST(i.h AS VARCHAR) AS observation_hash, i.eligible, p.event_id AS previous_event_id,
       CASE WHEN NOT i.eligible AND p.state = 'ELIGIBLE' THEN 'INVALIDATION' WHEN NOT i.eligible THEN 'SUPPRESSED_INELIGIBLE'
            WHEN p.state = 'ELIGIBLE' AND i.h = p.h THEN 'UNCHANGED' WHEN p.state = 'ELIGIBLE' THEN 'REVISED_OBSERVATION' ELSE 'NEW_OBSERVATION' END AS decision
FROM incoming i LEFT JOIN published p ON i.user_id = p.user_id""")
def revision_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = series.latest_by(_events(spark, sf_dir).select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"])
    whole = F.floor("value").cast("long")
    published = latest.filter("event_type <> 'view'").select("user_id", F.col("event_id").cast("string").alias("event_id"), whole.cast("string").alias("observation_hash"), F.when(F.col("event_type") == "error", series.INVALIDATED).otherwise(series.ELIGIBLE).alias("publication_state"))
    incoming = latest.select("user_id", (whole + F.when(F.col("event_type") == "signup", 1).otherwise(0)).cast("string").alias("observation_hash"), (F.col("value") >= 20).alias("eligible"))
    return series.revision_decisions(incoming, published, ["user_id"])


@query("""
SELECT event_id, sha256('event_v1|' || CAST(user_id AS VARCHAR) || '|' || event_type || '|' || CASE WHEN event_id % 9 = 0 THEN '<NULL>' ELSE CAST(event_id AS VARCHAR) END) AS identity
FROM events""")
def event_identity_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.col("user_id"), F.col("event_type"), F.when(F.col("event_id") % 9 != 0, F.col("event_id"))]
    return _events(spark, sf_dir).select("event_id", event_id("event_v1", parts).alias("identity"))


@query("""
WITH p AS (SELECT event_id, CAST(user_id AS INT) AS hour, event_type, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(round(value * 1000) AS BIGINT) END AS mills FROM events)
SELECT event_id, sha256('{"delivery_hour":' || hour || ',"source_flag":"' || CASE WHEN event_type = 'view' THEN '<NULL>' ELSE event_type END || '","zonal_price":"' ||
         CASE WHEN mills IS NULL THEN '<NULL>' ELSE (mills // 1000) || CASE WHEN mills % 1000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(mills % 1000 AS VARCHAR), 3, '0'), '0') END END || '"}') AS observation_hash
FROM p""")
def observation_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("event_id") % 9 != 0, (F.round(F.col("value") * 1000).cast("decimal(18,0)") / F.lit(1000)).cast("decimal(18,3)"))
    flag = F.when(F.col("event_type") != "view", F.col("event_type"))
    fields = {"zonal_price": canonical_decimal(price), "delivery_hour": F.col("user_id").cast("int"), "source_flag": canonical_text(flag)}
    return _events(spark, sf_dir).select("event_id", observation_hash(fields).alias("observation_hash"))


# -- audits


@query("""
SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_keys, count(*) FILTER (WHERE n > 1) AS duplicate_keys,
       CAST(sum(n - 1) AS BIGINT) AS excess_rows, CAST(0 AS BIGINT) AS null_keys
FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)""")
def duplicate_key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.key_audit(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
SELECT count(*) AS rows, count(*) FILTER (WHERE c_acctbal < 0) AS c_acctbal_negative, count(*) FILTER (WHERE c_acctbal = 0) AS c_acctbal_zero,
       count(*) FILTER (WHERE c_acctbal IS NULL) AS c_acctbal_nulls, count(*) FILTER (WHERE c_name IS NULL) AS c_name_nulls FROM customer""")
def null_and_negative_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return customer.agg(F.count(F.lit(1)).alias("rows"), *audit.sign_counts(customer, "c_acctbal"), F.count_if(F.col("c_name").isNull()).alias("c_name_nulls"))


@query("""
SELECT o_orderstatus, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_day, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_day,
       count(DISTINCT CAST(o_orderdate AS DATE)) AS days, count(*) AS rows, date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) + 1 AS days_spanned
FROM orders GROUP BY 1""")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.coverage(table(spark, sf_dir, "orders"), _day("o_orderdate"), ["o_orderstatus"])
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")}).withColumn("days_spanned", F.col("days_spanned").cast("long"))


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS rows FROM events GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, rows, day = (SELECT max(day) FROM d) AS is_latest,
       CASE WHEN rows = 288 THEN 'COMPLETE' WHEN day = (SELECT max(day) FROM d) THEN 'LATEST_PARTIAL' ELSE 'INCOMPLETE' END AS state FROM d""")
def day_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.completeness(_events(spark, sf_dir), _day("ts"), 288).withColumn("day", F.col("day").cast("string"))


@query("""
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'),
span AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT CAST(day AS VARCHAR) AS missing_day FROM span WHERE day NOT IN (SELECT day FROM d)""")
def calendar_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' and o_orderpriority = '5-LOW'")
    return audit.calendar_gaps(rows, _day("o_orderdate")).select(F.col("missing_day").cast("string").alias("missing_day"))


@query("""
WITH l AS (SELECT DISTINCT o_orderkey AS k FROM orders), r AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
SELECT (SELECT count(*) FROM l) AS left_keys, (SELECT count(*) FROM r) AS right_keys, (SELECT count(*) FROM l JOIN r ON l.k = r.k) AS shared_keys,
       (SELECT count(*) FROM l WHERE k NOT IN (SELECT k FROM r)) AS left_only, (SELECT count(*) FROM r WHERE k NOT IN (SELECT k FROM l)) AS right_only""")
def coverage_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    return audit.coverage_intersection(orders, lines, ["k"])


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.missing_keys(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT multiplicity, count(*) AS n_keys FROM (SELECT l_orderkey, count(*) AS multiplicity FROM lineitem GROUP BY 1) GROUP BY 1")
def grain_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.grain_multiplicity(table(spark, sf_dir, "lineitem"), ["l_orderkey"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.distribution(_events(spark, sf_dir), ["event_type"])


@query("SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 10")
def largest_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(audit.top_by_magnitude(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", ["c_custkey"], 10), ["c_acctbal"], 2)


@query("""
SELECT 'p_brand' AS column_name, count(*) AS n_rows, count(*) - count(p_brand) AS n_nulls, count(DISTINCT p_brand) AS n_distinct, min(p_brand) AS min_value, max(p_brand) AS max_value FROM part
UNION ALL SELECT 'p_size', count(*), count(*) - count(p_size), count(DISTINCT p_size), CAST(min(p_size) AS VARCHAR), CAST(max(p_size) AS VARCHAR) FROM part
UNION ALL SELECT 'p_type', count(*), count(*) - count(p_type), count(DISTINCT p_type), min(p_type), max(p_type) FROM part""")
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.profile(table(spark, sf_dir, "part"), ["p_brand", "p_size", "p_type"])


# -- serving


@query("""
WITH o AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderkey, CAST(floor(o_totalprice / 50000) AS BIGINT) AS measure FROM orders)
SELECT o.day, o_orderkey, measure FROM o JOIN (SELECT day, max(measure) AS top FROM o GROUP BY 1) t ON o.day = t.day AND o.measure = t.top""")
def daily_peak_all_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(_day("o_orderdate").cast("string").alias("day"), "o_orderkey", F.floor(F.col("o_totalprice") / 50000).alias("measure"))
    return series.peak_with_ties(rows, ["day"], "measure").select("day", "o_orderkey", "measure")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def lookup_optional_omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.lookup(table(spark, sf_dir, "orders"), {"o_orderstatus": "F"}, {"o_orderpriority": None}).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def lookup_optional_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.lookup(table(spark, sf_dir, "orders"), {"o_orderstatus": "F"}, {"o_orderpriority": "1-URGENT"}).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE false")
def lookup_required_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.lookup(table(spark, sf_dir, "orders"), {"o_orderstatus": None}).select("o_orderkey")


@query("SELECT p_partkey, p_type FROM part WHERE upper(trim(p_type)) = (SELECT upper(trim(min(p_type))) FROM part)")
def lookup_trim_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    asked = part.agg(F.min("p_type")).first()[0]  # one value, as a caller would give it
    return serving.lookup(part, {}, loosely={"p_type": f"  {asked.lower()} " if asked else None}).select("p_partkey", "p_type")


@query("""
WITH l AS (SELECT l_orderkey, CAST(round(sum(l_extendedprice), 2) AS DECIMAL(18,2)) AS v FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1),
o AS (SELECT o_orderkey, CAST(CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE round(o_totalprice, 2) END AS DECIMAL(18,2)) AS v FROM orders WHERE o_orderstatus <> 'P'),
k AS (SELECT o_orderkey AS k FROM orders)
SELECT k.k AS o_orderkey, CAST(o.v AS DOUBLE) AS left_price, CAST(l.v AS DOUBLE) AS right_price, CAST(l.v - o.v AS DOUBLE) AS delta_price,
       CASE WHEN o.o_orderkey IS NULL AND l.l_orderkey IS NULL THEN 'MISSING_BOTH' WHEN o.o_orderkey IS NULL THEN 'MISSING_DAY_AHEAD' WHEN l.l_orderkey IS NULL THEN 'MISSING_REALTIME'
            WHEN o.v IS NULL OR l.v IS NULL THEN 'INCOMPLETE_PRICE_COMPONENTS' ELSE 'COMPARABLE' END AS comparison_state
FROM k LEFT JOIN o ON k.k = o.o_orderkey LEFT JOIN l ON k.k = l.l_orderkey""")
def compare_state_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).cast("decimal(18,2)").alias("v"))
    orders = table(spark, sf_dir, "orders")
    left = orders.filter("o_orderstatus <> 'P'").select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.round("o_totalprice", 2)).cast("decimal(18,2)").alias("v"))
    out = serving.compared(orders.select("o_orderkey"), left, lines, ["o_orderkey"], ["o_orderkey"], {"price": ("v", "v")})
    return out.select("o_orderkey", *[F.col(c).cast("double").alias(c) for c in ("left_price", "right_price", "delta_price")], "comparison_state")


# -- reshape and reconciliation


@query("""
SELECT l_orderkey, l_linenumber, 'l_discount' AS measure, round(l_discount, 6) AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_quantity', CASE WHEN l_linenumber = 3 THEN NULL ELSE round(l_quantity, 6) END FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', round(l_tax, 6) FROM lineitem""")
def unpivot_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("l_quantity"), "l_tax")
    return _round(series.unpivoted(lines, ["l_orderkey", "l_linenumber"], ["l_discount", "l_quantity", "l_tax"], "measure", "value"), ["value"])


@query("""
WITH l AS (SELECT l_orderkey AS k, CAST(floor(sum(l_extendedprice) / 100000) AS BIGINT) AS b FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice / 100000) AS BIGINT) AS a FROM orders)
SELECT o.k, a, b, a - b AS difference, CASE WHEN a - b <> 0 THEN 'WARN' ELSE 'PASS' END AS outcome FROM o JOIN l ON o.k = l.k""")
def cross_source_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.floor(F.sum("l_extendedprice") / 100000).alias("b"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.floor(F.col("o_totalprice") / 100000).alias("a"))
    return series.reconciled(orders, lines, ["k"], "a", "b")


# -- versioned tables


def _store(spark: SparkSession, name: str, keys: list[str]) -> VersionedTable:
    """A table of its own below the folder that all executors share."""
    return VersionedTable(spark, f"{scratch_folder(spark)}/{name}", keys)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))


def _revised(spark: SparkSession, sf_dir: str) -> tuple[VersionedTable, DataFrame]:
    """The orders that are not pending, merged with a payload of all but the urgent ones in which high ones are revised; and that payload."""
    orders = _orders(spark, sf_dir)
    store = _store(spark, "orders", ["o_orderkey"])
    store.create(orders.filter("o_orderstatus <> 'P'"))
    payload = orders.filter("o_orderpriority <> '1-URGENT' or o_orderstatus = 'P'").withColumn("price", F.when(F.col("o_orderpriority") == "2-HIGH", F.col("price") + 1).otherwise(F.col("price")).cast("decimal(18,2)"))
    store.merge(payload)
    return store, payload


_REVISED = "CASE WHEN o_orderpriority = '2-HIGH' THEN CAST(o_totalprice AS DECIMAL(18,2)) + 1 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END"


@query(f"SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST({_REVISED} AS DOUBLE) AS price FROM orders")
def merge_upsert_change_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _revised(spark, sf_dir)[0].read().withColumn("price", F.col("price").cast("double"))


@query("""
WITH p AS (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_orderstatus = 'P')
SELECT _change_type, count(*) AS n FROM (
  SELECT 'insert' AS _change_type FROM p WHERE o_orderstatus = 'P'
  UNION ALL SELECT unnest(['update_preimage', 'update_postimage']) FROM p WHERE o_orderstatus <> 'P' AND o_orderpriority = '2-HIGH') GROUP BY 1""")
def merge_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _revised(spark, sf_dir)
    return store.changes(0).groupBy("_change_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '2-HIGH'")
def cdf_changed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _revised(spark, sf_dir)
    return read_increment(store, 0)[1].select("o_orderkey")


@query("SELECT (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM orders) AS target_rows, CAST(0 AS BIGINT) AS missing_from_target, CAST(0 AS BIGINT) AS unexpected_in_target, CAST(0 AS BIGINT) AS duplicate_keys, true AS repeat_made_no_version")
def merge_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, payload = _revised(spark, sf_dir)
    before = store.version()
    again = store.merge(payload)  # idempotent
    expected = _orders(spark, sf_dir).withColumn("price", F.when(F.col("o_orderpriority") == "2-HIGH", F.col("price") + 1).otherwise(F.col("price")).cast("decimal(18,2)"))
    return reconcile(expected, store.read(), ["o_orderkey", "o_orderstatus", "o_orderpriority", "price"], ["o_orderkey"]).withColumn("repeat_made_no_version", F.lit(again == before))


# -- others


@query("""
SELECT event_type, event_id, user_id FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.latest_per_group(_events(spark, sf_dir), ["event_type"], ["ts", "event_id"]).select("event_type", "event_id", "user_id")


@query("""
WITH f AS (
  SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT hour(ts)) AS hours, count(*) FILTER (WHERE event_type <> 'error') AS usable,
         count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1, 2)
SELECT user_id, day, hours, CASE WHEN usable = 0 THEN 'INSUFFICIENT' WHEN errors > usable THEN 'BLOCKED_BY_DQ' WHEN hours < 3 THEN 'PARTIAL' ELSE 'SUFFICIENT' END AS evidence_state FROM f""")
def evidence_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _events(spark, sf_dir).groupBy("user_id", _day("ts").cast("string").alias("day")).agg(F.count_distinct(F.hour("ts")).alias("hours"), F.count_if(F.col("event_type") != "error").alias("usable"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return facts.select("user_id", "day", "hours", evidence_state(F.lit(True), F.col("usable") > 0, F.col("errors") > F.col("usable"), F.col("hours") >= 3).alias("evidence_state"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""
SELECT state, count(*) AS n FROM (
  SELECT CASE WHEN a + b + c = 3 THEN 'FULLY_POPULATED' WHEN a + b + c = 0 THEN 'FULLY_EMPTY' ELSE 'PARTIALLY_POPULATED' END AS state FROM (
    SELECT CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS a, CASE WHEN event_id % 4 < 3 THEN 1 ELSE 0 END AS b, CASE WHEN event_id % 4 < 3 THEN 1 ELSE 0 END AS c FROM events)) GROUP BY 1""")
def population_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 4 < 3, F.col("value")).alias("b"), F.when(F.col("event_id") % 4 < 3, F.col("value")).alias("c"))
    return rows.select(series.population_state(["a", "b", "c"]).alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT n_name, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def demand_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    grouped = placed.groupBy("n_name", _day("o_orderdate").cast("string").alias("day"))
    return grouped.agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("""
WITH d AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY CAST(o_orderdate AS DATE)) AS top FROM orders)
SELECT day, o_orderkey, l_returnflag, count(*) AS lines, CAST(sum(CAST(l_quantity AS DECIMAL(18,3))) AS DOUBLE) AS quantity
FROM d JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice = top GROUP BY 1, 2, 3""")
def mix_at_daily_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(_day("o_orderdate").cast("string").alias("day"), "o_orderkey", "o_totalprice")
    peaks = series.peak_with_ties(orders, ["day"], "o_totalprice").select("day", "o_orderkey")
    mix = peaks.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("day", "o_orderkey", "l_returnflag")
    return mix.agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("decimal(18,3)")).cast("double").alias("quantity"))
