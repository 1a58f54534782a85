"""The real-time price functions over the event log: logical events, current state, change, windows, metrics, rules.

Each function takes the log as it was delivered (or what another of them gives); all of them keep the log's column names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.operators import series
from halyard.plans.contracts import PRICES

KEY = ["delivery_date", "delivery_hour", "interval"]
#: The fields whose presence makes a delivery complete, and those that no event may lack.
SCORED = [
    "event_schema_version", "event_type", "event_id", "observation_hash", *KEY, *PRICES, "publication_state", "source_name", "source_file", "source_url", "source_hash",
    "bronze_first_seen_at_utc", "publisher_run_id", "poll_id", "event_created_at_utc",
]
CORE = ["event_id", "event_type", *KEY, "source_hash", "event_created_at_utc"]
LINEAGE = ["event_id", "source_hash", "event_created_at_utc"]
#: What the rules on a log are called.
RULES = {
    "RT-DQ-001": "Technical duplicate deliveries", "RT-DQ-002": "Physical deliveries missing core fields", "RT-DQ-003": "Logical events missing core fields", "RT-DQ-004": "Invalid event type and publication-state combination",
    "RT-DQ-005": "Published observations missing price components", "RT-DQ-006": "Invalidations missing previous event lineage",
}
#: Statistics of a window, under the names they have in its rows and as columns of the metrics.
STATISTICS = {"rolling_avg": "rolling_{}_avg", "rolling_min": "rolling_{}_min", "rolling_max": "rolling_{}_max", "rolling_stddev": "rolling_{}_stddev", "negative_price_count": "negative_{}_count", "negative_price_share": "negative_{}_share"}
_OF = {"rolling_avg": "avg", "rolling_min": "min", "rolling_max": "max", "rolling_stddev": "stddev", "negative_price_count": "negative_count", "negative_price_share": "negative_share"}


def price_event_dedup(log: DataFrame) -> DataFrame:
    """One row an event: its most complete delivery; of equally complete ones the one whose fields have the largest hash."""
    tie = F.xxhash64(*[F.col(c).cast("string") for c in log.columns])
    return series.dedup_deliveries(log.withColumn("_tie", tie), "event_id", [c for c in SCORED if c in log.columns], ["_tie"]).drop("_tie")


def _counted(log: DataFrame) -> DataFrame:
    """price_event_dedup with _n, an event's deliveries, and _m, those of them without a core field: the log is read once."""
    counts = {"_n": F.count(F.lit(1)), "_m": F.count_if(series.missing_any(CORE))}
    tie = F.xxhash64(*[F.col(c).cast("string") for c in log.columns])
    return series.counted_deliveries(log.withColumn("_tie", tie), "event_id", [c for c in SCORED if c in log.columns], ["_tie"], counts)


def price_current(log: DataFrame) -> DataFrame:
    """The latest logical event of each key, if it is eligible."""
    return series.current_state(price_event_dedup(log), KEY, ["event_created_at_utc", "event_id"], F.col("publication_state") == series.ELIGIBLE)


def slots(current: DataFrame) -> DataFrame:
    """The columns that the series functions read: slot and price, and those that stay."""
    slot = series.slot_of_parts(F.to_date("delivery_date"), F.col("delivery_hour"), F.col("interval"))
    return current.select("delivery_date", "delivery_hour", F.col("interval").alias("interval_no"), slot.alias("slot"), F.col(PRICES[0]).cast("double").alias("price"), *LINEAGE)


def price_change(log: DataFrame) -> DataFrame:
    """Each current price with the one before it; the change is null unless the slots are adjacent."""
    changed = series.gap_safe_change(slots(price_current(log)), "slot", "price")
    return changed.select(*_change_columns(), *LINEAGE)


def _change_columns() -> list[str | Column]:
    return ["delivery_date", "delivery_hour", "interval_no", "price", F.col("previous_value").alias("previous_price"), "slot_gap", F.col("change").alias("interval_price_change"), (F.col("price") < 0).alias("is_negative_price")]


def price_rolling(log: DataFrame) -> DataFrame:
    """A row for each current price and window of 15, 30 and 60 minutes; statistics are null unless all slots have a price."""
    wide = series.rolling(slots(price_current(log)), "slot", "price")
    windows = [F.struct(F.lit(m).alias("window_minutes"), F.lit(n).alias("expected_slots"), F.col(f"r{m}_count").alias("matched_slots"), F.col(f"r{m}_complete").alias("window_complete"), *[F.col(f"r{m}_{x}").alias(c) for c, x in _OF.items()]) for m, n in series.WINDOWS.items()]
    return wide.select("delivery_date", "delivery_hour", "interval_no", F.explode(F.array(*windows)).alias("w"), *LINEAGE).select("delivery_date", "delivery_hour", "interval_no", "w.*", *LINEAGE)


def price_market_metrics(log: DataFrame) -> DataFrame:
    """Change and all windows of each current price, 32 columns."""
    return metrics_of(slots(price_current(log)))


def metrics_of(rows: DataFrame) -> DataFrame:
    """Change and all windows of rows as slots() gives them; change is computed on the rows that the windows need, without a join."""
    changed = series.gap_safe_change(rows, "slot", "price")
    wide = series.rolling(changed, "slot", "price")
    windows = [x for m in series.WINDOWS for x in (F.col(f"r{m}_complete").alias(f"rolling_{m}_complete"), *[F.col(f"r{m}_{_OF[c]}").alias(name.format(m)) for c, name in STATISTICS.items()])]
    return wide.select(*_change_columns(), *windows, *LINEAGE)


def dq_summary(log: DataFrame, at: Column | None = None) -> DataFrame:
    """(rule_id, rule_name, severity, status, metric_value, evaluated_at_utc): the six rules on a log; severity is what status is when a rule counts anything."""
    rules = series.counted_rules(_counted(log), CORE, list(PRICES), "_n", "_m")
    named = F.create_map(*[F.lit(x) for pair in RULES.items() for x in pair])
    return rules.select("rule_id", named[F.col("rule_id")].alias("rule_name"), F.col("criticality").alias("severity"), F.col("outcome").alias("status"), F.col("metric").alias("metric_value"), (F.current_timestamp() if at is None else at).alias("evaluated_at_utc"))


def metric_union(log: DataFrame) -> DataFrame:
    """(metric, value): physical rows, logical events, ids delivered more than once, logical rows lacking core fields, current rows."""
    events = _counted(log)  # one aggregate of the log, for all of them
    of_events = events.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("physical_rows"), F.count(F.lit(1)).alias("logical_events"), F.count_if(F.col("_n") > 1).alias("duplicate_event_ids"), F.count_if(series.missing_any(CORE)).alias("logical_rows_missing_core_fields"))
    current = series.current_state(events, KEY, ["event_created_at_utc", "event_id"], F.col("publication_state") == series.ELIGIBLE).agg(F.count(F.lit(1)).alias("current_eligible_rows"))
    row = of_events.crossJoin(F.broadcast(current))  # a row each
    return row.unpivot([], row.columns, "metric", "value")


def key_states(log: DataFrame) -> DataFrame:
    """One row: latest_business_keys, latest_eligible, latest_invalidated."""
    latest = series.latest_by(price_event_dedup(log), KEY, ["event_created_at_utc", "event_id"])
    state = F.col("publication_state")
    return latest.agg(F.count(F.lit(1)).alias("latest_business_keys"), F.count_if(state == series.ELIGIBLE).alias("latest_eligible"), F.count_if(state == series.INVALIDATED).alias("latest_invalidated"))


def checks_by_source(log: DataFrame) -> DataFrame:
    """(check, value, source_hash): rows, logical events, distinct ids, and logical events by source."""
    logical = _counted(log)
    totals = logical.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("PHYSICAL_ROWS"), F.count(F.lit(1)).alias("LOGICAL_EVENTS"), F.count_distinct("event_id").alias("DISTINCT_EVENT_IDS"))
    by_source = logical.groupBy(F.coalesce("source_hash", F.lit("")).alias("source_hash")).agg(F.count(F.lit(1)).alias("value"))
    return totals.unpivot([], totals.columns, "check", "value").withColumn("source_hash", F.lit("")).unionByName(by_source.withColumn("check", F.lit("EVENTS_BY_SOURCE_HASH")))


def of_event(log: DataFrame, event: str) -> DataFrame:
    """The logical event of an id."""
    return price_event_dedup(log.filter(F.col("event_id") == event))


def large_moves(changes: DataFrame, least: float, demand: DataFrame, generation: DataFrame) -> DataFrame:
    """Price changes of at least so much, with the hour's demand and its generation in all: a row a move, as both are summed up to the hour first."""
    hours = generation.groupBy("market_date", "hour_ending").agg(F.sum("output_mwh").alias("generation_mwh"), F.count(F.lit(1)).alias("fuel_types"))
    moves = changes.filter(F.abs("interval_price_change") >= least).select(F.to_date("delivery_date").alias("market_date"), F.col("delivery_hour").alias("hour_ending"), "interval_no", "price", "interval_price_change")
    context = demand.select("market_date", "hour_ending", "ontario_demand_mw")
    return moves.join(context, ["market_date", "hour_ending"], "left").join(hours, ["market_date", "hour_ending"], "left")
