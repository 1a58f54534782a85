"""Evidence: whether what is there suffices for an answer, with reasons; never what the answer means."""

from __future__ import annotations

import datetime
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.operators.serving import lookup
from halyard.plans.contracts import PRICES
from halyard.plans.runs import latest_results

SUFFICIENT, PARTIAL, INSUFFICIENT, BLOCKED = "SUFFICIENT", "PARTIAL", "INSUFFICIENT", "BLOCKED_BY_DQ"


def evidence_state(present: Column, usable: Column, blocked: Column, complete: Column) -> Column:
    """The first that holds: nothing there, unusable, blocked by data quality, incomplete; else sufficient."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(~yes(present) | ~yes(usable), INSUFFICIENT).when(yes(blocked), BLOCKED).when(~yes(complete), PARTIAL).otherwise(SUFFICIENT)


#: The one reason of each outcome, in the order in which they are looked at.
REASONS = ["NO_PRIMARY_EVIDENCE", "MISSING_REQUIRED_METRICS", "DQ_BLOCKING_FAILURE", "INCOMPLETE_COVERAGE", "EVIDENCE_COMPLETE"]


def reason_codes(present: Column, usable: Column, blocked: Column, complete: Column) -> Column:
    """The reason for evidence_state of the same facts, as an array of one."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    hits = [~yes(present), ~yes(usable), yes(blocked), ~yes(complete)]
    return F.array(reduce(lambda e, x: e.when(x[0], x[1]), zip(hits, REASONS, strict=False), F).otherwise(REASONS[-1]))


def checked_date(value: str) -> datetime.date:
    if not isinstance(value, str) or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        raise ValueError(f"not a date like 2026-01-31: {value!r}")
    return datetime.date.fromisoformat(value)


def checked_number(value: int | None, least: int, most: int, name: str, optional: bool = False) -> int | None:
    if value is None and optional:
        return None
    if not isinstance(value, int) or isinstance(value, bool) or not least <= value <= most:
        raise ValueError(f"{name} is not within {least} and {most}: {value!r}")
    return value


#: Measures that an hour's evidence needs, the dataset whose rules may block it, and what a slot's evidence needs.
MEASURES = ("ontario_demand_mw", "market_demand_mw")
DATASET = "gold.fact_market_demand_hourly"
DEMAND_SOURCES = [DATASET, "ops.vw_latest_dq_result"]
SLOT_SOURCES = ["fn_rt_price_current()", "fn_rt_dq_summary()"]
LIMITATIONS = [
    "An hour's demand is coarser than a slot of five minutes.",
    "What happened at the same time is no cause of a price's movement.",
]


def investigate_hours(fact: DataFrame, date: str, hour: int | None = None, results: DataFrame | None = None, dataset: str = DATASET, day_col: str = "market_date", hour_col: str = "hour_ending", values: tuple[str, ...] = MEASURES) -> DataFrame:
    """One row: coverage of the day, state and reasons for the day (24 distinct hours) or an hour (one row).

    results: of data quality (RESULT); the dataset's latest ones block if one of them is FAIL. Without results nothing is
    known to block. All of values must be there in every row that is asked for; a fact that lacks one of them has it in none.
    """
    day = checked_date(date)
    checked_number(hour, 1, 24, "hour", optional=True)
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() if c in fact.columns else F.lit(True) for c in values])
    asked = F.lit(True) if hour is None else F.col(hour_col) == hour
    found = lookup(fact, {day_col: day}).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct(hour_col).alias("distinct_hour_count"), F.min(hour_col).alias("min_hour"), F.max(hour_col).alias("max_hour"), F.count_if(missing).alias("null_metric_rows"),
        F.count_if(asked).alias("rows"), F.count_if(asked & missing).alias("unusable"),
    )
    if results is not None:
        latest = latest_results(results).filter(F.col("dataset_name") == dataset)
        found = found.crossJoin(F.broadcast(latest.agg(F.count(F.lit(1)).alias("dq_rule_count"), F.coalesce(F.bool_or(F.col("severity") == "FAIL"), F.lit(False)).alias("blocking_dq_failure"))))  # a row each
    else:
        found = found.withColumns({"dq_rule_count": F.lit(0).cast("long"), "blocking_dq_failure": F.lit(False)})
    whole = (F.col("distinct_hour_count") == 24) & (F.col("min_hour") == 1) & (F.col("max_hour") == 24) if hour is None else F.col("rows") == 1
    facts = (F.col("rows") > 0, F.col("unusable") == 0, F.col("blocking_dq_failure"), whole)
    return found.withColumn("evidence_state", evidence_state(*facts)).withColumn("reason_codes", reason_codes(*facts)).withColumn("coverage_complete", F.coalesce(whole, F.lit(False)))


def investigate_slot(current: DataFrame, rules: DataFrame, date: str, hour: int, interval: int, prices: tuple[str, ...] = PRICES) -> DataFrame:
    """One row: whether exactly one observation with all prices is there for a slot, and whether an event rule blocks it.

    rules: with status and severity; only a rule of severity FAIL that fails blocks.
    """
    day = checked_date(date)
    checked_number(hour, 1, 24, "hour")
    checked_number(interval, 1, 12, "interval")
    missing = reduce(lambda a, b: a | b, [F.col(p).isNull() for p in prices])
    found = lookup(current, {"delivery_date": str(day), "delivery_hour": hour, "interval": interval}).agg(F.count(F.lit(1)).alias("rows"), F.count_if(missing).alias("unusable"))
    failed = lambda severity: F.coalesce(F.bool_or((F.col("status") == "FAIL") & (F.col("severity") == severity)), F.lit(False))
    dq = rules.agg(F.count(F.lit(1)).alias("dq_rule_count"), failed("FAIL").alias("blocking_dq_failure"), failed("WARN").alias("nonblocking_dq_warning"))
    both = found.crossJoin(F.broadcast(dq))  # a row each
    facts = (F.col("rows") > 0, F.col("unusable") == 0, F.col("blocking_dq_failure"), F.col("rows") == 1)
    return both.withColumn("evidence_state", evidence_state(*facts)).withColumn("reason_codes", reason_codes(*facts))


def _response(tool: str, request: dict, evidence: dict, sources: list[str], result: object) -> dict:
    return {"tool_name": tool, "contract_version": "1.0", "request": request, "execution": {"status": "SUCCESS"}, "evidence": evidence | {"sources": sources}, "result": result}


def _rows(df: DataFrame, *order: str) -> list[dict]:
    """The rows of a key, a day's at most, as they are handed out at the boundary."""
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


def investigate_demand(fact: DataFrame, results: DataFrame | None, date: str, hour: int | None = None) -> dict:
    """A day's or an hour's demand with its evidence."""
    said = investigate_hours(fact, date, hour, results).first().asDict()
    coverage = {c: said[c] for c in ("row_count", "distinct_hour_count", "min_hour", "max_hour", "null_metric_rows")}
    evidence = {c: said[c] for c in ("evidence_state", "reason_codes")} | {"coverage": coverage} | {c: said[c] for c in ("dq_rule_count", "blocking_dq_failure")}
    request = {"market_date": date, "hour_ending": hour, "scope": "FULL_DAY" if hour is None else "EXACT_HOUR"}
    return _response("get_demand", request, evidence, DEMAND_SOURCES, _rows(lookup(fact, {"market_date": checked_date(date)}, {"hour_ending": hour}), "hour_ending"))


def investigate_realtime_price(current: DataFrame, rules: DataFrame, date: str, hour: int, interval: int) -> dict:
    """A slot's current observation with its evidence."""
    said = investigate_slot(current, rules, date, hour, interval).first().asDict()
    evidence = {c: said[c] for c in ("evidence_state", "reason_codes", "dq_rule_count", "blocking_dq_failure", "nonblocking_dq_warning")}
    key = {"delivery_date": date, "delivery_hour": hour, "interval": interval}
    return _response("get_realtime_price", key, evidence, SLOT_SOURCES, _rows(lookup(current, key)))


def combined_state(slot_state: Column, has_metrics: Column, hour_state: Column) -> Column:
    """(state, reasons) of an event: the slot's evidence first, then metrics, then the hour's demand."""
    said = lambda state, reason: F.struct(F.lit(state).alias("evidence_state"), F.array(F.lit(reason)).alias("reason_codes"))
    return (
        F.when(slot_state == BLOCKED, said(BLOCKED, "CORE_RT_BLOCKED_BY_DQ")).when(slot_state == INSUFFICIENT, said(INSUFFICIENT, "CORE_RT_INSUFFICIENT"))
        .when(~F.coalesce(has_metrics, F.lit(False)), said(PARTIAL, "RT_METRICS_UNAVAILABLE"))
        .when(~F.coalesce(hour_state == SUFFICIENT, F.lit(False)), said(PARTIAL, "HOURLY_DEMAND_CONTEXT_UNAVAILABLE"))
        .otherwise(said(SUFFICIENT, "EVIDENCE_COMPLETE"))
    )


def investigate_event(current: DataFrame, rules: DataFrame, metrics: DataFrame, fact: DataFrame, date: str, hour: int, interval: int, results: DataFrame | None = None) -> dict:
    """The composite answer at the boundary: a slot, its metrics, and the hour's demand beside it."""
    slot, day = investigate_realtime_price(current, rules, date, hour, interval), investigate_demand(fact, results, date, hour)
    found = _rows(lookup(metrics, {"delivery_date": str(checked_date(date)), "delivery_hour": hour, "interval_no": interval}))
    states = slot["evidence"]["evidence_state"], day["evidence"]["evidence_state"]
    said = current.sparkSession.range(1).select(combined_state(F.lit(states[0]), F.lit(len(found) == 1), F.lit(states[1])).alias("x")).select("x.*").first()
    evidence = said.asDict() | {"component_states": {"realtime_price": states[0], "realtime_metrics": SUFFICIENT if len(found) == 1 else INSUFFICIENT, "hourly_demand_context": states[1]}}
    sources = [SLOT_SOURCES[0], "fn_rt_price_market_metrics()", SLOT_SOURCES[1], *DEMAND_SOURCES]
    result = {"realtime_price": slot["result"], "realtime_metrics": found, "hourly_demand_context": day["result"]}
    limits = LIMITATIONS + (["The hour's data quality results were not given."] if results is None else [])
    return _response("investigate_market_event", slot["request"], evidence, sources, result) | {"limitations": limits}
