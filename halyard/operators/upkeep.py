"""Change and windows kept up to date: only what changed slots can alter is computed again.

A slot that changes, comes or goes alters its own row, the windows of the slots up to an hour behind it, and the change of the next slot
that is there. So the days of the changed slots are read with the nearest days before and behind them that have rows; of these days
the rows that may be altered are merged, and other days are neither read nor written.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators import realtime, series
from halyard.plans.store import BEFORE, VersionedTable

#: Slots of the longest window.
REACH = max(series.WINDOWS.values())
DAY = realtime.KEY[0]
#: The key of a metrics row.
METRIC_KEY = ["delivery_date", "delivery_hour", "interval_no"]


def metrics_table(spark: SparkSession, path: str) -> VersionedTable:
    """Where the metrics are kept: a partition a day."""
    return VersionedTable(spark, path, METRIC_KEY, partition=DAY)


def changed_slots(current: VersionedTable, after: int, until: int | None = None) -> DataFrame:
    """(day, slot, stays): the slots that versions changed, and whether the last change left them there."""
    log = current.changes(after, until).filter(F.col("_change_type") != BEFORE)
    slot = series.slot_of_parts(F.to_date("delivery_date"), F.col("delivery_hour"), F.col("interval"))
    last = log.select(F.col(DAY).cast("string").alias("day"), slot.alias("slot"), (F.col("_change_type") != "delete").alias("here"), "_version")
    return last.groupBy("day", "slot").agg(F.max_by("here", F.struct("_version", "here")).alias("stays"))


def _neighbours(current: VersionedTable, days: list[str], version: int | None) -> list[str]:
    """days, and of each the nearest day with rows before and behind it."""
    there = [p for p in current.parts(version) if p is not None]
    seen: dict[str, bool] = {}
    while True:
        held = [p for p in there if seen.get(p, True)]
        near = {held[k] for d in days for k in (bisect_left(held, d) - 1, bisect_right(held, d)) if 0 <= k < len(held)}
        unknown = sorted(near - seen.keys())
        if not unknown:
            return sorted(near | (set(days) & set(there)))
        rows = {r[0] for r in current.read(version, parts=unknown).select(F.col(DAY).cast("string")).distinct().collect()}  # of days whose rows are all gone there are none
        seen |= {p: p in rows for p in unknown}


def update(current: VersionedTable, metrics: VersionedTable, after: int, until: int | None = None) -> dict[str, int]:
    """Brings metrics from the version after to until of current; gives how many days were read and rows were altered.

    metrics: as price_market_metrics gives it. After it, it is what a computation of all rows would give.
    """
    changed = changed_slots(current, after, until)
    days = sorted(r[0] for r in changed.select("day").distinct().collect())  # a row a day
    if not days:
        return {"days_read": 0, "rows": 0}
    wanted = _neighbours(current, days, until) if current.read(until).limit(1).count() else []
    rows = realtime.slots(current.read(until, parts=wanted))
    whole = realtime.metrics_of(rows)
    # The rows behind changed slots: up to a window's reach, or the next that is there; slots that went mark their place
    reached = changed.select(F.explode(F.sequence(F.col("slot"), F.col("slot") + REACH - 1)).alias("slot"))
    marks = changed.filter(~F.col("stays")).select("slot", F.lit(None).cast("double").alias("price"))
    order = series.gap_safe_change(rows.select("slot", "price").unionByName(marks), "slot", "price").select("slot", "previous_slot")
    following = order.join(changed.select(F.col("slot").alias("previous_slot")), "previous_slot", "left_semi").select("slot")
    altered = reached.union(following).distinct()
    again = whole.withColumn("_slot", series.slot_of_parts(F.to_date("delivery_date"), F.col("delivery_hour"), F.col("interval_no"))).join(altered.withColumnRenamed("slot", "_slot"), "_slot", "left_semi").drop("_slot")
    gone = changed.filter(~F.col("stays")).select(*_parts(F.col("slot")))
    gone = gone.select(F.col("delivery_date").cast(again.schema[DAY].dataType), "delivery_hour", "interval_no")
    source = again.withColumn("_gone", F.lit(False)).unionByName(gone.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
    before = metrics.version()
    version = metrics.merge(source, gone="_gone")
    said = metrics.manifest(version) if version > before else {"inserted": 0, "updated": 0, "deleted": 0}
    return {"days_read": len(wanted), "rows": said["inserted"] + said["updated"] + said["deleted"]}


def _parts(slot) -> list:
    """(day, hour, interval) of an ordinal."""
    within = F.pmod(slot, F.lit(series.SLOTS_A_DAY))
    day = F.date_from_unix_date(F.floor(slot / series.SLOTS_A_DAY).cast("int"))
    return [day.alias("delivery_date"), (F.floor(within / 12) + 1).cast("int").alias("delivery_hour"), (within % 12 + 1).cast("int").alias("interval_no")]
