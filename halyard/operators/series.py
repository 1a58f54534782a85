"""Operators on series of revisable slots: current state, gap-safe change, complete-only rolling windows, event rules.

An event log keeps every delivery. A slot's ordinal counts its intervals from an epoch; windows run over ordinals, not
rows, so a gap in the series is a gap in the window. Windows are partitioned by blocks of ordinals (and a series' key):
each block gets a halo of the rows it looks back to, or the last row of the blocks before it, so no window has the whole
series in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots of a day at five minutes.
SLOTS_A_DAY = 288
#: Minutes of a window -> slots it has when complete.
WINDOWS = {15: 3, 30: 6, 60: 12}
#: Event types and the publication state that goes with each.
OBSERVATION, INVALIDATION = "RT_PRICE_OBSERVATION", "RT_PRICE_INVALIDATION"
ELIGIBLE, INVALIDATED = "ELIGIBLE", "INVALIDATED"


def slot_of_parts(day: Column, hour: Column, interval: Column) -> Column:
    """Ordinal of (day, hour ending 1..24, interval 1..12)."""
    return F.unix_date(day).cast("long") * SLOTS_A_DAY + (hour - 1) * 12 + (interval - 1)


def slot_of_timestamp(ts: Column, minutes: int = 5) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(minutes * 60_000_000)).cast("long")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last by `order` (its last column a tie breaker), by one aggregate that combines on the map side."""
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in order])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordering).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def completeness_score(columns: list[str]) -> Column:
    """How many of the columns hold something; an empty string holds nothing."""
    return reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0) for c in columns])


def dedup_deliveries(log: DataFrame, event_id: str, scored: list[str], tie: list[str]) -> DataFrame:
    """One row an event: the most complete delivery, then the last by `tie`."""
    return latest_by(log.withColumn("_score", completeness_score(scored)), [event_id], ["_score", *tie]).drop("_score")


def counted_deliveries(log: DataFrame, event_id: str, scored: list[str], tie: list[str], counts: dict[str, Column]) -> DataFrame:
    """dedup_deliveries with counts over each event's deliveries beside its row, from the same aggregate."""
    scored_log = log.withColumn("_score", completeness_score(scored))
    rest = [c for c in log.columns if c not in (event_id, *tie)]
    best = scored_log.groupBy(event_id).agg(F.max_by(F.struct(*rest), F.struct("_score", *tie)).alias("_row"), *[n.alias(c) for c, n in counts.items()])
    return best.select(event_id, "_row.*", *counts)


def current_state(events: DataFrame, keys: list[str], order: list[str], eligible: Column) -> DataFrame:
    """Latest event of each key, and only then those that are eligible: an invalidated key must not come back."""
    return latest_by(events, keys, order).filter(eligible)


def gap_safe_change(df: DataFrame, slot: str, value: str, series: list[str] | None = None, block: int = SLOTS_A_DAY) -> DataFrame:
    """df with previous_slot, previous_value, slot_gap, and change, which is null unless the previous slot is adjacent.

    df has a row a slot. Within a block the previous row is a lag; a block's first row takes the last row of the blocks
    before it, from a window over one row a block.
    """
    series = series or []
    blocked = df.withColumn("_block", F.floor(F.col(slot) / block))
    within = Window.partitionBy(*series, "_block").orderBy(slot)
    last = blocked.groupBy(*series, "_block").agg(F.max_by(F.struct(slot, value), slot).alias("_last"))
    before = Window.partitionBy(*series).orderBy("_block") if series else Window.orderBy("_block")
    carried = last.select(*series, "_block", F.lag("_last").over(before).alias("_carried"))
    out = blocked.withColumn("_own", F.lag(F.struct(slot, value)).over(within)).join(carried, [*series, "_block"], "left")
    previous = F.coalesce("_own", "_carried")
    out = out.withColumn("previous_slot", previous[slot]).withColumn("previous_value", previous[value]).withColumn("slot_gap", F.col(slot) - F.col("previous_slot"))
    return out.withColumn("change", F.when(F.col("slot_gap") == 1, F.col(value) - F.col("previous_value"))).drop("_block", "_own", "_carried")


def rolling(df: DataFrame, slot: str, value: str, windows: dict[int, int] | None = None, series: list[str] | None = None, block: int = SLOTS_A_DAY) -> DataFrame:
    """df with r{m}_ columns for each window of m minutes: count, complete, avg, min, max, stddev, negative_count, negative_share.

    All but count and complete are null unless every slot of the window has a value. Blocks get the rows of the longest
    window before them as a halo, at most a window's slots a block.
    """
    windows, series = windows or WINDOWS, series or []
    reach = max(windows.values()) - 1
    own = F.floor(F.col(slot) / block)
    blocks = F.when(F.pmod(F.col(slot), F.lit(block)) >= block - reach, F.array(own, own + 1)).otherwise(F.array(own))
    spread = df.withColumn("_own", own).withColumn("_block", F.explode(blocks))
    columns = {}
    for minutes, n in windows.items():
        frame = Window.partitionBy(*series, "_block").orderBy(slot).rangeBetween(-(n - 1), 0)
        count = F.count(value).over(frame)
        whole = count == n
        negative = F.count_if(F.col(value) < 0).over(frame)
        columns |= {
            f"r{minutes}_count": count, f"r{minutes}_complete": whole,
            f"r{minutes}_avg": F.when(whole, F.avg(value).over(frame)), f"r{minutes}_min": F.when(whole, F.min(value).over(frame)), f"r{minutes}_max": F.when(whole, F.max(value).over(frame)),
            f"r{minutes}_stddev": F.when(whole, F.stddev_samp(value).over(frame)),
            f"r{minutes}_negative_count": F.when(whole, negative), f"r{minutes}_negative_share": F.when(whole, negative / F.lit(n)),
        }
    return spread.withColumns(columns).filter(F.col("_own") == F.col("_block")).drop("_own", "_block")


def rolling_long(df: DataFrame, slot: str, value: str, windows: dict[int, int] | None = None) -> DataFrame:
    """(slot, window_minutes, expected_slots, present_slots, window_complete, rolling_avg): a row for each slot and window,
    by expanding the slots that each window expects and joining what is there."""
    windows = windows or WINDOWS
    specs = F.array(*[F.struct(F.lit(m).alias("window_minutes"), F.lit(n).alias("expected_slots")) for m, n in windows.items()])
    wanted = df.select(slot).withColumn("_w", F.explode(specs)).select(slot, "_w.*")
    wanted = wanted.withColumn("_slot", F.explode(F.expr(f"transform(sequence(0, expected_slots - 1), k -> {slot} - k)")))
    values = df.select(F.col(slot).alias("_slot"), F.col(value).alias("_value"))
    grouped = wanted.join(values, "_slot", "left").groupBy(slot, "window_minutes", "expected_slots").agg(F.count("_value").alias("present_slots"), F.avg("_value").alias("_avg"))
    whole = F.col("present_slots") == F.col("expected_slots")
    return grouped.select(slot, "window_minutes", "expected_slots", "present_slots", whole.alias("window_complete"), F.when(whole, F.col("_avg")).alias("rolling_avg"))


def market_metrics(current: DataFrame, slot: str, value: str, series: list[str] | None = None) -> DataFrame:
    """Change and all windows of each slot: the windows run over the rows that have their change, so nothing is joined on the slot."""
    change = gap_safe_change(current, slot, value, series).withColumn("is_negative", F.col(value) < 0)
    return rolling(change, slot, value, series=series)


def latest_per_group(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The last row of each group by row number; `order` ends with a tie breaker."""
    w = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def peak_with_ties(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """All rows that reach their group's largest value. The largest is an aggregate, so a large group does not sort in one task."""
    top = df.groupBy(*group).agg(F.max(value).alias("_top"))
    return df.join(top, group).filter(F.col(value) == F.col("_top")).drop("_top")


def population_state(parts: list[str]) -> Column:
    filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in parts])
    return F.when(filled == len(parts), "FULLY_POPULATED").when(filled == 0, "FULLY_EMPTY").otherwise("PARTIALLY_POPULATED")


def missing_any(columns: list[str]) -> Column:
    """Whether one of the columns holds nothing; an empty string holds nothing."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("string"), F.lit("")) == "" for c in columns])


def event_rules(log: DataFrame, logical: DataFrame, core: list[str], prices: list[str]) -> DataFrame:
    """(rule_id, rule_name, criticality, metric, outcome): the six rules on a delivery log and its logical events, from an aggregate of each."""
    copies = log.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(missing_any(core)).alias("m"))
    physical = copies.agg(F.sum(F.col("n") - 1).alias("m1"), F.sum("m").alias("m2"))
    return _rule_rows(physical.crossJoin(F.broadcast(logical.agg(*_logical_counts(core, prices)))))  # a row each


def counted_rules(events: DataFrame, core: list[str], prices: list[str], n: str, m: str) -> DataFrame:
    """event_rules of logical events that have the number of their deliveries (n), and of those without a core field (m), beside them: one pass."""
    return _rule_rows(events.agg(F.sum(F.col(n) - 1).alias("m1"), F.sum(m).alias("m2"), *_logical_counts(core, prices)))


def _logical_counts(core: list[str], prices: list[str]) -> list[Column]:
    """What the rules count of logical events; strings count as missing when empty, and no comparison is left undecided by a null."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    observed, invalid = text("event_type") == OBSERVATION, text("event_type") == INVALIDATION
    paired = (observed & (text("publication_state") == ELIGIBLE)) | (invalid & (text("publication_state") == INVALIDATED))
    no_price = reduce(lambda a, b: a | b, [F.col(p).isNull() for p in prices])
    return [F.count_if(missing_any(core)).alias("m3"), F.count_if(~paired).alias("m4"), F.count_if(observed & no_price).alias("m5"), F.count_if(invalid & (text("previous_event_id") == "")).alias("m6")]


def _rule_rows(counts: DataFrame) -> DataFrame:
    rows = [
        ("RT-DQ-001", "technical_duplicates", "WARN", "m1"), ("RT-DQ-002", "physical_missing_core", "WARN", "m2"), ("RT-DQ-003", "logical_missing_core", "FAIL", "m3"),
        ("RT-DQ-004", "invalid_type_state_pair", "FAIL", "m4"), ("RT-DQ-005", "observation_missing_price", "FAIL", "m5"), ("RT-DQ-006", "invalidation_without_previous", "FAIL", "m6"),
    ]
    each = F.array(*[F.struct(F.lit(i).alias("rule_id"), F.lit(n).alias("rule_name"), F.lit(c).alias("criticality"), F.coalesce(F.col(m), F.lit(0)).cast("long").alias("metric")) for i, n, c, m in rows])
    return counts.select(F.explode(each).alias("r")).select("r.*").withColumn("outcome", F.when(F.col("metric") == 0, "PASS").otherwise(F.col("criticality")))


def revision_decisions(incoming: DataFrame, latest: DataFrame, keys: list[str]) -> DataFrame:
    """incoming (keys, observation_hash, eligible) with previous_event_id and decision, from each key's latest publication.

    latest: keys, event_id, observation_hash, publication_state. An ineligible observation withdraws what is published
    and is otherwise suppressed; an eligible one is unchanged or revised against what is published, and new where nothing
    is, also after a withdrawal.
    """
    before = latest.select(*keys, F.col("event_id").alias("previous_event_id"), F.col("observation_hash").alias("_hash"), F.col("publication_state").alias("_state"))
    published = F.coalesce(F.col("_state") == ELIGIBLE, F.lit(False))
    decision = (
        F.when(~F.col("eligible") & published, "INVALIDATION")
        .when(~F.col("eligible"), "SUPPRESSED_INELIGIBLE")
        .when(published & F.col("observation_hash").eqNullSafe(F.col("_hash")), "UNCHANGED")
        .when(published, "REVISED_OBSERVATION")
        .otherwise("NEW_OBSERVATION")
    )
    return incoming.join(before, keys, "left").withColumn("decision", decision).drop("_hash", "_state")


def unpivoted(df: DataFrame, ids: list[str], measures: list[str], name: str, value: str) -> DataFrame:
    """A row for each measure of each row; nulls stay, so there are exactly as many rows as rows times measures."""
    return df.unpivot(ids, measures, name, value)


def reconciled(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, a, b, difference, outcome) on shared keys; a disagreement is a warning, and both values stay."""
    both = left.join(right, keys, "inner").withColumn("difference", F.col(a) - F.col(b))
    return both.select(*keys, a, b, "difference", F.when(F.col("difference") != 0, "WARN").otherwise("PASS").alias("outcome"))
