import statistics

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from halyard.operators import series


def slots(spark, rows):
    return spark.createDataFrame(rows, "slot long, value double")


def test_gap_makes_no_change(spark):
    out = {r.slot: r for r in series.gap_safe_change(slots(spark, [(286, 1.0), (287, 3.0), (288, 2.0), (290, 9.0), (2000, 1.0)]), "slot", "value").collect()}
    assert [out[s].change for s in (286, 287, 288, 290, 2000)] == [None, 2.0, -1.0, None, None]  # 287 to 288 crosses midnight
    assert out[290].slot_gap == 2 and out[2000].previous_slot == 290


def test_null_price_gives_no_change(spark):
    out = {r.slot: r.change for r in series.gap_safe_change(slots(spark, [(1, None), (2, 3.0), (3, None)]), "slot", "value").collect()}
    assert out == {1: None, 2: None, 3: None}


def test_partitioned_by_series(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 2, 5.0)], "k string, slot long, value double")
    out = {(r.k, r.slot): r.change for r in series.gap_safe_change(df, "slot", "value", ["k"]).collect()}
    assert out == {("a", 1): None, ("a", 2): 1.0, ("b", 2): None}


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.integers(270, 330), st.one_of(st.none(), st.floats(-5, 5).map(lambda x: round(x, 2))), min_size=1, max_size=40))
def test_rolling_is_the_offset_join(spark, values):
    df = slots(spark, sorted(values.items()))
    rows = series.rolling(df, "slot", "value").collect()
    long = {(r.slot, r.window_minutes): r for r in series.rolling_long(df, "slot", "value").collect()}
    assert len(rows) == len(values)
    for r in rows:
        for minutes, n in series.WINDOWS.items():
            there = [v for k in range(n) if (v := values.get(r.slot - k)) is not None]
            whole = len(there) == n
            assert r[f"r{minutes}_count"] == len(there) == long[r.slot, minutes].present_slots
            assert r[f"r{minutes}_complete"] == whole == long[r.slot, minutes].window_complete
            if whole:
                assert abs(r[f"r{minutes}_avg"] - statistics.mean(there)) < 1e-9 and abs(long[r.slot, minutes].rolling_avg - statistics.mean(there)) < 1e-9
                assert abs(r[f"r{minutes}_stddev"] - statistics.stdev(there)) < 1e-6
                assert r[f"r{minutes}_negative_count"] == sum(v < 0 for v in there)
            else:
                assert r[f"r{minutes}_avg"] is None and r[f"r{minutes}_negative_share"] is None


def test_invalidated_key_does_not_come_back(spark):
    log = spark.createDataFrame([("k", 1, "e1", "ELIGIBLE"), ("k", 2, "e2", "ELIGIBLE"), ("k", 3, "e3", "INVALIDATED"), ("j", 1, "e4", "ELIGIBLE")], "key string, at int, event_id string, state string")
    assert [r.event_id for r in series.current_state(log, ["key"], ["at", "event_id"], F.col("state") == "ELIGIBLE").collect()] == ["e4"]
    until = log.filter("at < 3")
    assert {r.event_id for r in series.current_state(until, ["key"], ["at", "event_id"], F.col("state") == "ELIGIBLE").collect()} == {"e2", "e4"}


def test_most_complete_delivery_wins(spark):
    log = spark.createDataFrame([("e", 1.0, "x", 1), ("e", None, "x", 2), ("e", 1.0, "", 3)], "event_id string, price double, source string, delivery int")
    assert [r.delivery for r in series.dedup_deliveries(log, "event_id", ["price", "source"], ["delivery"]).collect()] == [1]


def test_peak_keeps_ties(spark):
    df = spark.createDataFrame([("d", 1, 5), ("d", 2, 7), ("d", 3, 7), ("e", 1, None)], "day string, hour int, mw int")
    assert {(r.day, r.hour) for r in series.peak_with_ties(df, ["day"], "mw").collect()} == {("d", 2), ("d", 3)}


def test_decisions(spark):
    incoming = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "b", True), (4, "a", False), (5, "a", False), (6, "a", True)], "k int, observation_hash string, eligible boolean")
    latest = spark.createDataFrame([(2, "p2", "a", "ELIGIBLE"), (3, "p3", "a", "ELIGIBLE"), (4, "p4", "a", "ELIGIBLE"), (5, "p5", "a", "INVALIDATED"), (6, "p6", "a", "INVALIDATED")], "k int, event_id string, observation_hash string, publication_state string")
    out = {r.k: r.decision for r in series.revision_decisions(incoming, latest, ["k"]).collect()}
    assert out == {1: "NEW_OBSERVATION", 2: "UNCHANGED", 3: "REVISED_OBSERVATION", 4: "INVALIDATION", 5: "SUPPRESSED_INELIGIBLE", 6: "NEW_OBSERVATION"}


def test_unpivot_keeps_nulls(spark):
    df = spark.createDataFrame([(1, 1.0, None)], "id int, a double, b double")
    assert {(r.zone, r.mw) for r in series.unpivoted(df, ["id"], ["a", "b"], "zone", "mw").collect()} == {("a", 1.0), ("b", None)}


def test_slots_of_parts(spark):
    df = spark.sql("select date'2026-01-01' d, 24 h, 12 i union all select date'2026-01-02', 1, 1")
    a, b = sorted(r[0] for r in df.select(series.slot_of_parts(F.col("d"), F.col("h"), F.col("i"))).collect())
    assert b - a == 1
