"""Profiles of days against exact statistics."""

import pytest
from pyspark.sql import functions as F

from halyard.functions.sketches import DailyProfiles

EVENTS = "/root/testdata/sf0.01/events.parquet"


@pytest.fixture(scope="module")
def profiles(spark, tmp_path_factory):
    out = DailyProfiles(spark, str(tmp_path_factory.mktemp("profiles") / "t"), ["value"], ["user_id", "event_id"], ["event_type"])
    events = spark.read.parquet(EVENTS)
    days = sorted(r[0] for r in events.select(F.to_date("ts").cast("string")).distinct().collect())
    for part in (days[:12], days[12:13], days[13:]):
        out.update(events, F.to_date("ts"), part)
    return out


@pytest.mark.parametrize("span", [(None, None), ("2024-01-05", "2024-01-20"), ("2024-01-07", "2024-01-07")])
def test_merged_days_are_the_span(spark, profiles, span):
    rows = spark.read.parquet(EVENTS).filter(F.to_date("ts").between(*span) if span[0] else F.lit(True))
    said = profiles.described(*span).first()
    exact = rows.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("stddev"), F.min("value").alias("min"), F.max("value").alias("max"), F.percentile("value", F.array(*[F.lit(p + e) for p in (0.25, 0.5, 0.75) for e in (-0.01, 0.01)])).alias("p")).first()
    assert (said.n, said.min, said.max) == (exact.n, exact.min, exact.max) and abs(said["mean"] - exact["mean"]) < 1e-6 and abs(said.stddev - exact.stddev) < 1e-6
    for k, q in enumerate((said.q25, said.q50, said.q75)):
        assert exact.p[2 * k] <= q <= exact.p[2 * k + 1]
    counts = {r.column_name: r.n_distinct for r in profiles.distinct(*span).collect()}
    for c in ("user_id", "event_id"):
        n = rows.select(c).distinct().count()
        assert abs(counts[c] - n) <= max(1, 0.03 * n)
    top = {r.value: r.n for r in profiles.frequent("event_type", 3, *span).collect()}
    exactly = {r.event_type: r["count"] for r in rows.groupBy("event_type").count().collect()}
    assert all(exactly[v] == n for v, n in top.items()) and sorted(top.values()) == sorted(exactly.values())[-3:]


def test_only_days_that_changed_are_sketched_again(spark, tmp_path):
    out = DailyProfiles(spark, str(tmp_path / "t"), ["v"], ["v"])
    rows = spark.createDataFrame([("2026-01-01", 1.0), ("2026-01-01", None), ("2026-01-02", 5.0), (None, 9.0)], "d string, v double")
    out.update(rows, F.col("d"))
    before = out.table.manifest(0)["folders"]
    out.update(rows.withColumn("v", F.col("v") + 1), F.col("d"), ["2026-01-02"])
    kept = set(out.table.manifest(1)["folders"]) & set(before)
    assert len(kept) == 1 and "2026-01-01" in kept.pop()
    assert tuple(out.described().first()) == ("v", 2, 3.5, pytest.approx(3.5355339), 1.0, 1.0, 1.0, 6.0, 6.0)
    out.update(rows.limit(0), F.col("d"), ["2026-01-02"])
    assert out.described().first().n == 1 and out.described().first().stddev is None and out.table.read().count() == 1
