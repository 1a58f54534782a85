from pathlib import Path

import pytest
from pyspark.sql import functions as F

from halyard.plans.contracts import CONTRACTS
from halyard.plans.runs import IncrementalFacts, Runs, run_in_order, tables_of
from halyard.plans.store import ConstraintViolation, TableConflict, VersionedTable, read_increment, reconcile

SCHEMA = "k int, v int, note string"


@pytest.fixture
def store(spark, tmp_path):
    out = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    out.create(spark.createDataFrame([(1, 10, "a"), (2, 20, None)], SCHEMA))
    return out


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_changes_only_what_differs(spark, store):
    assert store.merge(spark.createDataFrame([(2, 20, None), (1, 11, "a"), (3, 30, "c")], SCHEMA)) == 1
    assert rows(store.read()) == [(1, 11, "a"), (2, 20, None), (3, 30, "c")]
    assert rows(store.changes(0).select("k", "v", "_change_type")) == [(1, 10, "update_preimage"), (1, 11, "update_postimage"), (3, 30, "insert")]
    assert rows(store.read(0).select("k", "v")) == [(1, 10), (2, 20)]


def test_repeated_merge_makes_no_version(spark, store):
    payload = spark.createDataFrame([(1, 11, "a"), (4, 1, "d")], SCHEMA)
    first = store.merge(payload)
    assert store.merge(payload) == first == store.version()


def test_absence_deletes_nothing(spark, store):
    store.merge(spark.createDataFrame([(1, 12, "a")], SCHEMA))
    assert store.read().count() == 2


def test_duplicate_and_null_keys_are_refused_before_writing(spark, store):
    with pytest.raises(ConstraintViolation, match="duplicate_business_key"):
        store.merge(spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], SCHEMA))
    with pytest.raises(ConstraintViolation, match="required_not_null"):
        store.merge(spark.createDataFrame([(None, 1, "x")], SCHEMA))
    assert store.version() == 0


def test_insert_only_update_delete(spark, store):
    store.insert_only(spark.createDataFrame([(1, 99, "z"), (5, 50, "e")], SCHEMA))
    assert rows(store.read().select("k", "v")) == [(1, 10), (2, 20), (5, 50)]
    store.update_where(F.col("v") > 15, {"note": F.lit("big")})
    assert rows(store.read().select("k", "note")) == [(1, "a"), (2, "big"), (5, "big")]
    store.delete_where(F.col("k") == 5)
    assert store.read().count() == 2
    assert [r.operation for r in store.history().orderBy("version").collect()] == ["create", "merge", "update", "delete"]


def test_conditional_and_partial_update(spark, store):
    store.merge(spark.createDataFrame([(1, 77, "n"), (2, 88, "n")], SCHEMA), update={"v": F.col("s.v")}, when=F.col("t.note").isNull())
    assert rows(store.read()) == [(1, 10, "a"), (2, 88, None)]


def test_writers_do_not_overwrite_each_other(spark, store):
    other = VersionedTable(spark, store.path, ["k"])
    other.merge(spark.createDataFrame([(1, 1, "o")], SCHEMA))
    with pytest.raises(TableConflict):
        store._commit(1, "merge", {})


def test_of_two_writers_one_fails_and_the_version_stays(spark, store):
    """The second begins at the version that the first begins at, and ends after it has committed."""
    late = VersionedTable(spark, store.path, ["k"])
    write = late._commit

    def commit(*args):
        late._commit = write
        store.merge(spark.createDataFrame([(1, 1, "first")], SCHEMA))
        return write(*args)

    late._commit = commit
    with pytest.raises(TableConflict):
        late.merge(spark.createDataFrame([(1, 2, "second")], SCHEMA))
    assert late.version() == 1 and rows(late.read()) == rows(store.read(1)) == [(1, 1, "first"), (2, 20, None)]
    late.merge(spark.createDataFrame([(1, 2, "second")], SCHEMA))
    assert rows(store.changes(1).select("v", "note", "_change_type")) == [(1, "first", "update_preimage"), (2, "second", "update_postimage")]
    assert len(list((Path(store.path) / "data").iterdir())) == 3


def test_append_and_insert_only_rewrite_nothing(spark, store):
    store.append(spark.createDataFrame([(7, 70, "x")], SCHEMA))
    store.insert_only(spark.createDataFrame([(7, 71, "y"), (8, 80, "z")], SCHEMA))
    assert rows(store.read().select("k", "v")) == [(1, 10), (2, 20), (7, 70), (8, 80)]
    assert rows(store.changes(0).select("k", "_change_type", "_version")) == [(7, "insert", 1), (8, "insert", 2)]
    assert store.manifest(2)["folders"][:2] == store.manifest(1)["folders"] and store.detail().first().version == 2
    store.create(spark.createDataFrame([(1, 1, "n")], SCHEMA))
    assert rows(store.read()) == [(1, 1, "n")] and store.changes(2).filter("_change_type = 'delete'").count() == 4


def test_increment(spark, store):
    store.merge(spark.createDataFrame([(2, 21, None)], SCHEMA))
    store.merge(spark.createDataFrame([(2, 22, None)], SCHEMA))
    until, changed = read_increment(store, 0)
    assert until == 2 and rows(changed.select("k", "v")) == [(2, 22)]
    store.delete_where(F.col("k") == 1)
    with pytest.raises(ConstraintViolation, match="delete_in_increment"):
        read_increment(store, 2)


def test_reconcile_counts_bags(spark):
    a = spark.createDataFrame([(1, 1), (1, 1), (2, None)], "k int, v int")
    b = spark.createDataFrame([(1, 1), (2, None), (3, 3)], "k int, v int")
    assert tuple(reconcile(a, b, ["k", "v"], ["k"]).first()) == (3, 3, 1, 1, 0)


def test_incremental_facts_follow_their_source(spark, tmp_path):
    contract = CONTRACTS["market_demand_hourly"]
    source, fact = tables_of(spark, str(tmp_path), contract)
    schema = "market_date date, hour_ending int, market_demand_mw decimal(18,3), ontario_demand_mw decimal(18,3)"
    make = lambda values: spark.createDataFrame([(1, h, float(v), 1.0) for h, v in values], "d int, hour_ending int, a double, b double").select(F.expr("date'2026-01-01'").alias("market_date"), "hour_ending", F.col("a").cast("decimal(18,3)").alias("market_demand_mw"), F.col("b").cast("decimal(18,3)").alias("ontario_demand_mw"))
    source.create(make([(1, 5), (2, 6)]))
    facts = IncrementalFacts(spark, str(tmp_path))
    assert facts.run(contract.dataset)["status"] == "SUCCESS"
    assert facts.run(contract.dataset)["status"] == "NO_CHANGE"
    source.merge(make([(2, 7)]))
    said = facts.run(contract.dataset)
    assert said["changed_keys"] == 1 and said["cdf_rows"] == 2 and facts.watermark(contract.dataset) == 1
    assert rows(fact.read().select("hour_ending", F.col("market_demand_mw").cast("int"))) == [(1, 5), (2, 7)]
    assert {r.status for r in facts.runs.table.read().collect()} == {"SUCCESS"} and schema
    facts.verify(contract.dataset)
    fact.update_where(F.col("hour_ending") == 1, {"market_demand_mw": F.lit(0)})
    with pytest.raises(RuntimeError, match="differ"):
        facts.verify(contract.dataset)


def test_failed_run_is_recorded_and_stops_the_chain(spark, tmp_path):
    runs = Runs(spark, str(tmp_path / "runs"))
    with pytest.raises(RuntimeError):
        runs.run("p", "s", lambda run_id: (_ for _ in ()).throw(RuntimeError("no")))
    assert [(r.status, r.error_message) for r in runs.table.read().collect()] == [("FAILED", "no")]
    said = run_in_order([("a", lambda: 1), ("b", lambda: 1 / 0), ("c", lambda: 1)])
    assert said["a"] == "SUCCESS" and said["b"].startswith("FAILED") and said["c"] == "SKIPPED"


# -- what a lost or careless writer leaves


def test_an_empty_manifest_locks_nobody_out(spark, store):
    """A writer of another kind was lost between creating and writing a manifest."""
    Path(store.path, "_manifest", "1.json").touch()
    assert store.version() == 0 and store.merge(spark.createDataFrame([(1, 5, "x")], SCHEMA)) == 1
    assert rows(store.read()) == [(1, 5, "x"), (2, 20, None)]


def test_a_manifest_appears_whole(spark, store, monkeypatch):
    """A writer that is lost before its manifest has its name leaves the version free."""
    late = VersionedTable(spark, store.path, ["k"])
    monkeypatch.setattr(late, "_put", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        late.merge(spark.createDataFrame([(1, 5, "lost")], SCHEMA))
    assert store.version() == 0 and store.merge(spark.createDataFrame([(1, 6, "next")], SCHEMA)) == 1
    assert rows(store.read())[0] == (1, 6, "next")


def test_unknown_columns_are_refused_or_added(spark, store):
    wide = spark.createDataFrame([(1, 10, "a", 7), (9, 90, None, 8)], SCHEMA + ", w int")
    with pytest.raises(ConstraintViolation, match="unknown_columns: w"):
        store.merge(wide)
    with pytest.raises(ConstraintViolation, match="unknown_columns: w"):
        store.append(wide)
    store.append(spark.createDataFrame([(4, 40)], "k int, v int"))
    store.merge(wide, evolve=True)
    assert rows(store.read()) == [(1, 10, "a", 7), (2, 20, None, None), (4, 40, None, None), (9, 90, None, 8)]
    assert {tuple(r) for r in store.changes(1).select("k", "w", "_change_type").collect()} == {(1, None, "update_preimage"), (1, 7, "update_postimage"), (9, 8, "insert")}
    assert store.read(1).columns == ["k", "v", "note"]


def test_a_key_that_the_table_has_twice_is_not_updated(spark, store):
    store.append(spark.createDataFrame([(1, 11, "again")], SCHEMA))
    with pytest.raises(ConstraintViolation, match="duplicate_key_in_table"):
        store.merge(spark.createDataFrame([(1, 12, "x")], SCHEMA))
    assert store.version() == 1 and store.merge(spark.createDataFrame([(2, 21, "y")], SCHEMA)) == 2  # other keys can be


def test_compaction_changes_no_row(spark, store):
    for k in range(3):
        store.append(spark.createDataFrame([(10 + k, k, "x")], SCHEMA))
    before = rows(store.read())
    store.compact()
    assert rows(store.read()) == before and len(store.manifest(4)["folders"]) == 1 and store.changes(3).count() == 0


# -- partitions


@pytest.fixture
def days(spark, tmp_path):
    out = VersionedTable(spark, str(tmp_path / "days"), ["day", "k"], partition="day")
    out.create(spark.range(3000).select(F.expr("date_add(date'2026-01-01', cast(id % 30 as int))").alias("day"), F.col("id").cast("int").alias("k"), F.lit("x" * 50).alias("note")))
    return out


def test_a_merge_of_one_day_writes_one_days_bytes(spark, days):
    whole = sum(size for _, size in days.files(days.manifest(0)["folders"]))
    day = days.read().filter("day = date'2026-01-05'")
    days.merge(day.limit(10).withColumn("note", F.lit("new")))
    written = sum(size for _, size in days.files(days.manifest(1)["written"]))
    assert len(days.manifest(1)["written"]) == 1 and len(days.manifest(1)["folders"]) == 30 and written < whole / 10
    assert set(days.manifest(1)["folders"]) & set(days.manifest(0)["folders"]) == set(days.manifest(0)["folders"]) - {f for f in days.manifest(0)["folders"] if "2026-01-05" in f}
    assert days.read().count() == 3000 and days.read().filter("note = 'new'").count() == 10 and days.changes(0).count() == 20
    assert days.read(parts=["2026-01-05"]).count() == 100 and days.parts()[4] == "2026-01-05"


def test_parts_of_any_value(spark, tmp_path):
    """New, missing and odd values; a part whose rows all go; an empty table."""
    table = VersionedTable(spark, str(tmp_path / "odd"), ["p", "k"], required=["k"], partition="p")
    table.create(spark.createDataFrame([], "p string, k int, v int"))
    assert table.read().count() == 0
    table.merge(spark.createDataFrame([("a/b=c %é", 1, 1), (None, 2, 2), ("", 3, 3)], "p string, k int, v int"))
    table.merge(spark.createDataFrame([("a/b=c %é", 1, 5), ("new", 4, 4)], "p string, k int, v int"))
    assert sorted(rows(table.read().select("k", "v"))) == [(1, 5), (2, 2), (3, 3), (4, 4)]
    table.delete_where(F.col("k") == 4)
    assert sorted(r.k for r in table.read().collect()) == [1, 2, 3] and table.insert_only(spark.createDataFrame([("new", 4, 9), ("a/b=c %é", 1, 0)], "p string, k int, v int")) == 4
    assert rows(table.changes(3).select("k", "v", "_change_type", "_version")) == [(4, 9, "insert", 4)]
    with pytest.raises(ValueError, match="one of the keys"):
        VersionedTable(spark, "x", ["k"], partition="p")


def test_changes_are_one_scan(spark, days):
    for k in range(3):
        days.merge(spark.createDataFrame([(k, f"n{k}")], "k int, note string").select(F.expr("date'2026-01-01' + k").alias("day"), "k", "note"))
    plan = days.changes(-1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert rows(days.changes(0).groupBy("_version").count()) == [(1, 2), (2, 2), (3, 2)]
