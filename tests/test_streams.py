"""Streams and what follows them: change feed, leases, keyed state, upkeep of windows, ingestion."""

import pytest
from pyspark.sql import functions as F

from halyard.plans.store import VersionedTable
from halyard.streaming import change_feed

SCHEMA = "k int, day date, v decimal(9,2), at timestamp, note string"


def frame(spark, rows):
    return spark.createDataFrame([(k, float(v), n) for k, v, n in rows], "k int, v double, note string").select("k", F.expr("date_add(date'2026-01-01', k)").alias("day"), F.col("v").cast("decimal(9,2)").alias("v"), F.expr("timestamp'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, k)").alias("at"), "note")


def rows(df):
    return sorted(map(str, df.collect()))


# -- change feed


@pytest.fixture(params=[None, "day"])
def source(spark, tmp_path, request):
    out = VersionedTable(spark, str(tmp_path / "source"), ["k", "day"], partition=request.param)
    out.create(frame(spark, [(k, k, "a") for k in range(20)]))
    return out


def test_a_stream_of_changes_is_the_change_log(spark, source, tmp_path):
    """Inserts, updates with both images and deletes; a query that is begun again goes on where it was, once."""
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        change_feed.changes(spark, source).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    run()
    assert spark.read.parquet(out).count() == 20
    source.merge(frame(spark, [(3, 9, "b"), (4, 4, "a"), (30, 1, None)]))
    source.delete_where(F.col("k") == 7)
    (source._fs.mkdirs(source._path(f"{source.path}/data/9-{'0' * 32}")))  # a lost writer's
    run()
    source.append(frame(spark, [(31, 1, "z")]))
    run()
    run()
    assert rows(spark.read.parquet(out).select(*source.changes(-1).columns)) == rows(source.changes(-1))
    assert source.changes(-1).groupBy("_change_type").count().collect()


def test_columns_that_come_later_are_null_before(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    table.create(spark.createDataFrame([(1, "a")], "k int, v string"))
    table.merge(spark.createDataFrame([(1, "b", 5), (2, "c", 6)], "k int, v string, w long"), evolve=True)
    out = str(tmp_path / "out")
    change_feed.changes(spark, table).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(out)) == rows(table.changes(-1))


def test_a_fact_follows_its_source(spark, source, tmp_path):
    fact, state = VersionedTable(spark, str(tmp_path / "fact"), source.keys, partition=source.partition), str(tmp_path / "state")
    follow = lambda: change_feed.follow(spark, source, fact, state).awaitTermination()
    follow()
    for step in range(3):
        source.merge(frame(spark, [(step, 50 + step, "b"), (40 + step, 0, None)]))
        source.delete_where(F.col("k") == 10 + step)
        if step == 1:
            source.merge(frame(spark, [(10, 1, "back")]))
        else:
            follow()
    follow()
    assert rows(fact.read()) == rows(source.read())
    version = fact.version()
    follow()
    change_feed.follow(spark, source, fact, str(tmp_path / "again")).awaitTermination()  # everything once more
    assert fact.version() == version and rows(fact.read()) == rows(source.read())


# -- keyed state and upkeep


def log_rows(spark, seed, n):
    """Deliveries of an event log: revisions, withdrawals, copies that lack fields, in any order."""
    import random

    from halyard.streaming.outbox import EVENT

    r, out = random.Random(seed), []
    names = [c.split()[0] for c in EVENT.split(", ")]
    for k in range(n):
        slot = r.choice([r.randrange(30), 280 + r.randrange(20), 900 + r.randrange(12), 1500])
        gone = r.random() < 0.2
        row = dict.fromkeys(names) | {
            "event_schema_version": "v1", "event_type": "RT_PRICE_INVALIDATION" if gone else "RT_PRICE_OBSERVATION", "event_id": f"e{k}", "delivery_date": f"2026-01-0{1 + slot // 288}", "delivery_hour": slot % 288 // 12 + 1, "interval": slot % 12 + 1,
            "zonal_price_capped_cad_per_mwh": None if gone else round(r.uniform(-5, 50), 2), "publication_state": "INVALIDATED" if gone else "ELIGIBLE", "source_hash": "h", "event_created_at_utc": f"2026-01-09T00:{k % 60:02d}:{k // 60:02d}",
        }
        out.append(row)
        if r.random() < 0.3:
            out.append(row | {"source_hash": None, "event_created_at_utc": f"2026-01-08T00:00:{k % 60:02d}"})
        if r.random() < 0.2:
            out.append(row | {"source_name": "fuller"})
    r.shuffle(out)
    return [spark.createDataFrame([tuple(x[c] for c in names) for x in out[k::10]], EVENT) for k in range(10)]


def test_state_and_windows_follow_the_log(spark, tmp_path):
    """After each of ten batches in any order the state is what the whole log gives, and so are change and windows."""
    from halyard.operators import realtime, upkeep
    from halyard.streaming import current
    from halyard.streaming.outbox import EVENT

    folder, table, metrics = str(tmp_path / "log"), current.current_table(spark, str(tmp_path / "current")), upkeep.metrics_table(spark, str(tmp_path / "metrics"))
    done, read = -1, []
    for k, part in enumerate(log_rows(spark, 3, 150)):
        part.coalesce(1).write.mode("append").parquet(folder)
        current.follow(spark.readStream.schema(EVENT).parquet(folder), table, str(tmp_path / "state")).awaitTermination()
        if k in (0, 4, 9):
            whole = spark.read.parquet(folder)
            assert rows(table.read()) == rows(realtime.price_current(whole).select(*table.read().columns)), k
            read.append(upkeep.update(table, metrics, done))
            done = table.version()
            ours, theirs = (rows(df.select(*[F.round(c, 6).alias(c) if kind == "double" else c for c, kind in df.dtypes])) for df in (metrics.read(), realtime.price_market_metrics(whole).select(*metrics.read().columns)))
            assert ours == theirs, k
    assert all(x["days_read"] for x in read) and upkeep.update(table, metrics, done)["rows"] == 0


def delivered(spark, *events):
    """Deliveries of one slot: (event, created, state, whether more complete)."""
    from halyard.streaming.outbox import EVENT

    names = [c.split()[0] for c in EVENT.split(", ")]
    full = lambda e, at, state, more: dict.fromkeys(names) | {"event_id": e, "delivery_date": "2026-01-01", "delivery_hour": 1, "interval": 1, "zonal_price_capped_cad_per_mwh": 1.0, "event_created_at_utc": at, "publication_state": state, "source_name": "full" if more else None}
    return spark.createDataFrame([tuple(full(*e)[c] for c in names) for e in events], EVENT)


def test_a_latest_event_that_goes_back_gives_way(spark, tmp_path):
    """A more complete delivery with an earlier time, or none, lets an event of an earlier batch follow; a less complete one changes nothing."""
    from halyard.operators import realtime
    from halyard.streaming import current
    from halyard.streaming.outbox import EVENT

    folder, table = str(tmp_path / "log"), current.current_table(spark, str(tmp_path / "current"))
    steps = [
        ([("a", "t5", "ELIGIBLE", False), ("b", "t3", "ELIGIBLE", False), ("c", "t1", "ELIGIBLE", True)], "a"),
        ([("a", "t2", "ELIGIBLE", True)], "b"),  # a goes back behind b, which this batch does not have
        ([("a", "t9", "ELIGIBLE", False)], "b"),
        ([("b", None, "ELIGIBLE", True)], "a"),
        ([("d", "t8", "INVALIDATED", True)], None),
        ([("e", "t7", "ELIGIBLE", True)], None),  # behind what is withdrawn
        ([("d", "t9", "ELIGIBLE", False), ("f", "t8", "ELIGIBLE", True)], "f"),
    ]
    for n, (events, wanted) in enumerate(steps):
        delivered(spark, *events).coalesce(1).write.mode("append").parquet(folder)
        current.follow(spark.readStream.schema(EVENT).parquet(folder), table, str(tmp_path / "state")).awaitTermination()
        assert [r.event_id for r in table.read().collect()] == ([wanted] if wanted else []), n
        assert rows(table.read()) == rows(realtime.price_current(spark.read.parquet(folder)).select(*table.read().columns)), n


def test_a_batch_that_is_played_again_changes_nothing(spark, tmp_path):
    from halyard.plans.store import VersionedTable
    from halyard.streaming import current

    table = current.current_table(spark, str(tmp_path / "current"))
    events, latest = (VersionedTable(spark, str(tmp_path / n), k, partition=p) for n, k, p in (("events", [*current.realtime.KEY, "event_id"], None), ("latest", current.realtime.KEY, "delivery_date")))
    first, second = delivered(spark, ("a", "t5", "ELIGIBLE", False), ("b", "t3", "ELIGIBLE", False)), delivered(spark, ("a", "t2", "ELIGIBLE", True))
    for batch, version in ((first, 0), (first, 0), (second, 1), (second, 1)):
        current._take(batch, events, latest, table)
        assert (table.version(), latest.version()) == (version, version)
    assert [r.event_id for r in table.read().collect()] == ["b"]


def test_a_batch_is_computed_once_by_an_aggregate(spark, tmp_path):
    """Neither state nor rows pass through Python, and the batch's rows are read once, however often what follows needs them."""
    from halyard.streaming import current
    from halyard.streaming.outbox import EVENT

    folder, table = str(tmp_path / "log"), current.current_table(spark, str(tmp_path / "current"))
    for n, part in enumerate(log_rows(spark, 5, 60)[:2]):
        part.coalesce(1).write.mode("append").parquet(folder)
        query = current.follow(spark.readStream.schema(EVENT).parquet(folder), table, str(tmp_path / "state"))
        query.awaitTermination()
        state = query.lastProgress["stateOperators"]
        assert [s["operatorName"] for s in state] == ["stateStoreSave"], n
        assert query.lastProgress["numInputRows"] == part.count(), n


def test_upkeep_reads_the_days_it_needs(spark, tmp_path):
    from halyard.operators import realtime, upkeep
    from halyard.streaming import current

    table, metrics = current.current_table(spark, str(tmp_path / "c")), upkeep.metrics_table(spark, str(tmp_path / "m"))
    slots = spark.range(288 * 20).select(F.date_format(F.expr("date'2026-01-01' + cast(id div 288 as int)"), "yyyy-MM-dd").alias("delivery_date"), (F.col("id") % 288 / 12 + 1).cast("int").alias("delivery_hour"), (F.col("id") % 12 + 1).cast("int").alias("interval"), (F.col("id") % 7).cast("double").alias("zonal_price_capped_cad_per_mwh"), F.lit("e").alias("event_id"), F.lit("h").alias("source_hash"), F.lit("t").alias("event_created_at_utc"))
    table.create(slots)
    assert upkeep.update(table, metrics, -1) == {"days_read": 20, "rows": 5760}
    table.merge(slots.filter("delivery_date = '2026-01-10' AND delivery_hour = 24 AND interval = 12").withColumn("zonal_price_capped_cad_per_mwh", F.lit(-1.0)))
    said = upkeep.update(table, metrics, 0)
    assert said == {"days_read": 3, "rows": 12} and len(metrics.manifest(1)["written"]) == 2  # the slot and eleven behind it, on two days
    table.delete_where(F.col("delivery_date") == "2026-01-11")
    said = upkeep.update(table, metrics, 1)
    assert said["days_read"] == 3 and metrics.read().count() == 19 * 288
    same = lambda df: rows(df.select(*[F.round(c, 6).alias(c) if kind == "double" else c for c, kind in df.dtypes]))
    assert same(metrics.read()) == same(realtime.metrics_of(realtime.slots(table.read())).select(*metrics.read().columns))


# -- ingestion and quarantine

LINES = ['{"event_id": "a", "delivery_hour": 1, "zonal_price_capped_cad_per_mwh": 1.5}', '{"event_id": "b", "delivery_hour": "2"}', "not json", "", "[1]", '{"delivery_hour": 3}', '{"event_id": "c", "delivery_hour": "x"}', '{"event_id": "a", "delivery_hour": 1, "zonal_price_capped_cad_per_mwh": 1.5}', '{"event_id": ""}', "null", '{"event_id": "d", "delivery_hour": null, "other": {"deep": 1}}']


def test_mapped_lines():
    from halyard.streaming import ingestion

    assert ingestion.MAPPING["event_id"] == "$.event_id" and len(ingestion.MAPPING) == 23


def test_malformed_lines_are_kept_apart_with_their_reason(spark):
    from halyard.streaming import ingestion

    found = ingestion.mapped(spark.createDataFrame([(x, "f") for x in LINES], "line string, _file string"))
    said = [(r.line, r.reason) for r in found.collect()]
    assert [reason for _, reason in said] == [None, None, "NOT_JSON", "EMPTY", "NOT_AN_OBJECT", "MISSING: event_id", "TYPE: delivery_hour", None, "MISSING: event_id", "NOT_AN_OBJECT", None]
    assert {(r.event_id, r.delivery_hour, r.zonal_price_capped_cad_per_mwh) for r in found.filter("reason IS NULL").collect()} == {("a", 1, 1.5), ("b", 2, None), ("d", None, None)}


def test_a_batch_that_is_played_twice_adds_nothing(spark, tmp_path):
    from halyard.streaming import ingestion

    into = ingestion.Ingestion(spark, str(tmp_path / "log"), str(tmp_path / "held"))
    batch = spark.createDataFrame([(x, "f") for x in LINES], "line string, _file string")
    into.take(batch, 0)
    into.take(batch, 0)
    assert into.events.read().count() == 4 and into.rejected.read().count() == 7
    lost = ingestion.Ingestion(spark, str(tmp_path / "log2"), str(tmp_path / "held2"))
    lost.events.append(ingestion.mapped(batch).filter("reason IS NULL").select(*lost.columns), batch=(lost.name, 0))  # lost between the two tables
    lost.take(batch, 0)
    lost.take(batch.limit(2), 1)
    assert lost.events.read().count() == 6 and lost.rejected.read().count() == 7
    assert {(r.batch_id, r.source_file) for r in lost.rejected.read().collect()} == {(0, "f")}


def test_lines_of_a_folder_go_in_once(spark, tmp_path):
    from halyard.streaming import ingestion

    folder, into = str(tmp_path / "in"), ingestion.Ingestion(spark, str(tmp_path / "log"), str(tmp_path / "held"))
    for part in (LINES[:5], LINES[5:]):
        spark.createDataFrame([(x,) for x in part], "value string").write.mode("append").text(folder)
        into.follow(folder, str(tmp_path / "state")).awaitTermination()
    assert into.events.read().count() == 4 and into.rejected.read().count() == 7
    assert {r.reason: r.n for r in into.rejected.read().groupBy("reason").agg(F.count("*").alias("n")).collect()} == {"NOT_JSON": 1, "EMPTY": 1, "NOT_AN_OBJECT": 2, "MISSING: event_id": 2, "TYPE: delivery_hour": 1}


def test_quarantine_and_replay(spark, tmp_path):
    from halyard.functions.typing import typed
    from halyard.plans.contracts import CONTRACTS
    from halyard.plans.quarantine import Quarantine

    contract = CONTRACTS["market_demand_hourly"]
    raw = lambda *rows: spark.createDataFrame(rows, "date_raw string, hour_raw string, market_demand_raw string, ontario_demand_raw string")
    target, held = VersionedTable(spark, str(tmp_path / "t"), list(contract.keys)), Quarantine(spark, str(tmp_path / "q"), contract)
    rows = raw(("2026-01-01", "1", "5", "6"), ("2026-01-01", "2", "N/A", "6"), ("2026-01-01", "77", "1", ""), ("2026-01-02", "3", "1", "1"), ("2026-01-02", "3", "2", "2"))
    assert held.admit(rows, target, "r1") == {"admitted": 1, "held": 4}
    held.admit(rows, target, "r1")  # again: nothing more
    assert held.table.read().count() == 4 and target.read().count() == 1
    said = {r.row["hour_raw"] + (r.row["market_demand_raw"] or ""): (r.payload_hash, r.rules) for r in held.waiting().collect()}
    assert said["2N/A"][1] == ["market_demand_mw_numeric"] and said["77" + "1"][1] == ["hour_ending_domain", "ontario_demand_mw_present"] and said["31"][1] == ["duplicate_business_key"]
    fixed = [(said["2N/A"][0], "2026-01-01", "2", "5", "6"), (said["771"][0], "2026-01-01", "7", "1", ""), (said["31"][0], "2026-01-02", "3", "1", "1"), ("unknown", "2026-01-03", "1", "1", "1")]
    corrected = spark.createDataFrame(fixed, "payload_hash string, date_raw string, hour_raw string, market_demand_raw string, ontario_demand_raw string")
    assert held.replay(corrected, target, "r2") == {"released": 2, "still_held": 1}
    left = {r.payload_hash: r for r in held.waiting().collect()}
    assert set(left) == {said["771"][0], said["32"][0]} and left[said["771"][0]].rules == ["ontario_demand_mw_present"] and left[said["771"][0]].run_id == "r2"
    assert held.replay(corrected, target, "r3") == {"released": 0, "still_held": 1}  # what was released stays so
    assert sorted((str(r.market_date), r.hour_ending) for r in target.read().collect()) == [("2026-01-01", 1), ("2026-01-01", 2), ("2026-01-02", 3)]
    assert typed(rows, contract.typing()).count() == 5


def test_corrected_orders_have_keys_of_their_own(spark, tmp_path):
    """Order keys that are 1,200,000 apart came under one day and hour, and were held again."""
    from halyard.upkeep_queries import quarantine_replay

    keys = [546, 546 + 1_200_000 * 13, 546 + 1_200_000 * 26]  # hour 0, all held at first
    rows = spark.createDataFrame([(k, 1, "O", 5.0, "1-URGENT", "1996-01-02") for k in keys], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string, d string")
    rows.withColumn("o_orderdate", F.to_timestamp("d")).drop("d").write.parquet(str(tmp_path / "orders.parquet"))
    assert {(r.state, r.n) for r in quarantine_replay(spark, str(tmp_path)).collect()} == {("RELEASED", 3)}


def test_a_line_is_parsed_once(spark):
    """A filter on the reason was pushed below and parsed each line again for every use."""
    from halyard.streaming import ingestion

    lines = spark.createDataFrame([(' [{"event_id": "a"}]', "f"), (' {"event_id": "b"}', "f"), ("3", "f")], "line string, _file string")
    found = ingestion.mapped(lines).filter("reason IS NULL")
    assert found._jdf.queryExecution().executedPlan().toString().count("try_parse_json") + found._jdf.queryExecution().optimizedPlan().toString().count("parse_json(") <= 2
    assert [r.event_id for r in found.collect()] == ["b"]
    assert {r.reason for r in ingestion.mapped(lines).collect()} == {None, "NOT_AN_OBJECT"}


def test_dispatch_from_the_executors(spark, tmp_path):
    """What fails is put back with its error, the others are sent, a lease of another owner stays."""
    from halyard.streaming import ingestion, outbox

    ids = spark.range(50).select(*[(F.concat(F.lit("e"), F.col("id").cast("string")) if c == "event_id" else F.lit(None)).cast(kind).alias(c) for c, kind in ingestion.KINDS.items()])
    box = outbox.Outbox(spark, str(tmp_path / "box"))
    box.put(ids)
    held = {e for e, _ in box.claims("other", 2, "1 day")}

    def send(event, payload):
        if event.endswith("7"):
            raise ConnectionError("no line")

    sent, failed = box.dispatch_all(send)
    rows = {r.event_id: r for r in box.read().collect()}
    assert len(rows) == 50 and sent + failed == 48 and {e for e, r in rows.items() if r.status == "SENDING"} == held
    back = {e for e, r in rows.items() if r.status == "PENDING"}
    assert back == {e for e in rows if e.endswith("7")} - held and len(back) == failed and {rows[e].last_error for e in back} == {"no line"}
    assert box.dispatch_all(lambda event, payload: None) == (failed, 0)
    assert {r.attempt_count for r in box.read().collect() if r.event_id in back} == {2}
