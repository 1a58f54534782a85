import hashlib
import json

import pytest
from pyspark.sql import functions as F

from halyard.functions.identity import canonical_decimal, logical_source_key
from halyard.operators import serving
from halyard.plans import evidence
from halyard.plans.contracts import PRICES, STATUS
from halyard.plans.runs import batch_status
from halyard.streaming import outbox


def test_optional_and_required(spark):
    df = spark.createDataFrame([(1, "GAS "), (2, "gas"), (2, "WIND")], "h int, fuel string")
    assert serving.lookup(df, {"h": 2}).count() == 2 and serving.lookup(df, {"h": None}).count() == 0
    assert serving.lookup(df, {}, {"h": None}, {"fuel": " Gas"}).count() == 2


def test_compare_states(spark):
    keys = spark.createDataFrame([(k,) for k in range(5)], "k int")
    left = spark.createDataFrame([(1, 1.0), (3, None), (4, -2.0)], "k int, p double")
    right = spark.createDataFrame([(2, 1.0), (3, 4.0), (4, 3.0)], "k int, q double")
    out = {r.k: (r.comparison_state, r.delta_price) for r in serving.compared(keys, left, right, ["k"], ["k"], {"price": ("p", "q")}).collect()}
    assert out == {0: ("MISSING_BOTH", None), 1: ("MISSING_REALTIME", None), 2: ("MISSING_DAY_AHEAD", None), 3: ("INCOMPLETE_PRICE_COMPONENTS", None), 4: ("COMPARABLE", 5.0)}


def test_table_functions(spark):
    spark.sql("select date'2026-01-01' market_date, h hour_ending, cast(m as decimal(18,3)) ontario_demand_mw, cast(m as decimal(18,3)) market_demand_mw from values (1, 5), (2, 7), (3, 7) v(h, m)").createOrReplaceTempView("fact_market_demand_hourly")
    spark.sql("select date'2026-01-01' market_date, 1 hour_ending, 'West' zone, cast(1 as decimal(18,3)) zonal_demand_mw").createOrReplaceTempView("fact_zonal_demand_hourly")
    spark.sql("select date'2026-01-01' market_date, 1 hour_ending, 'GAS' fuel_type, cast(1 as decimal(18,3)) output_mwh, 0 output_quality_code").createOrReplaceTempView("fact_generation_hourly")
    spark.sql("select date'2026-01-01' market_date, 1 hour_ending, cast(-1 as decimal(18,2)) zonal_price_capped_cad_per_mwh, cast(2 as decimal(18,2)) loss_price_capped_cad_per_mwh, cast(0 as decimal(18,2)) congestion_price_capped_cad_per_mwh, '' _source_flag").createOrReplaceTempView("fact_day_ahead_price_hourly")
    spark.sql("select date'2026-01-01' delivery_date, 1 delivery_hour, k `interval`, cast(3 as decimal(18,2)) zonal_price_capped_cad_per_mwh, cast(if(k = 2, null, 2) as decimal(18,2)) loss_price_capped_cad_per_mwh, cast(0 as decimal(18,2)) congestion_price_capped_cad_per_mwh, 'x' _source_flag from values (1), (2) v(k)").createOrReplaceTempView("fact_realtime_price_5min")
    results = spark.createDataFrame([("r1", "s", "d", "a", "c", "FAIL", "COMPLETED", 5, 1, "1", "0", "t"), ("r2", "s", "d", "a", "c", "PASS", "COMPLETED", 5, 0, "0", "0", "t"), ("r2", "s", "d", "b", "c", "WARN", "COMPLETED", 5, 0, "0", "0", "t")], "run_id string, source_name string, dataset_name string, rule_id string, rule_category string, severity string, status string, records_checked long, records_failed long, observed_value string, expected_value string, details string").withColumn("execution_timestamp", F.lit("2026-01-01").cast("timestamp"))
    serving.register_views(spark, {t: spark.table(t) for t in ("fact_market_demand_hourly", "fact_generation_hourly")}, results)
    assert len(serving.register_functions(spark)) == 7
    status = spark.sql("select * from fn_get_batch_dq_status('d', null)")
    assert status.columns == STATUS and {(x.rule_id, x.rule_outcome) for x in status.collect()} == {("a", "PASS"), ("b", "WARN")}
    assert batch_status(results, "d").collect() and batch_status(results, None).count() == 0 and {tuple(x) for x in batch_status(results, "d", "b").collect()} == {tuple(x) for x in status.filter("rule_id = 'b'").collect()}
    assert spark.table("vw_peak_generation_context").count() == 0
    said = lambda *key: [tuple(x) for x in spark.sql(f"select comparison_state, zonal_rt_minus_da_cad_per_mwh, loss_rt_minus_da_cad_per_mwh, rt_source_flag from fn_compare_da_vs_rt_price({', '.join(key)})").collect()]
    assert said("date'2026-01-01'", "1", "1") == [("COMPARABLE", 4, 0, "x")] and said("date'2026-01-01'", "1", "2") == [("INCOMPLETE_PRICE_COMPONENTS", 4, None, "x")]
    assert [x[0][0] for x in (said("date'2026-01-01'", "1", "3"), said("date'2026-01-02'", "1", "1"))] == ["MISSING_REALTIME", "MISSING_BOTH"] and said("date'2026-01-01'", "1", "null") == []
    facts = [spark.table(t) for t in ("fact_day_ahead_price_hourly", "fact_realtime_price_5min")]
    assert [tuple(x) for x in serving.compare_da_vs_rt_price(*facts, "2026-01-01", 1, 1).collect()] == [tuple(x) for x in spark.sql("select * from fn_compare_da_vs_rt_price(date'2026-01-01', 1, 1)").collect()]
    assert serving.compare_da_vs_rt_price(*facts, None, 1, 1).count() == 0
    n = lambda call: spark.sql(f"select * from {call}").count()
    assert n("fn_get_demand(date'2026-01-01', null)") == 3 and n("fn_get_demand(date'2026-01-01', 2)") == 1 and n("fn_get_demand(null, 2)") == 0
    assert n("fn_get_peak_demand(date'2026-01-01')") == 2 and "market_demand_mw" in spark.sql("select * from fn_get_peak_demand(date'2026-01-01')").columns
    assert n("fn_get_generation_mix(date'2026-01-01', 1, ' gas ')") == 1 and n("fn_get_generation_mix(date'2026-01-01', null, null)") == 0
    assert n("fn_get_zonal_demand(date'2026-01-01', null, 'west')") == 0 and n("fn_get_day_ahead_price(date'2026-01-01', null)") == 1


@pytest.mark.parametrize(
    ("facts", "state"),
    [((False, True, False, True), "INSUFFICIENT"), ((True, False, False, True), "INSUFFICIENT"), ((True, True, True, True), "BLOCKED_BY_DQ"), ((True, True, True, False), "BLOCKED_BY_DQ"), ((True, True, False, False), "PARTIAL"), ((True, True, False, True), "SUFFICIENT")],
)
def test_evidence_precedence(spark, facts, state):
    assert spark.range(1).select(evidence.evidence_state(*[F.lit(x) for x in facts])).first()[0] == state


def test_investigations(spark):
    fact = spark.sql("select date'2026-01-01' market_date, cast(id + 1 as int) hour_ending, 1.0 ontario_demand_mw, 1.0 market_demand_mw from range(24) union all select date'2026-01-02', 1, 1.0, 1.0")
    short = evidence.investigate_hours(fact.drop("market_demand_mw"), "2026-01-01").first()  # a measure that the fact lacks is missing in every row
    assert (short.evidence_state, short.reason_codes, short.null_metric_rows) == ("INSUFFICIENT", ["MISSING_REQUIRED_METRICS"], 24)
    state = lambda *a: evidence.investigate_hours(fact, *a).first().evidence_state
    assert [state("2026-01-01"), state("2026-01-02"), state("2026-01-02", 1), state("2026-01-03")] == ["SUFFICIENT", "PARTIAL", "SUFFICIENT", "INSUFFICIENT"]
    for bad in (("08/28/2026",), ("2026-01-01", 25)):
        with pytest.raises(ValueError):
            evidence.investigate_hours(fact, *bad)
    current = spark.sql("select '2026-01-01' delivery_date, 1 delivery_hour, 1 `interval`, 5.0D zonal_price_capped_cad_per_mwh, 1.0D loss_price_capped_cad_per_mwh, 0.0D congestion_price_capped_cad_per_mwh")
    rules = spark.sql("select 'RT-DQ-001' rule_id, 'WARN' severity, 'WARN' status")
    metrics = current.withColumnRenamed("interval", "interval_no")
    out = evidence.investigate_event(current, rules, metrics, fact, "2026-01-01", 1, 1)
    assert (out["evidence"]["evidence_state"], out["evidence"]["reason_codes"]) == ("SUFFICIENT", ["EVIDENCE_COMPLETE"]) and len(out["result"]["hourly_demand_context"]) == 1
    said = lambda *a: (x := evidence.investigate_event(*a, fact, "2026-01-01", 1, 1)["evidence"])["evidence_state"] + " " + x["reason_codes"][0]
    assert said(current, rules, metrics.limit(0)) == "PARTIAL RT_METRICS_UNAVAILABLE"
    assert said(current, spark.sql("select 'x' rule_id, 'FAIL' severity, 'FAIL' status"), metrics) == "BLOCKED_BY_DQ CORE_RT_BLOCKED_BY_DQ"
    assert said(current.withColumn("loss_price_capped_cad_per_mwh", F.lit(None).cast("double")), rules, metrics) == "INSUFFICIENT CORE_RT_INSUFFICIENT"
    assert evidence.investigate_event(current, rules, metrics, fact.limit(0), "2026-01-01", 1, 1)["evidence"]["reason_codes"] == ["HOURLY_DEMAND_CONTEXT_UNAVAILABLE"]
    with pytest.raises(ValueError):
        evidence.investigate_event(current, rules, current, fact, "2026-01-01", 1, 13)


def test_hours_need_both_measures_and_passed_rules(spark):
    fact = spark.sql("select date'2026-01-01' market_date, cast(id + 1 as int) hour_ending, 1.0 ontario_demand_mw, 1.0 market_demand_mw from range(24) union all select date'2026-01-02', id + 1, if(id = 5, 1.0, null), 1.0 from range(24) union all select date'2026-01-03', id + 1, 1.0, if(id = 5, null, 1.0) from range(24)")
    state = lambda date, *a, **b: evidence.investigate_hours(fact, date, *a, **b).first().evidence_state
    assert [state("2026-01-01"), state("2026-01-02"), state("2026-01-03"), state("2026-01-03", 5), state("2026-01-03", 6)] == ["SUFFICIENT", "INSUFFICIENT", "INSUFFICIENT", "SUFFICIENT", "INSUFFICIENT"]
    rows = [("r1", evidence.DATASET, "a", "FAIL", 1), ("r2", evidence.DATASET, "a", "PASS", 2), ("r2", "other", "b", "FAIL", 2)]
    results = lambda more=(): spark.createDataFrame([*rows, *more], "run_id string, dataset_name string, rule_id string, severity string, execution_timestamp int").selectExpr("*", "'s' source_name")
    failed, warned = results([("r3", evidence.DATASET, "a", "FAIL", 3)]), results([("r3", evidence.DATASET, "c", "WARN", 3)])
    assert [state("2026-01-01", results=results()), state("2026-01-01", results=failed), state("2026-01-02", results=failed), state("2026-01-04", results=failed)] == ["SUFFICIENT", "BLOCKED_BY_DQ", "INSUFFICIENT", "INSUFFICIENT"]
    reason = lambda date, results: evidence.investigate_demand(fact, results, date)["evidence"]["reason_codes"]
    assert [reason("2026-01-01", warned), reason("2026-01-01", failed), reason("2026-01-02", warned), reason("2026-01-04", warned)] == [["EVIDENCE_COMPLETE"], ["DQ_BLOCKING_FAILURE"], ["MISSING_REQUIRED_METRICS"], ["NO_PRIMARY_EVIDENCE"]]
    assert evidence.investigate_demand(fact, None, "2026-01-02", 5)["evidence"]["coverage"]["null_metric_rows"] == 23
    current = spark.sql("select '2026-01-01' delivery_date, 1 delivery_hour, 1 `interval`, 5.0D zonal_price_capped_cad_per_mwh, 1.0D loss_price_capped_cad_per_mwh, 0.0D congestion_price_capped_cad_per_mwh")
    rules = spark.sql("select 'x' rule_id, 'FAIL' severity, 'PASS' status")
    out = evidence.investigate_event(current, rules, current.withColumnRenamed("interval", "interval_no"), fact, "2026-01-01", 1, 1, results=failed)
    assert out["evidence"]["component_states"]["hourly_demand_context"] == "BLOCKED_BY_DQ" and out["evidence"]["evidence_state"] == "PARTIAL"


def test_canonical_decimals(spark):
    df = spark.sql("select cast(v as decimal(18,4)) v from values ('50.00'), ('-0.20'), ('0.000'), ('100'), ('-0.58'), ('1.001'), (null) t(v)")
    assert [r[0] for r in df.select(canonical_decimal(F.col("v"))).collect()] == ["50", "-0.2", "0", "100", "-0.58", "1.001", "<NULL>"]
    wide = spark.sql("select v from values (1.5D), (-0.0D), (12345678.25D), (0.00001D) t(v)")
    assert [r[0] for r in wide.select(canonical_decimal(F.col("v"))).collect()] == ["1.5", "0", "12345678.25", "0.00001"]
    assert logical_source_key("x", year="2026") == "x|year=2026"
    with pytest.raises(ValueError):
        logical_source_key("x")


def slots(spark, price="50.00"):
    return spark.createDataFrame([("2026-01-01", 1, 1, price, "0.1", "0.0", None), ("2026-01-01", 1, 2, None, None, None, None)], "d string, delivery_hour int, interval int, a string, b string, c string, source_flag string").select(
        F.to_date("d").alias("delivery_date"), "delivery_hour", "interval", *[F.col(x).cast("decimal(18,3)").alias(n) for x, n in zip("abc", PRICES, strict=True)], "source_flag"
    )


PUBLISHED = "delivery_date date, delivery_hour int, interval int, event_id string, observation_hash string, publication_state string"


def test_outbox_and_stream(spark, tmp_path):
    box = outbox.Outbox(spark, str(tmp_path / "box"))
    lineage = {"source_name": "rt", "source_hash": "a" * 64, "publisher_run_id": "p", "poll_id": "q", "source_created_at_raw": "2026-01-01T01:00:00"}
    none = spark.createDataFrame([], PUBLISHED)
    outbox.publish(box, slots(spark), none, lineage)
    version = box.table.version()
    outbox.publish(box, slots(spark), none, lineage)  # the same decision again puts nothing in
    assert box.table.version() == version and box.read().count() == 1
    payload = json.loads(box.read().first().event_payload)
    assert list(payload) == sorted(payload) and payload["zonal_price_capped_cad_per_mwh"] == 50.0 and payload["previous_event_id"] is None

    def broken(event, body):
        raise RuntimeError("no line")

    with pytest.raises(RuntimeError):
        box.dispatch(broken)
    assert (box.read().first().status, box.read().first().last_error) == ("PENDING", "no line")
    claimed = box.claim("dead", now=F.lit("2020-01-01 00:00:00").cast("timestamp"))  # its lease has long run out
    assert claimed and box.claim("other", now=F.lit("2020-01-01 00:01:00").cast("timestamp")) is None
    landing, log = str(tmp_path / "landing"), str(tmp_path / "log")
    (tmp_path / "landing").mkdir()
    assert box.dispatch(outbox.folder_sender(spark, landing)) == 1
    done = box.read().first()
    assert (done.status, done.lease_owner_run_id, done.attempt_count) == ("SENT", None, 3) and done.sent_at_utc
    outbox.folder_sender(spark, landing)(done.event_id, done.event_payload)  # delivered twice
    outbox.stream_to_log(spark, landing, log, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(log).count() == 2 and spark.read.parquet(log).select("event_id").distinct().count() == 1


def test_revision_then_withdrawal(spark, tmp_path):
    box = outbox.Outbox(spark, str(tmp_path / "box"))
    lineage = {"source_created_at_raw": "t1"}
    outbox.publish(box, slots(spark), spark.createDataFrame([], PUBLISHED), lineage)
    published = box.read().select(*[c.split()[0] for c in PUBLISHED.split(", ")]).withColumn("delivery_date", F.to_date("delivery_date"))
    outbox.publish(box, slots(spark, None), published, {"source_created_at_raw": "t2"})
    assert {(r.event_type, r.previous_event_id is None) for r in box.read().collect()} == {("RT_PRICE_OBSERVATION", True), ("RT_PRICE_INVALIDATION", False)}
    assert [outbox.gate(None, "a"), outbox.gate("a", "a"), outbox.gate("a", "b")] == ["BOOTSTRAP", "UNCHANGED", "NEW_REVISION"]


def test_identities_are_the_contract(spark):
    """The hash is of compact JSON with sorted names, the id of its six parts; prices that differ in the third digit differ."""
    row = outbox.observed(slots(spark, "50.10")).orderBy("interval").first()
    state = {"delivery_date": "2026-01-01", "delivery_hour": 1, "interval": 1, PRICES[0]: "50.1", PRICES[1]: "0.1", PRICES[2]: "0", "source_flag": "<NULL>"}
    assert row.observation_hash == hashlib.sha256(json.dumps(state, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() and row.eligible
    assert len({outbox.observed(slots(spark, p)).first().observation_hash for p in ("1.001", "1.004")}) == 2
    decided = outbox.observed(slots(spark)).withColumns({"decision": F.lit("NEW_OBSERVATION"), "previous_event_id": F.lit(None).cast("string")})
    ids = {r.event_id for r in outbox.events_of(decided, {"source_hash": "h" * 64, "source_created_at_raw": None}).collect()}
    assert ids == {hashlib.sha256("|".join(["rt_price_event_v1", "2026-01-01", "1", str(k), "<NULL>", "h" * 64]).encode()).hexdigest() for k in (1, 2)}


def test_batches_are_leased_once_and_settled(spark, tmp_path):
    box = outbox.Outbox(spark, str(tmp_path / "box"))
    many = slots(spark).limit(1).drop("interval").withColumn("interval", F.explode(F.sequence(F.lit(1), F.lit(5))))
    outbox.publish(box, many, spark.createDataFrame([], PUBLISHED), {"source_hash": "a"})
    first, second = box.claims("one", 3), box.claims("two", 9)
    assert (len(first), len(second)) == (3, 2) and not {x for x, _ in first} & {x for x, _ in second}
    box.settle("one", [first[0][0]], first[1][0], "no line", [first[2][0]])
    box.settle("two", [x for x, _ in first])  # not its own
    assert {(r.status, r.last_error, r.n) for r in box.read().groupBy("status", "last_error").agg(F.count("*").alias("n")).collect()} == {("SENT", None, 1), ("PENDING", "no line", 1), ("PENDING", None, 1), ("SENDING", None, 2)}
    versions = box.table.version()
    assert box.dispatch(lambda event, body: None) == 2 and box.table.version() == versions + 2


def test_checkpoint_gates_polls(spark, tmp_path):
    points = outbox.SourceCheckpoints(spark, str(tmp_path / "cp"))
    assert points.gate("rt", "a") == "BOOTSTRAP"
    points.complete("rt", "a", "/x", "run")
    points.polled("rt")
    assert [points.gate("rt", "a"), points.gate("rt", "b"), points.gate("other", "a")] == ["UNCHANGED", "NEW_REVISION", "BOOTSTRAP"]
