import pytest
from pyspark.sql import functions as F

from halyard.functions.typing import typed
from halyard.plans import quality
from halyard.plans.contracts import CONTRACTS
from halyard.plans.store import ConstraintViolation
from halyard.sources import delimited, documents, landing

DEMAND = "\\\\ Hourly report\n\\\\ created today\nDate,Hour,Market Demand,Ontario Demand\n2026-01-01,1,17310,16905\n2026-01-01,2,17420,17011\n"


def test_header_after_preamble(spark, tmp_path):
    (tmp_path / "d.csv").write_text(DEMAND)
    rows = delimited.read_demand(spark, str(tmp_path / "d.csv")).orderBy("_source_row_number").collect()
    assert [tuple(r) for r in rows] == [("2026-01-01", "1", "17310", "16905", 1), ("2026-01-01", "2", "17420", "17011", 2)]


@pytest.mark.parametrize("body", ["no header\n1,2\n", "Date,Hour,Market Demand,Ontario Demand\nDate,Hour,Market Demand,Ontario Demand\n", "Hour,Date,Market Demand,Ontario Demand\n1,2,3,4\n"])
def test_header_has_to_be_there_once_and_exact(spark, tmp_path, body):
    (tmp_path / "d.csv").write_text(body)
    with pytest.raises(ValueError):
        delimited.read_demand(spark, str(tmp_path / "d.csv")).collect()


def test_zonal_is_ten_rows_each(spark, tmp_path):
    head = ",".join(["Date", "Hour", "Ontario Demand", *delimited.ZONES, "Zone Total", "Diff"])
    (tmp_path / "z.csv").write_text(f"\\x\n{head}\n2026-01-01,1,100,{','.join('123456789')},10,55,-45\n")
    wide = delimited.read_zonal_demand(spark, str(tmp_path / "z.csv"))
    zones = {z: f"{z.lower()}_raw" for z in delimited.ZONES}
    long = delimited.zonal_long(wide, zones)
    assert long.count() == 10 and {r.zone for r in long.collect()} == set(delimited.ZONES)


GENERATION = """<?xml version="1.0"?><Document xmlns="http://x/y"><DocBody><DailyData><Day>2026-01-01</Day>
<HourlyData><Hour>1</Hour><FuelTotal><Fuel>NUCLEAR</Fuel><EnergyValue><OutputQuality>0</OutputQuality><Output>9000</Output></EnergyValue></FuelTotal>
<FuelTotal><Fuel>GAS</Fuel><EnergyValue><OutputQuality>-1</OutputQuality></EnergyValue></FuelTotal></HourlyData></DailyData></DocBody></Document>"""
REALTIME = """<?xml version="1.0"?><Document xmlns="http://x/y"><DocHeader><DocRevision>1</DocRevision><CreatedAt>2026-01-01T01:00:00</CreatedAt></DocHeader><DocBody><DeliveryDate>2026-01-01</DeliveryDate><DeliveryHour>1</DeliveryHour>
<ZonalPrice><Interval>1</Interval><Flag>DSO</Flag><LmpCap>-5.00</LmpCap><LossPriceCap>0.10</LossPriceCap><CongPriceCap>0.00</CongPriceCap></ZonalPrice>
<ZonalPrice><Interval>2</Interval><LmpCap></LmpCap></ZonalPrice><AveragePrice><LmpCap>1</LmpCap></AveragePrice></DocBody></Document>"""
DAY_AHEAD = """<?xml version="1.0"?><Document xmlns="http://x/y"><DocBody><DeliveryDate>2026-01-02</DeliveryDate>
<HourlyPriceComponents><PricingHour>1</PricingHour><ZonalPrice>30.1</ZonalPrice></HourlyPriceComponents><HourlyPriceComponents><PricingHour>2</PricingHour><ZonalPrice/></HourlyPriceComponents></DocBody></Document>"""


def test_documents(spark, tmp_path):
    for name, body in (("g", GENERATION), ("r", REALTIME), ("d", DAY_AHEAD)):
        (tmp_path / f"{name}.xml").write_text(body)
    rows = documents.read_generation(spark, str(tmp_path / "g.xml")).collect()
    assert [tuple(r) for r in rows] == [("2026-01-01", "1", "NUCLEAR", "9000", "0", 1), ("2026-01-01", "1", "GAS", None, "-1", 2)]
    rows = documents.read_realtime(spark, str(tmp_path / "r.xml")).collect()
    assert [(r.interval_raw, r.flag_raw, r.lmp_cap_raw, r.created_at_raw) for r in rows] == [("1", "DSO", "-5.00", "2026-01-01T01:00:00"), ("2", None, None, "2026-01-01T01:00:00")]
    rows = documents.read_day_ahead(spark, str(tmp_path / "d.xml")).collect()
    assert [(r.market_date_raw, r.hour_ending_raw, r.zonal_price_raw) for r in rows] == [("2026-01-02", "1", "30.1"), ("2026-01-02", "2", None)]
    assert "Document/DocHeader/CreatedAt" in documents.element_paths(spark, str(tmp_path / "r.xml"), "Document")


def demand(spark, *rows):
    raw = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "date_raw string, hour_raw string, market_demand_raw string, ontario_demand_raw string, _source_row_number long")
    return typed(raw, CONTRACTS["market_demand_hourly"].typing())


@pytest.mark.parametrize(
    ("rows", "rule"),
    [
        ([("2026-01-01", "1", "17310", "16905"), ("2026-01-01", "1", "17420", "17011")], "duplicate_business_key"),
        ([("2026-01-01", "1", "12,5x", "16905")], "market_demand_mw_numeric"),
        ([("2026-01-01", "25", "1", "2")], "hour_ending_domain"),
        ([("2026-01-01", "1", None, "2")], "market_demand_mw_present"),
        ([(None, "1", "1", "2")], "business_key_not_null"),
    ],
)
def test_rules_fail(spark, rows, rule):
    contract = CONTRACTS["market_demand_hourly"]
    with pytest.raises(ConstraintViolation, match=rule):
        quality.validated(demand(spark, *rows), contract)
    good, bad = quality.split_quarantine(demand(spark, ("2026-01-02", "3", "1", "2"), *rows), contract)
    assert good.count() == 1 and all(rule in r["_rules"] for r in bad.collect())


def test_null_output_is_an_observation(spark):
    contract = CONTRACTS["generation_hourly"]
    raw = spark.createDataFrame([("2026-07-15", "1", "BIOFUEL", None, "-1")], "date_raw string, hour_raw string, fuel_type_raw string, output_raw string, output_quality_raw string")
    said = quality.validated(typed(raw, contract.typing()), contract)
    assert said["output_mwh_null"] == 1 and "output_mwh_numeric" not in said


@pytest.mark.parametrize(("last", "partial", "empty"), [((None, None, None), 0, 1), (("41.30", None, None), 1, 0)])
def test_partial_and_empty_slots(spark, last, partial, empty):
    contract = CONTRACTS["realtime_price_5min"]
    rows = [("2026-01-01", "1", str(k), None, "41.30", "0.07", "-0.15") for k in range(1, 12)] + [("2026-01-01", "1", "12", None, *last)]
    raw = spark.createDataFrame(rows, "delivery_date_raw string, delivery_hour_raw string, interval_raw string, flag_raw string, lmp_cap_raw string, loss_price_cap_raw string, cong_price_cap_raw string")
    said = quality.validated(typed(raw, contract.typing()), contract)
    assert (said.get("partially_populated", 0), said.get("fully_empty", 0)) == (partial, empty) and said["congestion_price_capped_cad_per_mwh_negative"] == 11


def test_registry_states(spark, tmp_path):
    registry = landing.Registry(spark, str(tmp_path / "registry"))
    send = lambda payload: landing.ingest(spark, registry, str(tmp_path / "bronze"), "demand", "demand|year=2026", "d.csv", payload)
    first = send(b"one")
    assert first["classification"] == "NEW" and not first["reused_existing"]
    assert send(b"one")["classification"] == "UNCHANGED" and send(b"two")["classification"] == "REVISED"
    registry.fail("demand|year=2026", landing.payload_hash(b"two"))
    again = send(b"two")
    assert again["classification"] == "RECOVER" and again["reused_existing"]
    assert registry.current("demand").first().source_hash == landing.payload_hash(b"two")
    assert registry.orphans(landing.files_with_hash(spark, str(tmp_path / "bronze"))).count() == 0
    with pytest.raises(RuntimeError, match="SHA-256"):
        landing.persist_once(spark, b"x", str(tmp_path / "bronze/x"), "0" * 64)


def test_lineage_and_results(spark, tmp_path):
    contract = CONTRACTS["market_demand_hourly"]
    row = {"source_name": "demand", "source_file": "d.csv", "source_url": "", "source_hash": "a" * 64, "run_id": "r", "source_version": None, "source_created_at": None}
    df = landing.with_lineage(demand(spark, ("2026-01-01", "1", "1", "2")), row)
    assert {r.rule_id: r.severity for r in quality.five_rules(df, df, contract).collect()} == dict.fromkeys(["row_count_matches", "missing_rows", "unexpected_rows", "duplicate_business_key", "required_lineage"], "PASS")
    bare = {r.rule_id: r.records_failed for r in quality.five_rules(df, df.drop("_run_id"), contract).collect()}
    assert bare["required_lineage"] == 1 and bare["missing_rows"] == 0  # a fact without one of the columns fails in every row
    results = quality.results_table(spark, str(tmp_path / "dq"))
    results.merge(quality.result_rows(spark, quality.evaluate(df, contract), "r1", contract))
    results.merge(quality.result_rows(spark, quality.evaluate(df, contract), "r1", contract, at=F.lit("2026-01-01").cast("timestamp")))
    assert results.read().count() == len(quality.rules_of(contract, df.columns)) + 1


def test_totals_with_nulls(spark):
    """A null part adds nothing; a null total, measure or difference agrees with nothing."""
    wide = spark.createDataFrame([(1, 2, 3, 1, 2), (1, None, 1, 1, 0), (None, None, None, 1, None), (1, 1, 2, None, 1), (1, 1, 5, 1, 4)], "a int, b int, total int, other int, diff int")
    assert {r.rule_id: r.records_failed for r in quality.total_rules(wide, ["a", "b"], "total", "other", "diff").collect()} == {"parts_sum_to_total": 2, "difference_is_consistent": 2}


def test_freshness_by_source(spark):
    rows = spark.createDataFrame([("2026-01-01", h, "2026-01-01 23:00:00") for h in range(1, 25)] + [("2026-01-02", h, "2026-01-02 05:00:00") for h in (1, 3)], "d string, h int, i string").withColumn("d", F.to_date("d"))
    hourly = quality.Freshness(rows, "d", F.col("h") * 60, 24, 60, ingested="i")
    whole = quality.Freshness(rows.filter("d < date'2026-01-02'"), "d", F.col("h") * 60, 24, 60)
    said = {r.source_name: r for r in quality.freshness_by_source({"a": hourly, "b": whole, "c": quality.Freshness(rows.limit(0), "d", F.col("h") * 60, 24, 60)}, F.lit("2026-01-02 03:30:00").cast("timestamp")).collect()}
    assert (said["a"].latest_day_rows, said["a"].is_complete, said["a"].lag_minutes, said["a"].is_late, said["a"].last_ingested) == (2, False, 30, False, "2026-01-02 05:00:00")
    assert (said["b"].is_complete, said["b"].lag_minutes, said["b"].is_late) == (True, 210, True) and (said["c"].latest_day, said["c"].is_late) == (None, True)


def test_a_stub_that_a_lost_writer_left_is_replaced(spark, tmp_path):
    place, payload = tmp_path / "bronze" / "p.csv", b"Date,Hour"
    place.parent.mkdir()
    place.write_bytes(b"Dat")
    assert landing.persist_once(spark, payload, str(place), landing.payload_hash(payload))["reused_existing"] is False
    assert place.read_bytes() == payload and [p.name for p in place.parent.iterdir() if not p.name.endswith(".crc")] == ["p.csv"]
    assert landing.persist_once(spark, payload, str(place), landing.payload_hash(payload))["reused_existing"] is True
    place.write_bytes(b"Other one")
    with pytest.raises(RuntimeError, match="differs"):
        landing.persist_once(spark, payload, str(place), landing.payload_hash(payload))


def test_rules_are_counted_with_the_write(spark, tmp_path):
    """The same rules as a second scan gives, from one scan."""
    contract = CONTRACTS["market_demand_hourly"]
    demand(spark, ("2026-01-01", "1", "1", "2"), ("2026-01-01", "77", "N/A", ""), ("", "3", "-1", "1")).write.parquet(str(tmp_path / "in"))
    typed_rows = spark.read.parquet(str(tmp_path / "in"))
    rows, results = quality.observed(typed_rows, contract)
    rows.write.parquet(str(tmp_path / "out"))
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    want = {tuple(r) for r in quality.evaluate(typed_rows, contract).collect() if r.rule_id != "duplicate_business_key"}
    assert {tuple(r) for r in results().collect()} == want and spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_documents_in_blocks_and_parts(spark, tmp_path):
    """A document that is read in blocks of a few hundred bytes, as a file and as a folder of parts, numbered through; empty elements, entities, prefixes and comments in it."""
    hours = [f"<HourlyPriceComponents><PricingHour>{k}</PricingHour><ZonalPrice>{k} &lt; <![CDATA[<x>]]></ZonalPrice></HourlyPriceComponents>" for k in range(1, 200)]
    hours[49] = "<HourlyPriceComponents/>"
    hours[50] = "<!-- <HourlyPriceComponents> --><HourlyPriceComponents><p:PricingHour>51</p:PricingHour></HourlyPriceComponents>"
    lines = ["<Document><DocBody><DeliveryDate>2026-01-02</DeliveryDate>", *hours, "</DocBody></Document>"]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "d.xml").write_text("\n".join(lines))
    (tmp_path / "many").mkdir()
    for k in range(0, len(lines), 67):
        (tmp_path / "many" / f"part-{k:05}.xml").write_text("\n".join(lines[k : k + 67]) + "\n")
    want = [(k, str(k), f"{k} < <x>") if k not in (50, 51) else (k, None if k == 50 else "51", None) for k in range(1, 200)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        for folder, parts in (("one", False), ("many", True)):
            df = documents.read_day_ahead(spark, str(tmp_path / folder), "file", parts)
            rows = sorted(df.collect(), key=lambda r: r._source_record_number)
            assert [(r._source_record_number, r.hour_ending_raw, r.zonal_price_raw) for r in rows] == want
            assert {r.market_date_raw for r in rows} == {"2026-01-02"} and len({r.file for r in rows}) == 1
            tags = {r.element: r.n for r in documents.tag_counts(spark, str(tmp_path / folder), parts).collect()}
            assert tags["HourlyPriceComponents"] == 199 and tags["PricingHour"] == 198
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_records_that_cannot_be_cut_are_refused(spark, tmp_path):
    (tmp_path / "d.xml").write_text(DAY_AHEAD.replace("</HourlyPriceComponents>", "</n:HourlyPriceComponents>").replace("<HourlyPriceComponents>", "<n:HourlyPriceComponents>"))
    with pytest.raises(Exception, match="prefix"):
        documents.read_day_ahead(spark, str(tmp_path / "d.xml")).collect()


def test_payloads_are_written_by_many_tasks(spark, tmp_path):
    """One payload's lines are in several files, in order; none is the whole of it."""
    from halyard.market_queries import _written

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = spark.range(1000).select(F.lit(1).alias("payload"), F.col("id").alias("at"), F.col("id").cast("string").alias("line"))
        path = _written(lines, "payload", ["at"], str(tmp_path / "w"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [len(f.read_text().split()) for f in (tmp_path / "w" / "payload=1").glob("part-*")]
    assert len(sizes) > 1 and max(sizes) < 1000
    got = {r.line_number: r.line for r in delimited.numbered_lines(spark, path, parts=True).collect()}
    assert got == {k + 1: str(k) for k in range(1000)}
