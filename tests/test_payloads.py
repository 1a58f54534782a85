"""Payloads as sources send them: quoted commas, headers that come twice or late, short and long days, several files, and what sketches of rules see."""

import pytest
from pyspark.sql import functions as F

from halyard.functions.typing import typed
from halyard.plans import quality
from halyard.plans.contracts import CONTRACTS
from halyard.sources import delimited

HEAD = "Date,Hour,Market Demand,Ontario Demand"
CONTRACT = CONTRACTS["market_demand_hourly"]


def written(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")
    return str(folder)


def day(date, hours):
    return [f"{date},{h},{100 + h},{90 + h}" for h in hours]


def test_fields_with_commas_and_padded_names(spark, tmp_path):
    path = written(tmp_path / "p", "a.csv", "\\made by hand", 'Date, Hour ,"Market Demand",Ontario Demand', '2026-03-01,1,"12,345",7', '2026-03-01,2,"",8')
    rows = delimited.read_after_header(spark, path, {"Date": "d", "Hour": "h", "Market Demand": "m", "Ontario Demand": "o"}).orderBy("h").collect()
    assert [(r.h, r.m, r.o, r._source_row_number) for r in rows] == [("1", "12,345", "7", 1), ("2", None, "8", 2)] or rows[1].m == ""
    said = {r.rule_id: r.records_failed for r in quality.evaluate(typed(delimited.read_demand(spark, path), CONTRACT.typing()), CONTRACT).collect()}
    assert said["market_demand_mw_numeric"] == 1 and said["market_demand_mw_present"] == 1  # a number with a comma is none


@pytest.mark.parametrize("lines", [[HEAD, HEAD, "2026-03-01,1,2,3"], [f"\\line {k}" for k in range(60)] + [HEAD, "2026-03-01,1,2,3"], ["Date,Hour,Market Demand", "2026-03-01,1,2"], ["Hour,Date,Market Demand,Ontario Demand", "1,2026-03-01,2,3"]])
def test_headers_that_cannot_be_told(spark, tmp_path, lines):
    """Twice, beyond the lines that are searched, a column short, and in another order."""
    with pytest.raises(ValueError, match="header"):
        delimited.read_demand(spark, written(tmp_path / "p", "a.csv", *lines))


def test_days_of_23_and_25_rows_in_several_files(spark, tmp_path):
    """Clock changes: a day lacks an hour, another has one twice; each file's rows are numbered from its own header."""
    written(tmp_path / "p", "a.csv", "\\one", HEAD, *day("2026-03-08", [h for h in range(1, 25) if h != 3]))
    path = written(tmp_path / "p", "b.csv", HEAD, *day("2026-11-01", [*range(1, 25), 2]), *day("2026-11-02", range(1, 25)))
    rows = delimited.read_demand(spark, path, "file")
    assert {(r.file[-5:], r.n, r.top) for r in rows.groupBy("file").agg(F.count("*").alias("n"), F.max("_source_row_number").alias("top")).collect()} == {("a.csv", 23, 23), ("b.csv", 49, 49)}
    facts = typed(rows, CONTRACT.typing())
    days = {r.rule_id: (r.severity, r.records_failed) for r in quality.coverage_rules(facts, "market_date", 24).collect()}
    assert days == {"historical_days_complete": ("WARN", 2), "latest_day_complete": ("PASS", 0)}
    keys = next(r for r in quality.evaluate(facts, CONTRACT).collect() if r.rule_id == "duplicate_business_key")
    good, bad = quality.split_quarantine(facts, CONTRACT)
    assert (keys.severity, keys.records_failed) == ("FAIL", 1) and good.count() == 70 and {tuple(r._rules) for r in bad.collect()} == {("duplicate_business_key",)}


def test_files_with_other_headers_are_refused(spark, tmp_path):
    written(tmp_path / "p", "a.csv", HEAD, "2026-03-01,1,2,3")
    path = written(tmp_path / "p", "b.csv", HEAD + ",More", "2026-03-01,1,2,3,4")
    with pytest.raises(ValueError, match="header"):
        delimited.read_demand(spark, path)
