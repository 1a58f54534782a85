"""Data quality: rules of a contract in one aggregate, results as rows, their persistence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from halyard.functions.audit import any_null, completeness, duplicate_keys, required_headers
from halyard.functions.typing import blank_to_null, malformed
from halyard.operators.series import population_state
from halyard.plans.contracts import REQUIRED_LINEAGE, Contract
from halyard.plans.store import ConstraintViolation, VersionedTable, reconcile

FAIL, WARN, PASS = "FAIL", "WARN", "PASS"
RESULT = "run_id string, source_name string, dataset_name string, rule_id string, rule_category string, severity string, status string, records_checked long, records_failed long, observed_value string, expected_value string, execution_timestamp timestamp, details string"


def rules_of(contract: Contract, columns: list[str]) -> dict[str, tuple[str, Column]]:
    """rule -> (severity when hit, rows that hit it); observation rules are PASS whatever they count."""
    out: dict[str, tuple[str, Column]] = {"business_key_not_null": (FAIL, any_null(list(contract.keys)))}
    for key, (lo, hi) in contract.domains.items():
        out[f"{key}_domain"] = (FAIL, ~F.col(key).between(lo, hi))
    for name, (raw, kind) in contract.typing().items():
        if raw in columns and kind != "string":
            out[f"{name}_numeric" if name not in contract.keys else f"{name}_parses"] = (FAIL, malformed(raw, name))
    for name in contract.required:
        out[f"{name}_present"] = (FAIL, (blank_to_null(F.col(contract.typing()[name][0])).isNull() if contract.typing()[name][0] in columns else F.col(name).isNull()))
    for name in contract.measures:
        out[f"{name}_null"], out[f"{name}_negative"] = (PASS, F.col(name).isNull()), (PASS, F.col(name) < 0)
    if len(contract.measures) > 1 and not contract.required:
        state = population_state(list(contract.measures))
        out["partially_populated"], out["fully_empty"] = (WARN, state == "PARTIALLY_POPULATED"), (PASS, state == "FULLY_EMPTY")
    return out


def evaluate(typed: DataFrame, contract: Contract) -> DataFrame:
    """(rule_id, severity, records_checked, records_failed, is_observation): every rule of a contract from one aggregate, and its keys from another.

    Of an observation, which cannot fail, records_failed is what was observed.
    """
    rules = rules_of(contract, typed.columns)
    counts = typed.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.coalesce(hit, F.lit(False))).alias(rule) for rule, (_, hit) in rules.items()])
    keys = duplicate_keys(typed, list(contract.keys)).agg(F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("duplicate_business_key"))
    wanted = {"duplicate_business_key": FAIL} | {rule: worst for rule, (worst, _) in rules.items()}
    each = [F.struct(F.lit(rule).alias("rule_id"), F.lit(worst).alias("worst"), F.col("_n").alias("records_checked"), F.col(rule).cast("long").alias("records_failed")) for rule, worst in wanted.items()]
    rows = counts.crossJoin(F.broadcast(keys)).select(F.explode(F.array(*each)).alias("r")).select("r.*")  # a row each
    return rows.select("rule_id", F.when(F.col("records_failed") > 0, F.col("worst")).otherwise(PASS).alias("severity"), "records_checked", "records_failed", (F.col("worst") == PASS).alias("is_observation"))


def observed(typed: DataFrame, contract: Contract) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """The rows, and a function that gives the rules' results (as evaluate() does) once they have been written: what breaks a rule is
    counted as the rows go by, so they are computed and read once.

    Keys that come twice can't be counted in passing; a keyed merge refuses them, and evaluate() counts them.
    """
    rules, seen = rules_of(contract, typed.columns), Observation()
    out = typed.observe(seen, F.count(F.lit(1)).alias("_n"), *[F.count_if(F.coalesce(hit, F.lit(False))).alias(rule) for rule, (_, hit) in rules.items()])

    def results() -> DataFrame:
        counts = seen.get
        rows = [(rule, worst if counts[rule] else PASS, counts["_n"], counts[rule], worst == PASS) for rule, (worst, _) in rules.items()]
        return typed.sparkSession.createDataFrame(rows, "rule_id string, severity string, records_checked long, records_failed long, is_observation boolean")

    return out, results


def validated(typed: DataFrame, contract: Contract) -> dict[str, int]:
    """rule -> rows of the rules that hit; raises, naming them, if one of them fails."""
    found = {r.rule_id: (r.severity, r.records_failed) for r in evaluate(typed, contract).filter("records_failed > 0").collect()}
    failed = sorted(rule for rule, (severity, _) in found.items() if severity == FAIL)
    if failed:
        raise ConstraintViolation(", ".join(f"{rule}={found[rule][1]}" for rule in failed))
    return {rule: n for rule, (_, n) in found.items()}


def split_quarantine(typed: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """Rows that may go on and rows that may not, the latter with the rules they hit."""
    hits = [F.when(F.coalesce(hit, F.lit(False)), F.lit(rule)) for rule, (worst, hit) in rules_of(contract, typed.columns).items() if worst == FAIL]
    marked = typed.withColumn("_rules", F.array_compact(F.array(*hits)))
    copies = duplicate_keys(typed, list(contract.keys)).select(*contract.keys, F.lit(True).alias("_copy"))
    marked = marked.join(copies, list(contract.keys), "left").withColumn("_rules", F.when(F.col("_copy"), F.array_append("_rules", F.lit("duplicate_business_key"))).otherwise(F.col("_rules"))).drop("_copy")
    return marked.filter(F.size("_rules") == 0).drop("_rules"), marked.filter(F.size("_rules") > 0)


def five_rules(source: DataFrame, target: DataFrame, contract: Contract) -> DataFrame:
    """(rule_id, severity, records_failed) of a fact against its source: counts, both directions, keys, lineage.

    A fact that lacks a required lineage column fails in every row.
    """
    columns = list(contract.columns)
    two = reconcile(source, target, columns, list(contract.keys))
    lacking = any_null(REQUIRED_LINEAGE) if set(REQUIRED_LINEAGE) <= set(target.columns) else F.lit(True)
    lineage = target.agg(F.count_if(lacking).alias("required_lineage"))
    rules = {"row_count_matches": F.abs(F.col("source_rows") - F.col("target_rows")), "missing_rows": F.col("missing_from_target"), "unexpected_rows": F.col("unexpected_in_target"), "duplicate_business_key": F.col("duplicate_keys"), "required_lineage": F.col("required_lineage")}
    each = F.array(*[F.struct(F.lit(r).alias("rule_id"), n.cast("long").alias("records_failed")) for r, n in rules.items()])
    return two.crossJoin(F.broadcast(lineage)).select(F.explode(each).alias("r")).select("r.*").withColumn("severity", F.when(F.col("records_failed") > 0, FAIL).otherwise(PASS))


def result_rows(spark: SparkSession, rules: DataFrame, run_id: str, contract: Contract, category: str = "CONTRACT", at: Column | None = None) -> DataFrame:
    """Rules as results (RESULT). An observation has no failed records, and what it counted is its observed value."""
    seen = F.col("is_observation") if "is_observation" in rules.columns else F.lit(False)
    present = lambda c, kind, otherwise=None: (F.col(c) if c in rules.columns else F.lit(otherwise)).cast(kind)
    return rules.select(
        F.lit(run_id).alias("run_id"), F.lit(contract.source_name).alias("source_name"), F.lit(contract.dataset).alias("dataset_name"), "rule_id", F.when(seen, "OBSERVATION").otherwise(category).alias("rule_category"), "severity",
        F.lit("COMPLETED").alias("status"), present("records_checked", "long").alias("records_checked"), F.when(~seen, present("records_failed", "long")).alias("records_failed"),
        F.coalesce(present("observed_value", "string"), present("records_failed", "string")).alias("observed_value"), F.when(~seen, present("expected_value", "string", "0 failures")).alias("expected_value"),
        (F.current_timestamp() if at is None else at).alias("execution_timestamp"), present("details", "string").alias("details"),
    )


def warnings(counts: DataFrame, checked: Column, rules: dict[str, Column]) -> DataFrame:
    """(rule_id, severity, records_checked, records_failed, is_observation) from a row of counts: rules that warn when they count anything."""
    each = F.array(*[F.struct(F.lit(rule).alias("rule_id"), F.coalesce(n, F.lit(0)).cast("long").alias("records_failed")) for rule, n in rules.items()])
    rows = counts.select(checked.cast("long").alias("records_checked"), F.explode(each).alias("r"))
    return rows.select("r.rule_id", F.when(F.col("r.records_failed") > 0, WARN).otherwise(PASS).alias("severity"), "records_checked", "r.records_failed", F.lit(False).alias("is_observation"))


def coverage_rules(typed: DataFrame, day: str, expected: int) -> DataFrame:
    """Days before the latest that lack rows, and whether the latest lacks some."""
    days = completeness(typed.filter(F.col(day).isNotNull()), F.col(day), expected)
    counts = days.agg(F.count(F.lit(1)).alias("days"), F.count_if(F.col("state") == "INCOMPLETE").alias("old"), F.count_if(F.col("state") == "LATEST_PARTIAL").alias("latest"))
    return warnings(counts, F.col("days"), {"historical_days_complete": F.col("old"), "latest_day_complete": F.col("latest")})


def unseen_rules(df: DataFrame, known: dict[str, list]) -> DataFrame:
    """For each column the rows with a value outside its known set; such rows are kept and warned of."""
    rules = {f"{c}_known": F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(values)) for c, values in known.items()}
    named = [n.alias(rule) for rule, n in rules.items()]
    return warnings(df.agg(F.count(F.lit(1)).alias("_n"), *named), F.col("_n"), {rule: F.col(rule) for rule in rules})


def header_rules(spark: SparkSession, found: list[str], required: list[str]) -> DataFrame:
    """A missing column fails, one that is new is warned of."""
    missing, more = required_headers(found, required)
    rows = [("required_columns", FAIL if missing else PASS, len(required), len(missing), False, ", ".join(missing)), ("known_columns", WARN if more else PASS, len(found), len(more), False, ", ".join(more))]
    return spark.createDataFrame(rows, "rule_id string, severity string, records_checked long, records_failed long, is_observation boolean, details string")


def total_rules(wide: DataFrame, parts: list[str], total: str, other: str, difference: str) -> DataFrame:
    """Rows whose parts don't add up to the total, and whose difference isn't the total less the other measure.

    A part that is null adds nothing; where a total, measure or difference is null, nothing can agree with it.
    """
    deltas = sum_deltas(wide, parts, total, other, difference)
    counts = deltas.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.coalesce(F.col(c) != 0, F.lit(True))).alias(n) for c, n in (("sum_delta", "a"), ("difference_delta", "b"))])
    return warnings(counts, F.col("_n"), {"parts_sum_to_total": F.col("a"), "difference_is_consistent": F.col("b")})


def freshness(df: DataFrame, day: str, parts: list[str], expected: int, created: str | None = None, ingested: str | None = None) -> DataFrame:
    """One row: how far a dataset reaches, and whether its latest day is whole: latest_day, the largest of each of parts on it,
    latest_day_rows, expected_rows, is_complete, last_created, last_ingested."""
    when = lambda c: (F.max(c) if c else F.max(F.lit(None).cast("string"))).cast("string")
    days = df.filter(F.col(day).isNotNull()).groupBy(day).agg(F.count(F.lit(1)).alias("n"), *[F.max(p).alias(p) for p in parts], when(created).alias("_c"), when(ingested).alias("_i"))
    last = days.agg(F.max_by(F.struct(day, "n", *parts), day).alias("l"), F.max("_c").alias("last_created"), F.max("_i").alias("last_ingested"))
    return last.select(F.col(f"l.{day}").alias("latest_day"), *[F.col(f"l.{p}").alias(f"latest_{p}") for p in parts], F.col("l.n").alias("latest_day_rows"), F.lit(expected).cast("long").alias("expected_rows"), (F.col("l.n") >= expected).alias("is_complete"), "last_created", "last_ingested")


@dataclass(frozen=True)
class Freshness:
    """What a source's freshness is judged by: its rows, their day, the minutes of that day which a row reaches, the rows of a whole day, and
    how many minutes apart the source gives new ones; columns of when rows were made and taken in."""

    rows: DataFrame
    day: str
    reaches: Column
    expected: int
    cadence: int
    created: str | None = None
    ingested: str | None = None


def freshness_by_source(sources: dict[str, Freshness], now: Column | None = None, patience: int = 2) -> DataFrame:
    """A row a source: source_name, latest_day, latest_day_rows, expected_rows, is_complete, reached_at, lag_minutes, cadence_minutes, is_late, last_created, last_ingested.

    A source is late when what it has ends more than patience times its cadence before now, or has nothing; the latest day alone says
    neither that nor whether that day is whole.
    """
    now = F.current_timestamp() if now is None else now
    text = lambda c: (F.max(c) if c else F.max(F.lit(None).cast("string"))).cast("string")
    out = []
    for name, s in sources.items():
        days = s.rows.filter(F.col(s.day).isNotNull()).groupBy(F.col(s.day).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max(s.reaches).alias("m"), text(s.created).alias("c"), text(s.ingested).alias("i"))
        last = days.agg(F.max_by(F.struct("day", "n", "m"), "day").alias("l"), F.max("c").alias("last_created"), F.max("i").alias("last_ingested"))
        at = F.unix_seconds(F.col("l.day").cast("timestamp")) + F.col("l.m").cast("long") * 60
        row = last.select(
            F.lit(name).alias("source_name"), F.col("l.day").alias("latest_day"), F.col("l.n").alias("latest_day_rows"), F.lit(s.expected).cast("long").alias("expected_rows"), F.coalesce(F.col("l.n") >= s.expected, F.lit(False)).alias("is_complete"),
            F.timestamp_seconds(at).alias("reached_at"), F.floor((F.unix_seconds(now) - at) / 60).cast("long").alias("lag_minutes"), F.lit(s.cadence).cast("long").alias("cadence_minutes"), "last_created", "last_ingested",
        )
        out.append(row.withColumn("is_late", F.coalesce(F.col("lag_minutes") > s.cadence * patience, F.lit(True))))
    return reduce(DataFrame.unionByName, out)


def average_differences(slots: DataFrame, prices: list[str], reported: DataFrame, keys: list[str]) -> DataFrame:
    """keys, and for each price the reported average, that of the fully populated slots at two digits, and reported less calculated."""
    whole = slots.filter(population_state(prices) == "FULLY_POPULATED").groupBy(*keys).agg(*[F.round(F.avg(p), 2).alias(f"calculated_{p}") for p in prices])
    both = reported.select(*keys, *[F.col(p).alias(f"reported_{p}") for p in prices]).join(whole, keys, "left")
    return both.withColumns({f"difference_{p}": F.col(f"reported_{p}") - F.col(f"calculated_{p}") for p in prices})


def results_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, ["run_id", "source_name", "dataset_name", "rule_id"])


def unseen_values(df: DataFrame, column: str, known: list) -> DataFrame:
    """(column, n): values outside a known set; they are kept and warned of."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(known)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def sum_deltas(df: DataFrame, parts: list[str], total: str, other: str, difference: str) -> DataFrame:
    """df with sum_delta (parts less total; null parts add nothing) and difference_delta (total less other less difference)."""
    added = reduce(lambda a, b: a + b, [F.coalesce(F.col(p), F.lit(0)) for p in parts])
    return df.withColumn("sum_delta", added - F.col(total)).withColumn("difference_delta", F.col(total) - F.col(other) - F.col(difference))
