"""Serving contracts: parameterised lookups. An optional parameter that is None does not filter, a required one returns nothing."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.audit import top_by_magnitude
from halyard.plans.contracts import CALLED, CONTRACTS, PRICES, STATUS

MISSING_BOTH, MISSING_LEFT, MISSING_RIGHT, INCOMPLETE, COMPARABLE = "MISSING_BOTH", "MISSING_DAY_AHEAD", "MISSING_REALTIME", "INCOMPLETE_PRICE_COMPONENTS", "COMPARABLE"


def normalised(value: Column) -> Column:
    return F.upper(F.trim(value))


def lookup(df: DataFrame, required: dict[str, object], optional: dict[str, object] | None = None, loosely: dict[str, str | None] | None = None) -> DataFrame:
    """Rows that match: required values, optional ones where given, and strings where given without regard to case and blanks."""
    if any(v is None for v in required.values()):
        return df.filter(F.lit(False))
    conditions = [F.col(c) == F.lit(v) for c, v in required.items()]
    conditions += [F.col(c) == F.lit(v) for c, v in (optional or {}).items() if v is not None]
    conditions += [normalised(F.col(c)) == normalised(F.lit(v)) for c, v in (loosely or {}).items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, conditions, F.lit(True)))


def compare_state(left_there: Column, right_there: Column, pairs: list[tuple[Column, Column]]) -> Column:
    incomplete = reduce(lambda a, b: a | b, [x.isNull() | y.isNull() for x, y in pairs])
    return (
        F.when(~left_there & ~right_there, MISSING_BOTH).when(~left_there, MISSING_LEFT).when(~right_there, MISSING_RIGHT).when(incomplete, INCOMPLETE).otherwise(COMPARABLE)
    )


def compared(keys: DataFrame, left: DataFrame, right: DataFrame, on_left: list[str], on_right: list[str], measures: dict[str, tuple[str, str]]) -> DataFrame:
    """keys with both sides' measures, their deltas (right less left, null if either is) and the comparison's state.

    measures: name -> (column of left, column of right).
    """
    a = left.select(*on_left, F.lit(True).alias("_left"), *[F.col(x).alias(f"left_{n}") for n, (x, _) in measures.items()])
    b = right.select(*on_right, F.lit(True).alias("_right"), *[F.col(y).alias(f"right_{n}") for n, (_, y) in measures.items()])
    both = keys.join(a, on_left, "left").join(b, on_right, "left")
    there = lambda c: F.coalesce(F.col(c), F.lit(False))
    state = compare_state(there("_left"), there("_right"), [(F.col(f"left_{n}"), F.col(f"right_{n}")) for n in measures])
    deltas = {f"delta_{n}": F.col(f"right_{n}") - F.col(f"left_{n}") for n in measures}
    return both.withColumns(deltas).withColumn("comparison_state", state).drop("_left", "_right")


@dataclass(frozen=True)
class Served:
    """A table function: over which relation, which columns it gives (new name -> (column, type)), and what its parameters do."""

    name: str
    relation: str
    columns: dict[str, tuple[str, str]]
    #: column -> type
    required: dict[str, str]
    optional: dict[str, str] = field(default_factory=dict)
    #: optional, compared without regard to case and blanks
    loose: dict[str, str] = field(default_factory=dict)

    def sql(self, function: str, relation: str) -> str:
        own = lambda c: f"{function}.{c}"  # noqa: E731  parameters are named like the columns they are compared with
        given = [f"{own(c)} IS NOT NULL" for c in self.required] + [f"r.{c} = {own(c)}" for c in self.required]
        given += [f"({own(c)} IS NULL OR r.{c} = {own(c)})" for c in self.optional]
        given += [f"({own(c)} IS NULL OR upper(trim(r.{c})) = upper(trim({own(c)})))" for c in self.loose]
        parameters = ", ".join(f"{c} {kind}" for c, kind in (self.required | self.optional | self.loose).items())
        returned = ", ".join(f"{c} {kind}" for c, (_, kind) in self.columns.items())
        return f"CREATE OR REPLACE TEMPORARY FUNCTION {function}({parameters}) RETURNS TABLE({returned}) RETURN SELECT {', '.join(f'r.{x} AS {c}' for c, (x, _) in self.columns.items())} FROM {relation} r WHERE {' AND '.join(given)}"


def _of(dataset: str, *columns: str, **renamed: str) -> dict[str, tuple[str, str]]:
    kinds = CONTRACTS[dataset].columns
    return {c: (c, kinds[c]) for c in columns} | {c: (x, kinds[x]) for c, x in renamed.items()}


_KEY = {"market_date": "date", "hour_ending": "int"}
_HOURLY = ("market_date", "hour_ending", "ontario_demand_mw", "market_demand_mw")
_RESULT = {"records_checked": "long", "records_failed": "long", "evaluated_at": "timestamp"}
SERVED = [
    Served("fn_get_demand", "fact_market_demand_hourly", _of("market_demand_hourly", *_HOURLY), {"market_date": "date"}, {"hour_ending": "int"}),
    Served("fn_get_peak_demand", "vw_daily_peak_demand", _of("market_demand_hourly", *_HOURLY), {"market_date": "date"}),
    Served("fn_get_zonal_demand", "fact_zonal_demand_hourly", _of("zonal_demand_hourly", "market_date", "hour_ending", "zone", "zonal_demand_mw"), {"market_date": "date"}, {"hour_ending": "int", "zone": "string"}),
    Served("fn_get_generation_mix", "fact_generation_hourly", _of("generation_hourly", "market_date", "hour_ending", "fuel_type", "output_mwh", "output_quality_code"), _KEY, loose={"fuel_type": "string"}),
    Served("fn_get_day_ahead_price", "fact_day_ahead_price_hourly", _of("day_ahead_price_hourly", *_KEY, *PRICES, source_flag="_source_flag"), {"market_date": "date"}, {"hour_ending": "int"}),
    Served("fn_get_batch_dq_status", "vw_latest_dq_result", {c: (CALLED.get(c, c), _RESULT.get(c, "string")) for c in STATUS}, {"dataset_name": "string"}, {"rule_id": "string"}),
]


def daily_peaks(fact: DataFrame) -> DataFrame:
    """Every hour that reaches its day's largest demand."""
    from halyard.operators.series import peak_with_ties

    return peak_with_ties(fact, ["market_date"], "ontario_demand_mw").select(*_HOURLY)


def peak_generation_context(fact: DataFrame, generation: DataFrame) -> DataFrame:
    """The generation by fuel of every peak hour."""
    return daily_peaks(fact).join(generation.select("market_date", "hour_ending", "fuel_type", "output_mwh"), ["market_date", "hour_ending"])


def price_comparison(keys: DataFrame, day_ahead: DataFrame, realtime: DataFrame) -> DataFrame:
    """For each (market_date, hour_ending, interval) both sides' prices and flags, the comparison's state, and real time less day ahead."""
    of = lambda df, prefix: df.withColumnsRenamed({c: f"{prefix}_{c.lstrip('_')}" for c in (*PRICES, "_source_flag")})
    a = of(day_ahead.select("market_date", "hour_ending", *PRICES, "_source_flag"), "da").withColumn("_a", F.lit(True))
    b = of(realtime.select(F.col("delivery_date").alias("market_date"), F.col("delivery_hour").alias("hour_ending"), "interval", *PRICES, "_source_flag"), "rt").withColumn("_b", F.lit(True))
    both = keys.join(a, ["market_date", "hour_ending"], "left").join(b, ["market_date", "hour_ending", "interval"], "left")
    there = lambda c: F.coalesce(F.col(c), F.lit(False))
    state = compare_state(there("_a"), there("_b"), [(F.col(f"da_{p}"), F.col(f"rt_{p}")) for p in PRICES])
    deltas = [(F.col(f"rt_{p}") - F.col(f"da_{p}")).alias(p.split("_")[0] + "_rt_minus_da_cad_per_mwh") for p in PRICES]
    sides = [f"{side}_{c}" for side in ("da", "rt") for c in (*PRICES, "source_flag")]
    return both.select("market_date", "hour_ending", "interval", *sides, state.alias("comparison_state"), *deltas)


def compare_da_vs_rt_price(day_ahead: DataFrame, realtime: DataFrame, date: object, hour: int | None, interval: int | None) -> DataFrame:
    """price_comparison() of one key; all three parts are required."""
    asked = day_ahead.sparkSession.createDataFrame([(None if date is None else str(date), hour, interval)], "d string, hour_ending int, interval int").select(F.to_date("d").alias("market_date"), "hour_ending", "interval")
    return price_comparison(asked.dropna(), day_ahead, realtime)


def largest_deviations(compared_prices: DataFrame, n: int = 10) -> DataFrame:
    """The keys whose real-time price is furthest from the day-ahead one."""
    delta = "zonal_rt_minus_da_cad_per_mwh"
    return top_by_magnitude(compared_prices.filter(F.col(delta).isNotNull()), delta, ["market_date", "hour_ending", "interval"], n)


def register_views(spark: SparkSession, facts: dict[str, DataFrame], results: DataFrame | None = None) -> list[str]:
    """Views of facts (by name), and those that the functions read besides: daily peaks, their generation, the latest results."""
    from halyard.plans.runs import latest_results

    views = dict(facts)
    if (demand := facts.get("fact_market_demand_hourly")) is not None:
        views["vw_daily_peak_demand"] = daily_peaks(demand)
        if (generation := facts.get("fact_generation_hourly")) is not None:
            views["vw_peak_generation_context"] = peak_generation_context(demand, generation)
    if results is not None:
        views["vw_latest_dq_result"] = latest_results(results)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)


def _comparison_sql(function: str, relations: dict[str, str]) -> str:
    asked = {"market_date": "DATE", "hour_ending": "INT", "interval": "INT"}
    da, rt = relations.get("fact_day_ahead_price_hourly", "fact_day_ahead_price_hourly"), relations.get("fact_realtime_price_5min", "fact_realtime_price_5min")
    on_rt = {"market_date": "delivery_date", "hour_ending": "delivery_hour", "interval": "interval"}
    kinds = CONTRACTS["realtime_price_5min"].columns
    sides = {f"{side}_{c.lstrip('_')}": (f"{side}.{c}", kinds[c]) for side in ("da", "rt") for c in (*PRICES, "_source_flag")}
    incomplete = " OR ".join(f"{side}.{p} IS NULL" for side in ("da", "rt") for p in PRICES)
    state = f"CASE WHEN da.market_date IS NULL AND rt.delivery_date IS NULL THEN '{MISSING_BOTH}' WHEN da.market_date IS NULL THEN '{MISSING_LEFT}' WHEN rt.delivery_date IS NULL THEN '{MISSING_RIGHT}' WHEN {incomplete} THEN '{INCOMPLETE}' ELSE '{COMPARABLE}' END"
    deltas = {p.split("_")[0] + "_rt_minus_da_cad_per_mwh": f"rt.{p} - da.{p}" for p in PRICES}
    wide = "decimal(19,2)"  # what a difference of two prices has
    returned = ", ".join([*[f"{c} {t}" for c, t in asked.items()], *[f"{c} {t}" for c, (_, t) in sides.items()], "comparison_state STRING", *[f"{c} {wide}" for c in deltas]])
    chosen = ", ".join([*[f"k.{c}" for c in asked], *[f"{x} AS {c}" for c, (x, _) in sides.items()], f"{state} AS comparison_state", *[f"CAST({x} AS {wide}) AS {c}" for c, x in deltas.items()]])
    key = "SELECT " + ", ".join(f"{function}.{c} AS {c}" for c in asked) + " WHERE " + " AND ".join(f"{function}.{c} IS NOT NULL" for c in asked)
    joins = f"LEFT JOIN {da} da ON da.market_date = k.market_date AND da.hour_ending = k.hour_ending LEFT JOIN {rt} rt ON " + " AND ".join(f"rt.{x} = k.{c}" for c, x in on_rt.items())
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {function}({', '.join(f'{c} {t}' for c, t in asked.items())}) RETURNS TABLE({returned}) RETURN SELECT {chosen} FROM ({key}) k {joins}"


def register_functions(spark: SparkSession, prefix: str = "", relations: dict[str, str] | None = None) -> list[str]:
    """Creates the SQL table functions of the serving layer over tables or views of the catalog; returns their names.

    relations: what a function's relation is called, where it isn't called as in SERVED. Functions whose relation isn't
    there are left out.
    """
    relations, made = relations or {}, []
    there = lambda name: spark.catalog.tableExists(relations.get(name, name))
    for f in SERVED:
        if there(f.relation):
            spark.sql(f.sql(prefix + f.name, relations.get(f.relation, f.relation)))
            made.append(prefix + f.name)
    if there("fact_day_ahead_price_hourly") and there("fact_realtime_price_5min"):
        spark.sql(_comparison_sql(f"{prefix}fn_compare_da_vs_rt_price", relations))
        made.append(f"{prefix}fn_compare_da_vs_rt_price")
    return made
