"""Profiles of days that are kept and merged: quantiles, distinct counts and frequent values of any span, without reading its rows again.

A day's row has for each measure its count, moments, extremes and a KLL sketch, for each id column an HLL sketch, for each category an approximate
top-k state. Sketches of days merge into those of a span. A day that changed is sketched again from its own rows; others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.plans.store import VersionedTable

#: Size of a KLL sketch (ranks err by about 0.4 %), and of an HLL sketch as a power of two (counts err by about 1.6 %).
KLL_K, HLL_LG = 800, 12
#: Values that a category's state tracks.
TRACKED = 1000
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


class DailyProfiles:
    """What a dataset's days hold, a row a day; each column is under its own name with what it is of it."""

    def __init__(self, spark: SparkSession, path: str, measures: list[str], ids: list[str] | None = None, categories: list[str] | None = None) -> None:
        self.table = VersionedTable(spark, path, ["day"], partition="day")
        self.measures, self.ids, self.categories = measures, ids or [], categories or []

    def sketched(self, rows: DataFrame, day: Column) -> DataFrame:
        """A row for each day of rows, from one aggregate that combines on the map side."""
        value = {c: F.col(c).cast("double") for c in self.measures}
        parts = [
            x
            for c, v in value.items()
            for x in (F.count(v).alias(f"{c}_n"), F.sum(v).alias(f"{c}_sum"), F.avg(v).alias(f"{c}_mean"), F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias(f"{c}_m2"), F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max"), F.kll_sketch_agg_double(v, F.lit(KLL_K)).alias(f"{c}_kll"))
        ]
        parts += [F.hll_sketch_agg(F.col(c).cast("string"), HLL_LG).alias(f"{c}_hll") for c in self.ids]
        parts += [F.expr(f"approx_top_k_accumulate(`{c}`, {TRACKED})").alias(f"{c}_top") for c in self.categories]
        return rows.withColumn("day", day.cast("string")).filter(F.col("day").isNotNull()).groupBy("day").agg(F.count(F.lit(1)).alias("n_rows"), *parts)

    def update(self, rows: DataFrame, day: Column, days: list[str] | None = None) -> int:
        """Sketches days of rows again (default all that rows has); days that are named and have no rows any more go."""
        if days is not None:
            rows = rows.filter(day.cast("string").isin(days))
        made = self.sketched(rows, day).withColumn("_gone", F.lit(False))
        if days is not None and self.table.exists():
            left = self.table.read(parts=days).select("day").join(made.select("day"), "day", "left_anti")
            made = made.unionByName(left.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        return self.table.merge(made, change_only=False, gone="_gone")

    def span(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """The days' rows in [since, until]."""
        days = [d for d in self.table.parts() if d is not None and (since is None or d >= since) and (until is None or d <= until)]
        return self.table.read(parts=days)

    def described(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """(column_name, n, mean, stddev, min, q25, q50, q75, max) of each measure over a span; all but the quartiles are exact."""
        made = []
        for c in self.measures:
            n, mean = F.sum(f"{c}_n"), F.sum(f"{c}_sum") / F.sum(f"{c}_n")
            squares = F.sum(f"{c}_m2") + F.sum(F.col(f"{c}_n") * F.col(f"{c}_mean") * F.col(f"{c}_mean")) - n * mean * mean
            kll = F.kll_merge_agg_double(f"{c}_kll", F.lit(KLL_K))
            quartiles = [F.kll_sketch_get_quantile_double(kll, F.lit(p)).alias(q) for q, p in QUARTILES.items()]
            made.append(F.struct(F.lit(c).alias("column_name"), n.alias("n"), mean.alias("mean"), F.sqrt(F.greatest(squares, F.lit(0.0)) / F.nullif(n - 1, F.lit(0))).alias("stddev"), F.min(f"{c}_min").alias("min"), *quartiles, F.max(f"{c}_max").alias("max")).alias(c))
        return self.span(since, until).agg(*made).select(F.explode(F.array(*self.measures)).alias("e")).select("e.*")

    def distinct(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """(column_name, n_distinct) of each id column over a span, approximate."""
        row = self.span(since, until).agg(*[F.hll_sketch_estimate(F.hll_union_agg(f"{c}_hll")).alias(c) for c in self.ids])
        return row.unpivot([], self.ids, "column_name", "n_distinct")

    def frequent(self, column: str, k: int, since: str | None = None, until: str | None = None) -> DataFrame:
        """(value, n): a category's most frequent values over a span; exact where it has no more than TRACKED of them."""
        top = F.expr(f"approx_top_k_estimate(approx_top_k_combine(`{column}_top`, {TRACKED}), {k})")
        return self.span(since, until).agg(top.alias("t")).select(F.explode("t").alias("e")).select(F.col("e.item").alias("value"), F.col("e.count").alias("n"))
