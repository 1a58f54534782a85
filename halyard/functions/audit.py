"""Audits of tables: keys, nulls, coverage, gaps, profiles. Each is one pass of built-in aggregates where it can be."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_null(keys: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_rows) of keys with more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def key_audit(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: total_rows, distinct_keys, duplicate_keys, excess_rows, null_keys."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess_rows"),
        F.coalesce(F.sum(F.when(any_null(keys), F.col("n")).otherwise(0)), F.lit(0)).alias("null_keys"),
    )


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the nulls of each column, in one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])


def sign_counts(df: DataFrame, column: str) -> list[Column]:
    return [F.count_if(F.col(column) < 0).alias(f"{column}_negative"), F.count_if(F.col(column) == 0).alias(f"{column}_zero"), F.count_if(F.col(column).isNull()).alias(f"{column}_nulls")]


def coverage(df: DataFrame, day: Column, by: list[str] | None = None) -> DataFrame:
    """first_day, last_day, days, rows, days_spanned over all or by group; null days count as rows only."""
    dated = df.withColumn("_day", day)
    grouped = dated.groupBy(*(by or []))
    return grouped.agg(
        F.min("_day").alias("first_day"), F.max("_day").alias("last_day"), F.count_distinct("_day").alias("days"), F.count(F.lit(1)).alias("rows"),
        (F.datediff(F.max("_day"), F.min("_day")) + 1).alias("days_spanned"),
    )


def completeness(df: DataFrame, day: Column, expected: int) -> DataFrame:
    """(day, rows, is_latest, state): each day's rows against what a whole day has; the last day may still be filling."""
    days = df.select(day.alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("rows"))
    latest = days.agg(F.max("day").alias("latest"))  # one row
    state = F.when(F.col("rows") == expected, "COMPLETE").when(F.col("day") == F.col("latest"), "LATEST_PARTIAL").otherwise("INCOMPLETE")
    return days.crossJoin(F.broadcast(latest)).select("day", "rows", (F.col("day") == F.col("latest")).alias("is_latest"), state.alias("state"))


def calendar_gaps(df: DataFrame, day: Column) -> DataFrame:
    """(missing_day): days between the first and the last that have no row."""
    days = df.select(day.alias("day")).filter("day is not null").distinct()
    span = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).filter("lo is not null")
    wanted = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("missing_day"))
    return wanted.join(days, wanted["missing_day"] == days["day"], "left_anti")


def missing_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of left that right lacks."""
    return left.select(*keys).distinct().join(right.select(*keys), keys, "left_anti")


def shared_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "inner")


def coverage_intersection(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: left_keys, right_keys, shared_keys, left_only, right_only; one shuffle of distinct keys a side."""
    marked = left.select(*keys).distinct().withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0)).unionByName(right.select(*keys).distinct().withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1)))
    both = marked.groupBy(*keys).agg(F.max("_l").alias("l"), F.max("_r").alias("r"))
    return both.agg(F.count_if(F.col("l") == 1).alias("left_keys"), F.count_if(F.col("r") == 1).alias("right_keys"), F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("shared_keys"), F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("left_only"), F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("right_only"))


def grain_multiplicity(df: DataFrame, keys: list[str]) -> DataFrame:
    """(multiplicity, n_keys): how many keys have how many rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("multiplicity")).groupBy("multiplicity").agg(F.count(F.lit(1)).alias("n_keys"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_rows, n_nulls, n_distinct, min_value, max_value) for each column."""
    return schema_profile(df, columns).drop("data_type", "n_invalid")


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n): value counts, null groups kept."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def top_by_magnitude(df: DataFrame, value: str, ties: list[str], n: int) -> DataFrame:
    return df.orderBy(F.abs(F.col(value)).desc(), *ties).limit(n)


def required_headers(found: list[str], required: list[str]) -> tuple[list[str], list[str]]:
    """What is missing from a header, and what it has besides, in order."""
    return [c for c in required if c not in found], [c for c in found if c not in required]


def schema_profile(df: DataFrame, columns: list[str], valid: dict[str, Column] | None = None) -> DataFrame:
    """(column_name, data_type, n_rows, n_nulls, n_distinct, n_invalid, min_value, max_value) for each column.

    One Expand of a column's value a row, aggregated twice: counts of distinct values combine on the map side and no
    group holds a column's whole set. valid: what the values of a column have to meet.
    """
    kinds = dict(df.dtypes)
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("data_type"), F.col(c).cast("string").alias("value"), F.coalesce(~(valid or {}).get(c, F.lit(True)), F.lit(False)).alias("invalid"), F.lit(k).alias("k")) for k, c in enumerate(columns)]
    each = df.select(F.explode(F.array(*cells)).alias("x")).groupBy("x.column_name", "x.data_type", "x.value").agg(F.count(F.lit(1)).alias("n"), F.count_if("x.invalid").alias("bad"))
    out = each.groupBy("column_name", "data_type").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_nulls"), F.count("value").alias("n_distinct"), F.sum("bad").alias("n_invalid"))
    ends = df.agg(*[F.struct(F.min(c).cast("string").alias("lo"), F.max(c).cast("string").alias("hi")).alias(f"c{k}") for k, c in enumerate(columns)])
    spread = ends.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{k}.lo").alias("min_value"), F.col(f"c{k}.hi").alias("max_value")) for k, c in enumerate(columns)])).alias("e")).select("e.*")
    return out.join(F.broadcast(spread), "column_name")  # a row a column


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, mean, stddev, min, max) of numeric columns, from one aggregate."""
    stats = {"n": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(*[F.struct(*[f(c).cast("double" if name != "n" else "long").alias(name) for name, f in stats.items()]).alias(f"c{k}") for k, c in enumerate(columns)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{k}").alias("s")) for k, c in enumerate(columns)])).alias("e")).select("e.column_name", "e.s.*")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join on keys; raises where a key is there twice on a side."""
    for name, side in (("left", left), ("right", right)):
        if not duplicate_keys(side, keys).isEmpty():
            raise ValueError(f"{name} has a key twice: {', '.join(keys)}")
    return left.join(right, keys, "inner")


def collected(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, values): the distinct values of each group in order; for groups whose values are known to be few."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(value)).alias("values"))
