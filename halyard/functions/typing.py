"""Typing projections: strings to typed columns, malformed values to null (and counted by data quality, not thrown)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def typed(df: DataFrame, types: dict[str, tuple[str, str]]) -> DataFrame:
    """types: new name -> (raw column, type); the raw columns stay so that rules can tell malformed from missing."""
    return df.withColumns({name: blank_to_null(F.col(raw)).try_cast(kind) for name, (raw, kind) in types.items()})


def malformed(raw: str, name: str) -> Column:
    """Whether a value is there but did not parse."""
    return blank_to_null(F.col(raw)).isNotNull() & F.col(name).isNull()
