"""Identities of observations and events: canonical text, then SHA-256, all in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_TOKEN = "<NULL>"


def canonical_decimal(value: Column, null: str | None = NULL_TOKEN) -> Column:
    """Plain notation without closing zeros or a negative zero, no digit rounded; null as the token (or null).

    Doubles that print with an exponent are taken as decimals of 18 places.
    """
    said = value.cast("string")
    plain = F.when(said.contains("E"), value.try_cast("decimal(38,18)").cast("string")).otherwise(said)
    trimmed = F.when(F.instr(plain, ".") > 0, F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    out = F.when(plain.rlike(r"^-?0*(\.0*)?$"), F.lit("0")).otherwise(trimmed)
    return F.coalesce(out, F.lit(null)) if null is not None else out


def canonical_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(NULL_TOKEN))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON with names sorted and no blanks; numbers stay numbers, so fields come as they are to be written."""
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]), {"ignoreNullFields": "false"})


def observation_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of canonical JSON. Lineage does not belong into it."""
    return F.sha2(canonical_json(fields), 256)


def event_id(version: str, parts: list[Column]) -> Column:
    """SHA-256 of the version and the parts, joined by |, nulls as a token."""
    return F.sha2(F.concat_ws("|", F.lit(version), *[canonical_text(p) for p in parts]), 256)


def logical_source_key(source: str, **kind: str) -> str:
    """`name|year=…`, `name|delivery_date=…` or `name|alias=…`: exactly one kind."""
    if len(kind) != 1 or next(iter(kind)) not in ("year", "delivery_date", "alias"):
        raise ValueError("one of year, delivery_date, alias")
    name, value = next(iter(kind.items()))
    return f"{source}|{name}={value}"
