"""What the session's catalog and folders hold: scans by name, introspection, tables and views made and dropped."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.plans.contracts import Contract

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*){0,2}")


def named(name: str) -> str:
    if not NAME.fullmatch(name):
        raise ValueError(f"not the name of a table, view or function: {name!r}")
    return name


def scan(spark: SparkSession, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table or view, or some of its columns."""
    return spark.table(named(name)).select(*(columns or ["*"]))


def call(spark: SparkSession, function: str, *arguments: object) -> DataFrame:
    """The rows of a table function for some arguments."""
    marks = ", ".join(f":a{k}" for k in range(len(arguments)))
    return spark.sql(f"SELECT * FROM {named(function)}({marks})", {f"a{k}": x for k, x in enumerate(arguments)})


def tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(name, is_temporary) of tables and views."""
    shown = spark.sql("SHOW TABLES" + (f" IN {named(database)}" if database else ""))
    return shown.select(F.col("tableName").alias("name"), F.col("isTemporary").alias("is_temporary"))


def described(spark: SparkSession, name: str) -> DataFrame:
    """(position, column_name, data_type, nullable) of a table or view."""
    rows = [(k, f.name, f.dataType.simpleString(), f.nullable) for k, f in enumerate(spark.table(named(name)).schema.fields, 1)]
    return spark.createDataFrame(rows, "position int, column_name string, data_type string, nullable boolean")


def properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {named(name)}").collect()}


def set_property(spark: SparkSession, name: str, key: str, value: str) -> None:
    quoted = [x.replace("'", "\\'") for x in (key, value)]
    spark.sql(f"ALTER TABLE {named(name)} SET TBLPROPERTIES ('{quoted[0]}' = '{quoted[1]}')")


def create_table(spark: SparkSession, name: str, contract: Contract) -> None:
    """A table as its contract declares it, unless it is there."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {named(name)} ({contract.ddl()}) USING parquet")


def create_as(spark: SparkSession, name: str, df: DataFrame, order: list[str] | None = None, limit: int | None = None) -> None:
    """A table of df's rows, or of the first of them by an order."""
    rows = df.orderBy(*order) if order else df
    (rows if limit is None else rows.limit(limit)).write.format("parquet").saveAsTable(named(name))


def drop(spark: SparkSession, name: str) -> None:
    """Drops a table, a view or a temporary view, if there is one."""
    if not spark.catalog.dropTempView(named(name)) and spark.catalog.tableExists(name):
        kind = "VIEW" if spark.catalog.getTable(name).tableType == "VIEW" else "TABLE"
        spark.sql(f"DROP {kind} IF EXISTS {name}")


# -- folders


def listed(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names in a folder and their length; empty if there is no such folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {f.getPath().getName(): f.getLen() for f in fs.listStatus(place)} if fs.exists(place) else {}


def missing_folders(spark: SparkSession, base: str, expected: list[str]) -> list[str]:
    """Which of the expected names a folder lacks."""
    there = listed(spark, base)
    return [name for name in expected if name not in there]


def probe_versions(spark: SparkSession, folder: str, name: str) -> list[tuple[int, str]]:
    """(version, file) of a payload and its numbered versions (name_v1.ext, name_v2.ext, ...), the unnumbered one as 0."""
    stem, dot, ending = name.rpartition(".")
    pattern = re.compile(rf"{re.escape(stem if dot else name)}(?:_v(\d+))?{re.escape(dot + ending) if dot else ''}")
    found = [(int(m.group(1) or 0), x) for x in listed(spark, folder) if (m := pattern.fullmatch(x))]
    return sorted(found)


def file_checks(files: DataFrame, registry: DataFrame) -> DataFrame:
    """(source_hash, state) of registered payloads against stored files (path, length, source_hash): MISSING, LENGTH_DIFFERS or OK."""
    stored = files.groupBy("source_hash").agg(F.max("length").alias("length"))
    state = F.when(F.col("length").isNull(), "MISSING").when(F.col("length") != F.col("file_size"), "LENGTH_DIFFERS").otherwise("OK")
    return registry.select("source_hash", "file_size").join(stored, "source_hash", "left").select("source_hash", state.alias("state"))
