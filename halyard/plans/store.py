"""Versioned Parquet tables: snapshots, change logs, keyed merges.

A version is written once, into a folder of its own name (`data/<version>-<uuid>`): the rows that then hold, and with
them how the version changed each (`_kind`: insert, update, delete, or null) and what an updated row was before. So
snapshot and change log are one set of files, and reading either prunes the other's columns. `_manifest/<n>.json` names
the folders that make version n, those that it wrote, and the schema. An append adds folders and rewrites nothing; in a table with a
partition column, which is one of the keys, a version has a folder for each of its values, and a merge rewrites only those that a
source row is in and names the others again. A version exists once its manifest does. A manifest appears whole and only for the
version after the one that the writer began with: it is written beside and then put in place where nothing is, so
of two writers one fails, its folder is deleted, and a writer that is lost leaves nothing that others see. Readers keep the
snapshot they began with. A merge that changes nothing makes no version. All paths go through the Hadoop file system of
the table's location.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from halyard.functions.audit import any_null, duplicate_keys

INSERT, BEFORE, AFTER, DELETE = "insert", "update_preimage", "update_postimage", "delete"
KIND, PREVIOUS = "_kind", "_before"
#: The column by which folders are cut, and what a missing value is called there.
PART, NO_VALUE = "_part", "__HIVE_DEFAULT_PARTITION__"
#: How the folders of a version are named.
VERSION_OF_PATH = r"/data/([0-9]+)-[0-9a-f]{32}/"


class TableConflict(RuntimeError):
    """Another writer has made the version meanwhile."""


class ConstraintViolation(ValueError):
    """Rows break what the table promises; the message names the rule."""


def put_in_place(spark: SparkSession, source, place) -> bool:
    """Gives a complete file (Hadoop paths) its name if nothing has it, in one step; False if something has."""
    from py4j.protocol import Py4JJavaError

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = place.getFileSystem(conf)
    try:
        if fs.getScheme() == "file":  # a rename would replace what is there; a link never does
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(place), local(source))
        else:
            none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(source, place, none)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    return True


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], required: list[str] | None = None, partition: str | None = None) -> None:
        if partition is not None and partition not in keys:
            raise ValueError("a partition column must be one of the keys, so that a key stays in its partition")
        self.spark, self.path, self.keys, self.required, self.partition = spark, path.rstrip("/"), keys, required or keys, partition
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    # -- versions

    def version(self) -> int:
        """The latest version; -1 before the first. An empty manifest, which only a lost writer of another kind leaves, names none."""
        folder = self._path(f"{self.path}/_manifest")
        if not self._fs.exists(folder):
            return -1
        names = [f.getPath().getName() for f in self._fs.listStatus(folder) if f.getLen() > 0]
        return max([int(n[:-5]) for n in names if re.fullmatch(r"[0-9]+\.json", n)], default=-1)

    def manifest(self, version: int) -> dict:
        reader = self._fs.open(self._path(f"{self.path}/_manifest/{version}.json"))
        try:
            return json.loads(bytes(reader.readAllBytes()).decode())
        finally:
            reader.close()

    def history(self) -> DataFrame:
        rows = [self.manifest(v) for v in range(self.version() + 1)]
        return self.spark.createDataFrame([(r["version"], r["operation"], r["inserted"], r["updated"], r["deleted"]) for r in rows], "version long, operation string, inserted long, updated long, deleted long")

    def files(self, folders: list[str]) -> list[tuple[str, int]]:
        """(name, bytes) of the data files in folders."""
        return [(f"{folder}/{f.getPath().getName()}", f.getLen()) for folder in folders for f in self._fs.listStatus(self._path(f"{self.path}/{folder}")) if f.getPath().getName().endswith(".parquet")]

    def detail(self) -> DataFrame:
        """One row: where the latest version is, what it is keyed by, its files and their bytes."""
        version = self.version()
        files = self.files(self.manifest(version)["folders"] if version >= 0 else [])
        row = (self.path, version, self.keys, len(files), sum(size for _, size in files), True)
        return self.spark.createDataFrame([row], "location string, version long, keys array<string>, num_files long, size_in_bytes long, change_feed boolean")

    def exists(self) -> bool:
        return self.version() >= 0

    def _commit(self, version: int, operation: str, counts: dict[str, int], folders: list[str] | None = None, written: list[str] | None = None, schema: StructType | None = None, batches: dict[str, int] | None = None) -> int:
        place, beside = self._path(f"{self.path}/_manifest/{version}.json"), self._path(f"{self.path}/_manifest/.{version}-{uuid.uuid4().hex}.tmp")
        body = {"version": version, "operation": operation, "inserted": counts.get(INSERT, 0), "updated": counts.get(AFTER, 0), "deleted": counts.get(DELETE, 0), "folders": folders or [], "written": written or [], "schema": json.loads((schema or StructType()).json()), "batches": batches or {}}
        out = self._fs.create(beside, False)
        try:
            out.write(bytearray(json.dumps(body).encode()))
            out.close()
            if self._fs.exists(place) and self._fs.getFileStatus(place).getLen() == 0:
                self._move_stub(place)
            if self._fs.exists(place) or not self._put(beside, place):
                raise TableConflict(f"{self.path}: version {version} exists")
        finally:
            self._fs.delete(beside, False)
        return version

    def _put(self, source, place) -> bool:
        return put_in_place(self.spark, source, place)

    def _move_stub(self, place) -> None:
        """Takes an empty manifest away. If it was another's whole one by then, that gets its name back."""
        aside = self._path(f"{self.path}/_manifest/.stub-{uuid.uuid4().hex}.tmp")
        if self._fs.rename(place, aside):
            if self._fs.getFileStatus(aside).getLen() > 0:
                self._put(aside, place)
            self._fs.delete(aside, False)

    # -- reading

    def schema(self, version: int | None = None) -> StructType:
        return StructType.fromJson(self.manifest(self.version() if version is None else version)["schema"])

    def _folders(self, names: list[str], schema: StructType) -> DataFrame:
        """The rows of folders with KIND and PREVIOUS; columns that a folder does not have are null."""
        plain = StructType([StructField(f.name, f.dataType, True) for f in schema.fields])
        whole = StructType([*plain.fields, StructField(KIND, StringType()), StructField(PREVIOUS, plain)])
        if not names:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(*[f"{self.path}/{name}" for name in names])

    def _held(self, names: list[str], schema: StructType) -> DataFrame:
        return self._folders(names, schema).filter(~F.col(KIND).eqNullSafe(DELETE)).drop(KIND, PREVIOUS)

    def read(self, version: int | None = None, parts: list | None = None, numbered: str | None = None) -> DataFrame:
        """The rows of a version; parts: only of these values of the partition column, without listing the others;
        numbered: a column for the version that wrote each row."""
        said = self.manifest(self.version() if version is None else version)
        if numbered:
            rows = self._folders(said["folders"], StructType.fromJson(said["schema"]))
            at = F.regexp_extract("_metadata.file_path", VERSION_OF_PATH, 1).cast("int") if said["folders"] else F.lit(0)
            return rows.withColumn(numbered, at).filter(~F.col(KIND).eqNullSafe(DELETE)).drop(KIND, PREVIOUS)
        return self._held([f for f in said["folders"] if parts is None or _part_of(f) in {_said(p) for p in parts}], StructType.fromJson(said["schema"]))

    def written(self, version: int) -> DataFrame:
        """The rows that a version wrote and that then hold: of an append, those that it added."""
        said = self.manifest(version)
        return self._held(said["written"], StructType.fromJson(said["schema"]))

    def parts(self, version: int | None = None) -> list[str | None]:
        """The values of the partition column, in order."""
        names = {_part_of(f) for f in self.manifest(self.version() if version is None else version)["folders"]}
        return sorted(names, key=lambda p: (p is not None, p))

    def changes(self, after: int, until: int | None = None) -> DataFrame:
        """What the versions in (after, until] changed, with _version: one scan of the folders that they wrote."""
        until = self.version() if until is None else until
        written = [f for v in range(max(after, -1) + 1, until + 1) for f in self.manifest(v)["written"]]
        version = F.regexp_extract("_metadata.file_path", VERSION_OF_PATH, 1).cast("int") if written else F.lit(0)
        rows = self._folders(written, self.schema()).withColumn("_version", version).filter(F.col(KIND).isNotNull())
        own = F.struct(*[c for c in rows.columns if c not in (KIND, PREVIOUS, "_version")])
        entry = lambda kind, row: F.struct(kind.alias("k"), row.alias("r"))
        pair = F.when(F.col(KIND) == AFTER, F.array(entry(F.lit(BEFORE), F.col(PREVIOUS)), entry(F.lit(AFTER), own))).otherwise(F.array(entry(F.col(KIND), own)))
        return rows.select(F.explode(pair).alias("c"), "_version").select("c.r.*", F.col("c.k").alias("_change_type"), "_version")

    # -- writing

    def check(self, rows: DataFrame) -> None:
        """Raises where a required column is null or a key is there twice; nothing has been written then."""
        groups = rows.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(any_null(self.required)).alias("nulls"))
        found = groups.agg(F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls"), F.count_if(F.col("n") > 1).alias("copies")).first()
        if found.nulls:
            raise ConstraintViolation(f"required_not_null: {', '.join(self.required)}")
        if found.copies:
            raise ConstraintViolation(f"duplicate_business_key: {', '.join(self.keys)}")

    def _write(self, base: int, rows: DataFrame, operation: str, beside: list[str] | None = None, silent: bool = False, batch: tuple[str, int] | None = None) -> int:
        """The version after base from rows with KIND and PREVIOUS; beside: folders that hold besides.

        What changed is counted as the rows are written. silent: the rows are those that held, and nothing changed. batch: whose
        batch this is, and its number, which the version keeps.
        """
        version, folder = base + 1, f"data/{base + 1}-{uuid.uuid4().hex}"
        schema = rows.drop(KIND, PREVIOUS).schema
        out = rows
        if self.partition:
            out = out.withColumn(PART, F.col(self.partition).cast("string")).hint("rebalance", PART)  # a large part is split
        seen = Observation()
        out = out.observe(seen, *[F.count_if(F.col(KIND) == kind).alias(kind) for kind in (INSERT, AFTER, DELETE)])
        try:
            (out.write.partitionBy(PART) if self.partition else out.write).parquet(f"{self.path}/{folder}")
        except PySparkException as e:
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)
            if broken := re.search(r"<<(.+?)>>", str(e)):
                raise ConstraintViolation(broken[1]) from e
            raise
        counts = {kind: n for kind, n in seen.get.items() if n}
        if version and not counts and not silent:
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)
            return base
        written = [folder]
        if self.partition:
            written = sorted(f"{folder}/{f.getPath().getName()}" for f in self._fs.listStatus(self._path(f"{self.path}/{folder}")) if f.isDirectory() and f.getPath().getName().startswith(f"{PART}="))
        try:
            known = self.manifest(base)["batches"] if base >= 0 else {}
            return self._commit(version, operation, counts, [*(beside or []), *written], [] if silent else written, schema, known | dict([batch] if batch else []))
        except TableConflict:
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)
            raise

    @staticmethod
    def _marked(rows: DataFrame, kind: str | None) -> DataFrame:
        of = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in rows.schema.fields) + ">"
        return rows.withColumn(KIND, F.lit(kind).cast("string")).withColumn(PREVIOUS, F.lit(None).cast(of))

    def _aligned(self, rows: DataFrame, schema: StructType) -> DataFrame:
        """rows under a table's schema; columns that it lacks are refused, those that rows lack are null."""
        if more := [c for c in rows.columns if c not in schema.names]:
            raise ConstraintViolation(f"unknown_columns: {', '.join(more)}")
        return rows.select(*[(rows[f.name] if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])

    def create(self, rows: DataFrame) -> int:
        """The first version, or what overwrites all rows."""
        base = self.version()
        self.check(rows)
        if base < 0:
            return self._write(base, self._marked(rows, INSERT), "create")
        old = self.read(base)
        gone = old.select(*[(old[f.name] if f.name in old.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
        return self._write(base, self._marked(rows, INSERT).unionByName(self._marked(gone, DELETE)), "overwrite")

    def append(self, rows: DataFrame, base: int | None = None, batch: tuple[str, int] | None = None) -> int:
        """Adds rows as they are, without looking at keys or at the rows that hold; base: the version that was looked at.

        batch: a writer and the number of its batch; one that the table has taken already, or a later one of the same writer, adds nothing.
        """
        base = self.version() if base is None else base
        if batch and base >= 0 and self.manifest(base)["batches"].get(batch[0], -1) >= batch[1]:
            return base
        if base >= 0:
            rows = self._aligned(rows, self.schema(base))
        return self._write(base, self._marked(rows, INSERT), "append", self.manifest(base)["folders"] if base >= 0 else [], batch=batch)

    def _touched(self, base: int, rows: DataFrame) -> tuple[list[str], list[str]]:
        """The folders that rows of these partitions are in, and those that none is in; all are touched without a partition column."""
        folders = self.manifest(base)["folders"]
        if not self.partition:
            return folders, []
        parts = {r[0] or None for r in rows.select(F.col(self.partition).cast("string")).distinct().collect()}  # a row a partition; an empty value has no folder of its own
        return [f for f in folders if _part_of(f) in parts], [f for f in folders if _part_of(f) not in parts]

    def merge(self, source: DataFrame, update: dict[str, Column] | None = None, when: Column | None = None, insert: bool = True, change_only: bool = True, compare: list[str] | None = None, evolve: bool = False, gone: str | None = None) -> int:
        """Upserts source by the keys and returns the version that then holds.

        Columns of both sides are named s.x and t.x in update (what a matched row gets; default every column of source) and
        in when (which matched rows change; default all). insert: whether rows without a match come in. change_only:
        rows whose compared columns (default all but the keys) are equal, nulls to nulls, stay as they are. Columns that the table
        lacks are refused (where update doesn't say what becomes of them), or added if evolve is set. gone: a column of source, not of
        the table, that is true in rows whose key is to be deleted; absence from source never deletes. Both sides are joined and written once, and the same pass refuses a null in a required column
        and a key that source, or the table in a matched row, has twice.
        """
        base = self.version()
        if base < 0:
            rows = source.filter(~F.coalesce(F.col(gone), F.lit(False))).drop(gone) if gone else source
            self.check(rows)
            return self._write(base, self._marked(rows, INSERT), "merge")
        touched, kept = self._touched(base, source)
        schema = self.schema(base)
        more = [f for f in source.schema.fields if f.name not in schema.names and f.name != gone]
        if more and update is None and not evolve:
            raise ConstraintViolation(f"unknown_columns: {', '.join(f.name for f in more)}")
        schema = StructType([*schema.fields, *(more if evolve else [])])
        columns = schema.names
        target = self._held(touched, schema)
        copies = lambda side: F.count(F.lit(1)).over(Window.partitionBy(*[f"_{side}_{k}" for k in self.keys]))  # noqa: E731  dealt and sorted as the join needs it
        s = source.select(F.struct(*[source[c] for c in source.columns]).alias("s"), *[source[k].alias(f"_s_{k}") for k in self.keys], any_null(self.required).alias("_s_null")).withColumn("_s_n", copies("s"))
        t = target.select(F.struct(*columns).alias("t"), *[target[k].alias(f"_t_{k}") for k in self.keys]).withColumn("_t_n", copies("t"))
        both = s.join(t, reduce(lambda a, b: a & b, [F.col(f"_s_{k}") == F.col(f"_t_{k}") for k in self.keys]), "full_outer")
        refused = (
            F.when(F.col("_s_null"), F.lit(f"<<required_not_null: {', '.join(self.required)}>>"))
            .when(F.col("_s_n") > 1, F.lit(f"<<duplicate_business_key: {', '.join(self.keys)}>>"))
            .when(F.col("s").isNotNull() & (F.col("_t_n") > 1), F.lit(f"<<duplicate_key_in_table: {', '.join(self.keys)}>>"))
        )
        new = update if update is not None else {c: F.col(f"s.{c}") for c in source.columns if c in columns}
        after = F.struct(*[(new[c] if c in new else F.col(f"t.{c}")).cast(schema[c].dataType).alias(c) for c in columns])
        born = F.struct(*[(F.col(f"s.{c}") if c in source.columns else F.lit(None)).cast(schema[c].dataType).alias(c) for c in columns])
        matched = F.col("s").isNotNull() & F.col("t").isNotNull()
        applies = matched if when is None else matched & F.coalesce(when, F.lit(False))
        rows = both.withColumn("_after", after)
        if change_only:
            compared = compare or [c for c in columns if c not in self.keys and c in new]
            applies &= ~reduce(lambda a, b: a & b, [F.col(f"_after.{c}").eqNullSafe(F.col(f"t.{c}")) for c in compared], F.lit(True))
        leaves = F.coalesce(F.col(f"s.{gone}"), F.lit(False)) if gone else F.lit(False)
        kind = F.when(refused.isNotNull(), F.raise_error(refused).cast("string")).when(matched & leaves, DELETE).when(applies, AFTER).when(F.col("t").isNull() & F.lit(insert) & ~leaves, INSERT)
        rows = rows.withColumn(KIND, kind).filter(F.col("t").isNotNull() | F.col(KIND).isNotNull())
        own = F.when(F.col(KIND) == AFTER, F.col("_after")).when(F.col(KIND) == INSERT, born).otherwise(F.col("t"))
        out = rows.select(own.alias("r"), KIND, F.when(F.col(KIND) == AFTER, F.col("t")).alias(PREVIOUS)).select("r.*", KIND, PREVIOUS)
        return self._write(base, out, "merge", kept)

    def insert_only(self, source: DataFrame) -> int:
        """Takes in rows whose key is not there yet; what is there isn't rewritten, and read only where source's partitions are."""
        base = self.version()
        self.check(source)
        if base < 0:
            return self._write(base, self._marked(source, INSERT), "merge")
        schema = self.schema(base)
        there = self._held(self._touched(base, source)[0], schema).select(*self.keys)
        new = self._aligned(source, schema).join(there, self.keys, "left_anti").select(*schema.names)
        return self._write(base, self._marked(new, INSERT), "merge", self.manifest(base)["folders"])

    def update_where(self, condition: Column, values: dict[str, Column], base: int | None = None) -> int:
        """Sets columns of rows that meet a condition on the table's own columns; base: the version that was looked at."""
        base = self.version() if base is None else base
        target = self.read(base)
        hit = target.withColumn(KIND, F.when(condition, AFTER)).withColumn(PREVIOUS, F.when(F.col(KIND) == AFTER, F.struct(*target.columns)))
        return self._write(base, hit.withColumns({c: F.when(F.col(KIND) == AFTER, v.cast(target.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}), "update")

    def delete_where(self, condition: Column) -> int:
        base = self.version()
        return self._write(base, self._marked(self.read(base), None).withColumn(KIND, F.when(condition, DELETE)), "delete")

    def compact(self, rows: DataFrame | None = None, base: int | None = None) -> int:
        """The rows that hold (or what stands for them), rewritten into as few folders as there can be; no change is logged."""
        base = self.version() if base is None else base
        held = self.read(base) if rows is None else self._aligned(rows, self.schema(base))
        return self._write(base, self._marked(held, None), "compact", silent=True)


def _part_of(folder: str) -> str | None:
    """The partition value that a folder is for."""
    value = folder.rpartition(f"/{PART}=")[2]
    return None if value == NO_VALUE else unquote(value)


def _said(part) -> str | None:
    return None if part is None else str(part)


def reconcile(source: DataFrame, target: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """One row: source_rows, target_rows, missing_from_target, unexpected_in_target, duplicate_keys, as bags of rows.

    One aggregate of both tables' rows gives what two except-alls and two counts would.
    """
    side = lambda df, a, b: df.select(*columns).withColumn("_a", F.lit(a)).withColumn("_b", F.lit(b))
    groups = side(source, 1, 0).unionByName(side(target, 0, 1)).groupBy(*columns).agg(F.sum("_a").alias("a"), F.sum("_b").alias("b"))
    counts = groups.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("source_rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("target_rows"),
        F.coalesce(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))), F.lit(0)).alias("missing_from_target"), F.coalesce(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))), F.lit(0)).alias("unexpected_in_target"),
    )
    return counts.crossJoin(F.broadcast(duplicate_keys(target, keys).agg(F.count(F.lit(1)).alias("duplicate_keys"))))  # a row each


def changed_keys(changes: DataFrame, keys: list[str]) -> DataFrame:
    return changes.select(*keys).distinct()


def read_increment(table: VersionedTable, after: int) -> tuple[int, DataFrame]:
    """The latest version, and the current rows of the keys that changed after a version. A delete in between is refused."""
    until = table.version()
    log = table.changes(after, until)
    if not log.filter(F.col("_change_type") == DELETE).isEmpty():
        raise ConstraintViolation("delete_in_increment")
    return until, table.read(until).join(changed_keys(log, table.keys), table.keys, "left_semi")
