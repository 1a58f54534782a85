"""Payloads as they came: content-addressed, written once, and registered with what is known of them.

The registry is a versioned table keyed by (logical_source_key, source_hash). A payload is NEW (unknown key), UNCHANGED
(known and done), REVISED (known key, new hash) or RECOVER (known, but not done).
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from halyard.plans.store import VersionedTable, put_in_place

REGISTRY = "source_name string, logical_source_key string, source_url string, source_file string, source_version string, file_size long, source_hash string, source_created_at string, bronze_path string, first_seen_timestamp timestamp, last_seen_timestamp timestamp, processing_status string, run_id string"
PENDING, SUCCESS, FAILED = "PENDING", "SUCCESS", "FAILED"
NEW, UNCHANGED, REVISED, RECOVER = "NEW", "UNCHANGED", "REVISED", "RECOVER"


def payload_hash(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()


def landing_path(base: str, source_hash: str, source_file: str) -> str:
    return f"{base.rstrip('/')}/{source_hash}/{source_file}"


def files_with_hash(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, source_hash) of files, hashed where they are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("source_hash"))


def persist_once(spark: SparkSession, payload: bytes, path: str, expected_hash: str) -> dict:
    """Writes a payload unless it is there, then reads it back; raises if its SHA-256 is not the expected one.

    It is written beside and then gets its name, so a writer that is lost leaves nothing under it. A file that is the beginning of the
    payload, which a writer of another kind may have left, is replaced.
    """
    if payload_hash(payload) != expected_hash:
        raise RuntimeError(f"SHA-256 of the payload differs from {expected_hash}")
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def stored() -> bytes:
        reader = fs.open(place)
        try:
            return bytes(reader.readAllBytes())
        finally:
            reader.close()

    back = stored() if fs.exists(place) else None
    if back is not None and len(back) < len(payload) and payload.startswith(back):
        fs.delete(place, False)
        back = None
    reused = back is not None
    if not reused:
        beside = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}-{uuid.uuid4().hex}.tmp")
        out = fs.create(beside, False)
        try:
            out.write(bytearray(payload))
            out.close()
            reused = not put_in_place(spark, beside, place)  # another writer may have been first
        finally:
            fs.delete(beside, False)
        back = stored()
    if payload_hash(back) != expected_hash:
        raise RuntimeError(f"SHA-256 of {path} differs from {expected_hash}")
    return {"bronze_path": path, "file_size": len(back), "source_hash": expected_hash, "reused_existing": reused}


class Registry:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.table = VersionedTable(spark, path, ["logical_source_key", "source_hash"])

    def _rows(self, key: str) -> list[Row]:
        return self.table.read().filter(F.col("logical_source_key") == key).select("source_hash", "processing_status").collect() if self.table.exists() else []

    def classify(self, key: str, source_hash: str) -> str:
        rows = self._rows(key)
        own = [r for r in rows if r.source_hash == source_hash]
        if own:
            return UNCHANGED if own[0].processing_status == SUCCESS else RECOVER
        return REVISED if rows else NEW

    def pending(self, **payload: object) -> None:
        """Registers a payload that is being processed; a retry takes its row over, first seen stays."""
        row = {name.split()[0]: None for name in REGISTRY.split(", ")} | payload | {"processing_status": PENDING, "bronze_path": None}
        source = self.spark.createDataFrame([tuple(row.values())], REGISTRY).withColumns({c: F.coalesce(c, F.current_timestamp()) for c in ("first_seen_timestamp", "last_seen_timestamp")})
        self.table.merge(source, update={c: F.col(f"s.{c}") for c in source.columns if c != "first_seen_timestamp"})

    def _set(self, key: str, source_hash: str, **values: object) -> None:
        self.table.update_where((F.col("logical_source_key") == key) & (F.col("source_hash") == source_hash), {c: v if hasattr(v, "_jc") else F.lit(v) for c, v in values.items()})

    def succeed(self, key: str, source_hash: str, bronze_path: str) -> None:
        self._set(key, source_hash, processing_status=SUCCESS, bronze_path=bronze_path)

    def fail(self, key: str, source_hash: str) -> None:
        self._set(key, source_hash, processing_status=FAILED)

    def touch(self, key: str, source_hash: str) -> None:
        """Bumps when it was last seen; whose run it is stays."""
        self._set(key, source_hash, last_seen_timestamp=F.current_timestamp())

    def current(self, source_name: str) -> DataFrame:
        """The latest successful payload of each logical key of a source."""
        from halyard.operators.series import latest_by

        done = self.table.read().filter((F.col("source_name") == source_name) & (F.col("processing_status") == SUCCESS))
        return latest_by(done, ["logical_source_key"], ["first_seen_timestamp", "source_hash"])

    def orphans(self, files: DataFrame) -> DataFrame:
        """Registered payloads without a stored file of that hash."""
        return self.table.read().filter(F.col("processing_status") == SUCCESS).join(files.select("source_hash"), "source_hash", "left_anti")


def ingest(spark: SparkSession, registry: Registry, base: str, source_name: str, key: str, source_file: str, payload: bytes, source_url: str = "") -> dict:
    """Hash, classify, store, register: what a source sends becomes a payload once, whatever is sent again."""
    source_hash, run_id = payload_hash(payload), str(uuid.uuid4())
    kind = registry.classify(key, source_hash)
    if kind == UNCHANGED:
        registry.touch(key, source_hash)
        return {"classification": kind, "source_hash": source_hash, "bronze_path": landing_path(base, source_hash, source_file), "reused_existing": True, "run_id": run_id}
    registry.pending(source_name=source_name, logical_source_key=key, source_url=source_url, source_file=source_file, file_size=len(payload), source_hash=source_hash, run_id=run_id)
    try:
        stored = persist_once(spark, payload, landing_path(base, source_hash, source_file), source_hash)
    except Exception:
        registry.fail(key, source_hash)
        raise
    registry.succeed(key, source_hash, stored["bronze_path"])
    return {"classification": kind, "run_id": run_id, **stored}


def with_lineage(df: DataFrame, registered: Row) -> DataFrame:
    """df with the lineage of a registered payload."""
    return df.withColumns({
        "_source_name": F.lit(registered["source_name"]), "_source_file": F.lit(registered["source_file"]), "_source_url": F.lit(registered["source_url"]), "_source_hash": F.lit(registered["source_hash"]),
        "_ingestion_timestamp": F.current_timestamp(), "_run_id": F.lit(registered["run_id"]), "_source_version": F.lit(registered["source_version"]).cast("string"), "_source_created_at": F.lit(registered["source_created_at"]).cast("string"),
    })
