"""Lines of events into the log: columns by JSON paths, each batch once, and what is malformed kept apart with its reason.

A line is parsed once (as a variant). One that is empty, no JSON, no object, lacks a required column, or has a value that doesn't
fit a column's type goes into the table of rejects with its file, batch and reason; columns that aren't mapped are ignored. Both tables
keep the number of the last batch that they took, so a batch that is played again, wholly or in part, adds what is not there yet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from halyard.plans.store import VersionedTable
from halyard.streaming.outbox import EVENT

KINDS = dict(c.split() for c in EVENT.split(", "))
#: column -> where it is in a line.
MAPPING = {c: f"$.{c}" for c in KINDS}
REQUIRED = ["event_id"]


def mapped(lines: DataFrame, mapping: dict[str, str] | None = None, kinds: dict[str, str] | None = None, required: list[str] | None = None) -> DataFrame:
    """lines (line, _file) with the mapped columns and reason, null where a line is as it should be."""
    mapping, kinds, required = mapping or MAPPING, kinds or KINDS, REQUIRED if required is None else required
    # Generated, so that a filter on what is made of it isn't pushed below, where each use would parse the line anew.
    parsed = lines.select("*", F.explode(F.array(F.try_parse_json("line"))).alias("_v"))
    value = {c: F.try_variant_get("_v", path, kinds[c]) for c, path in mapping.items()}
    said = {c: value[c] if kinds[c] == "string" else F.try_variant_get("_v", path, "string") for c, path in mapping.items()}
    listed = lambda hits: F.array_join(F.array_compact(F.array(*[F.when(hit, F.lit(c)) for c, hit in hits.items()])), ", ")
    missing = {c: F.coalesce(said[c], F.lit("")) == "" for c in required}
    misfits = {c: said[c].isNotNull() & value[c].isNull() for c in mapping if kinds[c] != "string"}
    any_of = lambda hits: reduce(lambda a, b: a | b, hits.values(), F.lit(False))
    reason = (
        F.when(F.trim(F.coalesce("line", F.lit(""))) == "", "EMPTY").when(F.col("_v").isNull(), "NOT_JSON").when(~F.col("line").rlike(r"^[ \t\r\n]*\{"), "NOT_AN_OBJECT")
        .when(any_of(missing), F.concat(F.lit("MISSING: "), listed(missing))).when(any_of(misfits), F.concat(F.lit("TYPE: "), listed(misfits)))
    )
    return parsed.select(*lines.columns, *[v.alias(c) for c, v in value.items()], reason.alias("reason"))


class Ingestion:
    """A log of events and the lines that could not become any."""

    def __init__(self, spark: SparkSession, log: str, rejected: str, name: str = "events", mapping: dict[str, str] | None = None, kinds: dict[str, str] | None = None, required: list[str] | None = None) -> None:
        self.spark, self.name, self.mapping, self.kinds, self.required = spark, name, mapping or MAPPING, kinds or KINDS, required
        self.columns = list(self.mapping)
        self.events, self.rejected = VersionedTable(spark, log, ["event_id"]), VersionedTable(spark, rejected, ["payload_hash"])

    def take(self, lines: DataFrame, batch_id: int) -> None:
        """A batch of (line, _file)."""
        found = mapped(lines, self.mapping, self.kinds, self.required)
        bad = found.filter("reason IS NOT NULL").select(F.sha2(F.coalesce("line", F.lit("")), 256).alias("payload_hash"), "line", "reason", F.col("_file").alias("source_file"), F.lit(self.name).alias("ingestion"), F.lit(batch_id).cast("long").alias("batch_id"), F.current_timestamp().alias("rejected_at_utc"))
        self.rejected.append(bad, batch=(self.name, batch_id))
        self.events.append(found.filter("reason IS NULL").select(*self.columns), batch=(self.name, batch_id))

    def follow(self, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """Takes the lines of a folder's files as they come."""
        lines = self.spark.readStream.text(folder).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"))
        stream = lines.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint)
        return (stream.trigger(availableNow=True) if available_now else stream).start()
