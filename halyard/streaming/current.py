"""The current price of each key as the log grows: keyed state, and a table that follows it.

The state of an event of a key is its best delivery, kept by Spark's own streaming aggregate, so a more complete delivery or a revision
may come in any order and at any time: there is no watermark, and nothing is ever too late. After each batch the keys that it touched
are as `realtime.price_current` of the whole log has them. An event's deliveries have its key; those without a whole key have no state.
State is kept by RocksDB (STATE_STORE), and neither state nor rows pass through Python.

A key's latest event is found from the batch's events and the one that was latest before (`latest`, with those that are withdrawn), so a batch costs
what it brings, however many events its keys have. Only where that one itself went back, as a more complete delivery has an earlier
time, another that came long ago may follow: then the keys' events are read again (`events`, to which each batch's are appended).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from halyard.operators import realtime, series
from halyard.plans.store import VersionedTable

#: All stores of an executor share so much memory.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: What makes an event of a key the latest.
ORDER = ["event_created_at_utc", "event_id"]


def best_of_events(log: DataFrame) -> DataFrame:
    """The best delivery of each event of a key, under the log's columns; of a stream, that of each event with new deliveries."""
    tie = F.xxhash64(*[F.col(c).cast("string") for c in log.columns])
    score = series.completeness_score([c for c in realtime.SCORED if c in log.columns])
    rows = log.filter(" AND ".join(f"{c} IS NOT NULL" for c in [*realtime.KEY, "event_id"])).withColumn("_score", score).withColumn("_tie", tie)
    return series.latest_by(rows, [*realtime.KEY, "event_id"], ["_score", "_tie"]).drop("_score", "_tie")


def current_table(spark: SparkSession, path: str) -> VersionedTable:
    """Where the current prices are kept: a partition a day."""
    return VersionedTable(spark, path, realtime.KEY, partition=realtime.KEY[0])


def _take(batch: DataFrame, events: VersionedTable, latest: VersionedTable, table: VersionedTable) -> None:
    """Brings latest and table to what they are with a batch of events. One that is played again changes nothing but adds its events again."""
    before = events.version()
    version = events.append(batch, before)  # the batch's only use: its state is computed once
    if version == before:
        return
    rows = events.written(version)
    new = series.latest_by(rows, realtime.KEY, ORDER).persist()
    changed, cached = new, [new]
    if latest.exists():
        days = [r[0] for r in new.select(F.col(realtime.KEY[0]).cast("string")).distinct().collect()]  # a row a day
        was = latest.read(parts=days).select(*realtime.KEY, *[F.col(c).alias(f"_{c}") for c in ORDER])
        pairs = new.join(was, realtime.KEY, "left")
        follows = F.col("_event_id").isNull() | (F.struct(*ORDER) >= F.struct(*[f"_{c}" for c in ORDER]))
        behind = pairs.filter(~follows).select(*realtime.KEY, F.col("_event_id").alias("event_id"))
        fallen = behind.join(rows.select(*realtime.KEY, "event_id"), [*realtime.KEY, "event_id"], "left_semi").select(*realtime.KEY).persist()
        changed = pairs.filter(follows).select(*new.columns)
        if not fallen.isEmpty():
            again = best_of_events(events.read(version).join(fallen, realtime.KEY, "left_semi").select(*new.columns))
            changed = changed.unionByName(series.latest_by(again, realtime.KEY, ORDER))
        changed = changed.persist()
        cached += [fallen, changed]
    table.merge(changed.withColumn("_gone", ~F.coalesce(F.col("publication_state") == series.ELIGIBLE, F.lit(False))), gone="_gone")
    latest.merge(changed.select(*realtime.KEY, *ORDER))  # after table, so that a batch that was cut off finds what it found
    for df in cached:
        df.unpersist()


def follow(log: DataFrame, table: VersionedTable, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps a table as the current prices of a streamed log: a key that is withdrawn goes. Only its days are rewritten.

    checkpoint: a folder for the stream's own checkpoint and the tables beside it.
    """
    for name, value in STATE_STORE.items():
        log.sparkSession.conf.set(name, value)
    events = VersionedTable(table.spark, f"{checkpoint}/events", [*realtime.KEY, "event_id"])
    latest = VersionedTable(table.spark, f"{checkpoint}/latest", realtime.KEY, partition=realtime.KEY[0])
    stream = best_of_events(log).writeStream.outputMode("update").foreachBatch(lambda batch, _: _take(batch, events, latest, table)).option("checkpointLocation", f"{checkpoint}/stream")
    return (stream.trigger(availableNow=True) if available_now else stream).start()
