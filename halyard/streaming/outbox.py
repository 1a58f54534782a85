"""Publishing events once: an outbox as a versioned table, leases, and a stream from the landing folder to the log."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.identity import canonical_decimal, canonical_text, event_id, observation_hash
from halyard.operators.series import ELIGIBLE, INVALIDATED, INVALIDATION, OBSERVATION, population_state, revision_decisions
from halyard.plans.contracts import PRICES
from halyard.plans.store import TableConflict, VersionedTable
from halyard.session import scratch_folder

PENDING, SENDING, SENT = "PENDING", "SENDING", "SENT"
EVENT_VERSION = "rt_price_event_v1"
SLOT = ["delivery_date", "delivery_hour", "interval"]
#: The event as it is sent and as the log holds it.
EVENT = "event_schema_version string, event_type string, event_id string, observation_hash string, delivery_date string, delivery_hour int, interval int, zonal_price_capped_cad_per_mwh double, loss_price_capped_cad_per_mwh double, congestion_price_capped_cad_per_mwh double, source_flag string, publication_state string, previous_event_id string, source_name string, source_file string, source_url string, source_hash string, source_created_at_raw string, source_doc_revision string, bronze_first_seen_at_utc string, publisher_run_id string, poll_id string, event_created_at_utc string"
_NAMES = [c.split()[0] for c in EVENT.split(", ")]


def observed(df: DataFrame, prices: tuple[str, ...] = PRICES) -> DataFrame:
    """Typed slots with observation_hash, of the seven fields that make an observation, and whether they may be published: all prices are there."""
    day, hour, interval = SLOT
    fields = {day: F.col(day).cast("string"), hour: F.col(hour).cast("int"), interval: F.col(interval).cast("int"), "source_flag": canonical_text(F.col("source_flag"))}
    fields |= {p: canonical_decimal(F.col(p)) for p in prices}
    return df.withColumn("observation_hash", observation_hash(fields)).withColumn("eligible", population_state(list(prices)) == "FULLY_POPULATED")


def events_of(decided: DataFrame, lineage: dict[str, str | None], created_at: Column | None = None) -> DataFrame:
    """The events that decisions ask for; unchanged and suppressed slots make none."""
    wanted = decided.filter(F.col("decision").isin("NEW_OBSERVATION", "REVISED_OBSERVATION", "INVALIDATION"))
    withdrawn = F.col("decision") == "INVALIDATION"
    price = lambda c: F.when(~withdrawn, F.col(c).cast("double"))
    made = {
        "event_schema_version": F.lit(EVENT_VERSION), "event_type": F.when(withdrawn, INVALIDATION).otherwise(OBSERVATION),
        "event_id": event_id(EVENT_VERSION, [F.col("delivery_date"), F.col("delivery_hour"), F.col("interval"), F.lit(lineage.get("source_created_at_raw")), F.lit(lineage.get("source_hash"))]),
        "delivery_date": F.col("delivery_date").cast("string"), **{p: price(p) for p in PRICES},
        "publication_state": F.when(withdrawn, INVALIDATED).otherwise(ELIGIBLE), "event_created_at_utc": F.date_format(F.current_timestamp() if created_at is None else created_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
        **{c: F.lit(v).cast("string") for c, v in lineage.items()},
    }
    return wanted.select(*[(made.get(c, F.col(c) if c in wanted.columns else F.lit(None).cast("string"))).alias(c) for c in _NAMES])


#: What changes of an event in the outbox; the rest is written once.
STATE = {"status": "string", "lease_owner_run_id": "string", "lease_expires_at_utc": "timestamp", "last_attempt_at_utc": "timestamp", "attempt_count": "long", "sent_at_utc": "timestamp", "last_error": "string", "updated_at_utc": "timestamp"}
#: Folders of the log after which it is folded into one.
FOLDERS = 200


class Outbox:
    """Rows stay until they are sent: PENDING, then SENDING under a lease, then SENT; a lease that runs out can be taken over.

    The table is a log: an event's own row, then one for each lease and outcome, and nothing is rewritten. What holds of an event is
    what its own row says and the state in its last one. A version follows the one that its writer looked at, so two claimers
    never share an event. Once the log has many folders it is folded: a row an event, without the payload of those that are sent.
    """

    def __init__(self, spark: SparkSession, path: str, folders: int = FOLDERS) -> None:
        self.spark, self.table, self.folders = spark, VersionedTable(spark, path, ["event_id"]), folders

    def put(self, events: DataFrame) -> int:
        """Takes events in that are not there yet, as JSON with the keys in order."""
        payload = F.to_json(F.struct(*[F.col(c) for c in sorted(_NAMES)]), {"ignoreNullFields": "false"})
        state = {"status": F.lit(PENDING), "attempt_count": F.lit(0), "updated_at_utc": F.current_timestamp()}
        kept = ["event_id", "event_schema_version", "event_type", "publication_state", *SLOT, "observation_hash", "previous_event_id", "source_hash", "publisher_run_id", "poll_id"]
        return self.table.insert_only(events.select(*kept, payload.alias("event_payload"), *[state.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in STATE.items()], F.current_timestamp().alias("created_at_utc")))

    def read(self, version: int | None = None, columns: list[str] | None = None) -> DataFrame:
        """A row an event: what it is and how it stands; columns: only these of what it is."""
        log = self.table.read(version, numbered="_version")
        own = [c for c in columns or log.columns if c not in (*STATE, "event_id", "_version")]
        folded = log.groupBy("event_id").agg(F.max_by(F.struct(*STATE), "_version").alias("s"), *[F.first(c, ignorenulls=True).alias(c) for c in own])
        return folded.select("event_id", *own, "s.*")

    def _again(self, change: Callable[[int], object], tries: int = 8):
        """change(version), once more from the new version where another writer came first."""
        for k in range(tries):
            try:
                return change(self.table.version())
            except TableConflict:
                if k == tries - 1:
                    raise

    def claims(self, owner: str, most: int = 1, lease: str = "5 minutes", now: Column | None = None) -> list[tuple[str, str]]:
        """Leases the oldest rows that wait or whose lease has run out, at most so many: (event_id, payload)."""
        now = F.current_timestamp() if now is None else now
        free = (F.col("status") == PENDING) | ((F.col("status") == SENDING) & (F.col("lease_expires_at_utc") <= now))

        def lease_heads(version: int) -> list[tuple[str, str]]:
            head = self.read(version, ["created_at_utc"]).filter(free).orderBy("created_at_utc", "event_id").limit(most).select("event_id", "attempt_count").collect()
            if not head:
                return []
            state = {"status": F.lit(SENDING), "lease_owner_run_id": F.lit(owner), "lease_expires_at_utc": now + F.expr(f"interval {lease}"), "last_attempt_at_utc": now, "attempt_count": F.col("attempt_count") + 1, "updated_at_utc": now}
            rows = self.spark.createDataFrame(head, "event_id string, attempt_count long").coalesce(1)
            self.table.append(rows.select("event_id", *[state.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in STATE.items()]), version)
            payloads = dict(self.table.read(version).filter(F.col("event_id").isin([r.event_id for r in head]) & F.col("event_payload").isNotNull()).select("event_id", "event_payload").collect())
            return [(r.event_id, payloads[r.event_id]) for r in head]

        return self._again(lease_heads)

    def claim(self, owner: str, lease: str = "5 minutes", now: Column | None = None) -> tuple[str, str] | None:
        """Leases the oldest row that may be sent."""
        return next(iter(self.claims(owner, 1, lease, now)), None)

    def settle(self, owner: str, sent: list[str], failed: str | None = None, error: str = "", released: list[str] | None = None) -> None:
        """Marks what an owner has sent, puts back what failed, with its error, and what it didn't try; one version for all.

        What another owner has taken over since stays as that one has it.
        """
        wanted = [*sent, *(released or []), *([failed] if failed else [])]
        mine = F.col("event_id").isin(wanted) & (F.col("status") == SENDING) & (F.col("lease_owner_run_id") == owner)
        done, broken = F.col("event_id").isin(sent), F.col("event_id") == F.lit(failed)
        values = {
            "status": F.when(done, SENT).otherwise(PENDING), "sent_at_utc": F.when(done, F.current_timestamp()).otherwise(F.col("sent_at_utc")),
            "last_error": F.when(broken, F.lit(error[:4000])).when(done, F.lit(None)).otherwise(F.col("last_error")),
            "lease_owner_run_id": F.lit(None), "lease_expires_at_utc": F.lit(None), "updated_at_utc": F.current_timestamp(),
        }

        def outcome(version: int) -> int:
            rows = self.read(version, []).filter(mine).coalesce(1)  # a batch at most
            return self.table.append(rows.select("event_id", *[values.get(c, F.col(c)).cast(kind).alias(c) for c, kind in STATE.items()]), version)

        self._again(outcome)

    def compact(self) -> int:
        """The log as a row an event; payloads of sent events go."""
        payload = F.when(F.col("status") != SENT, F.col("event_payload")).alias("event_payload")
        return self._again(lambda version: self.table.compact(self.read(version).withColumn("event_payload", payload), version))

    def dispatch(self, send: Callable[[str, str], None], most: int = 100, owner: str | None = None, batch: int = 50) -> int:
        """Sends what waits, oldest first, leased in batches; a failure puts its row back and goes on to the caller."""
        owner, done = owner or str(uuid.uuid4()), 0
        while done < most and (claimed := self.claims(owner, min(batch, most - done))):
            for k, (event, payload) in enumerate(claimed):
                try:
                    send(event, payload)
                except Exception as e:
                    self.settle(owner, [x for x, _ in claimed[:k]], event, str(e), [x for x, _ in claimed[k + 1 :]])
                    raise
            self.settle(owner, [x for x, _ in claimed])
            done += len(claimed)
            if len(self.table.manifest(self.table.version())["folders"]) > self.folders:
                self.compact()
        return done

    def dispatch_all(self, send: Callable[[str, str], None], owner: str | None = None, lease: str = "1 day") -> tuple[int, int]:
        """Sends all that waits from the executors, in any order: one lease and one outcome for all; (sent, failed).

        What fails is put back with its error, and the others go on. Nothing but counts comes to the driver. A task that is run again sends again.
        """
        owner, now = owner or str(uuid.uuid4()), F.current_timestamp()
        free = (F.col("status") == PENDING) | ((F.col("status") == SENDING) & (F.col("lease_expires_at_utc") <= now))
        taken = {"status": F.lit(SENDING), "lease_owner_run_id": F.lit(owner), "lease_expires_at_utc": now + F.expr(f"interval {lease}"), "last_attempt_at_utc": now, "attempt_count": F.col("attempt_count") + 1, "updated_at_utc": now}
        self._again(lambda version: self.table.append(self.read(version, []).filter(free).select("event_id", *[taken.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in STATE.items()]), version))
        mine = (F.col("status") == SENDING) & (F.col("lease_owner_run_id") == owner)

        def sent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                errors = []
                for event, payload in zip(frame["event_id"], frame["event_payload"], strict=True):
                    try:
                        send(event, payload)
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001  whatever a sender raises
                        errors.append(str(e)[:4000])
                yield pd.DataFrame({"event_id": frame["event_id"], "_error": pd.Series(errors, dtype=object), "_sent": [e is None for e in errors]})

        kind = "event_id string, _error string, _sent boolean"
        waiting = self.read(columns=["event_payload"]).filter(mine).select("event_id", "event_payload")
        waiting.mapInPandas(sent, kind).write.parquet(folder := f"{scratch_folder(self.spark)}/sent")  # once, however often the outcome is tried
        said = self.spark.read.schema(kind).parquet(folder)
        values = {
            "status": F.when(F.col("_sent"), SENT).otherwise(PENDING), "sent_at_utc": F.when(F.col("_sent"), F.current_timestamp()).otherwise(F.col("sent_at_utc")), "last_error": F.col("_error"),
            "lease_owner_run_id": F.lit(None), "lease_expires_at_utc": F.lit(None), "updated_at_utc": F.current_timestamp(),
        }
        self._again(lambda version: self.table.append(self.read(version, []).filter(mine).join(said, "event_id").select("event_id", *[values.get(c, F.col(c)).cast(kind).alias(c) for c, kind in STATE.items()]), version))
        counts = said.agg(F.count_if("_sent"), F.count_if(~F.col("_sent"))).first()
        return counts[0], counts[1]

    def status(self) -> DataFrame:
        return self.read(columns=[]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def gate(checkpoint_hash: str | None, source_hash: str) -> str:
    """Whether a poll has work: the first ever, a new revision, or nothing new."""
    return "BOOTSTRAP" if checkpoint_hash is None else "UNCHANGED" if checkpoint_hash == source_hash else "NEW_REVISION"


CHECKPOINT = "source_name string, last_completed_source_hash string, last_completed_bronze_path string, last_completed_first_seen_at_utc timestamp, last_completed_at_utc timestamp, last_successful_poll_at_utc timestamp, last_publisher_run_id string, updated_at_utc timestamp"


class SourceCheckpoints:
    """What each source's publisher has completed: a row a source, advanced once all events of a payload are in the outbox."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.table = spark, VersionedTable(spark, path, ["source_name"])

    def gate(self, source: str, source_hash: str) -> str:
        rows = self.table.read().filter(F.col("source_name") == source).select("last_completed_source_hash").collect() if self.table.exists() else []
        return gate(rows[0][0] if rows else None, source_hash)

    def complete(self, source: str, source_hash: str, bronze_path: str, run_id: str) -> int:
        """Source, hash and path that are done; a poll that finds nothing new uses polled()."""
        row = self.spark.createDataFrame([(source, source_hash, bronze_path, None, None, None, run_id, None)], CHECKPOINT)
        return self.table.merge(row.withColumns({c: F.current_timestamp() for c in ("last_completed_first_seen_at_utc", "last_completed_at_utc", "last_successful_poll_at_utc", "updated_at_utc")}))

    def polled(self, source: str) -> int:
        now = F.current_timestamp()
        return self.table.update_where(F.col("source_name") == source, {"last_successful_poll_at_utc": now, "updated_at_utc": now})


def publish(outbox: Outbox, slots: DataFrame, published: DataFrame, lineage: dict[str, str | None]) -> int:
    """Decides every slot against the latest publication of its key and puts the events into the outbox."""
    named = slots.withColumnRenamed("_source_flag", "source_flag")  # what facts call it
    decided = revision_decisions(observed(named), published, SLOT)
    return outbox.put(events_of(decided, lineage))


def folder_sender(spark: SparkSession, folder: str) -> Callable[[str, str], None]:
    """Sends an event as a file of its own; a file is complete or not there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def send(event: str, payload: str) -> None:
        json.loads(payload)
        part, place = jvm.org.apache.hadoop.fs.Path(f"{folder}/_{event}.tmp"), jvm.org.apache.hadoop.fs.Path(f"{folder}/{event}-{uuid.uuid4().hex}.json")
        fs = place.getFileSystem(conf)
        out = fs.create(part, True)
        out.write(bytearray(payload.encode()))
        out.close()
        fs.rename(part, place)

    return send


def stream_to_log(spark: SparkSession, folder: str, log: str, checkpoint: str):
    """A query that appends every delivery to the log as it is; duplicates and late revisions are sorted out on reading,
    so there is no watermark that would drop them."""
    events = spark.readStream.schema(EVENT).json(folder)
    return events.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
