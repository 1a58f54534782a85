"""Rows that broke a rule of their contract: held with the rules, their run and what they said, and replayed once they are corrected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.typing import typed
from halyard.plans.contracts import Contract
from halyard.plans.quality import split_quarantine
from halyard.plans.store import VersionedTable

HELD, RELEASED = "HELD", "RELEASED"


class Quarantine:
    """What a contract's dataset holds back. A row is known by the hash of its raw columns, so holding it again adds nothing."""

    def __init__(self, spark: SparkSession, path: str, contract: Contract, beside: list[str] | None = None) -> None:
        """beside: columns besides the raw ones that tell rows apart; they are kept as text."""
        self.spark, self.contract, self.table, self.beside = spark, contract, VersionedTable(spark, path, ["payload_hash"]), beside or []
        self.raw = [raw for raw, _ in contract.typing().values()]

    def _hashed(self, rows: DataFrame) -> DataFrame:
        said = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in [*self.beside, *self.raw]]), {"ignoreNullFields": "false"})
        return rows.withColumn("payload_hash", F.sha2(said, 256))

    def _split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        return split_quarantine(typed(rows, self.contract.typing()), self.contract)

    def _held(self, bad: DataFrame, run_id: str) -> DataFrame:
        """Rows as the table has them; equal rows are one."""
        row = F.map_from_arrays(F.array(*[F.lit(c) for c in self.raw]), F.array(*[F.col(c).cast("string") for c in self.raw]))
        rows = bad.select("payload_hash", F.lit(self.contract.dataset).alias("dataset_name"), F.lit(run_id).alias("run_id"), F.col("_rules").alias("rules"), row.alias("row"), F.lit(HELD).alias("state"), *[F.col(c).cast("string").alias(c) for c in self.beside])
        first = rows.groupBy("payload_hash").agg(F.first(F.struct(*rows.columns[1:])).alias("r"))
        return first.select("payload_hash", "r.*").withColumn("changed_at_utc", F.current_timestamp())

    def _rows(self, good: DataFrame) -> DataFrame:
        return good.select(*self.contract.typing())

    def admit(self, rows: DataFrame, target: VersionedTable, run_id: str) -> dict[str, int]:
        """Merges the rows that may go on into target and holds the others."""
        good, bad = self._split(self._hashed(rows))
        before = self.table.version()
        version = self.table.insert_only(self._held(bad, run_id))
        target.merge(self._rows(good))
        return {"admitted": good.count(), "held": self.table.manifest(version)["inserted"] if version > before else 0}

    def waiting(self) -> DataFrame:
        return self.table.read().filter(F.col("state") == HELD)

    def replay(self, corrected: DataFrame, target: VersionedTable, run_id: str) -> dict[str, int]:
        """Takes corrected rows (payload_hash of what is held, and the raw columns): those that pass go into target and are released, the
        others stay with the rules that they break now. Hashes that nothing holds are ignored.

        Target comes first: a run that is lost in between is repeated without harm.
        """
        before = self.table.version()
        tried = corrected.join(self.waiting().select("payload_hash"), "payload_hash", "left_semi")
        good, bad = self._split(tried)
        target.merge(self._rows(good))
        now = {"run_id": F.lit(run_id), "changed_at_utc": F.current_timestamp()}
        outcome = good.select("payload_hash", F.lit(RELEASED).alias("state"), F.array().cast("array<string>").alias("rules")).unionByName(bad.select("payload_hash", F.lit(HELD).alias("state"), F.col("_rules").alias("rules")))
        version = self.table.merge(outcome, update={"state": F.col("s.state"), "rules": F.col("s.rules"), **now}, insert=False, change_only=False)
        rows = self.table.changes(before, version).filter("_change_type = 'update_postimage'").groupBy("state").count().collect() if version > before else []  # two at most
        said = {r.state: r["count"] for r in rows}
        return {"released": said.get(RELEASED, 0), "still_held": said.get(HELD, 0)}
