"""Runs and incremental facts: a run is recorded from start to end; a fact follows its source by version watermarks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.plans.contracts import CALLED, CONTRACTS, STATUS, Contract
from halyard.plans.store import VersionedTable, read_increment, reconcile

RUN = "run_id string, pipeline_name string, source_name string, start_timestamp timestamp, end_timestamp timestamp, status string, records_read long, records_written long, records_rejected long, error_message string"
WATERMARK = "pipeline_name string, dataset_name string, source_table string, target_table string, last_processed_version long, last_successful_run_id string, updated_timestamp timestamp"


class Runs:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.table = spark, VersionedTable(spark, path, ["run_id"])

    def start(self, pipeline: str, source: str) -> str:
        run_id = str(uuid.uuid4())
        row = self.spark.createDataFrame([(run_id, pipeline, source, None, None, "RUNNING", None, None, None, None)], RUN).withColumn("start_timestamp", F.current_timestamp())
        self.table.append(row)
        return run_id

    def finish(self, run_id: str, status: str, error: str | None = None, written: int | None = None) -> None:
        self.table.update_where(F.col("run_id") == run_id, {"status": F.lit(status), "end_timestamp": F.current_timestamp(), "error_message": F.lit(error and error[:4000]), "records_written": F.lit(written)})

    def run(self, pipeline: str, source: str, work: Callable[[str], int]) -> str:
        """Records work as a run; what it raises is recorded and goes on."""
        run_id = self.start(pipeline, source)
        try:
            written = work(run_id)
        except Exception as e:
            self.finish(run_id, "FAILED", str(e))
            raise
        self.finish(run_id, "SUCCESS", written=written)
        return run_id


def tables_of(spark: SparkSession, base: str, contract: Contract) -> tuple[VersionedTable, VersionedTable]:
    """The source-aligned table of a contract and the fact that follows it."""
    keys = list(contract.keys)
    return VersionedTable(spark, f"{base}/silver/{contract.dataset}", keys), VersionedTable(spark, f"{base}/gold/fact_{contract.dataset}", keys)


class IncrementalFacts:
    """Facts that follow their sources: changed keys since the watermark, current rows, merge, check, and only then the watermark."""

    def __init__(self, spark: SparkSession, base: str, pipeline: str = "gold_incremental") -> None:
        self.spark, self.base, self.pipeline = spark, base, pipeline
        self.watermarks = VersionedTable(spark, f"{base}/ops/pipeline_watermark", ["pipeline_name", "dataset_name"])
        self.runs = Runs(spark, f"{base}/ops/etl_run")

    def watermark(self, dataset: str) -> int:
        if not self.watermarks.exists():
            return -1
        rows = self.watermarks.read().filter((F.col("pipeline_name") == self.pipeline) & (F.col("dataset_name") == dataset)).select("last_processed_version").collect()
        return rows[0][0] if rows else -1

    def _advance(self, dataset: str, previous: int, until: int, run_id: str) -> None:
        if self.watermark(dataset) != previous:
            raise RuntimeError(f"the watermark of {dataset} is no longer {previous}")
        row = self.spark.createDataFrame([(self.pipeline, dataset, f"silver.{dataset}", f"gold.fact_{dataset}", until, run_id, None)], WATERMARK).withColumn("updated_timestamp", F.current_timestamp())
        self.watermarks.merge(row)

    def run(self, dataset: str) -> dict:
        contract = CONTRACTS[dataset]
        source, fact = tables_of(self.spark, self.base, contract)
        previous, until = self.watermark(dataset), source.version()
        said = {"previous_version": previous, "ending_version": until, "cdf_rows": 0, "changed_keys": 0, "processed_rows": 0, "status": "NO_CHANGE"}
        if until <= previous:
            return said

        def work(run_id: str) -> int:
            end, rows = read_increment(source, previous)
            fact.merge(rows)
            said["cdf_rows"] = source.changes(previous, end).count()
            said["changed_keys"] = said["processed_rows"] = rows.count()
            keys = rows.select(*contract.keys)
            self._agree(dataset, rows, fact.read().join(keys, list(contract.keys), "left_semi"))
            self._advance(dataset, previous, end, run_id)
            return said["processed_rows"]

        self.runs.run(self.pipeline, contract.source_name, work)
        return said | {"status": "SUCCESS"}

    def _agree(self, dataset: str, source: DataFrame, fact: DataFrame) -> None:
        contract = CONTRACTS[dataset]
        two = reconcile(source, fact, list(contract.columns), list(contract.keys)).first()
        if two.missing_from_target or two.unexpected_in_target or two.duplicate_keys:
            raise RuntimeError(f"{dataset} and its fact differ: {two.asDict()}")

    def verify(self, dataset: str) -> None:
        """Raises unless the whole fact is what its source was at the watermark; a run looks at the changed keys only."""
        source, fact = tables_of(self.spark, self.base, CONTRACTS[dataset])
        self._agree(dataset, source.read(self.watermark(dataset)), fact.read())


def run_in_order(steps: list[tuple[str, Callable[[], object]]]) -> dict[str, str]:
    """Runs steps one after the other; one that fails leaves those after it undone."""
    out = {name: "SKIPPED" for name, _ in steps}
    for name, step in steps:
        try:
            step()
        except Exception as e:  # the state is what is asked for; the next steps must not run
            out[name] = f"FAILED: {e}"
            break
        out[name] = "SUCCESS"
    return out


def latest_results(results: DataFrame) -> DataFrame:
    """The latest result of each rule of a dataset."""
    from halyard.operators.series import latest_by

    return latest_by(results, ["source_name", "dataset_name", "rule_id"], ["execution_timestamp", "run_id"])


def batch_status(results: DataFrame, dataset: str | None, rule: str | None = None) -> DataFrame:
    """Latest results of a dataset (required) and rule (optional) under the names the serving layer gives them: severity is a rule's outcome, status its execution."""
    from halyard.operators.serving import lookup

    found = lookup(latest_results(results), {"dataset_name": dataset}, {"rule_id": rule})
    return found.select(*[F.col(CALLED.get(c, c)).alias(c) for c in STATUS])


def unfinished_payloads(registry: DataFrame, runs: DataFrame) -> DataFrame:
    """Registered payloads whose run isn't among the successful ones."""
    return registry.join(runs.filter(F.col("status") == "SUCCESS").select("run_id"), "run_id", "left_anti")
