"""A versioned table's changes as a stream: offsets are versions, and each file that they wrote is a partition.

`spark.readStream.format(FORMAT).option("path", table.path)` gives the rows of `table.changes()` as versions are committed; a query
that is begun again goes on after the last version that its checkpoint has. Files are read by the executors, in Arrow batches, from
any file system that pyarrow reaches; nothing is listed but the manifests, so what a lost writer left is never read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from halyard.plans.store import AFTER, BEFORE, DELETE, KIND, PREVIOUS, VersionedTable

FORMAT = "halyard_changes"
_MARKS = [StructField("_change_type", StringType()), StructField("_version", IntegerType())]


class Written(InputPartition):
    """A file of a version."""

    def __init__(self, version: int, path: str) -> None:
        self.version, self.path = version, path


class Manifests:
    """The manifests of a table, read without a session."""

    def __init__(self, path: str) -> None:
        self.fs, self.root = fs.FileSystem.from_uri(path.rstrip("/"))

    def latest(self) -> int:
        files = self.fs.get_file_info(fs.FileSelector(f"{self.root}/_manifest", allow_not_found=True))
        return max((int(f.base_name[:-5]) for f in files if f.size and re.fullmatch(r"[0-9]+\.json", f.base_name)), default=-1)

    def of(self, version: int) -> dict:
        with self.fs.open_input_stream(f"{self.root}/_manifest/{version}.json") as f:
            return json.loads(f.read())

    def files(self, version: int) -> list[Written]:
        folders = [fs.FileSelector(f"{self.root}/{folder}") for folder in self.of(version)["written"]]
        return [Written(version, f.path) for folder in folders for f in self.fs.get_file_info(folder) if f.base_name.endswith(".parquet")]


def read_file(files: fs.FileSystem, written: Written, wanted: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The changes in a file, under a schema whose last columns are the kind of change and the version."""
    plain = list(wanted)[:-2]

    def rows(columns: dict[str, pa.Array], kinds: pa.Array) -> pa.RecordBatch:
        n = len(kinds)
        data = [columns[f.name].cast(f.type, safe=False) if f.name in columns else pa.nulls(n, f.type) for f in plain]
        return pa.RecordBatch.from_arrays([*data, kinds.cast(pa.string()), pa.array([written.version] * n, pa.int32())], schema=wanted)

    with files.open_input_file(written.path) as f:
        for batch in pq.ParquetFile(f).iter_batches(batch_size=10_000):
            batch = batch.filter(pc.is_valid(batch[KIND]))
            if not batch.num_rows:
                continue
            yield rows({c: batch[c] for c in batch.schema.names}, pc.if_else(pc.equal(batch[KIND], AFTER), AFTER, batch[KIND]))
            changed = batch.filter(pc.equal(batch[KIND], AFTER))
            if changed.num_rows:
                before = changed[PREVIOUS]
                yield rows({k.name: pc.struct_field(before, k.name) for k in before.type}, pa.array([BEFORE] * changed.num_rows))


class ChangeReader(DataSourceStreamReader):
    def __init__(self, path: str, after: int, schema: StructType) -> None:
        self.path, self.after, self.wanted = path, after, to_arrow_schema(schema)

    def initialOffset(self) -> dict:
        return {"version": self.after}

    def latestOffset(self) -> dict:
        return {"version": max(Manifests(self.path).latest(), self.after)}

    def partitions(self, start: dict, end: dict) -> list[Written]:
        manifests = Manifests(self.path)
        return [f for version in range(start["version"] + 1, end["version"] + 1) for f in manifests.files(version)]

    def read(self, partition: Written) -> Iterator[pa.RecordBatch]:
        yield from read_file(Manifests(self.path).fs, partition, self.wanted)


class ChangeFeed(DataSource):
    """Options: path, and startingVersion (default -1), the version after which to begin."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        manifests = Manifests(self.options["path"])
        fields = StructType.fromJson(manifests.of(manifests.latest())["schema"]).fields
        return StructType([*[StructField(f.name, f.dataType, True) for f in fields], *_MARKS])

    def streamReader(self, schema: StructType) -> ChangeReader:
        return ChangeReader(self.options["path"], int(self.options.get("startingVersion", -1)), schema)


def changes(spark: SparkSession, table: VersionedTable, after: int = -1) -> DataFrame:
    """The stream of what versions after one changed: the table's columns, _change_type and _version."""
    spark.dataSource.register(ChangeFeed)
    return spark.readStream.format(FORMAT).option("path", table.path).option("startingVersion", after).load()


def net(changed: DataFrame, keys: list[str]) -> DataFrame:
    """The last change of each key, with _gone: whether that took it away."""
    last = changed.filter(F.col("_change_type") != BEFORE)
    rest = [c for c in last.columns if c not in keys]
    # In one version a key may go and come in again; then it is there.
    best = last.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_version", F.col("_change_type") != DELETE)).alias("r")).select(*keys, "r.*")
    return best.withColumn("_gone", F.col("_change_type") == DELETE).drop("_change_type", "_version")


def follow(spark: SparkSession, source: VersionedTable, fact: VersionedTable, checkpoint: str, shaped: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True) -> StreamingQuery:
    """Keeps a fact as its source is, by the keys that changed, deletes included.

    A batch that is played again changes nothing, as a merge of the same rows makes no version. shaped: what a fact's rows are made of the
    source's; it keeps the keys and _gone.
    """

    def apply(batch: DataFrame, _: int) -> None:
        rows = net(batch, source.keys)
        fact.merge(shaped(rows) if shaped else rows, gone="_gone")

    stream = changes(spark, source).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()
