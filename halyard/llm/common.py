"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a batch that goes to a Python worker; a batch holds whole texts, so both are bounded.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batched(df: DataFrame) -> DataFrame:
    """df, with batches to Python workers kept small in its session."""
    for key, value in BATCH.items():
        df.sparkSession.conf.set(key, value)
    return df


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a checkpoint in the folder that the cluster names.

    The folder is spark.checkpoint.dir; only where that is unset (tests) one is set beside the warehouse.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        conf = df.sparkSession.conf
        context.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or conf.get("spark.sql.warehouse.dir") + "/checkpoints")
    return df.checkpoint(eager=True)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns as (id, text), whatever else df holds; a null text becomes an empty one."""
    return df.select(df[id_col].alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """The ids and the texts of each batch of (id, text)."""
    for batch in batches:
        yield batch.column(0), batch.column(1).to_pylist()


def unused(df: DataFrame, name: str) -> str:
    """name, or with marks before it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its rows' numbers from 1 in an order, without a task that sees them all.

    Rows are dealt by ranges of the order and sorted there; what is counted before a range comes from one row a range. The order
    should tell rows apart: rows that it leaves equal are in one range.
    """
    part, place = unused(df, "part"), unused(df, "place")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = checkpointed(dealt.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    before, sizes = 0, {}
    for row in dealt.groupBy(part).count().orderBy(part).collect():
        sizes[row[0]], before = before, before + row["count"]
    if not sizes:
        return df.withColumn(name, F.lit(0).cast("long"))
    base = df.sparkSession.createDataFrame(list(sizes.items()), f"`{part}` int, _before long")
    out = dealt.join(F.broadcast(base), part)  # one row a range
    return out.select(*[dealt[c] for c in df.columns], (F.col("_before") + dealt[place] + 1).alias(name))
