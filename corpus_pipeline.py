"""The stages that turn documents into packed training sequences.

Each stage takes what the one before it has kept, written as Parquet and read again; all but the last return the
columns of documents. Language and source columns that a table lacks count as null.

Cases: a null or empty text fails the first stage's base and goes; texts of any length go through whole; ties and repeated
rows go by the rules of each stage, so of equal texts the smallest id stays and rows with one id and text stay or go
together; an empty table gives an empty result; other columns stay up to the packing, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from halyard.llm import jaccard_join, line_chunks, packing, quality, secrets
from halyard.llm.common import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose tokeniser fertility lies within their language's bands."""
    return quality.filtered(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the content-defined chunks, and the ends and short passages that chunks miss, that stand earlier in the table; those of which nothing is left go."""
    return line_chunks.without_passages(docs, keep_empty=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest id."""
    return jaccard_join.representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in them replaced."""
    return secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and the sequences they are packed into."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenisers and a trained forest are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what lies between them is written below the folder for checkpoints.

    A stage's rows are deleted once the next one's are written; those that the last one reads, lazily, stay as long as
    the session's JVM.
    """
    base = _folder(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(path := f"{base}/{name}")
            docs = spark.read.parquet(path)
            if before:
                _delete(spark, before)
            before = path
    return docs


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _folder(spark: SparkSession) -> str:
    """A new folder below the one for checkpoints, deleted when the session's JVM ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
    path = f"{shared}/pipeline-{uuid.uuid4().hex}"
    fs, place = _place(spark, path)
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    fs, place = _place(spark, path)
    fs.delete(place, True)
