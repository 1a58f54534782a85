"""The queries of this subpackage, a thin one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from halyard.llm import bpe, collocations, importance, jaccard_join, line_chunks, mixing, packing, personal_data, piecewise_hashes, quality, revisits, secrets, token_counts
from halyard.llm.common import table


def op1_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.digests(revisits.resolve(revisits.records_of_pages(table(spark, sf_dir, "pages"))))


def op2_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op4_piecewise_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise_hashes.neighbours(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digests(personal_data.spans(table(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


def op10_content_defined_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.deduped(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "line_dedup.n_lines", "line_dedup.n_removed_lines")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mixture(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_revisit_resolution": op1_revisit_resolution,
    "op2_tokenizer_fertility": op2_tokenizer_fertility,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_piecewise_hashes": op4_piecewise_hashes,
    "op5_secret_scan": op5_secret_scan,
    "op6_personal_data": op6_personal_data,
    "op7_token_counts": op7_token_counts,
    "op8_sum_of_squares_packing": op8_sum_of_squares_packing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_content_defined_line_chunks": op10_content_defined_line_chunks,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_collocations": op12_collocations,
    "op13_source_mixing": op13_source_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_revisit_resolution": revisits.ORACLE_SQL,
    "op10_content_defined_line_chunks": line_chunks.ORACLE_SQL,
    "op11_importance_resampling": importance.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
    "op13_source_mixing": mixing.ORACLE_SQL,
}
