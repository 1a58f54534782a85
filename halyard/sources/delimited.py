"""Delimited files with a preamble: the header is the one early line that holds all required names. Each file is a payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines in which the header has to be.
SEARCHED = 50
#: Lines of a chunk, over whose sums prefixes are taken; lines that a quoted record may run over.
CHUNK, LONGEST = 10_000, 10_000


def in_parts(file: Column, parts: bool) -> tuple[Column, Column]:
    """(payload, part) of a file's path: the path itself, or its folder and its name, by which a payload's parts are in order."""
    return (F.regexp_replace(file, "/[^/]*$", ""), F.regexp_extract(file, "[^/]*$", 0)) if parts else (file, F.lit(""))


def starts_of(sizes: DataFrame, parts: bool) -> DataFrame:
    """(_file, block, file, first, before) of a row (_file, block, n, first) a block: the payload, and what stands before the block in it."""
    file, part = in_parts(F.col("_file"), parts)
    before = Window.partitionBy("file").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumns({"file": file, "part": part}).select("_file", "block", "file", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def numbered_lines(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(file, line_number, line) of files of any size: blocks are read apart, and only their line counts are summed up.

    A block's lines are read one after the other, so within it their numbers are distances of a running id. parts: a payload is a
    folder, and its files, in the order of their names, are the parts of it.
    """
    block = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select(*block, F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    starts = starts_of(lines.groupBy("_file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")), parts)
    return lines.join(F.broadcast(starts), ["_file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_number"), "line")  # a row a block


def _before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows (file, line_number, ...) with the sum of value over the lines of their file before them.

    Sums are over chunks of lines and of whole chunks, so a file's lines are never in one task.
    """
    rows = rows.withColumns({"_chunk": F.floor(F.col("line_number") / CHUNK), "_value": value})
    chunks = rows.groupBy("file", "_chunk").agg(F.sum("_value").alias("_in"))
    whole = chunks.select("file", "_chunk", (F.sum("_in").over(Window.partitionBy("file").orderBy("_chunk")) - F.col("_in")).alias("_base"))
    within = F.sum("_value").over(Window.partitionBy("file", "_chunk").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_value")
    return rows.withColumn("_within", within).join(whole, ["file", "_chunk"]).withColumn(name, F.col("_base") + F.col("_within")).drop("_chunk", "_value", "_base", "_within")


def logical_lines(lines: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(file, line_number, line): the records of (file, line_number, line), whose quoted fields may hold line breaks; numbers count records, from the first.

    Whether a line begins within quotes is the parity of the quotes before it: a line keeps the state or turns it, so chunks of lines are
    looked at apart and only their parities are added up. Breaks within a field become line feeds. A quote that is not closed within
    so many lines is refused.
    """
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    begun = _before(lines.withColumn("_q", quotes % 2), F.col("_q"), "_quotes").withColumn("_starts", (F.col("_quotes") % 2 == 0).cast("int"))
    placed = _before(begun, F.col("_starts"), "_records").withColumn("_record", F.col("_records") + F.col("_starts"))
    over = placed.groupBy("file", "_record").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > longest).first()
    if over:
        raise ValueError(f"record {over._record} of {over.file} runs over {over.n} lines: a quote is not closed")
    parts = placed.groupBy("file", "_record").agg(F.array_sort(F.collect_list(F.struct("line_number", "line"))).alias("p"))
    return parts.select("file", F.col("_record").alias("line_number"), F.array_join(F.col("p.line"), "\n").alias("line"))


def _names(line: Column) -> Column:
    return F.transform(F.split(line, ","), lambda c: F.trim(F.regexp_replace(c, '^"|"$', "")))


def headers_of(lines: DataFrame, required: list[str], searched: int = SEARCHED) -> DataFrame:
    """(file, n, header_at, names): how many early lines of each file hold all required names, and the first of them."""
    names = _names(F.col("line"))
    hit = (F.col("line_number") <= searched) & (F.size(F.array_intersect(names, F.array(*[F.lit(r) for r in required]))) == len(set(required)))
    first = F.min(F.when(hit, F.struct("line_number", names.alias("names"))))
    return lines.groupBy("file").agg(F.count_if(hit).alias("n"), first.alias("h")).select("file", "n", F.col("h.line_number").alias("header_at"), "h.names")


def read_after_header(spark: SparkSession, path: str, columns: dict[str, str], exact: bool = True, file_col: str | None = None, quoted: bool = False, parts: bool = False) -> DataFrame:
    """The rows below each file's header as strings, renamed (header name -> column), with _source_row_number from 1.

    quoted: fields in quotes may hold line breaks, and a quote within them is doubled; rows are then numbered by records.

    exact: the header has to be just these names in this order; else all files have to have the same header. file_col:
    what the file's path is called, if it is asked for. parts: each folder is a payload, its files are the parts of it.
    """
    lines = numbered_lines(spark, path, parts)
    headers = headers_of(lines, list(columns))
    said = headers.agg(F.count_if(F.col("n") != 1).alias("bad"), F.min(F.struct("n", "file")).alias("least"), F.max(F.struct("n", "file")).alias("most"), F.min("names").alias("names"), F.max("names").alias("other")).first()
    if said.bad is None or said.least is None or said.bad:
        wrong = said.least if said.least and said.least.n == 0 else said.most
        raise ValueError(f"{wrong.n if wrong and wrong.n else 'no'} header lines with {', '.join(columns)} in the first {SEARCHED}" + (f" of {wrong.file}" if wrong else ""))
    for names in (said.names, said.other):
        if exact and list(names) != list(columns) or names != said.names:
            raise ValueError(f"header is {names}, not {list(columns) if exact else said.names}")
    names = list(said.names)
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = lines.join(F.broadcast(headers.select("file", "header_at")), "file").filter(F.col("line_number") > F.col("header_at"))  # a row a payload
    rows = rows.select("file", (F.col("line_number") - F.col("header_at")).alias("line_number"), "line")
    rows = (logical_lines(rows) if quoted else rows).filter(F.trim("line") != "")
    parsed = rows.select("file", F.col("line_number").alias("_source_row_number"), F.from_csv("line", schema, {"escape": '"'} if quoted else {}).alias("r"))
    return parsed.select(*[F.col(f"r.`{n}`").alias(columns.get(n, n)) for n in names], "_source_row_number", *([F.col("file").alias(file_col)] if file_col else []))


def read_demand(spark: SparkSession, path: str, file_col: str | None = None, parts: bool = False) -> DataFrame:
    return read_after_header(spark, path, {"Date": "date_raw", "Hour": "hour_raw", "Market Demand": "market_demand_raw", "Ontario Demand": "ontario_demand_raw"}, file_col=file_col, parts=parts)


#: The zones' columns of the wide file, in its order.
ZONES = ["Northwest", "Northeast", "Ottawa", "East", "Toronto", "Essa", "Bruce", "Southwest", "Niagara", "West"]


def read_zonal_demand(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    names = ["Date", "Hour", "Ontario Demand", *ZONES, "Zone Total", "Diff"]
    return read_after_header(spark, path, {n: n.lower().replace(" ", "_") + "_raw" for n in names}, parts=parts)


def zonal_long(wide: DataFrame, typed_zones: dict[str, str] | None = None) -> DataFrame:
    """Ten rows for each row of typed zones, nulls kept."""
    zones = typed_zones or {z: z.lower() for z in ZONES}
    renamed = wide.withColumnsRenamed({c: z for z, c in zones.items()})
    return renamed.unpivot([c for c in wide.columns if c not in zones.values()], list(zones), "zone", "zonal_demand_mw")
