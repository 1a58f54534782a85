"""XML payloads: nested records to flat rows of strings. Each file is a payload, or each folder, whose files are the parts of it in the order of their names.

Files of any size are read in blocks, as text that is cut at end tags; no task reads a payload, and no row holds one. An end tag of a record
has to be written as `</Name>`; one with a prefix or a blank is refused.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from halyard.session import scratch_folder
from halyard.sources.delimited import in_parts, starts_of

_XML = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "true"}


def text(value: str) -> Column:
    """An element's text, trimmed, null when empty: an empty tag reads as an empty string."""
    return F.nullif(F.trim(F.col(value)), F.lit(""))


def _pieces(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(_file, block, lead, xml): the text up to each end tag of a record: what stands before the record, and the record within <r>.

    Empty elements are records too, and stand before the one that ends.
    """
    said = F.col("value")
    said = F.when(F.contains(said, F.lit("<!--")), F.regexp_replace(said, "(?s)<!--.*?-->", "")).otherwise(said)
    odd = F.col("said").rlike(rf"</(?:[\w.-]+:{tag}\s*|{tag}\s+)>|<[\w.-]+:{tag}[\s/>]|<!--")
    empty = rf"<{tag}(?:\s[^<>]*)?/>"
    rows = spark.read.option("lineSep", f"</{tag}>").text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("block"), said.alias("said"))
    rows = rows.withColumn("said", F.when(odd, F.raise_error(F.concat(F.lit(f"{tag} is written with a prefix or a blank, or within a comment, in "), "_file")).cast("string")).otherwise(F.col("said")))
    rows = rows.withColumns({"empty": F.when(F.contains("said", F.lit("/>")), F.regexp_count("said", F.lit(empty))).otherwise(0), "said": F.when(F.contains("said", F.lit("/>")), F.regexp_replace("said", empty, "")).otherwise(F.col("said"))})
    record = F.regexp_extract("said", rf"(?s)(<{tag}[\s>].*)", 1)
    rows = rows.withColumn("record", record).withColumn("lead", F.substr("said", F.lit(1), F.length("said") - F.length("record")))
    ended = F.when(F.col("record") != "", F.concat("record", F.lit(f"</{tag}>"))).otherwise("")
    xml = F.concat(F.lit("<r>"), F.repeat(F.lit(f"<{tag}/>"), F.col("empty")), ended, F.lit("</r>"))
    # Generated, so that a filter isn't pushed below, where each use of a column would be worked out anew.
    return rows.select("_file", "block", F.explode(F.array(F.struct("lead", xml.alias("xml")))).alias("p")).select("_file", "block", "p.*")


#: Characters that are parsed at once.
_AT_ONCE = 1 << 20
_PREFIXED = re.compile(r"""(</?)[\w.-]+:|\s[\w.-]+:[\w.-]+\s*=\s*(?:"[^"]*"|'[^']*')""")


def _parsed(pieces: list[str]) -> Iterator[ElementTree.Element | None]:
    """The <r> of each piece; None where one can't be parsed. They are parsed together as long as all of them can be."""
    try:
        yield from list(ElementTree.fromstring(f"<b>{''.join(pieces)}</b>")) if len(pieces) > 1 else [ElementTree.fromstring(pieces[0])]
    except ElementTree.ParseError:
        if len(pieces) > 1:
            half = len(pieces) // 2
            yield from _parsed(pieces[:half])
            yield from _parsed(pieces[half:])
            return
        try:  # a prefix is declared further up
            yield ElementTree.fromstring(_PREFIXED.sub(lambda m: m[1] or "", pieces[0]))
        except ElementTree.ParseError:
            yield None


def _elements(spark: SparkSession, path: str, tag: str, columns: list[str], flat: Callable[[ElementTree.Element], list[tuple]], counted: str, parts: bool) -> DataFrame:
    """(file, _source_record_number, *columns): the rows that flat makes of each record, in document order, from 1 in each payload.

    A row is an occurrence of the tag `counted`, so that blocks are counted without being parsed; what can't be parsed has a number and no row.
    """
    plain = F.when(F.contains("xml", F.lit("<![CDATA[")), F.regexp_replace("xml", r"(?s)<!\[CDATA\[.*?\]\]>", "")).otherwise(F.col("xml"))
    pieces = _pieces(spark, path, tag).withColumn("n", F.regexp_count(plain, F.lit(rf"<{counted}[\s/>]"))).filter("n > 0").withColumn("_hash", F.xxhash64("_file"))
    each = pieces.select("_file", "_hash", "block", F.explode(F.array_repeat(F.lit(0), F.col("n")))).select("_file", "_hash", "block", F.monotonically_increasing_id().alias("at"))
    starts = starts_of(each.groupBy("_file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")), parts).withColumn("_hash", F.xxhash64("_file")).drop("_file")
    ddl = ", ".join(["_hash long", "block long", "_there boolean", *[f"{c} string" for c in columns]])
    schema, nothing = to_arrow_schema(StructType.fromDDL(ddl)), (None,) * len(columns)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, blocks, ns, xmls = (batch.column(k).to_pylist() for k in range(4))
            at = 0
            while at < len(xmls):
                end, size = at, 0
                while end < len(xmls) and (size < _AT_ONCE or end == at):
                    size, end = size + len(xmls[end]), end + 1
                out, keys = [], []
                for k, r in zip(range(at, end), _parsed(xmls[at:end]), strict=True):
                    found = [(True, *row) for record in (r if r is not None else ()) for row in flat(record)][: ns[k]]
                    out += found + [(False, *nothing)] * (ns[k] - len(found))
                    keys += [k] * ns[k]
                values = zip(*out, strict=True)
                arrays = [pa.array([hashes[k] for k in keys], pa.int64()), pa.array([blocks[k] for k in keys], pa.int64()), *[pa.array(v, f.type) for v, f in zip(values, list(schema)[2:], strict=True)]]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
                at = end

    found = pieces.select("_hash", "block", "n", "xml").mapInArrow(rows, ddl).withColumn("at", F.monotonically_increasing_id())
    both = found.join(F.broadcast(starts), ["_hash", "block"])  # a row a block
    return both.filter("_there").select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("_source_record_number"), *columns)


def _heads(spark: SparkSession, path: str, tag: str, fields: list[str], parts: bool) -> DataFrame:
    """(file, *fields): what a payload says outside its records, once."""
    element = lambda f: F.regexp_extract("lead", rf"(?s)(<(?:[\w.-]+:)?{f}[\s>].*?</(?:[\w.-]+:)?{f}>)", 1)
    near = " OR ".join(f"contains(lead, '{f}')" for f in fields)
    said = _pieces(spark, path, tag).filter(near).select("_file", F.concat(F.lit("<r>"), *[element(f) for f in fields], F.lit("</r>")).alias("xml"))
    said = said.select(in_parts(F.col("_file"), parts)[0].alias("file"), F.from_xml("xml", ", ".join(f"{f} string" for f in fields), _XML).alias("r"))
    one = lambda f: F.when(F.min(f"r.{f}") != F.max(f"r.{f}"), F.raise_error(F.concat(F.lit(f"{f} has two values in "), F.col("file"))).cast("string")).otherwise(F.max(f"r.{f}"))
    return said.groupBy("file").agg(*[one(f).alias(f) for f in fields])


def _flat(rows: DataFrame, columns: dict[str, Column], file_col: str | None) -> DataFrame:
    return rows.select(*[c.alias(n) for n, c in columns.items()], "_source_record_number", *([F.col("file").alias(file_col)] if file_col else []))


def _texts(fields: list[str]) -> Callable[[ElementTree.Element], list[tuple]]:
    return lambda record: [tuple(record.findtext(f) for f in fields)]


def _fuels(day: ElementTree.Element) -> list[tuple]:
    date, out = day.findtext("Day"), []
    for hour in day.findall("HourlyData"):
        number = hour.findtext("Hour")
        for fuel in hour.findall("FuelTotal"):
            value = fuel.find("EnergyValue")
            out.append((date, number, fuel.findtext("Fuel"), *((None, None) if value is None else (value.findtext("Output"), value.findtext("OutputQuality")))))
    return out


def read_generation(spark: SparkSession, path: str, file_col: str | None = None, parts: bool = False) -> DataFrame:
    """(date_raw, hour_raw, fuel_type_raw, output_raw, output_quality_raw): three levels flattened."""
    rows = _elements(spark, path, "DailyData", ["date", "hour", "fuel", "output", "quality"], _fuels, "FuelTotal", parts)
    return _flat(rows, {"date_raw": text("date"), "hour_raw": text("hour"), "fuel_type_raw": text("fuel"), "output_raw": text("output"), "output_quality_raw": text("quality")}, file_col)


def read_day_ahead(spark: SparkSession, path: str, file_col: str | None = None, parts: bool = False) -> DataFrame:
    """A row an hour, with the document's delivery date on each."""
    tag, fields = "HourlyPriceComponents", ["PricingHour", "ZonalPrice", "LossPriceCapped", "CongestionPriceCapped", "Flag"]
    rows = _elements(spark, path, tag, fields, _texts(fields), tag, parts)
    both = rows.join(F.broadcast(_heads(spark, path, tag, ["DeliveryDate"], parts)), "file", "left")  # a row a payload
    return _flat(both, {"market_date_raw": text("DeliveryDate"), "hour_ending_raw": text("PricingHour"), "zonal_price_raw": text("ZonalPrice"), "loss_price_raw": text("LossPriceCapped"), "congestion_price_raw": text("CongestionPriceCapped"), "source_flag_raw": text("Flag")}, file_col)


def read_realtime(spark: SparkSession, path: str, file_col: str | None = None, parts: bool = False) -> DataFrame:
    """A row an interval; the average at the end of a document is no interval and is not read."""
    tag, fields = "ZonalPrice", ["Interval", "Flag", "LmpCap", "LossPriceCap", "CongPriceCap"]
    rows = _elements(spark, path, tag, fields, _texts(fields), tag, parts)
    both = rows.join(F.broadcast(_heads(spark, path, tag, ["CreatedAt", "DeliveryDate", "DeliveryHour"], parts)), "file", "left")  # a row a payload
    return _flat(both, {
        "delivery_date_raw": text("DeliveryDate"), "delivery_hour_raw": text("DeliveryHour"), "interval_raw": text("Interval"), "flag_raw": text("Flag"),
        "lmp_cap_raw": text("LmpCap"), "loss_price_cap_raw": text("LossPriceCap"), "cong_price_cap_raw": text("CongPriceCap"), "created_at_raw": text("CreatedAt"),
    }, file_col)


def element_paths(spark: SparkSession, path: str, tag: str) -> dict[str, str]:
    """Paths of all elements below a tag and their inferred types."""
    from pyspark.sql.types import ArrayType, StructType

    schema = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").load(path).schema
    out: dict[str, str] = {}

    def walk(kind, at: str) -> None:
        if isinstance(kind, ArrayType):
            walk(kind.elementType, at)
        elif isinstance(kind, StructType):
            for f in kind.fields:
                walk(f.dataType, f"{at}/{f.name}")
        else:
            out[at] = kind.simpleString()

    walk(schema, tag)
    return out


def tag_counts(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(element, n): how often each element occurs, by its local name."""
    return tags_and_namespaces(spark, path, parts)[0]


def namespaces(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(prefix, uri) that elements declare; the default one has an empty prefix."""
    return tags_and_namespaces(spark, path, parts)[1]


def tags_and_namespaces(spark: SparkSession, path: str, parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """tag_counts and namespaces, from one reading of the files."""
    counts, spaces = _walked(spark, path, parts)
    return counts.groupBy(F.substring_index("path", "/", -1).alias("element")).agg(F.sum("n").alias("n")), spaces


def path_counts(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(file, path, n): how often each element occurs under each path of local names, in payloads of any size."""
    return _walked(spark, path, parts)[0]


# -- blocks of files, whatever they begin within

_OUTSIDE, _COMMENT, _DATA = 0, 1, 2
_ENDS = {_COMMENT: "-->", _DATA: "]]>"}
_TOKEN = re.compile(r"<!--|<!\[CDATA\[|<\?.*?\?>|<([^\s/<>!?][^\s/<>]*)([^<>]*?)(/?)>", re.S)
_SPACE = re.compile(r"\sxmlns(?::([\w.-]+))?\s*=\s*[\"']([^\"']*)[\"']")
#: Transitions that are kept of a block at once.
_KEPT = 100_000


def _steps(said: str, state: int, closes: bool) -> tuple[list, int]:
    """What a piece of text does: None for an element that it closes, (name, whether it stays open, namespaces) for one that it opens; and its last state."""
    steps, at = [], 0
    if state == _OUTSIDE and closes:
        steps.append(None)
        at = said.find(">") + 1
    while True:
        if state != _OUTSIDE:
            end = said.find(_ENDS[state], at)
            if end < 0:
                return steps, state
            at, state = end + 3, _OUTSIDE
        m = _TOKEN.search(said, at)
        if not m:
            return steps, state
        at = m.end()
        if m[0] == "<!--":
            state = _COMMENT
        elif m[0] == "<![CDATA[":
            state = _DATA
        elif m[1]:
            steps.append((m[1].rpartition(":")[2], not m[3], [(p or "", u) for p, u in _SPACE.findall(m[2])] if "xmlns" in m[2] else []))


class _Pieces:
    """Pieces of one block, each from behind a "</" to the next (the first of a file begins the file): their shapes, which are the pieces without
    texts and attributes, and those that have to be read as they are."""

    def __init__(self, said: pa.Array, first: bool) -> None:
        self.said, self.first = said, first
        odd = pc.or_(pc.match_substring(said, "<!"), pc.match_substring(said, "xmlns")).to_numpy(zero_copy_only=False)
        if first:
            odd[0] = True
        self.odd = [*np.flatnonzero(odd).tolist(), len(said)]
        shapes = pc.replace_substring_regex(said, r">[^<]+", ">")
        if pc.any(pc.match_substring(shapes, "=")).as_py():
            shapes = pc.replace_substring_regex(shapes, r"(<[^\s<>/!?]+)\s[^<>]*?(/?>)", r"\1\2")
        coded = shapes.dictionary_encode()
        kinds = coded.dictionary.to_pylist()
        self.shapes = [kinds[k] for k in coded.indices.to_pylist()]
        self._ends: dict[int, list[int]] = {}

    def ending(self, state: int, at: int) -> int:
        """The next piece that ends a comment or character data."""
        if state not in self._ends:
            self._ends[state] = [*np.flatnonzero(pc.match_substring(self.said, _ENDS[state]).to_numpy(zero_copy_only=False)).tolist(), len(self.said)]
        return self._ends[state][bisect_left(self._ends[state], at)]


class _Node(dict):
    """How many elements are closed and which are open; shape -> [the node after it, how often]."""

    def __init__(self, at: tuple[int, tuple[str, ...]]) -> None:
        super().__init__()
        self.at = at


class _Block:
    """A block as it is if it begins in a state: how many open elements it closes, those it leaves open, and its elements by path,
    below how many closed ones. Shapes come again and again, so what one does at a place is worked out once."""

    def __init__(self, state: int) -> None:
        self.begin = self.state = state
        self.counts, self.spaces = Counter(), set()
        self.node = _Node((0, ()))
        self.nodes, self.kept = {self.node.at: self.node}, 0

    def _after(self, at: tuple[int, tuple[str, ...]], steps: list, n: int = 0) -> tuple[int, tuple[str, ...]]:
        """Where steps lead to; n: how often they were taken, counted."""
        closed, open_ = at
        for step in steps:
            if step is None:
                closed, open_ = (closed, open_[:-1]) if open_ else (closed + 1, ())
                continue
            name, stays, spaces = step
            if n:
                self.counts[closed, "/".join((*open_, name))] += n
                self.spaces.update(spaces)
            if stays:
                open_ = (*open_, name)
        return closed, open_

    def _node(self, at: tuple[int, tuple[str, ...]]) -> _Node:
        return self.nodes.setdefault(at, _Node(at))

    def _sum(self) -> None:
        """Counts what was taken, and forgets it."""
        for node in self.nodes.values():
            for shape, (_, n) in node.items():
                self._after(node.at, _steps(shape, _OUTSIDE, True)[0], n)
        self.node = _Node(self.node.at)
        self.nodes, self.kept = {self.node.at: self.node}, 0

    def take(self, pieces: _Pieces) -> None:
        at, n = 0, len(pieces.shapes)
        while at < n:
            if self.state == _OUTSIDE:
                until = pieces.odd[bisect_left(pieces.odd, at)]
                node = self.node
                for shape in pieces.shapes[at:until]:
                    entry = node.get(shape)
                    if entry is None:
                        entry = node[shape] = [self._node(self._after(node.at, _steps(shape, _OUTSIDE, True)[0])), 0]
                        self.kept += 1
                    entry[1] += 1
                    node = entry[0]
                self.node, at = node, until
            else:
                at = pieces.ending(self.state, at)
            if at < n:
                steps, self.state = _steps(pieces.said[at].as_py(), self.state, not (pieces.first and at == 0))
                self.node = self._node(self._after(self.node.at, steps, 1))
                at += 1
            if self.kept > _KEPT:
                self._sum()

    def row(self, file: int, block: int) -> dict:
        self._sum()
        closed, open_ = self.node.at
        counts = [{"closed": closed, "below": below, "n": n} for (closed, below), n in self.counts.items()]
        return {"file": file, "block": block, "begin": self.begin, "end": self.state, "closed": closed, "open": list(open_), "counts": counts, "spaces": [{"prefix": p, "uri": u} for p, u in self.spaces]}


_BLOCK = "file long, block long, begin int, end int, closed int, open array<string>, counts array<struct<closed:int, below:string, n:long>>, spaces array<struct<prefix:string, uri:string>>"


def _walked(spark: SparkSession, path: str, parts: bool) -> tuple[DataFrame, DataFrame]:
    """(file, path, n) of elements and (prefix, uri) of the namespaces that they declare, in payloads of any size.

    Files are read in blocks, each once and in any order. What a block does to the open elements is put together in the order of
    blocks: a row a block and state, as long as its elements are deep. A ">" within an attribute has to be written as an entity.
    """
    schema = to_arrow_schema(StructType.fromDDL(_BLOCK))
    pieces = spark.read.option("lineSep", "</").text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, states = None, []
        made = lambda: pa.RecordBatch.from_pylist([s.row(*at) for s in states], schema=schema)
        for batch in batches:
            files, places = (batch.column(k).to_numpy() for k in range(2))
            turns = (np.flatnonzero((files[1:] != files[:-1]) | (places[1:] != places[:-1])) + 1).tolist()
            for start, end in zip([0, *turns], [*turns, len(files)], strict=True):
                if start == end:
                    continue
                here, new = (int(files[start]), int(places[start])), False
                if here != at:
                    if states:
                        yield made()
                    at, new = here, True
                    states = [_Block(s) for s in ((_OUTSIDE,) if at[1] == 0 and not parts else (_OUTSIDE, _COMMENT, _DATA))]
                taken = _Pieces(batch.column(2).slice(start, end - start), new and at[1] == 0)
                for s in states:
                    s.take(taken)
        if states:
            yield made()

    def begun(rows: pd.DataFrame) -> pd.DataFrame:
        state, open_, out = _OUTSIDE, [], []
        of = {(r.part, r.block, r.begin): r for r in rows.itertuples(index=False)}
        for part, block in sorted({(p, b) for p, b, _ in of}):
            r = of[part, block, state]
            out.append((r.payload, r.file, block, state, list(open_)))
            state, open_ = r.end, open_[: max(0, len(open_) - r.closed)] + list(r.open)
        return pd.DataFrame(out, columns=["payload", "file", "block", "begin", "above"])

    # The rows are few and are read twice, the files once.
    pieces.mapInArrow(blocks, _BLOCK).write.parquet(folder := f"{scratch_folder(spark)}/blocks")
    each = spark.read.schema(_BLOCK).parquet(folder)
    payload, part = in_parts(F.col("_metadata.file_path"), parts)
    names = spark.read.format("binaryFile").load(path).select(F.xxhash64("_metadata.file_path").alias("file"), payload.alias("payload"), part.alias("part"))
    starts = each.drop("counts", "spaces").join(names, "file").groupBy("payload").applyInPandas(begun, "payload string, file long, block long, begin int, above array<string>")
    found = each.join(starts, ["file", "block", "begin"])
    above = F.slice("above", F.lit(1), F.greatest(F.size("above") - F.col("c.closed"), F.lit(0)))
    counted = found.select("payload", "above", F.explode("counts").alias("c")).groupBy(F.col("payload").alias("file"), F.array_join(F.concat(above, F.array("c.below")), "/").alias("path")).agg(F.sum("c.n").alias("n"))
    return counted, found.select(F.inline("spaces")).distinct()
