"""Operator 8: best-fit packing of documents into token sequences by the sum-of-squares rule.

A document goes where the sum over all residual gaps of the squared number of open bins with that gap becomes
smallest. Documents are taken longest first. Two rounds keep that a job without a central task: in the first, each
shard of about SHARD pieces packs its own; in the second, the bins that FAN shards left with a gap are opened again and
their pieces packed together, and bins that then fit into others whole are put there. Only (piece, length, checksum) rows
are shuffled, never texts, and a shard's size does not depend on the input's: rows are dealt by a hash of themselves and of
the partition they stand in, so a shard gets what is equal in a partition, but not what is equal in the table.

A document's ids end with an end mark (id 0). Only documents longer than a sequence are cut: whole sequences from the
end, so that the first piece is the shorter one.

Cases: a null text counts as empty and is the end mark alone; repeated rows are packed each for itself, also with equal
or null ids; ties between gaps go to the smallest gap and a new bin only if nothing else is as good; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm import vocabularies
from halyard.llm.common import batched, id_and_text, id_type, rows_of
from halyard.llm.pretokens import KEPT_CHARS, AfterSpace, Cut, Kept, splits_at_spaces

#: Tokens of a sequence.
CAPACITY = 2048
#: Pieces that one task packs together in the first round, about.
SHARD = 20_000
#: Shards whose unfilled bins are packed together in the second round.
FAN = 32
#: Bytes of a token, about; only the number of shards depends on it.
TOKEN_BYTES = 3
NO_GAP = np.int64(1) << 60
END = (0).to_bytes(4, "little")


class DocumentIds:
    """The ids of texts as the tokenizer gives them, with kept pre-tokens.

    ranks: the same vocabulary as ranks, by which single pre-tokens are encoded in half the time (the tests hold the two
    against each other); texts that hold special tokens or adjacent white space go to the tokenizer itself.
    """

    def __init__(self, name: str, ranks: str) -> None:
        self.coder = vocabularies.byte_level(name)
        self.special = [t.content for t in self.coder.get_added_tokens_decoder().values()]
        after_space = AfterSpace(ranks)
        self.first = Kept(lambda pieces: [array("I", after_space.plain(p)).tobytes() for p in pieces])
        self.spaced = Kept(after_space)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.coder.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [splits_at_spaces(t) and not any(s in t for s in self.special) for t in texts]
        by_piece = iter(self._by_piece([t for t, c in zip(texts, cut, strict=True) if c]))
        rest = iter(self.whole([t for t, c in zip(texts, cut, strict=True) if not c]))
        return [next(by_piece) if c else next(rest) for c in cut]

    def _by_piece(self, texts: list[str]) -> list[bytes]:
        """Texts cut at spaces: each distinct piece is looked up once, and its ids are put wherever it stands."""
        cut = Cut(texts)
        self.spaced.load(cut.distinct)
        self.first.load(set(cut.firsts))  # no space before these
        values = [*map(self.spaced.__getitem__, cut.distinct), *map(self.first.__getitem__, cut.firsts)]
        for kept, own in ((self.spaced, cut.distinct), (self.first, cut.firsts)):
            for p in own:
                if len(p) > KEPT_CHARS:
                    kept.pop(p, None)
            kept.trim()
        which = cut.which.copy()
        which[cut.begins] = len(cut.distinct) + np.arange(len(cut.firsts))
        out, stops = cut.ids(values, which)
        return [out[s:e].tobytes() for s, e in zip(stops, stops[1:], strict=False)]


def document_ids(name: str, ranks: str = vocabularies.BYTE_BPE_RANKS) -> DocumentIds:
    return vocabularies.held(DocumentIds, name, ranks)


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = vocabularies.BYTE_BPE, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32): what has to be packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = document_ids(tokenizer)
        for ids, texts in rows_of(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, coded in enumerate(ids_of(texts)):
                coded += END
                n = len(coded) // 4
                at, k = 0, 0
                while at < n:
                    end = at + ((n - at) % capacity or capacity)
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(end - at)
                    crc.append(zlib.crc32(coded[4 * at : 4 * end]))
                    at, k = end, k + 1
            columns = [ids.take(pa.array(row, pa.int64())), *(pa.array(x, t) for x, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32"])

    schema = f"id {id_type(df, id_col)}, piece int, start long, length long, ids_crc32 long"
    return batched(id_and_text(df, id_col, text_col)).mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin and the offset of each length, and what each bin leaves free; longest first, ties as they come."""
    open_bins = np.zeros(capacity + 1, np.int64)  # by gap; full bins are not counted
    where: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, gaps = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        # What the sum changes by at each gap from size on: of n bins one goes, and m that have what is left get one more.
        change = 2 * (open_bins[: capacity - size + 1] - open_bins[size:]) + 2
        change[0] = 1 - 2 * open_bins[size]  # a filled bin is no longer counted
        change = np.where(open_bins[size:] > 0, change, NO_GAP)
        best = int(change.argmin())
        if change[best] > min(2 * open_bins[capacity - size] + 1, NO_GAP - 1):
            b, gap = len(gaps), capacity
            gaps.append(capacity)
        else:
            gap = best + size
            b = where[gap].pop()
            open_bins[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        gaps[b] = left = gap - size
        if left:
            where[left].append(b)
            open_bins[left] += 1
    return bins, offsets, np.array(gaps, np.int64)


def merged(gaps: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bins put whole into others: for each the bin it goes to and where it begins there; fullest first, into the smallest gap.

    The rule keeps gaps of all sizes open for what may come; when nothing does, what they hold moves together.
    """
    open_bins = np.zeros(capacity + 1, bool)
    where: list[list[int]] = [[] for _ in range(capacity + 1)]
    to, shift = np.arange(len(gaps)), np.zeros(len(gaps), np.int64)
    for b in np.argsort(gaps, kind="stable").tolist():
        fill = capacity - int(gaps[b])
        gap = fill + int(open_bins[fill:].argmax())
        target, left = b, int(gaps[b])
        if open_bins[gap]:
            target, left = where[gap].pop(), gap - fill
            open_bins[gap] = bool(where[gap])
            to[b], shift[b] = target, capacity - gap
        if left:
            where[left].append(target)
            open_bins[left] = True
    return to, shift


def _round(fields: dict[str, str], capacity: int, last: bool):
    """Packs the rows of a group whose sequence_id is null; the others pass. In the last round bins that fit into others join them."""
    names = [*fields, "sequence_id", "offset", "gap"]

    def run(table: pa.Table) -> pa.Table:
        settled = table.filter(pc.is_valid(table["sequence_id"]))
        todo = table.filter(pc.is_null(table["sequence_id"]))
        order = [(c, "ascending") for c in ("length", "ids_crc32", "start", "piece")]
        todo = todo.sort_by(order) if len(todo) else todo  # a run that is repeated packs alike
        lengths = todo["length"].to_numpy()
        bins, offsets, gaps = sum_of_squares(lengths, capacity)
        if last and len(bins):
            to, shift = merged(gaps, capacity)
            bins, offsets = to[bins], offsets + shift[bins]
        group = int(table["group"][0].as_py())
        for name, values in (("sequence_id", (np.int64(group) << np.int64(32)) + bins), ("offset", offsets), ("gap", gaps[bins] if len(bins) else bins)):
            todo = todo.set_column(todo.schema.get_field_index(name), name, pa.array(values, pa.int64()))
        return pa.concat_tables([settled.select(names), todo.select(names)])

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, fan: int = FAN, rows: int | None = None) -> DataFrame:
    """items with a column length (1 to capacity) and ids_crc32, start, piece, and where each is placed: sequence_id, offset.

    rows: about how many items there are; counted if not given.
    """
    shards = max(1, -(-(items.count() if rows is None else rows) // shard))
    fields = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    schema = ", ".join(f"`{n}` {t}" for n, t in fields.items()) + ", sequence_id long, offset long, gap long"
    full = F.col("length") == capacity
    mixed = F.xxhash64(F.spark_partition_id(), *[F.col(n) for n in fields])  # equal rows of several partitions fall apart
    start = items.withColumns({"group": F.pmod(mixed, F.lit(shards)), "sequence_id": F.lit(None).cast("long"), "offset": F.lit(0).cast("long"), "gap": F.lit(capacity).cast("long")})
    first = start.groupBy("group").applyInArrow(_round(fields, capacity, shards == 1), schema)
    if shards == 1:
        return first.drop("gap")
    # Second round: filled bins stay where they are, the others' pieces meet those of other shards.
    from_shard = F.shiftright("sequence_id", 32)
    numbered = F.col("sequence_id") + F.lit(1 << 56)
    again = (
        first.withColumn("group", F.when(F.col("gap") > 0, F.floor(from_shard / fan)).otherwise(-1 - from_shard))
        .withColumn("sequence_id", F.when(F.col("gap") <= 0, numbered))
    )
    return again.groupBy("group").applyInArrow(_round(fields, capacity, True), schema).drop("gap")


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = vocabularies.BYTE_BPE, capacity: int = CAPACITY) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every text."""
    texts = id_and_text(df, id_col, text_col)
    about = texts.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.octet_length("text") / (TOKEN_BYTES * capacity))))).first()[0] or 0
    packed = pack(pieces(df, id_col, text_col, tokenizer, capacity), capacity, rows=about)
    return packed.withColumnRenamed("id", id_col)
