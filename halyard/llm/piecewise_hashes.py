"""Operator 4: context-triggered piecewise hashing of texts.

A rolling hash over the last WINDOW bytes ends a chunk where it fits the block size; each chunk gives one character of
a signature, from a hash of its bytes. The block size follows the text's length, so that a signature has at least
SIGNATURE / 2 characters or so, and a fingerprint holds the signatures of its block size and of twice that:
`block:signature:signature`. Two fingerprints are compared at the block sizes they share (equal, double or half), by
the edit distance (insertions and deletions) of the signatures; the likeness is 1 less the distance over the summed
lengths, and 0 if the signatures have no run of COMMON characters in common.

All hashes are numpy operations over a text's bytes: window sums, shifts, and prefix sums of a polynomial whose base has
an inverse modulo 2**64.

neighbours() also takes each text's next one in descending id order, as a range-partitioned pass: rows are dealt to
ranges of ids that end at quantiles, each range is sorted and read once, and gets a copy of the row that follows its last
one. Rows of one id, or with a null one, are read by one task, one after the other.

Cases: a null text counts as empty and has an empty signature, which is like itself; equal texts have equal
fingerprints; equal ids stand in the order of their texts, null ids come last; the next row after the last is the
first (a lone row follows itself); texts may have any length, and signatures have LONGEST characters at most; ids that
aren't numbers raise a TypeError; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from halyard.llm.common import batched, checkpointed, id_and_text, id_type

WINDOW = 7
#: Characters of a signature that the block size aims at, at first; it is halved while there are fewer than half as many.
#: Texts of few distinct windows may have many more at any size, as a window ends chunks everywhere or nowhere; a size up
#: is taken while it still has enough, and beyond LONGEST characters the rest of the text is the last one's chunk.
SIGNATURE, LONGEST = 64, 256
LEAST_BLOCK = 3
COMMON = 4
#: The characters of signatures.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Rows of a range, about, while there are not more than RANGES of them.
RANGE, RANGES = 8_000, 20_000

_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once; the powers for them are computed once.
_STRETCH = 1 << 16


def _powers(base: int) -> np.ndarray:
    out = np.full(_STRETCH + 1, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def _rolling(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: its window's sum, its weighted sum, and its shifted exclusive or."""
    wide = np.concatenate([np.zeros(WINDOW, np.uint32), data.astype(np.uint32)])
    n = len(data)
    total, weighted, mixed = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for back in range(WINDOW):
        part = wide[WINDOW - back : WINDOW - back + n]
        total += part
        weighted += np.uint32(WINDOW - back) * part
        mixed ^= part << np.uint32(5 * back)
    return total + weighted + mixed


def _signature(data: np.ndarray, ends: np.ndarray) -> str:
    """A character for each chunk; chunks end after the bytes `ends`, the last one with the text."""
    if not len(data):
        return ""
    stops = ends + 1
    if not len(stops) or stops[-1] != len(data):
        stops = np.append(stops, len(data))
    starts = np.concatenate([[0], stops[:-1]])
    values = np.zeros(len(stops), np.uint64)
    # Chunk hash: the sum of (byte + 1) * BASE ** (distance from the chunk's end), from prefix sums within each stretch.
    for begin in range(0, len(data), _STRETCH):
        piece = data[begin : begin + _STRETCH].astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(piece * _DOWN[: len(piece)], dtype=np.uint64)])
        a, b = np.searchsorted(stops, begin, side="right"), np.searchsorted(starts, begin + len(piece), side="left")
        s, e = np.maximum(starts[a:b], begin) - begin, np.minimum(stops[a:b], begin + len(piece)) - begin
        values[a:b] = values[a:b] * _UP[e - s] + (sums[e] - sums[s]) * _UP[e]
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    return _LETTERS[(values >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    """`block:signature:signature`, the second at twice the block size."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    block = LEAST_BLOCK
    while block * SIGNATURE < len(data):
        block *= 2
    rolling = _rolling(data)
    # What ends a chunk at twice a block size ends one at that size, too.
    coarser = lambda at, size: at[rolling[at] % np.uint32(size) == size - 1]
    ends = {block: np.flatnonzero(rolling % np.uint32(block) == block - 1)}
    while block > LEAST_BLOCK and len(ends[block]) < SIGNATURE // 2:
        block //= 2
        ends[block] = np.flatnonzero(rolling % np.uint32(block) == block - 1)
    while len(ends[block]) >= LONGEST and len(more := coarser(ends[block], 2 * block)) >= SIGNATURE // 2:
        block *= 2
        ends[block] = more
    return f"{block}:{_signature(data, ends[block][: LONGEST - 1])}:{_signature(data, coarser(ends[block], 2 * block)[: LONGEST - 1])}"


def longest_common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a column of the table per bit of an integer.

    What both begin and end with is in it, and is taken off first.
    """
    begin = len(os.path.commonprefix([a, b]))
    a, b = a[begin:], b[begin:]
    end = len(os.path.commonprefix([a[::-1], b[::-1]]))
    a, b, same = a[: len(a) - end], b[: len(b) - end], begin + end
    places: dict[str, int] = {}
    letters = np.array(list(a))
    for c in set(a):
        places[c] = int.from_bytes(np.packbits(letters == c, bitorder="little").tobytes(), "little")
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return same + len(a) - row.bit_count()


def _likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(COMMON, len(a), len(b))
    if not run:
        return 0.0
    runs = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in runs for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * longest_common(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: the best likeness of two fingerprints at a block size that both have."""
    if a == b:
        return 1.0
    (x, a1, a2), (y, b1, b2) = a.split(":"), b.split(":")
    x, y = int(x), int(y)
    if x == y:
        # Both block sizes are shared; the coarser one counts only where it has enough chunks to tell.
        pairs = [(a1, b1)] + ([(a2, b2)] if min(len(a2), len(b2)) >= 2 * COMMON else [])
    else:
        pairs = [(a1, b2)] if x == 2 * y else [(a2, b1)] if y == 2 * x else []
    return max([0.0, *(_likeness(p, q) for p, q in pairs)])


def edited(text: str, following: str) -> str:
    """The text, its last third replaced by as much of the beginning of the following one (or all)."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def ranges(df: DataFrame, id_col: str, rows: int = RANGE) -> tuple[DataFrame, int]:
    """df with the number of its id's range, in descending order, as `range`, and how many ranges there are.

    Ranges end at quantiles of the ids, so they have about as many rows each, wherever the ids lie; only the bounds reach
    the driver, RANGES at most. Rows of one id stay in one range. A row finds its range by halving.
    """
    if not isinstance(df.schema[id_col].dataType, NumericType):
        raise TypeError(f"{id_col} has to be numeric: its order is what tells the next text")
    n = df.select(id_col).count()
    wanted = min(RANGES, -(-n // rows))
    shares = [k / wanted for k in range(1, wanted)]
    found = df.agg(F.percentile_approx(id_col, shares, F.lit(min(10_000 + 20 * wanted, 400_000)))).first()[0] if shares else None
    if not found:
        return df.withColumn("range", F.lit(0)), 1
    bounds = sorted(set(found), reverse=True)
    table = F.from_json(F.lit(f"[{','.join(map(str, bounds))}]"), f"array<{df.schema[id_col].dataType.simpleString()}>")
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    halved = lambda at: F.when(F.get(table, F.shiftright(at["low"] + at["high"], 1)) >= F.col(id_col), F.struct((F.shiftright(at["low"] + at["high"], 1) + 1).alias("low"), at["high"].alias("high")))
    search = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), lambda at, _: F.when(at["low"] < at["high"], halved(at).otherwise(F.struct(at["low"].alias("low"), F.shiftright(at["low"] + at["high"], 1).alias("high")))).otherwise(at))
    # Null ids come last.
    return df.withColumn("range", F.when(F.col(id_col).isNull(), F.lit(len(bounds))).otherwise(search["low"])), len(bounds) + 1


def neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every text."""
    texts, n = ranges(id_and_text(df, id_col, text_col), "id")
    # The first row of each range also ends the range before it, and the very first the last one.
    heads = texts.groupBy("range").agg(F.max(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("head"))
    at = Window.orderBy("r")  # a row a range
    before = F.coalesce(F.lag("r").over(at), F.max("r").over(Window.partitionBy()))
    first = checkpointed(heads.select(F.col("range").alias("r"), F.col("head.id").alias("head_id")).withColumn("before", before))
    least = texts.join(F.broadcast(first), (F.col("range") == F.col("r")) & F.col("id").eqNullSafe(F.col("head_id")))
    # Of equal ids at the head the first text counts; min keeps one row a range.
    tails = least.groupBy("before").agg(F.min("text").alias("text")).select(F.lit(None).cast(texts.schema["id"].dataType).alias("id"), "text", F.col("before").alias("range"), F.lit(True).alias("tail"))
    dealt = texts.withColumn("tail", F.lit(False)).unionByName(tails)
    ordered = dealt.repartitionById(n, F.col("range").cast("int")).sortWithinPartitions("range", "tail", F.col("id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row before, with its fingerprint
        for batch in batches:
            out: list[tuple] = []
            for i, (text, of, tail) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                own = fingerprint(text)
                if held is not None and held[0] == of:
                    _, key, before, mark = held
                    changed = edited(before, text)
                    other = fingerprint(changed)
                    out.append((key, len(before), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), mark, other, likeness(mark, other), likeness(mark, own)))
                held = None if tail else (of, batch.column(0)[i], text, own)
            if out:
                columns = [pa.array([x[0].as_py() for x in out], batch.column(0).type), *(pa.array(x, t) for x, t in zip(list(zip(*out, strict=True))[1:], kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = f"id {id_type(df, id_col)}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return batched(ordered).mapInArrow(run, schema).withColumnRenamed("id", id_col)
