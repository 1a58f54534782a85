"""Operator 7: token counts by a two-tier lookup on the map side.

Tier one is a compact table of the lengths of the corpus' frequent pre-tokens: each partition makes one row of those that
make up a SHARE of its own pre-tokens (at most 1/SHARE of them, whatever the partition holds); rows are summed up in a tree,
and the first FREQUENT go to every worker as one string and one array. Tier two is a bounded cache in each worker for all
other pre-tokens. No pre-token is a shuffle's key, and none is shuffled but within a partition's one row.

Cases: a null text counts as empty and has no tokens; repeated rows are counted each for itself; ties in frequency are
ordered by the pre-token; texts may have any length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm import vocabularies
from halyard.llm.common import batched, checkpointed, id_and_text, id_type, rows_of
from halyard.llm.pretokens import KEPT_CHARS, Kept

#: Entries of the broadcast table at most: under 2 MB in all.
FREQUENT = 1 << 15
#: What part of a partition's pre-tokens one must make up to be handed on.
SHARE = 1 / (1 << 14)
#: Partitions' counts that become one at a time, and that reach the driver at most.
MERGED = 64
#: Pre-tokens counted at once in a partition; rarer ones are forgotten in between (only speed depends on it).
COUNTED = 200_000
#: Tokens beyond which a text is too long.
LIMIT = 4096
#: Stands for a space in a piece model, which merges it only with what follows.
MARK = "▁"


@lru_cache(maxsize=4)
def by_spaces(model: str) -> bool:
    """True if no piece goes on across a space and nothing is normalised, so that texts can be cut at spaces."""
    pieces = vocabularies.pieces_model(model)
    probe = "ﬁ Ａ a"
    return not any(MARK in pieces.id_to_piece(i).lstrip(MARK) for i in range(pieces.get_piece_size())) and pieces.decode(pieces.encode(probe)) == probe


def cut(text: str, model: str) -> list[str] | None:
    """The pre-tokens of a text, each to be encoded as if alone; None if it has to be encoded whole."""
    if not by_spaces(model) or "  " in text or text[:1] == " " or text[-1:] == " " or MARK in text:
        return None
    return text.split(" ") if text else []


class Lengths(Kept):
    """pre-token -> tokens: the frequent ones stay, the others as far as there is room."""

    def __init__(self, model: str, frequent: tuple[bytes, bytes]) -> None:
        pieces = vocabularies.pieces_model(model)
        super().__init__(lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)])
        words, lengths = frequent
        self.first = dict(zip(words.decode().split(" "), np.frombuffer(lengths, "<u4").tolist(), strict=True)) if lengths else {}
        self.update(self.first)

    def clear(self) -> None:
        super().clear()
        self.update(self.first)


def frequent_pretokens(texts: DataFrame, model: str = vocabularies.PIECE_BPE) -> DataFrame:
    """(piece, n): the FREQUENT most frequent pre-tokens among those that any partition of (id, text) hands on.

    Each partition makes one row of its counts; MERGED rows at a time become one, and the last MERGED reach the driver.
    """

    def merged(counts: Counter) -> pa.RecordBatch:
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT]
        return pa.RecordBatch.from_arrays([pa.array([[k for k, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], names=["pieces", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                pieces = cut(text, model) or ()
                counts.update(pieces)
                total += len(pieces)
            if len(counts) > COUNTED:
                least = total * SHARE / 2
                counts = Counter({k: n for k, n in counts.items() if n >= least})
        picked = Counter({k: n for k, n in counts.items() if n >= max(2, total * SHARE) and 0 < len(k) <= KEPT_CHARS})
        if picked:
            yield merged(picked)

    def total_of(rows: pa.Table) -> Counter:
        counts = Counter()
        for pieces, numbers in zip(rows["pieces"].to_pylist(), rows["counts"].to_pylist(), strict=True):
            for k, n in zip(pieces, numbers, strict=True):
                counts[k] += n
        return counts

    def join(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([merged(total_of(rows))]).append_column("part", rows["group"].slice(0, 1).cast(pa.int32()))

    kinds = "pieces array<string>, counts array<long>"
    each = checkpointed(texts.select("text").mapInArrow(run, kinds).withColumn("part", F.spark_partition_id()))
    while (left := each.count()) > MERGED:
        groups = -(-left // MERGED)
        joined = each.withColumn("group", F.pmod("part", F.lit(groups))).groupBy("group").applyInArrow(join, f"{kinds}, part int")
        each = checkpointed(joined)
    top = merged(total_of(each.select("pieces", "counts").toArrow()))
    rows = list(zip(top.column(0)[0].as_py(), top.column(1)[0].as_py(), strict=True))
    return texts.sparkSession.createDataFrame(rows, "piece string, n long")


def compact(frequent: DataFrame, model: str) -> tuple[bytes, bytes]:
    """The lengths of at most FREQUENT pre-tokens, as one string and one array."""
    words = [row.piece for row in frequent.collect()]
    lengths = [len(ids) for ids in vocabularies.pieces_model(model).encode(words, num_threads=1)] if words else []
    return " ".join(words).encode(), np.array(lengths, "<u4").tobytes()


#: The table of each broadcast, by its id, as this worker uses it.
_LENGTHS: dict[str, Lengths] = {}


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = vocabularies.PIECE_BPE, limit: int = LIMIT) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for every text, as the model's library counts its tokens."""
    texts = batched(id_and_text(df, id_col, text_col))
    table = compact(frequent_pretokens(texts, model), model)
    shared = df.sparkSession.sparkContext.broadcast((f"{model}:{hash(table)}", table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, frequent = shared.value
        if key not in _LENGTHS:
            _LENGTHS.clear()
            _LENGTHS[key] = Lengths(model, frequent)
        lengths, pieces = _LENGTHS[key], vocabularies.pieces_model(model)
        for ids, texts in rows_of(batches):
            parts = [cut(text, model) for text in texts]
            every = set().union(*[p for p in parts if p])
            long = [p for p in every if len(p) > KEPT_CHARS]
            lengths.load(every)
            get = lengths.__getitem__
            n = [sum(map(get, p)) if p is not None else len(pieces.encode(t, num_threads=1)) for p, t in zip(parts, texts, strict=True)]
            for p in long:
                lengths.pop(p, None)
            lengths.trim()
            columns = [ids, pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_tokens", "over_limit"])

    return texts.mapInArrow(run, f"id {id_type(df, id_col)}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
