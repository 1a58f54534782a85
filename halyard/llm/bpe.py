"""Operator 3: byte-level BPE encoding and decoding in length-bucketed padded matrices.

Pre-tokens of about one length make a matrix, a row each. Every round each row merges its leftmost pair of minimum
rank; the ranks of pairs come from an open-addressed hash table that numpy probes for all rows at once. Rows without
a pair left leave the matrix (compaction). Beyond MATRIX_BYTES bytes a row is a matrix of its own, whose rounds merge all
pairs of the minimum rank that one pair a round would merge one after the other, so a long run costs a few rounds for each
rank that it holds and not one for each merge.

Cases: a null text counts as empty and has no tokens; equal ids or texts, ties and repeated rows are encoded each for
itself; texts and pre-tokens may have any length; an empty table gives an empty result; other columns of the input are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from halyard.llm import vocabularies
from halyard.llm.common import batched, id_and_text, id_type, rows_of
from halyard.llm.pretokens import KEPT_CHARS, Kept, splits_at_spaces

#: Bytes of a row that shares a matrix with others, at most.
MATRIX_BYTES = 256
#: Cells of one matrix at most.
CELLS = 1 << 20
NO_RANK = np.int32(2**31 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> rank of the merged token, by open addressing with linear probing."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        values = np.array(merged, np.int32)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, np.uint64(2**64 - 1)), np.full(1 << bits, NO_RANK)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == np.uint64(2**64 - 1)
            slots, first = np.unique(at[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[slots], self.values[slots] = keys[placed], values[placed]
            todo = todo[~np.isin(todo, placed, assume_unique=True)]
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NO_RANK where they don't merge."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NO_RANK)
        todo = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != np.uint64(2**64 - 1))]
        return out


class Encoder:
    """Encodes and decodes by ranks, as the library of the rank file would, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.table = PairTable(ranks)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.plain = Kept(lambda tokens: self.encode_tokens([t.encode() for t in tokens]))
        self.spaced = Kept(self._spaced)

    # -- merging

    def encode_tokens(self, tokens: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(tokens)
        buckets: dict[int, list[int]] = {}
        for i, token in enumerate(tokens):
            rank = self.ranks.get(token)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(token) > MATRIX_BYTES:
                out[i] = self._by_row(token)
            elif token:
                buckets.setdefault(max(4, 1 << (len(token) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            step = max(1, CELLS // width)
            for start in range(0, len(rows), step):
                part = rows[start : start + step]
                for i, ids in zip(part, self._by_matrix([tokens[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _by_matrix(self, tokens: list[bytes], width: int) -> list[bytes]:
        raw = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in tokens), np.uint8).reshape(-1, width)
        size = np.array([len(t) for t in tokens], np.int64)
        ids = self.single[raw]
        columns = np.arange(width - 1)
        ranks = self.table(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, width - 1)
        ranks[columns >= (size - 1)[:, None]] = NO_RANK
        out: list[bytes] = [b""] * len(tokens)
        rows = np.arange(len(tokens))
        while len(rows):
            at = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            best = ranks[every, at]
            over = best == NO_RANK
            if over.any():
                for k in np.flatnonzero(over):
                    out[rows[k]] = ids[k, : size[k]].astype("<u4").tobytes()
                going = ~over
                ids, ranks, size, rows, at, best = ids[going], ranks[going], size[going], rows[going], at[going], best[going]
                if not len(rows):
                    break
                longest = int(size.max())
                ids, ranks = ids[:, :longest], ranks[:, : longest - 1]
                every = np.arange(len(rows))
            # What lies right of the merged pair moves one place to the left.
            ids[every, at] = best
            later = np.arange(ids.shape[1] - 1) > at[:, None]
            ids[:, :-1] = np.where(later, ids[:, 1:], ids[:, :-1])
            if ranks.shape[1] > 1:
                later = np.arange(ranks.shape[1] - 1) >= at[:, None]
                ranks[:, :-1] = np.where(later, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NO_RANK
            size -= 1
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.table(ids[left, at[left] - 1], best[left])
            right = np.flatnonzero(at < size - 1)
            ranks[right, at[right]] = self.table(best[right], ids[right, at[right] + 1])
            last = np.flatnonzero((at >= size - 1) & (at < ranks.shape[1]))
            ranks[last, at[last]] = NO_RANK
        return out

    def _by_row(self, token: bytes) -> bytes:
        """A matrix of one row, whose rounds merge all pairs of the minimum rank at once, from the left and without overlap.

        That is what one pair a round would come to as long as no merge makes a pair of a lower rank, which would be next;
        a round ends with the first merge that does.
        """
        ids = self.single[np.frombuffer(token, np.uint8)]
        ranks = self.table(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NO_RANK:
            at = np.flatnonzero(ranks == best)
            order = np.arange(len(at))
            begins = np.diff(at, prepend=-2) != 1  # neighbouring pairs overlap: of a run of them every other one merges
            at = at[(order - np.maximum.accumulate(np.where(begins, order, 0))) % 2 == 0]
            merged = np.full(len(at), best, np.int32)
            left, right = np.where(np.diff(at, prepend=-9) == 2, best, ids[at - 1]), ids[np.minimum(at + 2, len(ids) - 1)]
            lower = ((at > 0) & (self.table(left, merged) < best)) | ((at + 2 < len(ids)) & (self.table(merged, right) < best))
            if lower.any():
                at = at[: int(lower.argmax()) + 1]
            gone = at + 1
            ids[at] = best
            ids = np.delete(ids, gone)
            ranks = np.delete(ranks, np.minimum(gone, len(ranks) - 1))
            near = at - np.arange(len(at))  # where the merged ones are now
            near = np.unique(np.concatenate([near - 1, near]))
            near = near[(near >= 0) & (near < len(ranks))]
            ranks[near] = self.table(ids[near], ids[near + 1])
        return ids.astype("<u4").tobytes()

    # -- texts

    def _spaced(self, pieces: list[str]) -> list[bytes]:
        found = [self.find(" " + p) for p in pieces]
        self.plain.load({t for tokens in found for t in tokens})
        out = [b"".join([self.plain[t] for t in tokens]) for tokens in found]
        self.plain.trim()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        cut: list[list[str] | None] = [t.split(" ") if splits_at_spaces(t) else None for t in texts]
        whole = [self.find(p[0] if p is not None else t) for t, p in zip(texts, cut, strict=True)]
        often, rare = set(), set()
        for pieces in cut:
            if pieces is not None:
                often.update(pieces[1:])
        long = [p for p in often if len(p) > KEPT_CHARS]
        self.spaced.load(often)
        rare.update(*whole)
        self.plain.load(rare)
        spaced, plain = self.spaced.__getitem__, self.plain.__getitem__
        out = [
            b"".join([*map(plain, tokens), *map(spaced, pieces[1:])]) if pieces is not None else b"".join(map(plain, tokens))
            for tokens, pieces in zip(whole, cut, strict=True)
        ]
        for p in long:
            self.spaced.pop(p, None)
        self.spaced.trim()
        self.plain.trim()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(vocabularies.ranks(name), vocabularies.pattern())


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = vocabularies.BYTE_BPE_RANKS) -> DataFrame:
    """(id_col, ids): the ids of every text as a binary of little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks)
        for ids, texts in rows_of(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(coder.encode(texts), pa.binary())], names=["id", "ids"])

    return batched(id_and_text(df, id_col, text_col)).mapInArrow(run, f"id {id_type(df, id_col)}, ids binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str = vocabularies.BYTE_BPE_RANKS) -> DataFrame:
    """(id_col, bytes): what the ids of each row stand for; null ids stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks)
        for batch in batches:
            out = [None if x is None else coder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "bytes"])

    picked = batched(df.select(df[id_col].alias("id"), df[ids_col].alias("ids")))
    return picked.mapInArrow(run, f"id {id_type(df, id_col)}, bytes binary").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = vocabularies.BYTE_BPE_RANKS) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): digests of the encoding and of its decoding, made where the ids are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks)
        for ids, texts in rows_of(batches):
            coded = coder.encode(texts)
            columns = [
                ids,
                pa.array([len(x) // 4 for x in coded], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()),
                pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in coded], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"id {id_type(df, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return batched(id_and_text(df, id_col, text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)
