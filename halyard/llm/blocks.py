"""Words of many texts as blocks of numbers, for the operators that count runs of words in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words of a block. Blocks are cut between parts, so a block ends with the part that fills it.
BLOCK = 1 << 20


class Block:
    """Parts of texts as one array of word numbers; part k is ids[start[k]:start[k + 1]], of text owner[k]."""

    def __init__(self) -> None:
        self.number: dict[object, int] = {}
        self._ids: list[np.ndarray] = []
        self._lengths: list[int] = []
        self.owner: list[int] = []
        self.size = 0

    def add(self, owner: int, words: list) -> None:
        number = self.number
        self._ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        self._lengths.append(len(words))
        self.owner.append(owner)
        self.size += len(words)

    @property
    def ids(self) -> np.ndarray:
        return np.concatenate(self._ids) if self._ids else np.empty(0, np.int64)

    @property
    def start(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self._lengths, dtype=np.int64)]).astype(np.int64)

    @property
    def words(self) -> list:
        return list(self.number)


def blocks_of(parts: Iterator[tuple[int, list]], size: int = BLOCK) -> Iterator[Block]:
    """Blocks of (owner, words) pairs, each of about size words; one part is never cut."""
    block = Block()
    for owner, words in parts:
        block.add(owner, words)
        if block.size >= size:
            yield block
            block = Block()
    if block.owner:
        yield block
