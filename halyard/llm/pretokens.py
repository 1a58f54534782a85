"""Pre-tokens whose encodings are kept by worker.

Both vocabularies in use never merge across a single space between two other characters: the space opens the
next pre-token. A text without adjacent white space is therefore cut at its spaces and each piece is looked up;
any other text goes the library's or the pattern's own way, whole. Either way gives what the library gives.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from halyard.llm import vocabularies

#: Pieces kept by a worker; one that is full starts again, so memory stays bounded however many words there are.
KEPT = 100_000
#: Longer pieces are encoded each time: they hardly repeat.
KEPT_CHARS = 64

ADJACENT = re.compile(r"\s\s")


def splits_at_spaces(text: str) -> bool:
    """True if cutting at every U+0020 gives pieces that are encoded independently of each other."""
    return ADJACENT.search(text) is None


class Kept(dict):
    """piece -> value for a worker; `fill` computes the values of those missing, many at a time."""

    def __init__(self, fill: Callable[[list[str]], Iterable], kept: int = KEPT) -> None:
        super().__init__()
        self.fill, self.kept = fill, kept

    def load(self, pieces: set[str] | list[str]) -> None:
        """Afterwards self[p] is there for each of the pieces, none of which is given twice."""
        missing = [p for p in pieces if p not in self]
        if len(self) + len(missing) > self.kept:
            self.clear()
            missing = list(pieces)
        self.update(zip(missing, self.fill(missing), strict=True))

    def trim(self) -> None:
        """Drops all if one batch has filled it beyond its bound."""
        if len(self) > self.kept:
            self.clear()


class Cut:
    """Texts cut at spaces: the distinct pieces, which of them stands at each place, and where each text's first and last are."""

    def __init__(self, texts: list[str]) -> None:
        pieces = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        self.after = pieces.offsets.to_numpy()[1:]
        self.begins = np.concatenate([np.zeros(min(1, len(texts)), np.int64), self.after[:-1]])
        coded = pieces.flatten().dictionary_encode()
        self.which, self.distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        self.firsts = [self.distinct[k] for k in self.which[self.begins]]

    def ids(self, values: list[bytes], which: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The ids of all texts one after the other, and where each text's begin and the last one's end.

        values: ids as little-endian unsigned 32-bit integers; which: of them stands at each place.
        """
        ids, sizes = np.frombuffer(b"".join(values), np.uint32), np.fromiter(map(len, values), np.int64, len(values)) // 4
        lengths = sizes[which]
        upto = np.cumsum(lengths)
        total = int(upto[-1]) if len(upto) else 0
        out = ids[np.repeat((np.cumsum(sizes) - sizes)[which] - (upto - lengths), lengths) + np.arange(total)]
        return out, [0, *upto[self.after - 1].tolist()]

    def sums(self, numbers: np.ndarray) -> np.ndarray:
        """What a number for each distinct piece comes to in each text, but for its first piece."""
        each = numbers[self.which]
        each[self.begins] = 0
        return np.add.reduceat(each, self.begins) if len(self.begins) else each


class AfterSpace:
    """Ids, by ranks, of pieces as they stand after a space.

    Pieces that neither begin nor end with white space are encoded many at once, joined by spaces: none is merged across,
    and the ids that begin with a space tell where each begins.
    """

    def __init__(self, ranks: str) -> None:
        import tiktoken

        tokens = vocabularies.ranks(ranks)
        self.plain = tiktoken.Encoding("ranks", pat_str=vocabularies.pattern(), mergeable_ranks=tokens, special_tokens={}).encode_ordinary
        self.begins = np.zeros(max(tokens.values()) + 1, bool)
        self.begins[[rank for token, rank in tokens.items() if token[:1] == b" "]] = True

    def __call__(self, pieces: list[str]) -> list[bytes]:
        """As little-endian unsigned 32-bit integers."""
        alone = [not p or p[0].isspace() or p[-1].isspace() or " " in p for p in pieces]
        some = [p for p, a in zip(pieces, alone, strict=True) if not a]
        ids = np.array(self.plain(" " + " ".join(some)) if some else [], "<u4")
        stops = [*(4 * np.flatnonzero(self.begins[ids])).tolist(), 4 * len(ids)]
        if len(stops) != len(some) + 1:  # a vocabulary that merges across spaces
            alone = [True] * len(pieces)
        raw = ids.tobytes()
        joined = iter(raw[s:e] for s, e in zip(stops, stops[1:], strict=False))
        return [np.array(self.plain(" " + p), "<u4").tobytes() if a else next(joined) for p, a in zip(pieces, alone, strict=True)]
