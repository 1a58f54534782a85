"""Public vocabularies, read once by each worker. Their place is a parameter; nothing is copied."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

BYTE_BPE_RANKS = "byte_bpe_50k.tiktoken"
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def path(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def ranks(name: str) -> dict[bytes, int]:
    with open(path(name), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def pieces_model(name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path(name))


@lru_cache(maxsize=4)
def byte_level(name: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path(name))


#: What this worker keeps between tasks, by what made it.
_HELD: dict[tuple, object] = {}


def held(make: Callable, *args):
    """make(*args), made once; only the last one made is kept, so no stage holds what the stages before it kept."""
    if (key := (make, args)) not in _HELD:
        _HELD.clear()
        _HELD[key] = make(*args)
    return _HELD[key]
