"""Rank files of byte-level BPE, and encoders that keep what they have encoded."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from ._runtime import KEEP_ENCODED, Kept


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def rank_encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def packed(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


class Unclean(Exception):
    """A part that may share a white-space run with its neighbour."""


def independent_parts(text: str) -> list[str]:
    """Cuts before single spaces between other characters; the parts concatenate to the text.

    A pre-token never holds a space behind another character unless both are white space, so patterns whose
    only space is an optional first one treat each part as they treat the whole text.
    """
    parts, current = [], []
    for i, chunk in enumerate(text.split(" ")):
        if i and chunk and not chunk[0].isspace() and current[-1] and not current[-1][-1].isspace():
            parts.append("".join(current))
            current = []
        if i:
            current.append(" ")
        current.append(chunk)
        if len(current) > 1 and not chunk:
            current = ["".join(current)]
    parts.append("".join(current))
    return parts


class PartWise:
    """Applies ``make`` to the independent parts of texts, each distinct part once while it is kept."""

    def __init__(self, make: Callable[[str], object]):
        def spaced(chunk: str):
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                raise Unclean
            return make(" " + chunk)

        self.make = make
        self.spaced = Kept(spaced, KEEP_ENCODED)

    def __call__(self, text: str) -> list:
        if not text:
            return []
        first, *rest = text.split(" ")
        if not first or not first[-1].isspace():
            try:
                if first or rest and rest[0]:
                    return [self.make(first), *map(self.spaced.__getitem__, rest)] if first else [*map(self.spaced.__getitem__, rest)]
            except Unclean:
                pass
        return [self.make(part) for part in independent_parts(text)]
