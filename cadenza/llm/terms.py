"""Tokens of whole texts as numpy arrays: where each begins and ends, which are equal, and to which text each belongs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .pieces import _LOWER, PAD, distinct, passes, spread, text_bytes


def without(*ranges: tuple[int, int]) -> np.ndarray:
    """For each byte whether it is part of a token: all but the ASCII ranges (first, last) that separate tokens."""
    table = np.ones(256, bool)
    for a, b in ranges:
        table[a : b + 1] = False
    return table


ALPHANUMERIC = without((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
LETTERS = without((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
WORDS = without((0x20, 0x20), (0x09, 0x0D))


def _bounds(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = int(offsets[-1])
    hit = inside[buf[:n]]
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(hit & (~np.append(False, hit[:-1]) | edge[:n]))
    return starts, np.flatnonzero(hit & ~np.append(hit[1:] & ~edge[1:n], False)) + 1


class Tokens:
    """The tokens of one pass of texts, ASCII letters in lower case: bounds, numbers of distinct tokens, bounds of the texts."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        n = int(offsets[-1])
        self.buf, self.offsets = np.append(_LOWER[buf[:n]], np.zeros(PAD, np.uint8)), offsets
        self.starts, self.ends = _bounds(self.buf, offsets, inside)
        self.codes, self.first = distinct(self.buf, self.starts, self.ends, long=True)
        self.at = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        """How many tokens each text has."""
        return np.diff(self.at)

    @property
    def texts(self) -> np.ndarray:
        """For each token the number of its text."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def words(self) -> list[bytes]:
        """The distinct tokens, by their numbers."""
        raw = self.buf.tobytes()
        return [raw[a:b] for a, b in zip(self.starts[self.first].tolist(), self.ends[self.first].tolist(), strict=True)]


def each(column: pa.Array | pa.ChunkedArray, inside: np.ndarray) -> Iterator[tuple[int, int, Tokens]]:
    """(first text, after the last text, their tokens) for passes of about equal bytes; null is an empty text."""
    buf, offsets = text_bytes(column)
    for a, b in passes(offsets):
        yield a, b, Tokens(np.append(buf[offsets[a] : offsets[b]], np.zeros(PAD, np.uint8)), offsets[a : b + 1] - offsets[a], inside)


def token_counts(column: pa.Array | pa.ChunkedArray, inside: np.ndarray) -> np.ndarray:
    """How many tokens each text has, without telling them apart."""
    buf, offsets = text_bytes(column)
    return np.diff(np.searchsorted(_bounds(buf, offsets, inside)[0], offsets))


def strings(words: list[bytes]) -> pa.Array:
    """Tokens as an Arrow column of strings."""
    return pa.array(words, pa.binary()).cast(pa.string())


__all__ = ["ALPHANUMERIC", "LETTERS", "WORDS", "Tokens", "each", "spread", "strings", "token_counts", "without"]
