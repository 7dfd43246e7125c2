"""Words and word hashes of whole Arrow string columns, without a Python loop over words.

The bytes of many texts lie in one buffer; words, their texts and their 64-bit hashes come out as NumPy arrays. Buffers are cut at
text boundaries into pieces of about ``PIECE_BYTES``, so memory does not depend on the size of a batch; a text longer than that
is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

_RATE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

#: Bytes of ``[^\x20\x09-\x0D]``.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``.
LETTERS = np.ones(256, bool)
LETTERS[0x00:0x30] = LETTERS[0x3A:0x61] = LETTERS[0x7B:0x80] = False
#: Lower case of A-Z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits of the result depend on all bits of the input."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the polynomial's base and of its inverse modulo 2^64, extended on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n + 1:
            n = max(n, PIECE_BYTES + 1024)
            for name, base in (("up", _RATE), ("down", pow(_RATE, -1, 1 << 64))):
                steps = np.full(n + 1, base & _MASK, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


@dataclass
class Piece:
    """Texts ``first .. first + len(offsets) - 2`` of a batch: one byte buffer and where each text starts and ends."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


@dataclass
class Words:
    """Word starts and ends in a piece's buffer, the text of each word, and the first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    bounds: np.ndarray


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a string column into buffers of about ``limit`` bytes. A null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        own = offsets[at : end + 1]
        yield Piece(at, data[own[0] : own[-1]], own - own[0])
        at = end


def split(piece: Piece, inside: np.ndarray = SPACED) -> Words:
    """Maximal runs of the bytes marked in ``inside``; a run never crosses a text's end."""
    n = len(piece.data)
    mask = inside[piece.data]
    first = np.zeros(n + 1, bool)
    first[piece.offsets] = True
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | first[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~after | first[1:])) + 1
    bounds = np.searchsorted(starts, piece.offsets)
    return Words(starts, ends, np.repeat(np.arange(len(piece)), np.diff(bounds)), bounds)


def hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial modulo 2^64 from prefix sums, then mixed."""
    up, down = _Powers.of(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        value = (sums[words.ends] - sums[words.starts]) * down[words.starts]
    return mix(value + (words.ends - words.starts).astype(np.uint64))


def windows(word_hashes: np.ndarray, words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every ``width`` consecutive words of one text, and the window's first word."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    base = np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        value = word_hashes[:n].copy()
        for k in range(1, width):
            value *= base
            value += word_hashes[k : k + n]
    at = np.flatnonzero(words.text[:n] == words.text[width - 1 :])
    return mix(value[at]), at


def hash_of(data: bytes) -> int:
    """The hash of one word, as ``hashes`` gives it."""
    buffer = np.frombuffer(data, np.uint8)
    one = Words(np.array([0]), np.array([len(buffer)]), np.array([0]), np.array([0, 1]))
    return int(hashes(buffer, one)[0])


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes before each position from ``width`` on; entry k belongs to position ``width + k``."""
    up, down = _Powers.of(len(data))
    if len(data) < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[width:] - sums[:-width]) * down[: len(data) - width + 1])
