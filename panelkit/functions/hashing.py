"""Seeded pseudo-randomness from md5, equal for every partitioning and on every engine."""

from __future__ import annotations

import math
from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


LAST_DRAW = 12
#: For each step of MD5 (RFC 1321): the word it reads, its constant and how far it turns.
MD5_STEPS = [
    (((1, 5, 3, 7)[k // 16] * k + (0, 1, 5, 0)[k // 16]) % 16, np.uint32(int(abs(math.sin(k + 1)) * 2**32)),
     np.uint32(((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))[k // 16][k % 4]))
    for k in range(64)
]
#: Messages that are digested at once: an Arrow batch whole.
MD5_ROWS = 16_384


def hash_prefix(key: Column, salt: str | Column, digits: int = 8) -> Column:
    """The first hex digits of ``md5(key:salt)`` as a long (15 digits at most stay positive)."""
    text = F.concat(key.cast("string"), F.lit(":"), salt if isinstance(salt, Column) else F.lit(str(salt)))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def hash_bucket(key: Column, salt: str | Column, buckets: int = 100) -> Column:
    return hash_prefix(key, salt) % F.lit(buckets)


def md5_prefixes(words: np.ndarray, rest: Sequence[int]) -> np.ndarray:
    """The first eight hex digits, as numbers, of the MD5 digests of many padded messages of one block each.

    ``words``: the first little-endian words of each message (words x messages); ``rest``: what all messages add to each of the 16 words. The
    last three steps do not reach these digits.
    """
    start = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(words.shape[1], v) for v in start)
    mixed = np.empty_like(a)
    for step, (place, sine, turn) in enumerate(MD5_STEPS[:61]):
        if step < 16:
            np.bitwise_xor(c, d, out=mixed)
            mixed &= b
            mixed ^= d
        elif step < 32:
            np.bitwise_xor(b, c, out=mixed)
            mixed &= d
            mixed ^= c
        elif step < 48:
            np.bitwise_xor(b, c, out=mixed)
            mixed ^= d
        else:
            np.invert(d, out=mixed)
            mixed |= b
            mixed ^= c
        mixed += a
        if place < len(words):
            mixed += words[place]
        mixed += np.uint32((int(sine) + rest[place]) % 2**32)
        turned = np.left_shift(mixed, turn, out=a)
        mixed >>= np.uint32(32) - turn
        turned |= mixed
        turned += b
        a, b, c, d = d, turned, b, c
    return (b + start[0]).byteswap()


def _salted_prefixes(texts: Sequence[bytes], ends: Sequence[bytes]) -> np.ndarray:
    """``md5_prefixes`` of every text with every end (texts x ends), texts of equal length at a time."""
    found = np.zeros((len(ends), len(texts)), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    for length in np.unique(lengths).tolist():
        same = np.flatnonzero(lengths == length)
        if length + max(map(len, ends)) > 55:  # more than a block
            for row in same:
                found[:, row] = [int.from_bytes(md5(texts[row] + e, usedforsecurity=False).digest()[:4], "big") for e in ends]
            continue
        rests = []
        for end in ends:
            size = (length + len(end)) * 8
            rests.append(np.frombuffer((bytes(length) + end + b"\x80").ljust(56, b"\0") + size.to_bytes(8, "little"), "<u4").tolist())
        held = -(-length // 4)
        for rows in (same[k : k + MD5_ROWS] for k in range(0, len(same), MD5_ROWS)):
            plain = np.zeros((len(rows), 4 * held), np.uint8)
            plain[:, :length] = np.frombuffer(b"".join([texts[row] for row in rows]), np.uint8).reshape(len(rows), length)
            words = np.ascontiguousarray(plain.view("<u4").T)
            for column, rest in enumerate(rests):
                found[column, rows] = md5_prefixes(words, rest)
    return found.T


def flag_matrix(keys: Sequence[str | None], salts: Sequence[str], limit: int, buckets: int = 100) -> np.ndarray:
    """``hash_flags`` of keys that a task holds (keys x salts)."""
    texts = [None if k is None else k.encode() for k in keys]
    known = np.array([t is not None for t in texts], bool)
    found = np.zeros((len(texts), len(salts)), np.int32)
    found[known] = _salted_prefixes([t for t in texts if t is not None], [f":{s}".encode() for s in salts]) % buckets < limit
    return found


def hash_flags(key: Column, salts: Sequence[str], limit: int, buckets: int = 100) -> Column:
    """Whether ``hash_bucket`` of the key lies below ``limit``, for every salt: an array of 1 and 0 (0 for a null key).

    For many salts: the digests of many rows are made at once, a column for each salt takes about four times as long.
    """
    salts = list(salts)

    @F.pandas_udf("array<int>")
    def flags(keys: pd.Series) -> pd.Series:
        return pd.Series(list(flag_matrix([None if k is None or k is pd.NA else k for k in keys], salts, limit, buckets)))

    return flags(key.cast("string"))


def hash_uniform(key: Column, salt: str | Column) -> Column:
    """A double in [0, 1) with 2^-32 steps."""
    return hash_prefix(key, salt).cast("double") / F.lit(4294967296.0)


def poisson_one(uniform: Column) -> Column:
    """Poisson(1) draw by inversion of its distribution function, up to 12: more has less chance than a step of the hash."""
    cumulative, term, expr = 0.0, 0.36787944117144233, None
    for count in range(LAST_DRAW):
        if count:
            term /= count
        cumulative += term
        condition = uniform < F.lit(cumulative)
        expr = F.when(condition, count) if expr is None else expr.when(condition, count)
    return expr.otherwise(LAST_DRAW).cast("int")


def poisson_matrix(keys: Sequence[str | None], salts: Sequence[str]) -> np.ndarray:
    """``poisson_one(hash_uniform(key, salt))`` of keys that a task holds (keys x salts); a null key has ``LAST_DRAW``, as there."""
    terms = [0.36787944117144233]
    for count in range(1, LAST_DRAW):
        terms.append(terms[-1] / count)
    steps = np.cumsum(terms) * 2.0**32
    texts = [None if k is None else k.encode() for k in keys]
    known = np.array([t is not None for t in texts], bool)
    found = np.full((len(texts), len(salts)), LAST_DRAW, np.uint8)
    # draws beginning with the same 16 bits mostly have the same count
    counts = np.searchsorted(steps, np.arange(1 << 16) * 2.0**16, side="right").astype(np.uint8)
    open_ = np.searchsorted(steps, np.arange(1, (1 << 16) + 1) * 2.0**16, side="left") != counts
    draws = _salted_prefixes([t for t in texts if t is not None], [f":{s}".encode() for s in salts])
    drawn = counts.take(draws >> np.uint32(16))
    left = np.flatnonzero(open_.take(draws >> np.uint32(16)))
    drawn.reshape(-1)[left] = np.searchsorted(steps, draws.reshape(-1).take(left).astype(float), side="right")
    found[known] = drawn
    return found
