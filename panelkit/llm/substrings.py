"""Removal of word windows that an earlier document already has.

Rabin-Karp hashes of every window are counted in Spark without sending one row per window: documents fall into blocks of
consecutive ids, and a task sends, for each bucket of hash values, the sorted distinct hashes with their blocks. As blocks follow the order
of ids, a bucket only tells each block which of its hashes an earlier block has; repeats inside a block are found where its texts are.
A window in a third of all documents is therefore one entry per block and task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm import words as W

WIDTH = 13
BLOCK_BYTES = 3 << 20
BUCKET_BYTES = 8 << 20
COARSE = 64
HELD_WINDOWS = 1_500_000

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()),
    T.StructField("removed", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
])


def _block(docs: DataFrame, key: str, text: str) -> tuple[Column, int]:
    """An expression that numbers blocks of about ``BLOCK_BYTES`` in the order of ids, and the number of hash buckets.

    Ids are cut at sketched quantiles, then evenly inside each range. Rows without an id get negative numbers.
    """
    shares = [k / COARSE for k in range(1, COARSE)]
    found = docs.agg(
        F.sum(F.octet_length(text)).alias("bytes"), F.min(key).alias("low"), F.max(key).alias("high"),
        F.percentile_approx(key, F.lit(shares), 10_000).alias("cuts"),
    ).first()
    size = found["bytes"] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    fine, step = math.ceil(blocks / COARSE), max(1, COARSE // blocks)
    cuts = sorted({int(c) for c in (found["cuts"] or [])[step - 1 :: step] if c > found["low"]})
    low = F.array(*[F.lit(int(x)).cast("long") for x in [found["low"] or 0, *cuts]])
    high = F.array(*[F.lit(int(x)).cast("long") for x in [*cuts, (found["high"] or 0) + 1]])
    value = F.col(key).cast("long")
    coarse = sum(((value >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    start, end = F.get(low, coarse).cast("double"), F.get(high, coarse).cast("double")
    inside = F.least(F.floor((value.cast("double") - start) * fine / F.greatest(end - start, F.lit(1.0))), F.lit(fine - 1))
    spread = F.lit(-1) - F.pmod(F.xxhash64(text), F.lit(1024))
    return F.when(value.isNull(), spread).otherwise(coarse * fine + inside).cast("long"), max(16, math.ceil(size / BUCKET_BYTES))


def _pack(sorted_hashes: np.ndarray) -> bytes:
    """Byte planes, highest first: the leading planes of sorted values are long runs, which the shuffle's codec removes."""
    return np.ascontiguousarray(sorted_hashes.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def _sketches(buckets: int, width: int):
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    schema = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("blocks", pa.binary())])

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        value, block = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(block, kind="stable")
        order = order[np.argsort(value[order], kind="stable")]
        value, block = value[order], block[order]
        new = np.r_[True, (value[1:] != value[:-1]) | (block[1:] != block[:-1])]
        value, block = value[new], block[new]
        cut = np.r_[0, np.searchsorted(value, edges), len(value)]
        out: tuple[list, list, list] = ([], [], [])
        for bucket in np.flatnonzero(np.diff(cut)):
            own = slice(cut[bucket], cut[bucket + 1])
            for column, item in zip(out, (bucket, _pack(value[own]), _pack(block[own])), strict=True):
                column.append(item)
        return pa.record_batch([pa.array(x, t) for x, t in zip(out, schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            block = batch.column(0).to_numpy()
            for piece in W.pieces(batch.column(1)):
                own = W.split(piece)
                value, at = W.windows(W.hashes(piece.data, own), own, width)
                if len(value):
                    held.append((value, block[piece.first + own.text[at]]))
                    count += len(value)
                if count >= HELD_WINDOWS:
                    yield flush(held)
                    held, count = [], 0
        if held:
            yield flush(held)

    return run


def _earlier(group: pa.Table) -> pa.Table:
    """For each block, its hashes of this bucket that a block of smaller ids has as well."""
    value, block = (np.concatenate([_unpack(x.as_py()) for x in group.column(n)]) for n in ("hashes", "blocks"))
    order = np.argsort(block, kind="stable")
    order = order[np.argsort(value[order], kind="stable")]
    value, block = value[order], block[order]
    start = np.r_[True, value[1:] != value[:-1]]
    first = block[np.flatnonzero(start)][np.cumsum(start) - 1]
    late = block > first
    value, block = value[late], block[late]
    order = np.argsort(block, kind="stable")
    value, block = value[order], block[order]
    at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, int)
    return pa.table({
        "block": pa.array(block[at].astype(np.int64), pa.int64()),
        "hashes": pa.array([_pack(np.unique(x)) for x in np.split(value, at[1:])] if len(at) else [], pa.binary()),
    })


def _remove(width: int, key: str, text: str, names: list[str]):
    def spans(mask: np.ndarray) -> list[dict]:
        edge = np.diff(np.r_[False, mask, False].astype(np.int8))
        return [{"first": int(a), "last": int(b) - 1} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        known = np.unique(np.concatenate([_unpack(x.as_py()) for x in found.column("hashes")])) if len(found) else np.zeros(0, np.uint64)
        ids, block = docs.column(key), docs.column("block").to_numpy()
        n_words, n_removed, kept, removed = [], [], [], []
        for piece in W.pieces(docs.column(text), 1 << 62):
            own = W.split(piece)
            gone = np.zeros(len(own.starts) + 1, np.int32)
            if len(block) and block[0] >= 0:
                value, at = W.windows(W.hashes(piece.data, own), own, width)
                doc = ids.to_numpy()[own.text[at]]
                late = np.zeros(len(value), bool)
                if len(value):
                    if len(known):
                        late |= known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value
                    order = np.argsort(value, kind="stable")
                    start = np.flatnonzero(np.r_[True, value[order][1:] != value[order][:-1]])
                    least = np.minimum.reduceat(doc[order], start)
                    late[order] |= doc[order] > np.repeat(least, np.diff(np.r_[start, len(order)]))
                np.add.at(gone, at[late], 1)
                np.add.at(gone, at[late] + width, -1)
            gone = np.cumsum(gone)[:-1] > 0
            for k in range(len(piece)):
                mask = gone[own.bounds[k] : own.bounds[k + 1]]
                lost = int(np.count_nonzero(mask))
                tokens = piece.text(k).split()
                kept.append(b" ".join([t for t, m in zip(tokens, mask.tolist(), strict=True) if not m] if lost else tokens))
                n_words.append(len(mask))
                n_removed.append(lost)
                removed.append(spans(mask) if lost else [])
        new = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
               pa.array(removed, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))]
        return pa.table([*(docs.column(n) for n in names), *new], names=[*names, *RESULT.names])

    return run


def remove_repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``kept`` (remaining words, one space between) and ``removed`` (maximal word spans).

    A word goes when a window of ``width`` words covers it whose words also stand in a document with a smaller id. Windows are
    judged on the input. Rows with the same id do not remove from each other. A null text has no words; rows without an id keep
    all words and take nothing from others. Texts shorter than a window keep all words. Input columns called like a
    result column (or ``block``) are replaced. Windows are equal when their 64-bit hashes are.
    """
    docs = docs.drop(*RESULT.names, "block").withColumn(key, F.col(key).cast("long"))
    block, buckets = _block(docs, key, text)
    placed = docs.withColumn("block", block)
    sketches = placed.where("block >= 0").select("block", text).mapInArrow(
        _sketches(buckets, width), "bucket int, hashes binary, blocks binary")
    earlier = sketches.groupBy("bucket").applyInArrow(_earlier, "block long, hashes binary")
    schema = T.StructType([*docs.schema.fields, *RESULT.fields])
    return placed.groupBy("block").cogroup(earlier.groupBy("block")).applyInArrow(_remove(width, key, text, docs.columns), schema)
