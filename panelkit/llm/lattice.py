"""Near-duplicate vectors: random projections decoded to points of the E8 lattice, in several tables, verified by cosine.

A unit vector is projected to 8 dimensions twice per table and both projections are decoded; the pair of lattice points is the cell. Each
vector stands in its own cell and in the nearest neighbouring ones, so two close vectors meet unless both lie far on other sides of
several borders. Vectors that share cells are compared as matrix blocks in a task; a pair that meets in several cells counts
in the smallest cell it shares. Equal vectors are folded first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm import words as W
from panelkit.llm.components import components
from panelkit.session import materialise

SIMILARITY = 0.98
TABLES = 6
CODES = 2
PROBES = 4
#: Projected unit vectors are scaled so that vectors at the similarity bound lie this far apart.
SPREAD = 0.5
SEED = 31
#: Members of a crowded cell are dealt to groups of about this size; each pair of groups is one task's block.
GROUP = 2048


def decode(x: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` (up to 6) nearest found E8 points of each row, as doubled integers, and their squared distances.

    E8 is D8 (integers of even sum) and D8 moved by one half. In either, the nearest point rounds each coordinate and, where the sum is odd,
    rounds the worst one the other way; the next points round other coordinates the other way.
    """
    points, far = [], []
    rows = np.arange(len(x))
    for shift in (0.0, 0.5):
        near = np.rint(x - shift)
        error = x - shift - near
        order = np.argsort(-np.abs(error), axis=1, kind="stable")
        other = np.where(error >= 0, 1.0, -1.0)
        odd = near.sum(1) % 2 != 0
        for k in range(3):
            point = near.copy()
            if k == 0:
                flips = [(odd, order[:, 0])]
            else:
                flips = [(odd, order[:, k]), (~odd, order[:, 0]), (~odd, order[:, k])]
            for mask, place in flips:
                point[rows[mask], place[mask]] += other[rows[mask], place[mask]]
            point += shift
            points.append(np.rint(2 * point).astype(np.int64))
            far.append(((x - point) ** 2).sum(1))
    points, far = np.stack(points, 1), np.stack(far, 1)
    best = np.argsort(far, axis=1, kind="stable")[:, :wanted]
    return points[rows[:, None], best], far[rows[:, None], best]


def projections(dimensions: int, similarity: float, seed: int = SEED) -> np.ndarray:
    scale = SPREAD / max(np.sqrt(2 - 2 * similarity), 1e-3)
    return np.random.default_rng(seed).normal(0, scale / np.sqrt(8), (TABLES, CODES, dimensions, 8))


def cells(unit: np.ndarray, similarity: float) -> np.ndarray:
    """``rows x TABLES x PROBES`` cell hashes, the own cell first."""
    out = np.zeros((len(unit), TABLES, PROBES), np.uint64)
    rows = np.arange(len(unit))[:, None]
    for table, codes in enumerate(projections(unit.shape[1], similarity)):
        found = [decode(unit @ matrix, PROBES) for matrix in codes]
        combos = list(product(range(PROBES), repeat=CODES))
        far = np.stack([sum(found[c][1][:, k] for c, k in enumerate(combo)) for combo in combos], 1)
        best = np.argsort(far, axis=1, kind="stable")[:, :PROBES]
        picks = np.array(combos)[best]
        value = np.full(best.shape, 0x1234567 + table, np.uint64)
        with np.errstate(over="ignore"):
            for code in range(CODES):
                points = found[code][0][rows, picks[:, :, code]]
                for axis in range(8):
                    value = W.mix(value * np.uint64(0x9E3779B97F4A7C15) + points[:, :, axis].astype(np.uint64))
        out[:, table] = value
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows in double precision; scaled first, so that squares neither overflow nor vanish."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keys(similarity: float):
    schema = pa.schema([("id", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(3).value_lengths().to_numpy()
            for dimensions in np.unique(size):
                rows = np.flatnonzero(size == dimensions)
                for at in range(0, len(rows), 2048):
                    part = batch.take(pa.array(rows[at : at + 2048]))
                    key = cells(_matrix(part.column(3)), similarity).reshape(part.num_rows, -1)
                    own = part.column(1).to_numpy().astype(np.uint64) * np.uint64(1_000_003) + np.uint64(dimensions)
                    with np.errstate(over="ignore"):
                        key = W.mix(key + W.mix(own)[:, None]).astype(np.int64)
                    lists = pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * key.shape[1], pa.array(key.ravel()))
                    yield pa.record_batch([part.column(0), lists], schema=schema)

    return run


def _earlier_meetings(key: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether row i of ``a`` and row j of ``b`` share a cell smaller than ``key``; cells go by in slices of bounded size."""
    out = np.zeros((len(a), len(b)), bool)
    common = np.intersect1d(a[a < key], b[b < key])
    for at in range(0, len(common), 1024):
        part = common[at : at + 1024]
        marks = []
        for rows in (a, b):
            place = np.minimum(np.searchsorted(part, rows), len(part) - 1)
            held = part[place] == rows
            mark = np.zeros((len(rows), len(part)), np.float32)
            mark[np.nonzero(held)[0], place[held]] = 1
            marks.append(mark)
        out |= marks[0] @ marks[1].T > 0
    return out


def _compare(similarity: float):
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("peer", pa.int64())])

    def run(block: pa.Table) -> pa.Table:
        key, low, high = (block.column(n)[0].as_py() for n in ("key", "low", "high"))
        group, ids = block.column("part").to_numpy(), block.column("id").to_numpy()
        left, right = np.flatnonzero(group == low), np.flatnonzero(group == high)
        times = block.column("n").to_numpy()
        unit = _matrix(block.column("embedding").combine_chunks())
        keys = np.asarray(block.column("keys").combine_chunks().flatten()).reshape(len(ids), -1)
        links = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))
        pairs_a, pairs_b = [], []
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            near = unit[rows] @ unit[right].T >= similarity
            if low == high:
                near &= rows[:, None] < right[None, :]
            if near.any():
                near &= ~_earlier_meetings(key, keys[rows], keys[right])
                i, j = np.nonzero(near)
                pairs_a.append(rows[i])
                pairs_b.append(right[j])
        if not pairs_a:
            return pa.table([pa.array([], t) for t in schema.types], schema=schema)
        a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
        np.add.at(links, a, times[b])
        np.add.at(links, b, times[a])
        while True:
            least = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
            root = root[root]
            if (root == before).all():
                break
        some = np.flatnonzero(links)
        return pa.table([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[root[some]])], schema=schema)

    return run


def near_vectors(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", similarity: float = SIMILARITY
) -> DataFrame:
    """``rows`` with ``n_links`` (other vectors of the same label at ``similarity`` or more), ``component_id`` and ``kept``.

    The component is the smallest id that links lead to. Rows without id or label, and vectors that are null, empty, zero, or
    hold a null or non-finite component link with nothing; nor do vectors of different lengths. Every further row is another
    vector, also if it repeats one. Input columns called like a result column are replaced.
    """
    rows = rows.drop("n_links", "component_id", "kept").withColumn(key, F.col(key).cast("long"))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0)
    usable = F.coalesce(sound, F.lit(False)) & F.col(key).isNotNull() & F.col(label).isNotNull()
    digests = [F.when(usable, F.xxhash64(F.lit(seed), F.col(label), F.col(vector))).alias(name) for seed, name in ((1, "__d1"), (2, "__d2"))]
    named = rows.select(F.col(key).alias("id"), F.xxhash64(label).alias("label"), F.col(vector).alias("embedding"), *digests).where("__d1 IS NOT NULL")
    folded = materialise(named.groupBy("__d1", "__d2").agg(
        F.min("id").alias("id"), F.first("label").alias("label"), F.count("*").alias("n"), F.first("embedding").alias("embedding")), "vectors")
    keyed = materialise(folded.select("id", "label", "n", "embedding").mapInArrow(_keys(similarity), "id long, keys array<long>"), "cells")
    meeting = keyed.select("id", F.explode(F.array_distinct("keys")).alias("key"))
    busy = materialise(meeting.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "busy-cells")
    groups = F.ceil(F.col("size") / F.lit(GROUP)).cast("int")
    members = meeting.join(busy, "key").withColumn("groups", groups).withColumn("part", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int"))
    members = materialise(members.select("key", "id", "groups", "part"), "cell-members")
    blocks = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select(
        "key", "id", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    payload = materialise(folded.select("id", "n", "embedding").join(keyed, "id"), "payload")
    compared = blocks.join(payload, "id").groupBy("key", "low", "high").applyInArrow(_compare(similarity), "id long, links long, peer long")
    compared = materialise(compared, "vector-links")
    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    found = components(compared, "id", "peer").withColumnRenamed("node", "id")
    result = folded.select("__d1", "__d2", "id", "n").join(links, "id", "left").join(found, "id", "left").select(
        "__d1", "__d2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    result = materialise(result, "vector-classes")
    return rows.withColumns({"__d1": digests[0], "__d2": digests[1]}).join(result, ["__d1", "__d2"], "left").select(
        *rows.columns, F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", key).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
