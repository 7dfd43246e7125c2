"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

A document's shingles carry their counts as weights. Each shingle is a Poisson process whose rate is its weight; an arrival falls into
a random register, a register keeps its earliest shingle, and a shingle stops as soon as its next arrival is later than all
registers of the document. Two signatures agree in a register with the probability Jaccard similarity of the documents.
With all weights 1 they agree with the Jaccard similarity of the shingle sets; texts with repeated shingles have both signatures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm import words as W
from panelkit.llm.components import components
from panelkit.session import materialise

SHINGLE = 5
SIMILARITY = 0.8
REGISTERS = 128  # a power of two: the register is the low bits of a random word
BANDS = 25
ROWS = 5
#: Pairs whose registers agree this much less than the bound are not verified: over five deviations of the estimate.
SLACK = 0.2
#: Members of a crowded bucket are dealt to groups of about this size.
GROUP = 1024


def shingles(piece: W.Piece, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number, hash and count, in the order of texts.

    A text of fewer words than a shingle has one shingle of all its words; one without words has none.
    """
    own = W.split(piece)
    each = W.hashes(piece.data, own)
    value, at = W.windows(each, own, width)
    text = own.text[at]
    count = np.diff(own.bounds)
    for k in np.flatnonzero((count > 0) & (count < width)):
        whole = W.mix(np.frombuffer(hashlib.blake2b(each[own.bounds[k] : own.bounds[k + 1]].tobytes(), digest_size=8).digest(), np.uint64))
        value, text = np.append(value, whole), np.append(text, k)
    with np.errstate(over="ignore"):
        own_key = W.mix(value + text.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    _, first, times = np.unique(own_key, return_index=True, return_counts=True)
    order = np.argsort(first)
    order = order[np.argsort(text[first[order]], kind="stable")]
    first, times = first[order], times[order]
    return text[first], value[first], times


def signatures(text: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """``texts x registers`` shingle hashes; a row of zeros for a text without shingles."""
    times = np.full(texts * registers, np.inf)
    holder = np.zeros(texts * registers, np.uint64)
    stop = np.full(texts, np.inf)
    at = np.zeros(len(value))
    step = 0
    while len(value):
        step += 1
        with np.errstate(over="ignore"):
            random = W.mix(value + np.uint64(step) * np.uint64(0x9FB21C651E98DF25))
        at = at - np.log1p(-(random >> np.uint64(11)).astype(np.float64) * 2.0**-53) / weight
        alive = at < stop[text]
        text, value, weight, at, random = text[alive], value[alive], weight[alive], at[alive], random[alive]
        place = text * registers + (random & np.uint64(registers - 1)).astype(np.int64)
        np.minimum.at(times, place, at)
        won = times[place] == at
        holder[place[won]] = value[won]
        live = np.flatnonzero(np.bincount(text, minlength=texts))
        stop[live] = times.reshape(texts, registers)[live].max(1)
    return holder.reshape(texts, registers)


def both_signatures(text: np.ndarray, value: np.ndarray, count: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures by counts and by weights of 1, and the texts where they may differ: those with a repeated shingle."""
    weighted = signatures(text, value, count.astype(np.float64), texts)
    repeated = np.unique(text[count > 1])
    own = np.isin(text, repeated)
    plain = weighted.copy()
    plain[repeated] = signatures(np.searchsorted(repeated, text[own]), value[own], np.ones(int(own.sum())), len(repeated))
    return weighted, plain, repeated


def _bands(signature: np.ndarray) -> np.ndarray:
    bands = np.full((len(signature), BANDS), 0x51, np.uint64) + np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for row in range(ROWS):
            bands = W.mix(bands * np.uint64(0x9E3779B97F4A7C15) + signature[:, row : BANDS * ROWS : ROWS])
    return bands.astype(np.int64)


def _signed(width: int):
    schema = pa.schema([("id", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for piece in W.pieces(batch.column(1)):
                text, value, weight = shingles(piece, width)
                weighted, plain, repeated = both_signatures(text, value, weight, len(piece))
                lists = list(_bands(weighted))
                for k, more in zip(repeated, _bands(plain[repeated]), strict=True):
                    lists[k] = np.union1d(lists[k], more)
                some = np.flatnonzero(np.bincount(text, minlength=len(piece)))
                digest = [hashlib.blake2b(b" ".join(piece.text(k).split()), digest_size=16).digest() for k in some]
                ends = np.cumsum([0, *(len(lists[k]) for k in some)])
                flat = np.concatenate([np.zeros(0, np.int64), *(lists[k] for k in some)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
                yield pa.record_batch([ids.take(pa.array(some + piece.first)), pa.array(digest, pa.binary()), lists], schema=schema)

    return run


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Jaccard and probability Jaccard similarity of two sorted shingle arrays with counts."""
    (va, wa), (vb, wb) = a, b
    if not len(va) or not len(vb):
        return 0.0, 0.0
    at = np.minimum(np.searchsorted(vb, va), len(vb) - 1)
    both = vb[at] == va
    shared = int(np.count_nonzero(both))
    x, y = wa[both].astype(np.float64), wb[at[both]].astype(np.float64)
    order = np.argsort(-(x / y), kind="stable")
    x, y = x[order], y[order]
    only_x, only_y = float(wa.sum() - x.sum()), float(wb.sum() - y.sum())
    total = (only_x + np.cumsum(x)) / x + (only_y + y.sum() - np.cumsum(y)) / y
    return shared / (len(va) + len(vb) - shared), float((1.0 / total).sum())


def _sets(piece: W.Piece, text: np.ndarray, value: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted shingles of each text of a piece, with their counts."""
    cut = np.searchsorted(text, np.arange(len(piece) + 1))
    for k in range(len(piece)):
        own = value[cut[k] : cut[k + 1]]
        order = np.argsort(own)
        yield own[order], count[cut[k] : cut[k + 1]][order]


def _verify(width: int, similarity: float):
    def sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for piece in W.pieces(column):
            yield from _sets(piece, *shingles(piece, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([max(likeness(x, y)) for x, y in zip(sets(batch.column(2)), sets(batch.column(3)), strict=True)])
            keep = pa.array(found >= similarity - 1e-12) if len(found) else pa.array([], pa.bool_())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"]).filter(keep)

    return run


def bucket_members(classes: DataFrame) -> DataFrame:
    """``bucket, id, n, low`` of all buckets with more than one member."""
    rows = classes.select("id", F.explode("bands").alias("bucket"))
    buckets = materialise(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("low")).where("n > 1"), "buckets")
    return materialise(rows.join(buckets, "bucket"), "members")


def central_pairs(members: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of each bucket's members and its two centres, instead of all members with each other.

    The centres are the smallest id and the member that shares most buckets with others, which lies amid a group of copies of one text.
    """
    weight = materialise(members.groupBy("id").agg(F.sum("n").alias("weight")), "weights")
    amid = members.join(weight, "id").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("amid"))
    amid = materialise(amid.select("bucket", (-F.col("amid.id")).alias("amid")), "amid")
    pairs = members.select("id", F.col("low").alias("centre")).union(members.join(amid, "bucket").select("id", "amid"))
    return pairs.where("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def _sketches(width: int):
    """Registers by counts, then by weights of 1; the sorted shingles with their counts."""
    schema = pa.schema([("id", pa.int64()), ("registers", pa.binary()), ("shingles", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch.column(1)):
                text, value, weight = shingles(piece, width)
                weighted, plain, _ = both_signatures(text, value, weight, len(piece))
                found = np.concatenate([weighted, plain], 1).astype(np.uint32)
                own, times = [], []
                for value, count in _sets(piece, text, value, weight):
                    own.append(value.tobytes())
                    times.append(count.astype(np.uint32).tobytes())
                yield pa.record_batch([batch.column(0).slice(piece.first, len(piece)), pa.array([row.tobytes() for row in found], pa.binary()),
                                       pa.array(own, pa.binary()), pa.array(times, pa.binary())], schema=schema)

    return run


def _pairs(block: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a block's members in different components whose registers agree often enough, and how often they do; each pair once."""
    low, high = block.column("low")[0].as_py(), block.column("high")[0].as_py()
    part, component = (block.column(n).to_numpy() for n in ("part", "component"))
    registers = np.stack([np.frombuffer(x.as_py(), np.uint32) for x in block.column("registers")])
    looks = [0] if (registers[:, :REGISTERS] == registers[:, REGISTERS:]).all() else [0, REGISTERS]
    left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        agree = np.zeros((len(rows), len(right)), np.uint8)
        for first in looks:
            same = np.zeros_like(agree)
            for k in range(first, first + REGISTERS):
                same += registers[rows, k][:, None] == registers[right, k][None, :]
            np.maximum(agree, same, out=agree)
        wanted = (agree >= least * REGISTERS) & (component[rows][:, None] != component[right][None, :])
        if low == high:
            wanted &= rows[:, None] < right[None, :]
        x, y = np.nonzero(wanted)
        yield rows[x], right[y], agree[x, y]


def _paired(least: float):
    """The members of a block that have a pair to verify."""

    def run(block: pa.Table) -> pa.Table:
        some = np.zeros(len(block), bool)
        for x, y, _ in _pairs(block, least):
            some[x] = some[y] = True
        return block.select(["bucket", "id", "component", "part", "low", "high"]).filter(pa.array(some))

    return run


def _linked(least: float, similarity: float):
    """Links of a block: its pairs are verified from the likest on, unless links before have joined their components."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(block: pa.Table) -> pa.Table:
        ids, component = block.column("id").to_numpy(), block.column("component").to_numpy()
        sets = [(np.frombuffer(v.as_py(), np.uint64), np.frombuffer(c.as_py(), np.uint32))
                for v, c in zip(block.column("shingles"), block.column("counts"), strict=True)]
        x, y, agree = (np.concatenate(c) for c in zip(*_pairs(block, least), (np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint8)), strict=True))
        root = {c: c for c in component.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for k in np.argsort(-agree.astype(np.int16), kind="stable"):
            one, other = find(int(component[x[k]])), find(int(component[y[k]]))
            if one != other and max(likeness(sets[x[k]], sets[y[k]])) >= similarity - 1e-12:
                root[other] = one
                out.append(sorted((int(ids[x[k]]), int(ids[y[k]]))))
        return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], schema=schema)

    return run


def remaining_links(members: DataFrame, found: DataFrame, bodies: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links ``a < b`` that join the components which bucket-mates are left in by the links so far.

    Only buckets that hold several components are looked at again. Members outside the bucket's largest component are compared with
    all others, as blocks of two groups in a task; those of the largest component are not compared with each other. Every pair of a
    block that agrees in enough registers is verified there, so no pair is a row; only members with such a pair bring their shingles.
    """
    placed = members.select("bucket", "id").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    placed = materialise(placed, "placed-members")
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("bucket").agg(
        F.count("*").alias("kinds"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("largest")).where("kinds > 1")
    groups = lambda n: F.ceil(n / F.lit(GROUP)).cast("int")
    mixed = materialise(mixed.select("bucket", F.col("largest.component").alias("main"), groups(F.col("n") - F.col("largest.n")).alias("few"),
                                     groups(F.col("largest.n")).alias("many")), "mixed-buckets")
    rows = placed.join(mixed, "bucket").withColumn("inner", F.col("component") == F.col("main"))
    part = F.when(F.col("inner"), F.col("few") + F.pmod(F.xxhash64("id"), F.col("many"))).otherwise(F.pmod(F.xxhash64("id"), F.col("few")))
    rows = materialise(rows.withColumn("part", part.cast("int")).withColumn(
        "others", F.when(F.col("inner"), F.col("few")).otherwise(F.col("few") + F.col("many"))), "mixed-members")
    sketches = materialise(bodies.join(rows.select("id").distinct(), "id").select("id", "body").mapInArrow(
        _sketches(width), "id long, registers binary, shingles binary, counts binary"), "sketches")
    blocks = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).select(
        "bucket", "id", "component", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    paired = blocks.join(sketches.select("id", "registers"), "id").groupBy("bucket", "low", "high").applyInArrow(
        _paired(similarity - SLACK), "bucket long, id long, component long, part int, low int, high int")
    alike = materialise(paired, "paired").join(sketches, "id").groupBy("bucket", "low", "high").applyInArrow(
        _linked(similarity - SLACK, similarity), "a long, b long")
    return materialise(alike.distinct(), "far-links")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE
) -> DataFrame:
    """``docs`` with ``class_id`` (smallest id of the near-duplicate class) and ``kept`` (its id is the class id).

    Documents are linked when the Jaccard or the probability Jaccard similarity of their ``width``-word shingles is at least
    ``similarity``; classes are the connected components. Words are runs of non-space characters. Texts of equal word sequences are
    folded before banding, so a group of copies costs one signature. Null and wordless texts and rows without an id are in no class
    with others (no id: class null, kept). Rows that share an id are one document and share its class. Input columns
    called like a result column are replaced.
    """
    docs = docs.drop("class_id", "kept").withColumn(key, F.col(key).cast("long"))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("body")).where("id IS NOT NULL")
    signed = materialise(texts.mapInArrow(_signed(width), "id long, digest binary, bands array<long>"), "signatures")
    classes = materialise(signed.groupBy("digest").agg(F.min("id").alias("id"), F.first("bands").alias("bands")), "texts")
    members = bucket_members(classes)
    wanted = materialise(members.select("id").distinct(), "wanted")
    bodies = materialise(texts.join(wanted, "id").groupBy("id").agg(F.min("body").alias("body")), "bodies")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(bodies.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a").join(
            bodies.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b").select("a", "b", "body_a", "body_b")
        return materialise(both.mapInArrow(_verify(width, similarity), "a long, b long, similarity double"), "near-links")

    links = verified(materialise(central_pairs(members), "pairs"))
    found = components(links, "a", "b")
    far = remaining_links(members, found, bodies, width, similarity)
    if not far.isEmpty():
        # components stand for the links that made them
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(far), "a", "b")
    class_of = classes.select("digest", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "digest", F.coalesce("component", "id").alias("class_id"))
    member = signed.select("id", "digest").join(materialise(class_of, "classes"), "digest").select("id", "class_id")
    member = materialise(member.groupBy("id").agg(F.min("class_id").alias("class_id")), "members")
    joined = docs.join(member.withColumnRenamed("id", "__id"), F.col(key) == F.col("__id"), "left").drop("__id")
    return joined.withColumn("class_id", F.coalesce("class_id", key)).withColumn(
        "kept", F.coalesce(F.col(key) == F.col("class_id"), F.lit(True)))
