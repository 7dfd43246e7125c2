"""Ranked lexical search: the best documents of each item by saturated term weights, found with the best-position algorithm.

Each task reads its documents once, keeps postings of the items' terms for a bounded block of them, and ranks every item in that
block. The lists of an item's terms are read from their highest impact down. A document met in one list is looked up in all others at
once, and the places it has there count as seen. What no seen place can beat is the sum of each list's first unseen impact; the item is
done when the last of its best documents, of this block or those before, lies above that sum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from panelkit.llm import words as W
from panelkit.session import settled

TOP = 20
#: Items are searched in groups of about so many bytes of text: their terms and lists travel to every task.
ITEM_BYTES = 1 << 20
#: Postings of a block; a text that has more on its own is a block of its own.
BLOCK_POSTINGS = 1 << 21
#: Places read of each list in the first round; each further round reads twice as deep.
DEPTH = 32
#: Tasks' results meet in two steps, the first in so many parts of an item.
PARTS = 32


@dataclass
class Items:
    """The items of a group: their ids, the sorted hashes of their terms, and each item's terms and repeats."""

    ids: list
    terms: np.ndarray
    bounds: np.ndarray
    own: np.ndarray  # places in ``terms``, distinct in an item
    times: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        bounds, keys = [0], []
        for piece in W.pieces(pa.array([t for _, t in rows], pa.large_string())):
            data, found = _terms(piece)
            keys += [W.hashes(data, found)[a:b] for a, b in zip(found.bounds[:-1], found.bounds[1:])]
        terms = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        own, times = [], []
        for key in keys:
            place, count = np.unique(np.searchsorted(terms, key), return_counts=True)
            own.append(place)
            times.append(count)
            bounds.append(bounds[-1] + len(place))
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        return cls([i for i, _ in rows], terms, np.array(bounds), join(own), join(times))


def _terms(piece: W.Piece) -> tuple[np.ndarray, W.Words]:
    data = W.LOWER[piece.data]
    return data, W.split(W.Piece(0, data, piece.offsets), W.LETTERS)


class Lookup:
    """Which of many word hashes are terms, and which ones."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.marked = np.zeros(1 << 16, bool)
        self.marked[terms >> np.uint64(48)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` and the term at each."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.flatnonzero(self.marked[hashes >> np.uint64(48)])
        term = np.minimum(np.searchsorted(self.terms, hashes[near]), len(self.terms) - 1)
        same = self.terms[term] == hashes[near]
        return near[same], term[same]


def counted(column: pa.Array, lookup: Lookup) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece of a column: its first text, the terms of each text with repeats, and (text, known term, occurrences)."""
    width = max(1, len(lookup.terms))
    for piece in W.pieces(column):
        data, found = _terms(piece)
        at, term = lookup.find(W.hashes(data, found))
        pair, times = np.unique(found.text[at] * width + term, return_counts=True)
        yield piece.first, np.diff(found.bounds), pair // width, pair % width, times


def statistics(docs: DataFrame, text: str, terms: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms with repeats, and how many documents hold each of ``terms``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, some, every, holding = Lookup(terms), 0, 0, np.zeros(len(terms), np.int64)
        for batch in batches:
            for _, sizes, _, term, _ in counted(batch.column(0), lookup):
                some, every = some + int((sizes > 0).sum()), every + int(sizes.sum())
                holding += np.bincount(term, minlength=len(terms))
        place = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-2, -1], place]), pa.int64()), pa.array(np.concatenate([[some, every], holding[place]]), pa.int64())], ["term", "n"])

    rows = docs.select(text).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    holding = np.zeros(len(terms), np.int64)
    for term, n in found.items():
        if term >= 0:
            holding[term] = n
    return found.get(-2, 0), found.get(-1, 0), holding


def weights(documents: int, holding: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) if n else 0 for n in holding.tolist()], np.int64)


def impacts(occurrences: np.ndarray, sizes: np.ndarray, documents: int, every: int) -> np.ndarray:
    """Saturated share of a term in a document of so many terms, in millionths at most."""
    if 25 * documents * int(sizes.max(initial=0)) < 1 << 63:
        long = (25 * documents * sizes) // every
    else:
        long = np.array([25 * documents * int(n) // every for n in sizes], np.int64)
    return (1_000_000_000 * occurrences) // (1000 * occurrences + 12 * (75 + long))


class Block:
    """Postings of some documents, by term from the highest impact down and by document."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int, terms: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(terms + 1))
        by_doc = np.argsort(self.doc, kind="stable")
        self.place, self.term_at = by_doc, term[order][by_doc]
        self.rows = np.searchsorted(self.doc[by_doc], np.arange(docs + 1))
        self.docs, self.terms = docs, terms
        self.reads = 0

    def best(self, own: np.ndarray, weight: np.ndarray, top: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents (ascending by score, then place) that may be among the ``top``, and their scores; ``before`` has the scores of others."""
        live = (weight > 0) & (self.starts[own + 1] > self.starts[own])
        own, weight = own[live], weight[live]
        starts, lengths = self.starts[own], self.starts[own + 1] - self.starts[own]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        gain = np.zeros(self.terms, np.int64)
        gain[own] = weight
        shift = np.zeros(self.terms, np.int64)
        shift[own] = offsets[:-1] - starts
        seen, known = np.zeros(offsets[-1] + 1, bool), np.zeros(self.docs, bool)
        found, scores, depth, read = np.zeros(0, np.int64), np.zeros(0, np.int64), DEPTH, np.zeros(len(own), np.int64)
        while True:
            reach = np.minimum(lengths, depth)
            met = np.unique(self.doc[_spans(starts + read, reach - read)])
            met = met[~known[met]]
            known[met] = True
            if len(met):
                sizes = self.rows[met + 1] - self.rows[met]
                entry = _spans(self.rows[met], sizes)
                used = gain[self.term_at[entry]] > 0
                entry, row = entry[used], np.repeat(np.arange(len(met)), sizes)[used]
                term, place = self.term_at[entry], self.place[entry]
                seen[place + shift[term]] = True
                total = np.zeros(len(met), np.int64)
                np.add.at(total, row, gain[term] * self.impact[place])
                found, scores = np.concatenate([found, met]), np.concatenate([scores, total])
            read = reach
            unseen = np.append(np.flatnonzero(~seen[:-1]), offsets[-1])
            first = unseen[np.searchsorted(unseen, offsets[:-1])]
            open_ = np.flatnonzero(first < offsets[1:])
            bound = int((weight[open_] * self.impact[starts[open_] + first[open_] - offsets[open_]]).sum())
            every = np.concatenate([scores, before])
            if not len(open_) or (len(every) >= top and np.partition(every, len(every) - top)[len(every) - top] > bound):
                break
            depth *= 2
        self.reads += len(found)
        return found, scores


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of every span, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


class Ranking:
    """The best documents of each item over the blocks of one task, as (falling score, id missing, id)."""

    def __init__(self, items: Items, weight: np.ndarray, top: int):
        self.items, self.weight, self.top = items, weight, top
        self.held: list[list[tuple]] = [[] for _ in items.ids]

    def add(self, block: Block, ids: list) -> None:
        """Rank every item in a block; ``ids`` are those of its documents, in ascending order."""
        items, top = self.items, self.top
        for k, held in enumerate(self.held):
            own = slice(items.bounds[k], items.bounds[k + 1])
            term = items.own[own]
            found, scores = block.best(term, items.times[own] * self.weight[term], top, np.array([-h[0] for h in held], np.int64))
            if not len(found):
                continue
            if len(found) > top:
                least = np.partition(scores, len(scores) - top)[len(scores) - top]
                found, scores = found[scores >= least], scores[scores >= least]
            first = np.lexsort((found, -scores))[:top]
            new = [(-int(s), ids[d] is None, ids[d]) for d, s in zip(found[first].tolist(), scores[first].tolist()) if s > 0]
            self.held[k] = sorted(held + new)[:top]


def _search(items: Items, weight: np.ndarray, documents: int, every: int, top: int, schema: pa.Schema):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, ranking = Lookup(items.terms), Ranking(items, weight, top)
        keys, parts, docs, postings = [], [], 0, 0

        def flush() -> None:
            column = pa.chunked_array(keys).combine_chunks()
            # The place of a document among the ids in ascending order, missing ones last.
            order = pc.sort_indices(column, null_placement="at_end").to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            doc, term, impact = (np.concatenate([p[k] for p in parts]) for k in range(3))
            ranking.add(Block(place[doc], term, impact, docs, len(items.terms)), column.take(pa.array(order)).to_pylist())

        for batch in batches:
            column = batch.column(0)
            for first, sizes, doc, term, times in counted(batch.column(1), lookup):
                parts.append((doc + docs, term, impacts(times, sizes[doc], documents, every)))
                keys.append(column.slice(first, len(sizes)))
                docs, postings = docs + len(sizes), postings + len(doc)
                if postings >= BLOCK_POSTINGS:
                    flush()
                    keys, parts, docs, postings = [], [], 0, 0
        if postings:
            flush()
        rows = [(k, items.ids[k], h[2], -h[0]) for k, held in enumerate(ranking.held) for h in held]
        for start in range(0, len(rows), 10_000):
            columns = zip(*rows[start : start + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return search


def _best(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("__doc").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def rank_documents(
    docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", top: int = TOP
) -> DataFrame:
    """``item_key, rank, key, score``: the ``top`` documents of each item with a score above 0, equal scores by ascending key, null last.

    Terms are runs of letters and digits (all characters from U+0080 on count as letters), A-Z lower-cased. A term's weight falls with the
    share of documents that hold it; its part in a document grows with its occurrences and falls with the document's length. Term
    hashes of 64 bits stand for terms. Every row of ``items`` is an item of its own, repeated rows and null keys too, and every row of
    ``docs`` a document of its own. Null and empty texts match nothing; an empty table gives no rows. Other columns do not matter.
    """
    spark = docs.sparkSession
    kinds = [items.schema[item_key].dataType, docs.schema[key].dataType]
    plain = T.StructType([T.StructField("__item", T.LongType()), T.StructField("__key", kinds[0]), T.StructField("__doc", kinds[1]), T.StructField("score", T.LongType())])
    names = [item_key, "rank", key if key not in (item_key, "rank", "score") else f"{key}_found", "score"]
    docs = settled(docs.select(F.col(key).alias("__doc"), F.col(text).alias("__text")), "searched")
    asked = items.select(F.col(item_key).alias("__key"), F.col(item_text).alias("__text")).where(F.length("__text") > 0)
    groups = -(-(asked.agg(F.sum(F.octet_length("__text"))).first()[0] or 0) // ITEM_BYTES)
    results = []
    for k in range(groups):
        own = asked.where(F.pmod(F.xxhash64("__key", "__text"), F.lit(groups)) == k).collect()  # about ITEM_BYTES
        group = Items.of([tuple(r) for r in own])
        documents, every, holding = statistics(docs, "__text", group.terms)
        found = docs.mapInArrow(_search(group, weights(documents, holding), documents, every, top, to_arrow_schema(plain)), plain)
        parted = _best(found.withColumn("__part", F.pmod(F.xxhash64("__doc"), F.lit(PARTS))), ["__item", "__part"], top)
        results.append(_best(parted.drop("rank"), ["__item"], top).select("__key", "rank", "__doc", "score"))
    if not results:
        empty = spark.createDataFrame([], plain).withColumn("rank", F.lit(0))
        results = [empty.select("__key", "rank", "__doc", "score")]
    whole = results[0]
    for other in results[1:]:
        whole = whole.unionAll(other)
    return whole.toDF(*names)
