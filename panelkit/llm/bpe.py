"""Byte-pair encoding and decoding of whole texts, with chunks that many texts share encoded once.

A rolling hash over the last bytes cuts texts into chunks whose places depend on their content alone, so copies and shared passages
are cut alike. Chunks that occur more than once are found by counting their hashes; a bitmap of fixed size tells every task which
of its chunks may be among them (a wrong yes costs a shuffle of that chunk, never a wrong result). All other chunks are encoded
where they are read. Shared ones go through one group-by, are encoded once and joined to their places. Only whole words
inside a chunk are taken from it; the words at a join are encoded anew together with the neighbouring words, further out until both ends
agree with what the chunks say.

Tokenizers must drop white space, so that no token spans words; others are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm import words as W
from panelkit.session import materialise

WINDOW = 16
MASK = 511
SHORTEST, LONGEST = 64, 8192
BITMAP_BITS = 1 << 26  # 8 MB, whatever the number of shared chunks
PROBES = 3
CACHED_WORDS = 300_000
#: Texts of an Arrow batch that are copied at once.
COPIED_ROWS = 1_024

SEGMENTS = T.ArrayType(T.StructType([
    T.StructField("ids", T.BinaryType()), T.StructField("chunk", T.BinaryType()), T.StructField("text", T.BinaryType())]))
RESULT = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])


def chunk_ends(piece: W.Piece) -> list[list[int]]:
    """End of each chunk of each text, as places in the piece's buffer."""
    found = np.flatnonzero((W.rolling(piece.data, WINDOW) & np.uint64(MASK)) == 0) + WINDOW
    cut = np.searchsorted(found, piece.offsets)
    out = []
    for k in range(len(piece)):
        last, end, own = int(piece.offsets[k]), int(piece.offsets[k + 1]), []
        for place in [*found[cut[k] : cut[k + 1]].tolist(), end]:
            while place - last > LONGEST or (place < end and place - last >= SHORTEST):
                at = min(place, last + LONGEST)
                while at < end and piece.data[at] & 0xC0 == 0x80:  # never inside a character
                    at += 1
                if at >= end:
                    break
                own.append(at)
                last = at
        if end > last:
            own.append(end)
        out.append(own)
    return out


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


class Encoder:
    """One tokenizer of the library per worker, with the ids of frequent words kept."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # what was known before the last turn; words still in use move back
        one, two = self.raw(["Word", "it's"])
        if self.raw(["Word it's", " Word\n\t\x0b\x0c\rit's "]) != [one + two] * 2:
            raise ValueError("a tokenizer that keeps white space cannot be used here")
        self.table = None
        if self.tokenizer.decoder is None:
            size = self.tokenizer.get_vocab_size(with_added_tokens=True)
            self.table = [(self.tokenizer.id_to_token(k) or "").encode() for k in range(size)]

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def raw(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = {}, self.known
        new = []
        for w in words:
            if w not in self.known:
                ids = self.older.get(w)
                if ids is None:
                    new.append(w)
                else:
                    self.known[w] = ids
        for at in range(0, len(new), 10_000):
            own = new[at : at + 10_000]
            self.known.update(zip(own, self.raw([w.decode() for w in own]), strict=True))

    def ids(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.known.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.table is None:
            return self.tokenizer.decode(numbers, skip_special_tokens=False).encode()
        return b" ".join(map(self.table.__getitem__, numbers))


def _parts(chunk: bytes) -> tuple[bytes, list[bytes], bytes] | None:
    """What stands before the first white space, the whole words after it, what stands after the last; None without white space."""
    words = chunk.split()
    if not words:
        return (b"", [], b"") if chunk else None
    if len(words) == 1 and len(words[0]) == len(chunk):
        return None
    head = words.pop(0) if chunk[:1].strip() else b""
    tail = words.pop() if chunk[-1:].strip() else b""
    return head, words, tail


class _Plan:
    """A text as a list of segments: ids, words to look up, a shared chunk, or a join to repair."""

    def __init__(self, chunks: list[bytes], shared: list[bool]):
        self.segments: list[tuple] = []
        self.words: list[bytes] = []
        carry, before = b"", []
        for chunk, is_shared in zip(chunks, shared, strict=True):
            parts = _parts(chunk)
            if parts is None:
                carry += chunk
                continue
            head, words, tail = parts
            if carry or head:
                self.segments.append(("join", carry + head, before, words))
            self.words += words
            if words:
                self.segments.append(("chunk", chunk) if is_shared else ("words", words))
            carry, before = tail, words if words else []
        if carry:
            self.segments.append(("join", carry, before, []))


def _repair(encoder: Encoder, joins: list[tuple[bytes, list[bytes], list[bytes]]]) -> list[bytes]:
    """Ids of the word at each join: encoded with ``reach`` words on either side until both sides come out as in their chunks."""
    out: list[bytes] = [b""] * len(joins)
    waiting, reach = list(range(len(joins))), 1
    while waiting:
        regions = [(joins[k][1][-reach:], joins[k][0], joins[k][2][:reach]) for k in waiting]
        found = encoder.raw([b" ".join([*a, w, *b]).decode() for a, w, b in regions])
        again = []
        for k, (a, _, b), ids in zip(waiting, regions, found, strict=True):
            left, right = encoder.ids(a), encoder.ids(b)
            if ids.startswith(left) and ids.endswith(right) and len(ids) >= len(left) + len(right):
                out[k] = ids[len(left) : len(ids) - len(right)]
            elif reach > max(len(joins[k][1]), len(joins[k][2])):
                raise ValueError("the tokenizer joins words across white space")
            else:
                again.append(k)
        waiting, reach = again, reach * 2
    return out


def _encoded(encoder: Encoder, plans: list[_Plan]) -> list[list[tuple[bytes | None, bytes | None]]]:
    """Segments of each plan as ``(ids, None)`` or ``(None, shared chunk)``, neighbouring ids put together."""
    encoder.learn({w for plan in plans for w in plan.words})
    joins = [s[1:] for plan in plans for s in plan.segments if s[0] == "join"]
    repaired = iter(_repair(encoder, joins))
    out = []
    for plan in plans:
        own, held = [], []
        for segment in plan.segments:
            if segment[0] == "chunk":
                if held:
                    own.append((b"".join(held), None))
                    held = []
                own.append((None, segment[1]))
            else:
                held.append(next(repaired) if segment[0] == "join" else encoder.ids(segment[1]))
        if held:
            own.append((b"".join(held), None))
        out.append(own)
    return out


def _bits(digest: bytes) -> list[int]:
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "little") % BITMAP_BITS for k in range(PROBES)]


def _pieces(texts: pa.Array) -> Iterator[W.Piece]:
    """``W.pieces`` without a copy of the whole column: a worker holds one of some rows."""
    for start in range(0, len(texts), COPIED_ROWS):
        for piece in W.pieces(texts.slice(start, COPIED_ROWS)):
            yield W.Piece(start + piece.first, piece.data, piece.offsets)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in _pieces(batch.column(0)):
            out = []
            for k, ends in enumerate(chunk_ends(piece)):
                start = int(piece.offsets[k])
                for end in ends:
                    out.append(_digest(piece.data[start:end].tobytes()))
                    start = end
            yield pa.record_batch([pa.array(out, pa.binary())], ["chunk"])


def _bit_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array([b for x in batch.column(0) for b in _bits(x.as_py())], pa.int64())], ["bit"])


def _shared_bitmap(texts: DataFrame) -> Broadcast:
    """A bitmap of the digests of chunks that occur more than once, of ``BITMAP_BITS`` bits whatever their number."""
    counts = texts.mapInArrow(_hashes, "chunk binary").groupBy("chunk").count().where("count > 1").select("chunk")
    bits = counts.mapInArrow(_bit_places, "bit long")
    rows = bits.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bitmap = np.zeros(BITMAP_BITS // 8, np.uint8)
    for row in rows:
        start = (row["part"] - 1) * 4096
        part = np.frombuffer(row["bits"], np.uint8)
        bitmap[start : start + len(part)] |= part[: len(bitmap) - start]
    return texts.sparkSession.sparkContext.broadcast(bitmap)


def _plans(batch: pa.RecordBatch, column: str, bitmap: np.ndarray) -> Iterator[tuple[int, list[_Plan], list[bool]]]:
    """First row, plans, and which of them need a shared chunk, piece by piece."""
    for piece in _pieces(batch.column(column)):
        plans, open_ = [], []
        for k, ends in enumerate(chunk_ends(piece)):
            cuts = [int(piece.offsets[k]), *ends]
            chunks = [piece.data[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            shared = [all(bitmap[b >> 3] >> (b & 7) & 1 for b in _bits(_digest(c))) for c in chunks]
            plans.append(_Plan(chunks, shared))
            open_.append(any(s[0] == "chunk" for s in plans[-1].segments))
        yield piece.first, plans, open_


def _results(encoder: Encoder, ids: list[bytes]) -> list[pa.Array]:
    return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
            pa.array([encoder.decode(x) for x in ids], pa.binary()).cast(pa.string())]


def _closed(path: str, column: str, names: list[str], bitmap: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            for first, plans, open_ in _plans(batch, column, bitmap.value):
                rows = [k for k, is_open in enumerate(open_) if not is_open]
                ids = [b"".join(s[0] for s in own) for own in _encoded(encoder, [plans[k] for k in rows])]
                at = pa.array([first + k for k in rows], pa.int64())
                yield pa.record_batch([*(batch.column(n).take(at) for n in names), *_results(encoder, ids)], [*names, *RESULT.names])

    return run


def _open(path: str, column: str, names: list[str], bitmap: Broadcast):
    kind = pa.list_(pa.struct([("ids", pa.binary()), ("chunk", pa.binary()), ("text", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sent = Encoder.of(path), set()
        for batch in batches:
            for first, plans, open_ in _plans(batch, column, bitmap.value):
                rows, out = [k for k, is_open in enumerate(open_) if is_open], []
                for own in _encoded(encoder, [plans[k] for k in rows]):
                    segments = []
                    for ids, chunk in own:
                        digest = None if chunk is None else _digest(chunk)
                        new = digest is not None and digest not in sent
                        if new:  # each task sends a chunk's text once
                            if len(sent) >= CACHED_WORDS:
                                sent.clear()
                            sent.add(digest)
                        segments.append({"ids": ids, "chunk": digest, "text": chunk if new else None})
                    out.append(segments)
                at = pa.array([first + k for k in rows], pa.int64())
                yield pa.record_batch([*(batch.column(n).take(at) for n in names), pa.array(out, kind)], [*names, "__segments"])

    return run


def _chunk_ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            words = [_parts(x.as_py())[1] for x in batch.column(1)]
            encoder.learn({w for own in words for w in own})
            yield pa.record_batch([batch.column(0), pa.array([encoder.ids(own) for own in words], pa.binary())], ["chunk", "ids"])

    return run


def _filled(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = []
                for segments, found in zip(part.column("__segments").to_pylist(), part.column("__found").to_pylist(), strict=True):
                    known = {x["place"]: x["ids"] for x in found}
                    ids.append(b"".join(s["ids"] if s["chunk"] is None else known[k] for k, s in enumerate(segments)))
                yield pa.record_batch([*(part.column(n) for n in names), *_results(encoder, ids)], [*names, *RESULT.names])

    return run


def encode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_tokens``, ``ids`` (32-bit little-endian numbers) and ``decoded``.

    ``tokenizer`` is the path of a tokenizer file that every worker can read. Ids are those of the library without special tokens
    added; strings of special tokens in a text are encoded as the library does. ``decoded`` is the library's decoding of the ids with special tokens kept. A
    null text counts as empty and has no tokens. Rows may repeat. Input columns called like a result column are replaced.
    """
    names = [c for c in docs.columns if c != text and c not in RESULT.names]
    docs = docs.select(*names, text)
    bitmap = _shared_bitmap(docs.select(text))
    kept = [docs.schema[n] for n in names]
    done = docs.mapInArrow(_closed(tokenizer, text, names, bitmap), T.StructType([*kept, *RESULT.fields]))

    open_schema = T.StructType([*kept, T.StructField("__segments", SEGMENTS)])
    waiting = docs.mapInArrow(_open(tokenizer, text, names, bitmap), open_schema).withColumn("__row", F.expr("uuid()"))
    waiting = materialise(waiting, "open-texts")  # row names are fixed by this write
    places = waiting.select("__row", F.posexplode("__segments").alias("place", "part")).where("part.chunk IS NOT NULL").select(
        "__row", "place", "part.chunk", "part.text")
    chunks = places.where("text IS NOT NULL").groupBy("chunk").agg(F.first("text").alias("text"))
    chunks = materialise(chunks.mapInArrow(_chunk_ids(tokenizer), "chunk binary, ids binary"), "chunk-ids")
    found = places.select("__row", "place", "chunk").join(chunks, "chunk").groupBy("__row").agg(
        F.collect_list(F.struct("place", "ids")).alias("__found"))
    filled = waiting.join(found, "__row").drop("__row").mapInArrow(_filled(tokenizer, names), T.StructType([*kept, *RESULT.fields]))
    return done.unionByName(filled)
