"""Fill-in-the-middle: texts cut at two seeded places and put together again as prefix, suffix and middle.

Cuts are drawn in lines or code points, texts are cut in bytes, and lengths are told in code points. A sparse index of the
characters of several bytes (their places and the bytes each has beyond one) converts between the two with a binary search; between
two of them a place is the same number on both sides but for a constant.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm import words as W

#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 7
#: Texts transformed, and those of them with the suffix first, of a hundred.
RATE, SUFFIX_FIRST = 100, 50
UNITS = ("line", "char")

ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]
_FOUND = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


@dataclass
class Exceptions:
    """The characters of several bytes in a buffer: where each starts, in bytes and in code points, and the excess before it."""

    places: np.ndarray
    points: np.ndarray
    excess: np.ndarray  # excess[k]: bytes beyond one a character in the first k exceptions

    @classmethod
    def of(cls, data: np.ndarray) -> Exceptions:
        places = np.flatnonzero(data >= 0xC0)
        lead = data[places]
        excess = np.zeros(len(places) + 1, np.int64)
        np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), out=excess[1:])
        return cls(places, places - excess[:-1], excess)

    def to_points(self, places: np.ndarray) -> np.ndarray:
        """Code points before each byte place; a place is the start of a character or the end."""
        return places - self.excess[np.searchsorted(self.places, places)]

    def to_places(self, points: np.ndarray) -> np.ndarray:
        """Byte place of the character that follows so many code points."""
        return points + self.excess[np.searchsorted(self.points, points)]


def _cuts(piece: W.Piece, index: Exceptions, unit: str, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the byte places of its two cuts; ``draws`` is texts x 2 of whole numbers."""
    starts, ends = piece.offsets[:-1], piece.offsets[1:]
    if unit == "char":
        first = index.to_points(starts)
        n = index.to_points(ends) - first
        at = np.sort(draws % (n + 1)[:, None], axis=1)
        return n, index.to_places(first + at[:, 0]), index.to_places(first + at[:, 1])
    breaks = np.flatnonzero(piece.data == 0x0A)
    before = np.searchsorted(breaks, piece.offsets)
    whole = np.diff(before)
    open_end = np.zeros(len(piece), bool)
    full = ends > starts
    open_end[full] = piece.data[ends[full] - 1] != 0x0A
    n = whole + open_end
    at = np.sort(draws % (n + 1)[:, None], axis=1)
    last = np.append(breaks, -1)

    def place(k: np.ndarray) -> np.ndarray:
        inside = last[np.minimum(before[:-1] + k - 1, len(breaks))] + 1
        return np.where(k == 0, starts, np.where(k > whole, ends, inside))

    return n, place(at[:, 0]), place(at[:, 1])


def transform_column(
    column: pa.Array, draws: np.ndarray, unit: str = "line", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = SENTINELS
) -> pa.Array:
    """``_FOUND`` for each text; ``draws`` is texts x 4 of unsigned numbers (two cuts, whether, which form)."""
    signs = [m.encode() for m in marks]
    head, tail, middle = signs
    counts, forms, before, between, outputs = [], [], [], [], []
    for piece in W.pieces(column):
        index = Exceptions.of(piece.data)
        own = draws[piece.first : piece.first + len(piece)]
        n, low, high = _cuts(piece, index, unit, own[:, :2])
        starts = piece.offsets[:-1]
        points = index.to_points(np.stack([starts, low, high]))
        counts += n.tolist()
        for k, (a, b, start) in enumerate(zip(low.tolist(), high.tolist(), starts.tolist())):
            text = piece.text(k)
            if not text or own[k, 2] % 100 >= rate or any(s in text for s in signs):
                forms.append("plain")
                before.append(None)
                between.append(None)
                outputs.append(text)
                continue
            pre, mid, suf = text[: a - start], text[a - start : b - start], text[b - start :]
            spm = own[k, 3] % 100 < suffix_first
            forms.append("spm" if spm else "psm")
            before.append(int(points[1, k] - points[0, k]))
            between.append(int(points[2, k] - points[1, k]))
            outputs.append(b"".join((tail, suf, head, pre, middle, mid) if spm else (head, pre, tail, suf, middle, mid)))
    arrays = [pa.array(counts, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64()), pa.array(between, pa.int64()),
              pa.array(outputs, pa.large_binary()).cast(pa.large_string()).cast(pa.string())]
    return pa.StructArray.from_arrays(arrays, fields=list(_FOUND))


def _check(unit: str, marks: tuple[str, str, str]) -> None:
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    overlap = any(a[k:] and b.startswith(a[k:]) for a in marks for b in marks for k in range(1, len(a)))
    if len(set(marks)) < 3 or not all(marks) or overlap or any(a != b and a in b for a in marks for b in marks):
        raise ValueError("marks must differ, hold no other mark and not overlap")


def draws(key: str | Column, seed: int = SEED) -> Column:
    """Four unsigned 32-bit numbers of a row: the first groups of eight digits of the sha256 of seed, colon and key (null: empty)."""
    column = F.col(key) if isinstance(key, str) else key
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def fill_in_middle(
    docs: DataFrame, text: str = "text", key: str = "doc_id", unit: str = "line", seed: int = SEED, rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """``docs`` without its text, with ``n`` units, ``form``, the code points of prefix and middle, and ``output``.

    The unit is a line (with its break) or a code point. Two cuts are drawn from 0 to n by a hash of seed and key; equal cuts give an
    empty middle. ``psm`` is prefix, suffix, middle, each after its mark; ``spm`` has the suffix first; ``plain`` is the text as it is: empty or null
    ones (output empty), those that hold a mark, and those left out by ``rate``; their lengths are null. Rows of one key have equal draws, rows
    without a key those of an empty one. Repeated rows and empty tables are fine; input columns called like a result column are replaced.
    """
    _check(unit, marks)

    @F.arrow_udf("struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>")
    def transform(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        own = numbers.flatten().to_numpy().reshape(-1, 4)
        return transform_column(texts, own, unit, rate, suffix_first, marks)

    found = docs.withColumn("__found", transform.asNondeterministic()(F.col(text), draws(key, seed)))
    kept = [c for c in docs.columns if c not in (text, *ADDED)]
    return found.select(*kept, *[F.col(f"__found.{n}").alias(n) for n in ADDED])


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of."""
    whole = F.col(output)
    place = {m: F.instr(whole, m) for m in marks}
    head, tail, middle = marks

    def part(mark: str, after: str | None) -> Column:
        start = place[mark] + F.lit(len(mark))
        return F.substring(whole, start, (place[after] if after else F.length(whole) + 1) - start)

    psm = F.concat(part(head, tail), part(middle, None), part(tail, middle))
    spm = F.concat(part(head, middle), part(middle, None), part(tail, head))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(whole)
