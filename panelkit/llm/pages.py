"""Main text of web pages: markup and differencing against pages with near URLs vote on every line.

Pages of a host are ordered by URL path. Lines that also stand, in the same order, in the nearest neighbour (longest common subsequence)
belong to the host's template. Markup tells the frame that has elements of its own; names of classes tell more of it outside of an article
element, while inside one a doubtful name needs the neighbour's vote. Where the lines outside, without the template, are several times as
long as an article element, that is a teaser and they are the text.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.session import materialise

# Elements by their place in the markup language.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FRAME = frozenset("head nav header footer aside form noscript template iframe svg math select button dialog menu object canvas audio video datalist".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 "
                  "h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset("td th br".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

# Words of class names and ids that mark what is not the article.
FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments "
    "respond responses discussion disqus reply replies share sharing social related recommended widget widgets pagination pager toolbar login search disclaimer".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_URL = re.compile(r"^\s*[a-zA-Z][\w+.-]*://([^/?#\s]*)([^?#\s]*)")

#: Of these, what a name inside an article says for certain; any other name there needs the neighbour's vote.
CERTAIN_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe signup sidebar "
    "comment comments respond responses discussion disqus reply replies sharing related recommended".split())

#: A page that shares more than this part of its text with its neighbour may be a copy of it: the neighbour on the other side must share the line too.
COPY_SHARE = 0.8
#: Then a shared line of so many characters is a paragraph of copies and no template: nothing goes.
PARAGRAPH = 160
#: Lines outside, without the template, that are so many times as long as an article's make it a teaser.
TEASER = 3
#: Pairs of equal lines up to which chains are followed line by line; beyond, rows of bits are compared.
PAIRS = 200_000


def _frame(tag: str, attributes: str, article: bool) -> int:
    """Whether an element is frame: 0 no, 1 doubtful (a name inside an article), 2 yes."""
    if tag in FRAME:
        return 2
    if not attributes.strip(" /"):
        return 0
    named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "").lower():
        return 2
    if named.get("role", "").lower() in ROLES:
        return 1 if article and named["role"].lower() in ("alert", "complementary") else 2
    words = set(_WORD.findall(f"{named.get('class', '')} {named.get('id', '')}".lower()))
    if tag in ("article", "main", "body", "html"):
        return 2 if tag == "article" and words & {"comment", "comments", "reply"} else 0
    if article and not words & CERTAIN_WORDS:
        return int(bool(words & FRAME_WORDS))
    return 2 * bool(words & FRAME_WORDS)


def _closes(tag: str, open_: list[list]) -> int | None:
    """How far the stack is cut back when ``tag`` opens: a paragraph ends at the next block, a list item at the next item."""
    if tag in BLOCK:
        for k in range(len(open_) - 1, -1, -1):
            if open_[k][0] == "p":
                return k
            if open_[k][0] in BLOCK or open_[k][0] in ("td", "th"):
                break
    ends, bounds = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
                    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}.get(tag, ((), ()))
    for k in range(len(open_) - 1, -1, -1):
        if open_[k][0] in ends:
            return k
        if open_[k][0] in bounds or not ends:
            break
    return None


def lines(page: str | None) -> tuple[list[str], bool]:
    """What markup alone gives: text blocks in order without the frame, and whether they come from article or main elements."""
    every = blocks(page)
    own = [x for x, kind in every if kind]
    return (own, True) if own else ([x for x, _ in every], False)


def blocks(page: str | None) -> list[tuple[str, int]]:
    """Text blocks of a page in order without the certain frame; each is 0 outside of article and main elements, 1 inside, 2 inside and doubtful."""
    page = page or ""
    found: list[tuple[str, int]] = []
    text: list[str] = []
    open_: list[list] = []  # tag, how far in a frame (0 to 2), in article, only headings count

    def end() -> None:
        block = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if block:
            found.append((block, 1 + state[0] if state[1] else 0))

    def add(piece: str) -> None:
        if piece and state[0] < 2 and (not state[2] or any(e[0] in HEADINGS for e in open_)):
            text.append(piece)

    state = (0, False, False)
    at = 0
    while True:
        token = _TOKEN.search(page, at)
        add(page[at : token.start() if token else len(page)])
        if token is None:
            break
        at = token.end()
        tag = (token[2] or token[5] or "").lower()
        if not tag:
            continue
        closing, attributes = token[1] or token[4], token[3] or token[6] or ""
        if tag in BLOCK:
            end()
        elif tag in CELLS:
            add(" ")
        if closing:
            place = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == tag), None)
            if place is not None:
                del open_[place:]
        elif tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
        elif tag not in VOID:
            cut = _closes(tag, open_)
            if cut is not None:
                del open_[cut:]
            above = open_[-1][1:] if open_ else [0, False, False]
            inner_header = tag == "header" and above[1]
            frame = max(above[0], 0 if inner_header else _frame(tag, attributes, above[1]))
            article = above[1] or (not frame and (tag in ("article", "main") or re.search(r"role\s*=\s*[\"']?main", attributes, re.I) is not None))
            if not attributes.endswith("/") or tag in BLOCK:
                open_.append([tag, frame, article, above[2] or inner_header])
        state = tuple(open_[-1][1:]) if open_ else (0, False, False)
    end()
    return found


def shared_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``. Equal lines at both ends are matched at once."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inner, other = a[head : len(a) - tail], b[head : len(b) - tail]
    counts = Counter(other)
    pairs = sum(counts[x] for x in inner)
    middle = (_chains if pairs <= PAIRS else _halves)(inner, other) if pairs else []
    return [*range(head), *(head + k for k in middle), *range(len(a) - tail, len(a))]


def _chains(a: list, b: list) -> list[int]:
    """A longest common subsequence by following every pair of equal lines."""
    places = defaultdict(list)
    for k, line in enumerate(b):
        places[line].append(k)
    tails: list[int] = []
    nodes: list[tuple[int, tuple | None]] = []  # last matched place in a, the chain before it
    for k, line in enumerate(a):
        for place in reversed(places[line] if line in places else []):
            at = bisect_left(tails, place)
            node = (k, nodes[at - 1] if at else None)
            if at == len(tails):
                tails.append(place)
                nodes.append(node)
            else:
                tails[at], nodes[at] = place, node
    out, node = [], nodes[-1] if nodes else None
    while node is not None:
        out.append(node[0])
        node = node[1]
    return out[::-1]


def _row(a: list, b: list) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` and each start of ``b``, a line of ``a`` at a time for all of ``b`` as bits."""
    places: dict = defaultdict(int)
    for k, line in enumerate(b):
        places[line] |= 1 << k
    full = (1 << len(b)) - 1
    row = full
    for line in a:
        if line in places:
            hit = row & places[line]
            row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(bits == 0))


def _halves(a: list, b: list) -> list[int]:
    """A longest common subsequence in linear memory: ``a`` is halved and ``b`` cut where both parts together are longest."""
    if len(a) <= 1 or not b:
        return [0] if a and a[0] in b else []
    half = len(a) // 2
    low, high = _row(a[:half], b), _row(a[half:][::-1], b[::-1])[::-1]
    cut = int((low + high).argmax())
    return _halves(a[:half], b[:cut]) + [half + k for k in _halves(a[half:], b[cut:])]


def _line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, out = batch.slice(at, 256), ([], [], [], [])
            for url, page in zip(part.column(2), part.column(3), strict=True):
                place = _URL.match(url.as_py() or "")
                own = [x for x, _ in blocks(page.as_py())]
                for column, value in zip(out, (place[1].lower() if place else None, place[2].rstrip("/") if place else None,
                                               [_line_hash(x) for x in own], [len(x) for x in own]), strict=True):
                    column.append(value)
            yield pa.record_batch([part.column(0), part.column(1), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))],
                                  ["k1", "k2", "host", "path", "lines", "sizes"])


def template_lines(own: list, sizes: list[int], near: list | None, far: list | None) -> list[int]:
    """Places of the lines that belong to the template: shared with the nearest page and, where that may be a copy, with the next one too."""
    found = shared_lines(own, near) if near else []
    if sum(sizes[k] for k in found) > COPY_SHARE * sum(sizes):
        found = sorted(set(found) & set(shared_lines(own, far))) if far else []
        if sum(sizes[k] for k in found) > COPY_SHARE * sum(sizes) and (len(found) == len(own) or max(sizes[k] for k in found) >= PARAGRAPH):
            return []
    return found


def _template_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = ([], [], [])
        for k1, k2, *page in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            found = template_lines(*page)
            if found:
                for column, value in zip(out, (k1, k2, found), strict=True):
                    column.append(value)
        yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["k1", "k2", "gone"])


def nearest_pages(pages: DataFrame) -> DataFrame:
    """``k1, k2, p1, p2, q1, q2``: for each page (``host, path, k1, k2``) the neighbour of its host that shares more leading path segments
    (equally many: the one before), and the one on the other side, for the first and last page the one beyond the neighbour (null where there is none).

    Rows are dealt by range, so a host of any size is many tasks; what stands at the edge of a part comes from the next part.
    """
    count = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "path", "k1", "k2"]
    rows = pages.where("host IS NOT NULL").select(*order).repartitionByRange(count, *order).withColumn("part", F.spark_partition_id())
    rows = materialise(rows, "ordered-pages").withColumn("own", F.struct(*order))
    edges = rows.groupBy("part").agg(F.min("own").alias("first"), F.max("own").alias("last"))
    over = Window.orderBy("part")  # one row a part
    edges = edges.select("part", F.lag("last").over(over).alias("before"), F.lead("first").over(over).alias("after"))
    inside = Window.partitionBy("part").orderBy("own")
    rows = rows.select("part", "own", F.lag("own").over(inside).alias("l"), F.lead("own").over(inside).alias("r")).join(edges, "part").select(
        "own", F.coalesce("l", "before").alias("l"), F.coalesce("r", "after").alias("r"))

    def common(side: str):
        a, b = F.split("own.path", "/"), F.split(F.col(f"{side}.path"), "/")
        differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
        shared = F.when(differs == 0, F.size(a)).otherwise(differs - 1)
        return F.when(F.col(f"{side}.host") == F.col("own.host"), shared).otherwise(F.lit(-1))

    after = F.coalesce(common("r"), F.lit(-1)) > F.coalesce(common("l"), F.lit(-1))
    rows = rows.withColumn("best", F.when(after, F.col("r")).otherwise(F.col("l"))).withColumn("next", F.when(after, F.col("l")).otherwise(F.col("r")))
    other = lambda k: F.when(F.col("next.host") == F.col("own.host"), F.col(f"next.{k}"))
    found = materialise(rows.where("best.host = own.host").select(
        "own.k1", "own.k2", F.col("best.k1").alias("p1"), F.col("best.k2").alias("p2"), other("k1").alias("q1"), other("k2").alias("q2")), "page-neighbours")
    beyond = found.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.struct("p1", "p2").alias("a"), F.struct("q1", "q2").alias("b"))
    itself = (F.col("a.p1") == F.col("k1")) & (F.col("a.p2") == F.col("k2"))
    side = lambda k: F.coalesce(f"q{k}", F.when(itself, F.col(f"b.q{k}")).otherwise(F.col(f"a.p{k}"))).alias(f"q{k}")
    return found.join(beyond, ["p1", "p2"], "left").select("k1", "k2", "p1", "p2", side(1), side(2))


def chosen(own: list[tuple[str, int]], gone: set[int]) -> list[str]:
    """The lines of the main text: ``own`` as ``blocks`` gives them, ``gone`` the places of template lines."""
    article = [x for k, (x, kind) in enumerate(own) if kind == 1 or kind == 2 and k not in gone]
    outside = [x for k, (x, kind) in enumerate(own) if not kind and k not in gone]
    inside = sum(map(len, article))
    return outside if not article or sum(map(len, outside)) > TEASER * inside else article


def _main_text(pages: pa.Array, gone: pa.Array) -> pa.Array:
    return pa.array(["\n".join(chosen(blocks(page.as_py()), set(drop.as_py() or ()))) for page, drop in zip(pages, gone, strict=True)], pa.string())


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``pages`` without the markup, with ``text`` (blocks joined by newlines) and ``n_chars``.

    A null or empty page has an empty text. A page whose URL is null or has no host has no neighbour and is judged by
    markup alone, as is one whose neighbours are copies of it. Pages with equal lines count once in the order of URLs, so a group of copies is
    compared with the pages around it. Character references are decoded; white space inside a block, line breaks included, is one
    space. Repeated rows give the same text; an empty table gives none. Input columns called like a result column are replaced.
    """
    names = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    body = F.coalesce(F.col(page), F.lit(""))
    marks = [F.xxhash64(F.lit(seed), F.col(key), F.col(url), F.col(page)).alias(name) for seed, name in ((1, "k1"), (2, "k2"))]
    sketch = pages.select(*marks, F.col(url).alias("url"), body.alias("html")).mapInArrow(
        _sketch, "k1 long, k2 long, host string, path string, lines array<long>, sizes array<int>")
    sketch = materialise(sketch.dropDuplicates(["k1", "k2"]).withColumn("same", F.sha2(F.to_json("lines"), 256)), "page-lines")
    held = sketch.where("host IS NOT NULL AND size(lines) > 0")
    first = held.groupBy("host", "same").agg(F.min(F.struct("path", "k1", "k2")).alias("f")).select("host", "same", "f.*")
    first = materialise(first, "page-representatives")
    texts = lambda a, b, name: sketch.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("lines").alias(name))
    compared = nearest_pages(first).join(sketch.select("k1", "k2", "lines", "sizes"), ["k1", "k2"]).join(
        texts("p1", "p2", "near"), ["p1", "p2"]).join(texts("q1", "q2", "far"), ["q1", "q2"], "left")
    gone = compared.select("k1", "k2", "lines", "sizes", "near", "far").mapInArrow(_template_lines, "k1 long, k2 long, gone array<int>")
    gone = first.join(gone, ["k1", "k2"]).select("host", "same", "gone")
    gone = held.select("host", "same", "k1", "k2").join(gone, ["host", "same"]).select("k1", "k2", "gone")
    gone = materialise(gone, "template-lines").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("gone").alias("__gone"))
    keyed = pages.select(*names, body.alias("__html"), *[m.alias(f"__{n}") for m, n in zip(marks, ("k1", "k2"), strict=True)])
    joined = keyed.join(gone, ["__k1", "__k2"], "left").withColumn("text", F.arrow_udf(_main_text, "string").asNondeterministic()("__html", "__gone"))
    return joined.select(*names, "text").withColumn("n_chars", F.length("text").cast("long"))
