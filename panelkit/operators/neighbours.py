"""Exact k-nearest-neighbour join with a missing-aware distance, and imputation on top of it.

distance(r, d)^2 = p / s * sum over shared features of (r_j - d_j)^2, with p features, s of them present in
both rows; undefined for s = 0. A receiver's missing feature takes the mean of its k nearest rows that hold it
(ties by donor id), or the column mean when no distance is defined.

Donors lie in the leaves of a tree that is cut along whatever column spreads most in a node. The tree comes from a bounded
sample; it decides only where a donor lies, never what is found. A missing value is filled, for that purpose alone, from the
nearest sampled row. Every leaf keeps the range of each column, which columns some donor lacks and how many one donor lacks at
most; that bounds the distance to everything inside from below.

A receiver visits its own leaf first, then its nearest leaves in rounds of growing size, and stops where the bound
exceeds its k-th distance. Pairs exist only as matrix blocks inside a task; each visit returns at most k donors a feature. Leaves
that outgrow a block, because there is a limit on their number, are cut into blocks by a tree of their own inside the task and searched
the same way. Copies of a donor add nothing beyond the k smallest ids, so they are folded first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions.scalar import present, quoted
from panelkit.session import materialise, settled, sized

#: Donors of a leaf, and of a block that is compared as a whole.
CELL_ROWS = 1024
#: Leaves at most: their ranges travel to every task. With more donors leaves grow and are searched in blocks.
CELLS = 4096
#: Sampled rows a leaf, from which the tree is grown, and sampled rows that fill missing values for placing.
SAMPLED, GUIDES = 16, 1024
#: Successive leaves whose common range is looked at first.
GROUP_CELLS = 64
CHUNK_ROWS = 20_000
BLOCK_CELLS = 4_000_000
#: Each round visits so many times the leaves of the rounds before.
GROWTH = 4
#: Room for rounding when a bound is compared with a distance.
SLACK = 1 + 1e-9


def _vectors(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """``id, v0..`` with NaN turned into NULL."""
    values = []
    for i, c in enumerate(columns):
        v = quoted(c).cast("double")
        values.append(F.when(~F.isnan(v), v).alias(f"v{i}"))
    return df.select(quoted(row_id).alias("id"), *values)


def _by_pattern(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row indices per distinct null pattern."""
    absent = np.isnan(values)
    patterns, inverse = np.unique(absent, axis=0, return_inverse=True)
    inverse = inverse.reshape(-1)
    for g, pattern in enumerate(patterns):
        yield np.flatnonzero(inverse == g), pattern


class Tree:
    """Cuts along single columns; rows with missing values are placed as the nearest guide row would be."""

    def __init__(self, sample: np.ndarray, leaves: int):
        width = sample.shape[1]
        held = ~np.isnan(sample)
        with np.errstate(invalid="ignore"):
            means = np.where(held.any(axis=0), np.nansum(sample, axis=0) / np.maximum(held.sum(axis=0), 1), 0.0)
        whole = np.flatnonzero(held.all(axis=1))
        chosen = whole if len(whole) >= min(64, len(sample)) else np.arange(len(sample))
        self.guides = np.where(held[chosen], sample[chosen], means)[:GUIDES]
        if not len(self.guides):
            self.guides = means[None, :]
        self.column, self.cut, self.left, self.right = [-1], [0.0], [0], [0]
        self.leaf = [0]
        filled = self.fill(sample)
        waiting = [(0, np.arange(len(filled)), max(0, math.ceil(math.log2(max(1, leaves)))))]
        self.leaves = 0
        while waiting:
            node, rows, depth = waiting.pop()
            spread = filled[rows].std(axis=0) if len(rows) > 1 else np.zeros(width)
            split = self._split(filled[rows, int(spread.argmax())]) if depth and spread.max(initial=0.0) > 0 else None
            if split is None:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            axis = int(spread.argmax())
            below = filled[rows, axis] <= split
            children = []
            for part in (rows[below], rows[~below]):
                children.append(len(self.column))
                self.column.append(-1)
                self.cut.append(0.0)
                self.left.append(0)
                self.right.append(0)
                self.leaf.append(0)
                waiting.append((children[-1], part, depth - 1))
            self.column[node], self.cut[node], (self.left[node], self.right[node]) = axis, split, children
        for name in ("column", "cut", "left", "right", "leaf"):
            setattr(self, name, np.array(getattr(self, name)))

    @staticmethod
    def _split(values: np.ndarray) -> float | None:
        cut = float(np.median(values))
        if cut >= values.max():
            below = values[values < values.max()]
            return float(below.max()) if len(below) else None
        return cut

    def fill(self, matrix: np.ndarray) -> np.ndarray:
        """Missing values from the guide row that is nearest in the others."""
        filled = matrix.copy()
        for index, missing in _by_pattern(matrix):
            if not missing.any():
                continue
            shared = np.flatnonzero(~missing)
            step = max(1, BLOCK_CELLS // len(self.guides))
            for start in range(0, len(index), step):
                part = index[start : start + step]
                squares = np.zeros((len(part), len(self.guides)))
                for j in shared:
                    squares += (matrix[part, j][:, None] - self.guides[:, j]) ** 2
                nearest = squares.argmin(axis=1)
                filled[np.ix_(part, np.flatnonzero(missing))] = self.guides[np.ix_(nearest, np.flatnonzero(missing))]
        return filled

    def place(self, matrix: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        filled, node, every = self.fill(matrix), np.zeros(len(matrix), np.int64), np.arange(len(matrix))
        while True:
            inner = self.column[node] >= 0
            if not inner.any():
                return self.leaf[node]
            below = filled[every, np.maximum(self.column[node], 0)] <= self.cut[node]
            node = np.where(inner, np.where(below, self.left[node], self.right[node]), node)


class Boxes:
    """Ranges of cells: ``low, high`` of each column, ``holds`` (some donor has it), ``lacks`` (some has not), ``lost`` (most that one lacks)."""

    def __init__(self, names: np.ndarray, low: np.ndarray, high: np.ndarray, holds: np.ndarray, lacks: np.ndarray, lost: np.ndarray):
        self.names, self.low, self.high, self.holds, self.lacks, self.lost = names, low, high, holds, lacks, lost
        self.width = low.shape[1]

    @classmethod
    def of(cls, donors: np.ndarray, cell: np.ndarray) -> Boxes:
        """The ranges of rows that lie in the cells 0, 1, ..."""
        count = int(cell.max()) + 1
        shape, have = (count, donors.shape[1]), ~np.isnan(donors)
        low, high = np.full(shape, np.inf), np.full(shape, -np.inf)
        np.minimum.at(low, cell, np.where(have, donors, np.inf))
        np.maximum.at(high, cell, np.where(have, donors, -np.inf))
        holds, lacks, lost = np.zeros(shape, bool), np.zeros(shape, bool), np.zeros(count, np.int64)
        np.logical_or.at(holds, cell, have)
        np.logical_or.at(lacks, cell, ~have)
        np.maximum.at(lost, cell, (~have).sum(axis=1))
        return cls(np.arange(count), low, high, holds, lacks, lost)

    @classmethod
    def read(cls, placed: DataFrame, width: int) -> Boxes:
        """One row a cell reaches the driver, at most a few times ``CELLS``."""
        names = [f"v{i}" for i in range(width)]
        nulls = sum((F.col(n).isNull().cast("int") for n in names), F.lit(0))
        rows = placed.groupBy("cell").agg(
            F.count(F.lit(1)).alias("rows"), F.max(nulls).alias("lost"),
            *[f(n).alias(f"{label}{i}") for i, n in enumerate(names) for label, f in (("lo", F.min), ("hi", F.max), ("has", F.count))],
        ).orderBy("cell").collect()
        table = lambda label, empty: np.array(
            [[empty if r[f"{label}{i}"] is None else r[f"{label}{i}"] for i in range(width)] for r in rows], float).reshape(len(rows), width)
        has, total = table("has", 0), np.array([r["rows"] for r in rows], float).reshape(-1, 1)
        return cls(np.array([r["cell"] for r in rows], np.int64), table("lo", np.inf), table("hi", -np.inf), has > 0, has < total,
                   np.array([r["lost"] for r in rows], np.int64))

    def part(self, chosen: np.ndarray) -> Boxes:
        return Boxes(self.names[chosen], self.low[chosen], self.high[chosen], self.holds[chosen], self.lacks[chosen], self.lost[chosen])

    def grouped(self, size: int) -> Boxes:
        """The ranges of so many successive cells together; cells are numbered along the tree, so that these lie side by side."""
        starts = np.arange(0, len(self.names), size)
        if not len(starts):
            return self
        joined = lambda f, values: f.reduceat(values, starts, axis=0)
        return Boxes(starts // size, joined(np.minimum, self.low), joined(np.maximum, self.high), joined(np.logical_or, self.holds),
                     joined(np.logical_or, self.lacks), joined(np.maximum, self.lost))

    def bounds(self, vectors: np.ndarray, observed: np.ndarray) -> np.ndarray:
        """Lower bound of the squared distance, receivers x cells; infinite where no feature can be shared.

        All receivers share one pattern ``observed``. A donor that lacks t of the observed features loses t gaps, at worst the largest
        among those that some donor of the cell lacks.
        """
        axes = np.flatnonzero(observed)
        total = np.zeros((len(vectors), len(self.names)))
        lossy = np.flatnonzero((self.lost > 0) & self.lacks[:, axes].any(axis=1))
        gaps = np.zeros((len(vectors), len(lossy), len(axes)))
        for n, j in enumerate(axes):
            x = vectors[:, j][:, None]
            gap = np.maximum(0.0, np.maximum(self.low[:, j] - x, x - self.high[:, j]))
            square = np.where(self.holds[:, j], gap * gap, 0.0)
            total += square
            gaps[:, :, n] = np.where(self.lacks[lossy, j], square[:, lossy], 0.0)
        best = total * (self.width / max(1, len(axes)))
        most = int(min(self.lost[lossy].max(initial=0), len(axes) - 1))
        if most > 0:
            gaps.sort(axis=2)
            dropped = np.zeros((len(vectors), len(lossy)))
            for t in range(1, most + 1):
                dropped += gaps[:, :, -t]
                left = np.maximum(total[:, lossy] - dropped, 0.0) * (self.width / (len(axes) - t))
                possible = self.lost[lossy] >= t
                best[:, lossy] = np.where(possible, np.minimum(best[:, lossy], left), best[:, lossy])
        return np.where(self.holds[:, axes].any(axis=1), best, np.inf)


def _fold_copies(donors: DataFrame, width: int, k: int) -> DataFrame:
    """Keep the k smallest ids of equal vectors; the limit is applied before the shuffle as well."""
    same = Window.partitionBy(*[f"v{i}" for i in range(width)]).orderBy("id")
    return donors.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k).drop("copy")


def _grown(donors: DataFrame, width: int, cell_rows: int) -> tuple[Tree, int]:
    """A tree from a bounded sample, and the donors a leaf should hold."""
    rows = donors.count()
    size = max(cell_rows, math.ceil(rows / CELLS))
    wanted = min(rows, max(GUIDES, SAMPLED * math.ceil(rows / size)))
    share = min(1.0, 1.2 * wanted / max(1, rows))
    chosen = donors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(wanted)
    sample = chosen.orderBy("id").drop("id").toPandas().to_numpy(dtype=float).reshape(-1, width)
    return Tree(sample, math.ceil(rows / size)), size


def _placed(df: DataFrame, tree: Tree, width: int, name: str) -> DataFrame:
    """``df`` with the leaf of every row."""
    values = [f"v{i}" for i in range(width)]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{name: tree.place(batch[values].to_numpy(dtype=float)).astype("int64")})

    return df.mapInPandas(place, f"{df._jdf.schema().toDDL()}, {name} long")


def _with_cells(donors: DataFrame, tree: Tree, width: int, size: int, k: int) -> DataFrame:
    """Donors without surplus copies in cells: a leaf of many times its size is cut by a hash of the id."""
    placed = materialise(_fold_copies(_placed(donors, tree, width, "leaf"), width, k), "knn-donors")
    pieces = placed.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / F.lit(16 * size)).cast("long").alias("pieces"))
    crowd = sized(pieces.where("pieces > 1"), "knn-crowd")  # at most one row a leaf
    piece = F.coalesce(F.pmod(F.xxhash64("id"), F.col("pieces")), F.lit(0).cast("long"))
    return placed.join(crowd, "leaf", "left").withColumn("cell", F.col("leaf") + piece * F.lit(CELLS * 2)).drop("leaf", "pieces")


def _visits(boxes: Boxes, width: int, start: int, end: int):
    """mapInPandas function: the visits of receivers to their nearest cells, from the ``start``-th to before the ``end``-th.

    A receiver's own leaf is its nearest cell and the first to visit. ``more`` says that cells beyond may have to be visited; a receiver with none in
    this round and some beyond has one row without a cell. Cells stand in the order of the larger of their bound and their group's, so that the
    cells of groups beyond a receiver's reach need not be looked at: none of them comes before one within it.
    """
    values, limits = [f"v{i}" for i in range(width)], [f"u{i}" for i in range(width)]
    step = max(1, BLOCK_CELLS // max(1, len(boxes.names) * width))
    groups = boxes.grouped(GROUP_CELLS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            matrix, homes, kth = batch[values].to_numpy(dtype=float), batch["home"].to_numpy(), batch[limits].to_numpy(dtype=float)
            for index, missing in _by_pattern(matrix):
                useful = boxes.holds[:, missing].any(axis=1)
                if not start:
                    place = np.minimum(np.searchsorted(boxes.names, homes[index]), len(boxes.names) - 1)
                    at_home = useful[place] & (boxes.names[place] == homes[index])
                    yield batch.iloc[index][["id", *values, *limits]].assign(cell=np.where(at_home, homes[index], -1), more=True)
                    continue
                lacking = np.flatnonzero(missing)
                limit = np.where(np.isnan(kth[index][:, lacking]), np.inf, kth[index][:, lacking]) * SLACK
                reach = limit.max(axis=1, initial=0.0)
                # receivers of a block lie side by side; those without a limit look at all cells
                order = np.lexsort((homes[index], np.isinf(reach)))
                index, limit, reach = index[order], limit[order], reach[order]
                side = np.column_stack([homes[index] // GROUP_CELLS, np.isinf(reach)])
                starts = np.flatnonzero(np.append(True, (side[1:] != side[:-1]).any(axis=1)))
                blocks = [slice(k, min(k + step, stop)) for first, stop in zip(starts, np.append(starts[1:], len(index))) for k in range(first, stop, step)]
                for block in blocks:
                    part = index[block]
                    coarse = groups.bounds(matrix[part], ~missing)
                    near = (coarse <= reach[block, None]).any(axis=0)
                    chosen = np.flatnonzero(useful & np.repeat(near, GROUP_CELLS)[: len(useful)])
                    bounds = np.maximum(boxes.part(chosen).bounds(matrix[part], ~missing), coarse[:, chosen // GROUP_CELLS])
                    within = np.isfinite(bounds) & (bounds <= reach[block, None]) & (boxes.names[chosen] != homes[part][:, None])
                    rows, places = np.nonzero(within)
                    distance = bounds[rows, places]
                    order = np.lexsort((places, distance, rows))
                    rows, places, distance = rows[order], places[order], distance[order]
                    # The receiver's own leaf, which the first round has seen, has place 0.
                    place = 1 + np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
                    wanted = (boxes.holds[chosen[places]][:, lacking] & (distance[:, None] <= limit[block][rows])).any(axis=1)
                    more, now = np.zeros(len(part), bool), np.zeros(len(part), bool)
                    more[rows[wanted & (place >= end)]] = True
                    hit = wanted & (place >= start) & (place < end)
                    rows, cells = rows[hit], boxes.names[chosen[places[hit]]]
                    now[rows] = True
                    idle = np.flatnonzero(more & ~now)
                    rows, cells = np.concatenate([rows, idle]), np.concatenate([cells, np.full(len(idle), -1)])
                    yield batch.iloc[part[rows]][["id", *values, *limits]].assign(cell=cells, more=more[rows])

    return run


def _compare(matrix: np.ndarray, missing: np.ndarray, given: np.ndarray, names: np.ndarray, kth: np.ndarray, k: int) -> list[tuple]:
    """For receivers of one pattern and a block of donors in the order of ids: (feature, receivers, donors, squares, values), k a feature and receiver.

    ``kth`` (receivers x features) has distances beyond which nothing is wanted.
    """
    observed, have = np.flatnonzero(~missing), ~np.isnan(given)
    shared = have[:, observed].sum(axis=1)
    squares = np.zeros((len(matrix), len(names)))
    for j in observed:
        gap = matrix[:, j][:, None] - given[:, j][None, :]
        squares += np.where(have[:, j], gap * gap, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        squares = np.where(shared > 0, matrix.shape[1] / shared * squares, np.inf)
    found = []
    for f in np.flatnonzero(missing):
        usable = np.flatnonzero(have[:, f] & (shared > 0))
        if not len(usable):
            continue
        sub = squares[:, usable]
        count = min(k, len(usable))
        # donors are in the order of ids, so that the smaller id comes first among equal distances
        last = np.minimum(np.partition(sub, count - 1, axis=1)[:, count - 1], kth[:, f] * SLACK)
        rows, places = np.nonzero(sub <= last[:, None])
        order = np.lexsort((places, sub[rows, places], rows))
        rows, places = rows[order], places[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < count
        rows, places = rows[keep], places[keep]
        found.append((f, rows, names[usable][places], sub[rows, places], given[usable, f][places]))
    return found


def _nearest(width: int, k: int, block_rows: int):
    """Cogrouped function: receivers of a chunk against the donors of a cell, block by block where the cell is large."""
    values, limits = [f"v{i}" for i in range(width)], [f"u{i}" for i in range(width)]
    empty = pd.DataFrame({"id": [], "feature": [], "donor": [], "squared": [], "value": []})

    def run(receivers: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
        if receivers.empty or donors.empty:
            return empty
        donors = donors.sort_values("id")
        names, given = donors["id"].to_numpy(), donors[values].to_numpy(dtype=float)
        matrix, ids, kth = receivers[values].to_numpy(dtype=float), receivers["id"].to_numpy(), receivers[limits].to_numpy(dtype=float)
        kth = np.where(np.isnan(kth), np.inf, kth)
        blocks, boxes = [np.arange(len(names))], None
        if len(names) > 2 * block_rows:
            own = Tree(given[:: max(1, len(given) // 65_536)], math.ceil(len(names) / block_rows)).place(given)
            own = np.unique(own, return_inverse=True)[1]
            blocks = [np.flatnonzero(own == b) for b in range(own.max() + 1)]
            boxes = Boxes.of(given, own)
        step = max(1, BLOCK_CELLS // max(1, max(map(len, blocks)), len(blocks) * width))
        found = []
        for index, missing in _by_pattern(matrix):
            for start in range(0, len(index), step):
                part = index[start : start + step]
                reach = kth[part]
                bounds = boxes.bounds(matrix[part], ~missing) if boxes else np.zeros((len(part), 1))
                first = bounds.argmin(axis=1)
                lacking = np.flatnonzero(missing)
                for nearest in (True, False):
                    for b in range(bounds.shape[1]):
                        near = (bounds[:, b][:, None] <= reach[:, lacking] * SLACK).any(axis=1) & np.isfinite(bounds[:, b])
                        rows = np.flatnonzero(near & ((first == b) == nearest))
                        if not len(rows):
                            continue
                        for f, hit, donor, squared, value in _compare(matrix[part[rows]], missing, given[blocks[b]], names[blocks[b]], reach[rows], k):
                            found.append(pd.DataFrame({"id": ids[part[rows[hit]]], "feature": int(f), "donor": donor, "squared": squared, "value": value}))
                            if nearest and len(hit):
                                # the k-th of one block bounds what other blocks can add
                                count = np.bincount(hit, minlength=len(rows))
                                worst = np.zeros(len(rows))
                                np.maximum.at(worst, hit, squared)
                                full = count == k
                                reach[rows[full], f] = np.minimum(reach[rows[full], f], worst[full])
        return pd.concat(found, ignore_index=True) if found else empty

    return run


def _search(visits: DataFrame, placed: DataFrame, width: int, k: int, cell_rows: int, chunk_rows: int) -> DataFrame:
    """Run the visits cell by cell; crowded cells are cut into receiver chunks with a copy of the donors each."""
    kinds = [d.schema["id"].dataType.simpleString() for d in (visits, placed)]
    candidates = f"id {kinds[0]}, feature int, donor {kinds[1]}, squared double, value double"
    loads = visits.groupBy("cell").count().select(
        "cell", F.ceil(F.col("count") / F.lit(chunk_rows)).cast("int").alias("chunks")
    )
    loads = sized(loads, "knn-loads")  # one row per cell
    left = visits.join(loads, "cell").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    right = placed.join(loads, "cell").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1))
    )
    return left.drop("chunks").groupBy("cell", "chunk").cogroup(
        right.drop("chunks").groupBy("cell", "chunk")
    ).applyInPandas(_nearest(width, k, cell_rows), candidates)


def nearest_donors(
    df: DataFrame,
    row_id: str,
    columns: Sequence[str],
    k: int = 5,
    fit_on: DataFrame | None = None,
    cell_rows: int = CELL_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    visited: list[int] | None = None,
) -> DataFrame:
    """``row_id, feature, donor, rank, distance, value``: the k nearest donors of every missing cell.

    ``visited``, when given, receives the number of visits of each round.
    """
    columns, width = list(columns), len(columns)
    if fit_on is None:
        df = settled(df.select(quoted(row_id), *[quoted(c) for c in columns]), "knn-input")
    vectors = _vectors(df, row_id, columns)
    lacking = [F.col(f"v{i}").isNull() for i in range(width)]
    any_missing = lacking[0]
    all_missing = lacking[0]
    for c in lacking[1:]:
        any_missing, all_missing = any_missing | c, all_missing & c
    donors = _vectors(df if fit_on is None else fit_on, row_id, columns).where(~all_missing)
    tree, size = _grown(donors, width, cell_rows)
    placed = _with_cells(donors, tree, width, size, k)
    boxes = Boxes.read(placed, width)
    receivers = materialise(_placed(vectors.where(any_missing), tree, width, "home"), "knn-receivers")

    kind = receivers.schema["id"].dataType.simpleString()
    visit_schema = ", ".join([f"id {kind}", *[f"v{i} double" for i in range(width)], *[f"u{i} double" for i in range(width)], "cell long, more boolean"])
    ranked = Window.partitionBy("id", "feature").orderBy("squared", "donor")
    best, visits, start, end = None, None, 0, 1
    while best is None or start <= len(boxes.names):
        if best is None:
            asking = receivers.withColumns({f"u{i}": F.lit(None).cast("double") for i in range(width)})
        else:
            last = best.where(F.col("rank") == k).groupBy("id").agg(*[F.max(F.when(F.col("feature") == i, F.col("squared"))).alias(f"u{i}") for i in range(width)])
            asking = receivers.join(visits.where("more").select("id").distinct(), "id", "left_semi").join(last, "id", "left")
        visits = materialise(asking.mapInPandas(_visits(boxes, width, start, end), visit_schema), "knn-visits")
        if visited is not None:
            visited.append(visits.where("cell >= 0").count())
        found = _search(visits.where("cell >= 0").drop("more"), placed, width, k, cell_rows, chunk_rows)
        found = found if best is None else best.drop("rank").unionByName(found)
        best = materialise(found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k), "knn-best")
        if visits.where("more").isEmpty():
            break
        start, end = end, end * (GROWTH + 1)
    labels = F.array(*[F.lit(c) for c in columns])
    return best.select(
        F.col("id").alias(row_id), F.get(labels, F.col("feature")).alias("feature"), "donor", "rank", F.sqrt("squared").alias("distance"), "value")


def knn_impute(
    df: DataFrame, row_id: str, columns: Sequence[str], k: int = 5, fit_on: DataFrame | None = None,
    scale: bool = False, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Fill missing features with the mean of the k nearest donors, else with the column mean.

    ``scale`` divides the features by their deviation for the search only.
    """
    columns = list(columns)
    if fit_on is None:
        df = settled(df, "knn-input")
    base = df if fit_on is None else fit_on
    search, search_fit = df, fit_on
    deviations: dict[str, float] = {}
    if scale:
        row = base.agg(*[F.stddev_pop(present(base, c)).alias(f"s{i}") for i, c in enumerate(columns)]).first()
        deviations = {c: row[i] or 1.0 for i, c in enumerate(columns)}
        change = {c: quoted(c) / F.lit(s) for c, s in deviations.items()}
        search = df.withColumns(change)
        search_fit = fit_on.withColumns(change) if fit_on is not None else None
    found = nearest_donors(search, row_id, columns, k, search_fit, cell_rows)
    means = base.agg(*[F.avg(present(base, c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    filled = found.groupBy(row_id).agg(
        *[F.avg(F.when(F.col("feature") == c, F.col("value") * F.lit(deviations.get(c, 1.0)))).alias(f"fill{i}")
          for i, c in enumerate(columns)]
    )
    joined = df.join(filled, row_id, "left")
    result = {
        c: F.coalesce(present(df, c).cast("double"), F.col(f"fill{i}"), F.lit(means[i]).cast("double"))
        for i, c in enumerate(columns)
    }
    return joined.withColumns(result).select(*[quoted(c) for c in df.columns])
