"""Batched histogram trees: many ensembles, boosted or of independent trees, trained in the same Spark jobs.

Rows are binned once and packed into blocks of NumPy arrays. A *model* is one ensemble: a bootstrap replicate, a
fold, a segment or a grid point. Every block carries one weight per model, so all models share each pass: a level
costs one job for one model or for a hundred. A job sums the gradient histograms of the open nodes per (model, node)
and returns one best split each; the trees, not the rows, reach the driver. Published formulas: gain
1/2 [T(GL)^2/(HL+l) + T(GR)^2/(HR+l) - T(G)^2/(H+l)] with the L1 soft threshold T, leaf value -T(G)/(H+l).

Missing values have a bin of their own; each cut tries them on both sides and keeps the better one. Of two siblings only the lighter is
counted, the other is what remains of the parent.

Models whose own rows are bounded are trained whole by one task each, which gets those rows by a shuffle; beyond that, models grow level by
level in shared jobs. Both ways count the same numbers and give the same trees. Independent trees beyond that grow their top in shared jobs;
a node with few enough rows gets them by a shuffle, and one task grows what is below it. Trees of forests stay in the shared folder where they
are large; rows meet them there by a shuffle, and neither passes the driver.

Gradients are summed as scaled integers, so a result does not depend on partitioning or merge order. A finished
tree is folded into the margins by the next tree's first job, which caches the new blocks as it goes. The first
blocks lie in the shared folder and the lineage is checkpointed, so lost executors cost a recomputation and nothing
else.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel, TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from panelkit.functions.scalar import quoted
from panelkit.session import materialise, settled, work_folder
from panelkit.sources.tables import _exists

BLOCK_ROWS = 65_536
#: Packed rows of a model up to so many bytes are trained on by one task.
ALONE_BYTES = 64 << 20
#: The same for boosted models: a job for each level of each tree costs more than the cores that wait meanwhile.
BATCH_BYTES, BATCH_MODELS = 256 << 20, 1
#: Rows, as a power of two, whose gradients add up exactly.
EXACT_BITS = 21
#: Rows of a boosted model that are worked on together.
PIECE_ROWS = 1 << 16
#: Trees of a forest that one task grows.
FOREST_UNIT = 5
#: Nodes of independent trees up to which they come to the driver; more stay in the shared folder.
DRIVER_NODES = 1 << 19
#: Rows of a node up to which one task grows what is below it, where a model has more rows than a task takes.
NODE_ROWS = 1 << 19
#: Units of such trees that grow in the same jobs.
UNITS_AT_ONCE = 40
#: Rows that one task scores with the trees of a unit; the trees travel once for each so many rows.
SCORE_ROWS = 1 << 23
CHECKPOINT_EVERY = 25
MOST_WEIGHT = 65_535
#: Leaves that the bits of a word stand for, and a number whose six highest bits tell which bit it was multiplied by.
WORD_LEAVES, BIT_NAMES = 64, np.uint64(0x03F79D71B4CB0A89)
#: Rows from which it pays to make a tree's tables of leaves.
TABLE_ROWS = 2048
#: Cells of a table of sums, for each row, up to which rows are not sorted.
DENSE_CELLS = 8


@dataclass(frozen=True)
class BoostParams:
    """Settings of one ensemble; ``num_leaves`` switches from depth-wise to best-first growth."""

    n_estimators: int = 100
    learning_rate: float = 0.1
    max_depth: int = 5
    num_leaves: int | None = None
    min_child_weight: float = 1.0
    min_child_samples: int = 1
    min_samples_split: int = 2
    gamma: float = 0.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    seed: int = 42
    importance: str = "total_gain"
    #: Independent trees over bootstrap draws (or one tree over all rows) instead of boosted ones; each looks at ``max_features`` a node.
    forest: bool = False
    bootstrap: bool = False
    max_features: str = "all"

    def drawn(self, width: int) -> int:
        """Features a node looks at: all, the square root or binary logarithm of their number, a share or a number."""
        named = {"all": width, "sqrt": math.sqrt(width), "log2": math.log2(max(2, width))}
        value = named[self.max_features] if self.max_features in named else float(self.max_features)
        return max(1, min(width, int(value * width if "." in self.max_features else value)))

    @property
    def smallest(self) -> float:
        return max(self.min_child_weight, float(self.min_child_samples))

    @property
    def depth_limit(self) -> float:
        if self.max_depth > 0:
            return self.max_depth
        return self.num_leaves - 1 if self.num_leaves else math.inf  # no chain of splits is longer than the leaves allow


class _Tree:
    """A growing tree as parallel lists; node 0 is the root, feature -1 marks a leaf, ``low`` says where missing values go."""

    FIELDS = ("feature", "bin", "left", "right", "value", "gain", "depth", "parent", "low")

    def __init__(self):
        self.feature, self.bin, self.left, self.right = [-1], [0], [-1], [-1]
        self.value, self.gain, self.depth, self.parent, self.low = [0.0], [0.0], [0], [-1], [True]
        self.best: dict[int, tuple] = {}

    @classmethod
    def of(cls, columns: Sequence) -> _Tree:
        """A tree of its ``FIELDS``."""
        tree = cls()
        for name, column in zip(cls.FIELDS, columns):
            setattr(tree, name, column)
        return tree

    def split(self, node: int, found: tuple) -> tuple[int, int]:
        gain, feature, cut, low_value, high_value, low, *_ = found
        children = []
        for value in (low_value, high_value):
            self.feature.append(-1), self.bin.append(0), self.left.append(-1), self.right.append(-1)
            self.value.append(value), self.gain.append(0.0), self.low.append(True)
            self.depth.append(self.depth[node] + 1), self.parent.append(node)
            children.append(len(self.feature) - 1)
        self.feature[node], self.bin[node], self.gain[node], self.low[node] = feature, cut, gain, low
        self.left[node], self.right[node] = children
        return children[0], children[1]

    def lighter(self, node: int) -> tuple[int, int]:
        """The children of a split node, the one of less weight first."""
        *_, low_weight, high_weight = self.best[node]
        pair = (self.left[node], self.right[node])
        return pair if low_weight <= high_weight else pair[::-1]

    def close(self, node: int) -> None:
        self.feature[node], self.left[node], self.right[node], self.gain[node] = -1, -1, -1, 0.0

    def packed(self) -> tuple[np.ndarray, ...]:
        return (np.array(self.feature, np.int32), np.array(self.bin, np.int32), np.array(self.left, np.int32),
                np.array(self.right, np.int32), np.array(self.value), int(np.max(self.depth)), np.array(self.low, bool))


def _goes_low(x: np.ndarray, cut: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether rows with bins ``x`` (0: missing, else the value's bin and one) go to the low side."""
    return (x <= cut + 1) & ((x > 0) | low)


def _leaf_tables(tree: tuple) -> tuple[list[tuple[int, np.ndarray]], np.ndarray] | None:
    """For each feature that the tree asks, the leaves that a row can still reach given its bin, as bits from the low side on (QuickScorer).

    The lowest bit that all of a row's bins leave is its leaf; the second table gives its node. None: more leaves than a word has bits.
    """
    feature, cut, left, right, _, _, low = tree
    if (feature < 0).sum() > WORD_LEAVES:
        return None
    leaves, spans, waiting = [], {}, [(0, False)]
    while waiting:
        node, seen = waiting.pop()
        if feature[node] < 0:
            spans[node] = (len(leaves), len(leaves) + 1)
            leaves.append(node)
        elif seen:
            spans[node] = (spans[left[node]][0], spans[right[node]][1])
        else:
            waiting += [(node, True), (right[node], False), (left[node], False)]
    every = (1 << WORD_LEAVES) - 1
    tables: dict[int, np.ndarray] = {}
    for node in spans:
        if feature[node] >= 0:
            # the last cell stands for all bins beyond the cuts
            table = tables.setdefault(int(feature[node]), np.full(int(cut.max()) + 3, every, np.uint64))
            first, end = spans[left[node]]
            kept = np.uint64(every ^ ((1 << end) - (1 << first)))
            table[int(cut[node]) + 2 :] &= kept
            if not low[node]:
                table[0] &= kept
    nodes = np.zeros(WORD_LEAVES, np.int32)
    for bit, node in enumerate(leaves):
        nodes[(int(BIT_NAMES) << bit) % (1 << 64) >> 58] = node
    return list(tables.items()), nodes


def _descend(bins: np.ndarray, tree: tuple, tables: tuple | None = None, codes: np.ndarray | None = None) -> np.ndarray:
    """Node of every row; ``tables``, ``codes``: those of the tree, where they are known."""
    if tables is None and codes is None and len(bins) >= TABLE_ROWS:
        tables = _leaf_tables(tree)
    if tables is not None and tables[0]:
        asked, nodes = tables
        reached = None
        for f, table in asked:
            part = table.take(bins[:, f], mode="clip")
            reached = part if reached is None else np.bitwise_and(reached, part, out=reached)
        reached &= ~reached + np.uint64(1)
        reached *= BIT_NAMES
        reached >>= np.uint64(58)
        return nodes.take(reached.view(np.int64))
    feature, cut, left, right, _, depth, low = tree
    code = _node_codes(tree) if codes is None else codes
    flat, row, column = _flat(bins)
    rows = np.arange(len(bins)) * row
    if code is not None:
        node = np.zeros(len(bins), np.int64)
        for _ in range(depth):
            at = code.take(node)
            x = flat.take(rows + (at >> 1 & _CODE_MASK) * column)
            below = (x <= at >> 17 & _CODE_MASK) & ((x > 0) | (at & 1 > 0))
            node = (at >> 33) + ~below
        return node
    node = np.zeros(len(bins), np.int32)
    for _ in range(depth):
        f = feature.take(node)
        inner = f >= 0
        if not inner.any():
            break
        below = _goes_low(flat.take(rows + np.maximum(f, 0) * np.int64(column)), cut.take(node), low.take(node))
        node = np.where(inner, np.where(below, left.take(node), right.take(node)), node)
    return node


#: Bits of a feature and of a cut in a node's code.
_CODE_MASK = (1 << 16) - 1


def _node_codes(tree: tuple) -> np.ndarray | None:
    """A word for each node of a tree whose children stand side by side: low child, last bin that goes there, feature, where missing values go.

    A leaf sends every row back to itself. None: a tree of another form.
    """
    feature, cut, left, right, *_, low = tree
    inner = feature >= 0
    if len(feature) >= 1 << 29 or feature.max() > _CODE_MASK or cut.max() + 1 >= _CODE_MASK or (right[inner] != left[inner] + 1).any():
        return None
    child = np.where(inner, left, np.arange(len(feature))).astype(np.int64)
    last = np.where(inner, cut + 1, _CODE_MASK).astype(np.int64)
    return child << 33 | last << 17 | np.maximum(feature, 0).astype(np.int64) << 1 | (low | ~inner)


def _flat(x: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The cells of a table of rows and columns in one line, and how far apart rows and columns stand in it."""
    if x.flags.f_contiguous and not x.flags.c_contiguous:
        return x.T.reshape(-1), 1, len(x)
    return np.ascontiguousarray(x).reshape(-1), x.shape[1], 1


#: Leaves that half a word stands for, and a number whose five highest bits tell which bit it was multiplied by.
HALF_LEAVES, HALF_NAMES = 32, np.uint32(0x077CB531)


class _Scorer:
    """Sums of the leaves of a model's trees over binned rows. Neighbouring trees of up to ``HALF_LEAVES`` leaves are looked up together."""

    def __init__(self, trees: Sequence[tuple], base: float):
        self.base, self.steps, held = base, [], []
        for tree in trees:
            tables = _leaf_tables(tree)
            held.append((tree, tables))
            small = tables is not None and tables[0] and (tree[0] < 0).sum() <= HALF_LEAVES
            if not small or len(held) == 2:
                self.steps += [self._paired(*held)] if small else [(None, *h) for h in held]
                held = []
        self.steps += [(None, *h) for h in held]

    @staticmethod
    def _paired(*pair: tuple) -> tuple:
        length = max(len(t) for _, (tables, _) in pair for _, t in tables)
        joined: dict[int, np.ndarray] = {}
        for half, (_, (tables, _)) in enumerate(pair):
            for f, table in tables:
                own = joined.setdefault(f, np.full(length, (1 << 64) - 1, np.uint64))
                wide = np.append(table, np.full(length - len(table), table[-1], np.uint64)).astype("<u8")
                own.view("<u4")[half::2] = wide.view("<u4")[0::2]
        values = []
        for tree, (_, nodes) in pair:
            own = np.zeros(HALF_LEAVES)
            for bit in range(HALF_LEAVES):
                own[(int(HALF_NAMES) << bit) % (1 << 32) >> 27] = tree[4][nodes[(int(BIT_NAMES) << bit) % (1 << 64) >> 58]]
            values.append(own)
        return list(joined.items()), *values

    def __call__(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for start in range(0, len(bins), PIECE_ROWS):
            self._add(bins[start : start + PIECE_ROWS], out[start : start + PIECE_ROWS])
        return out

    def _add(self, bins: np.ndarray, out: np.ndarray) -> None:
        columns = [bins[:, f].astype(np.intp) for f in range(bins.shape[1])]
        reached, part = np.empty(len(bins), "<u8"), np.empty(len(bins), "<u8")
        halves = reached.view("<u4")
        for asked, *rest in self.steps:
            if asked is None:
                tree, tables = rest
                out += tree[4].take(_descend(bins, tree, tables))
                continue
            for k, (f, table) in enumerate(asked):
                np.take(table, columns[f], out=part if k else reached, mode="clip")
                if k:
                    reached &= part
            halves &= ~halves + np.uint32(1)
            halves *= HALF_NAMES
            halves >>= np.uint32(27)
            for half, values in enumerate(rest):
                out += values.take(halves[half::2])


def _mix(values: np.ndarray, salt: int) -> np.ndarray:
    """splitmix64 finaliser: uniform [0, 1) from a row hash and a salt."""
    with np.errstate(over="ignore"):
        z = values + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        for shift, rate in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
            z ^= z >> np.uint64(shift)
            if rate is not None:
                z *= np.uint64(rate)
    z >>= np.uint64(11)
    out = z.astype(np.float64)
    out /= 9007199254740992.0
    return out


def _column_mask(width: int, params: BoostParams, tree_no: int) -> np.ndarray:
    """Features of a tree: the share with the smallest hashes of (tree, feature)."""
    if params.colsample_bytree >= 1.0:
        return np.ones(width, bool)
    keep = max(1, int(params.colsample_bytree * width))
    draws = _mix(np.arange(width, dtype=np.uint64), params.seed * 1_000_003 + tree_no + 7)
    mask = np.zeros(width, bool)
    mask[np.argsort(draws, kind="stable")[:keep]] = True
    return mask


def _soft(g: np.ndarray | float, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def best_splits(histograms: np.ndarray, scale: float, params: BoostParams, mask: np.ndarray) -> list[tuple | None]:
    """For each node the best cut ``(gain, feature, bin, low value, high value, missing low, low weight, high weight)``, or None.

    ``histograms``: nodes x features x bins x (scaled gradient, weight) as integers; the first bin has the missing values. Equal gains: the
    first feature, then the lowest bin, then missing values low.
    """
    g = np.cumsum(histograms[..., 0], axis=2)
    h = np.cumsum(histograms[..., 1], axis=2)
    first = int(np.flatnonzero(mask)[0])  # any counted feature has the sums of all rows
    total_g, total_h = g[:, first : first + 1, -1:], h[:, first : first + 1, -1:]
    lam, alpha = params.reg_lambda, params.reg_alpha
    sides = []
    lost = histograms[:, :, :1, 1].any()
    for missing_low in (True, False) if lost else (True,):
        low_g = g[..., :-1] if missing_low else g[..., :-1] - histograms[:, :, :1, 0]
        low_h = h[..., :-1] if missing_low else h[..., :-1] - histograms[:, :, :1, 1]
        high_g, high_h = (total_g - low_g) / scale, (total_h - low_h).astype(float)
        low_g, low_h = low_g / scale, low_h.astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = 0.5 * (
                _soft(low_g, alpha) ** 2 / (low_h + lam) + _soft(high_g, alpha) ** 2 / (high_h + lam)
                - _soft(total_g / scale, alpha) ** 2 / (total_h + lam)
            )
        allowed = (low_h >= params.smallest) & (high_h >= params.smallest) & (low_h > 0) & (high_h > 0) & mask[None, :, None]
        allowed &= total_h >= params.min_samples_split
        sides.append((np.where(allowed & np.isfinite(gain), gain, -np.inf), low_g, low_h, high_g, high_h))
    every = np.stack([s[0] for s in sides], axis=-1).reshape(len(histograms), -1)
    places, rate, found = every.argmax(axis=1), params.learning_rate, []
    for n, place in enumerate(places.tolist()):
        best = every[n, place]
        if not best > 1e-12:
            found.append(None)
            continue
        place, side = divmod(place, len(sides))
        feature, cut = divmod(place, histograms.shape[2] - 1)
        low_g, low_h, high_g, high_h = (a[n, feature, cut] for a in sides[side][1:])
        found.append((
            float(best), int(feature), int(cut) - 1, float(-_soft(low_g, alpha) / (low_h + lam) * rate),
            float(-_soft(high_g, alpha) / (high_h + lam) * rate), side == 0, float(low_h), float(high_h)))
    return found


def _count(x: np.ndarray, slot: np.ndarray, gradient: np.ndarray, weight: np.ndarray, count: int, bins: int, mask: np.ndarray) -> np.ndarray:
    """Histograms (slots x features x bins x 2) of rows that lie in slots."""
    exact = 1 << EXACT_BITS
    if len(x) > exact:
        pieces = [slice(k, k + exact) for k in range(0, len(x), exact)]
        return sum(_count(x[p], slot[p], gradient[p], weight[p], count, bins, mask) for p in pieces)
    part = np.zeros((count, x.shape[1], bins, 2), np.int64)
    start = slot.astype(np.int64) * bins
    for f in np.flatnonzero(mask):
        cell = start + x[:, f]
        part[:, f, :, 0] = np.bincount(cell, weights=gradient, minlength=count * bins).reshape(count, bins)
        part[:, f, :, 1] = np.bincount(cell, weights=weight, minlength=count * bins).reshape(count, bins)
    return part


def _sampled_flags(keys: np.ndarray, setting: BoostParams, tree_no: int) -> np.ndarray:
    return _mix(keys, setting.seed * 100_003 * 10_007 + tree_no) < setting.subsample


def _sampled(keys: np.ndarray, rows: np.ndarray, setting: BoostParams, tree_no: int) -> np.ndarray:
    """The rows that a tree sees, by seed and tree alone: a model does not depend on what else is fitted with it."""
    if setting.subsample >= 1.0 or not len(rows):
        return rows
    return rows.take(np.flatnonzero(_sampled_flags(keys.take(rows), setting, tree_no)))


_POISSON_STEPS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])
#: Counts where a draw begins with these bits, and whether the bits that follow matter.
_POISSON_BITS = 12
_POISSON_COUNTS = np.searchsorted(_POISSON_STEPS, np.arange(1 << _POISSON_BITS) / (1 << _POISSON_BITS), side="right")
_POISSON_OPEN = np.searchsorted(_POISSON_STEPS, np.arange(1, (1 << _POISSON_BITS) + 1) / (1 << _POISSON_BITS), side="left") != _POISSON_COUNTS


def _poisson(uniform: np.ndarray) -> np.ndarray:
    """Bootstrap counts (mean 1) of uniform draws."""
    place = (uniform * (1 << _POISSON_BITS)).astype(np.int64)
    counts = _POISSON_COUNTS.take(place)
    open_ = np.flatnonzero(_POISSON_OPEN.take(place))
    counts[open_] = np.searchsorted(_POISSON_STEPS, uniform.take(open_), side="right")
    return counts


def _cell_cuts(x: np.ndarray, slot: np.ndarray, g: np.ndarray, w: np.ndarray, totals: tuple[np.ndarray, np.ndarray], bins: int, smallest: float):
    """For one feature: (slot, gain, bin, missing low, low sums, low weights), the best cut of each slot that has one.

    Only bins that hold rows take part, so that the work follows the rows and not the number of slots. Weights are whole and above 0.
    """
    key = slot * np.int64(bins)
    key += x
    cells = len(totals[0]) * bins
    if cells <= DENSE_CELLS * len(key):
        cell_w = np.bincount(key, w, cells)
        cell = np.flatnonzero(cell_w)
        cell_g, cell_w = np.bincount(key, g, cells).take(cell), cell_w.take(cell)
    else:
        # keys are sorted with the rows' numbers behind them: many times faster than to ask for the order
        bits = len(key).bit_length()
        key <<= bits
        key |= np.arange(len(key))
        key.sort()
        order = key & ((1 << bits) - 1)
        key >>= bits
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        cell_g, cell_w, cell = np.add.reduceat(g.take(order), starts), np.add.reduceat(w.take(order), starts), key.take(starts)
    at = cell // bins
    bin_ = cell - at * bins
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    sizes = np.diff(np.append(first, len(at)))
    own = at.take(first)

    def inside(c):
        run = np.cumsum(c)
        run -= np.repeat(run.take(first) - c.take(first), sizes)
        return run

    low_g, low_w = inside(cell_g), inside(cell_w)
    slot_g, slot_w = (t.take(own) for t in totals)
    all_g, all_w = np.repeat(slot_g, sizes), np.repeat(slot_w, sizes)
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = np.repeat(slot_g**2 / slot_w, sizes)
    lost = np.flatnonzero(bin_.take(first) == 0)
    best, least = None, max(smallest, 1.0)
    for low in (True, False) if len(lost) else (True,):
        sum_g, sum_w = low_g, low_w
        if not low:
            lost_g, lost_w = np.zeros(len(first)), np.zeros(len(first))
            lost_g[lost], lost_w[lost] = cell_g.take(first.take(lost)), cell_w.take(first.take(lost))
            sum_g, sum_w = low_g - np.repeat(lost_g, sizes), low_w - np.repeat(lost_w, sizes)
        high_w = all_w - sum_w
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = 0.5 * (sum_g**2 / sum_w + (all_g - sum_g) ** 2 / high_w - whole)
        gain[np.flatnonzero((sum_w < least) | (high_w < least))] = -np.inf
        top = np.maximum.reduceat(gain, first)
        hit = np.flatnonzero(gain == np.repeat(top, sizes))
        held = at.take(hit)
        hit = hit.take(np.flatnonzero(np.append(True, held[1:] != held[:-1])))  # the lowest bin of equal gains
        found = [own, top, bin_.take(hit) - 1, np.full(len(own), low), sum_g.take(hit), sum_w.take(hit)]
        if best is None:
            best = found
        else:
            better = found[1] > best[1]
            best = [np.where(better, new, old) for new, old in zip(found, best)]
    return best


def _grow_whole(x: np.ndarray, y: np.ndarray, w: np.ndarray, setting: BoostParams, salt: int, bins: int, scale: float, part: float) -> _Tree:
    """One tree over the rows, level by level; ``y`` in whole units of ``scale``, leaf values are means times ``part``.

    Rows of a node stand together, and rows whose node can't be split are left out.
    """
    width, drawn, tree = x.shape[1], setting.drawn(x.shape[1]), _Tree()
    rows = np.flatnonzero(w > 0)
    x, w = x.take(rows, axis=0), w.take(rows)
    g = y.take(rows) * w
    levels = [{k: np.array(getattr(tree, k)) for k in _Tree.FIELDS}]
    all_g, all_w = np.array([g.sum()]), np.array([w.sum()])
    if len(rows):
        levels[0]["value"][0] = all_g[0] / all_w[0] * (part / scale)
    least = max(setting.min_samples_split, 2 * setting.smallest)
    limit = setting.max_depth if setting.max_depth > 0 else math.inf
    # nodes that may be split, and the first and number of those made with them
    nodes, first, opened = np.flatnonzero(all_w >= least), 0, 1
    slot, depth = np.zeros(len(rows), np.int64), 0
    while len(nodes) and len(slot) and depth < limit:
        made, level = first + opened, levels[-1]
        if drawn < width:
            draws = _mix(((nodes - first + made) * width)[:, None].astype(np.uint64) + np.arange(width, dtype=np.uint64), salt)
            looked = np.ascontiguousarray(np.sort(np.argsort(draws, axis=1, kind="stable")[:, :drawn], axis=1).T)
        gain, feature, cut = np.full(len(nodes), 1e-12 * scale * scale), np.full(len(nodes), -1), np.zeros(len(nodes), np.int64)
        low, low_g, low_w = np.ones(len(nodes), bool), np.zeros(len(nodes)), np.zeros(len(nodes))
        flat, at_row = x.reshape(-1), np.arange(len(slot)) * width
        for k in range(drawn):
            own = looked[k] if drawn < width else k
            cell = at_row + (own.take(slot) if drawn < width else own)
            at, found, *rest = _cell_cuts(flat.take(cell), slot, g, w, (all_g, all_w), bins, setting.smallest)
            better = np.flatnonzero(found > gain.take(at))
            at = at.take(better)
            gain[at], feature[at] = found.take(better), own.take(at) if drawn < width else own
            cut[at], low[at], low_g[at], low_w[at] = (r.take(better) for r in rest)
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            break
        n = len(split)
        own, left = nodes.take(split) - first, made + 2 * np.arange(n)
        level["feature"][own], level["bin"][own], level["gain"][own], level["low"][own] = feature[split], cut[split], gain[split] / scale**2, low[split]
        level["left"][own], level["right"][own] = left, left + 1
        child_g = np.stack([low_g[split], all_g[split] - low_g[split]], axis=1).ravel()
        child_w = np.stack([low_w[split], all_w[split] - low_w[split]], axis=1).ravel()
        levels.append({"feature": np.full(2 * n, -1), "bin": np.zeros(2 * n, np.int64), "left": np.full(2 * n, -1), "right": np.full(2 * n, -1),
                       "value": child_g / child_w * (part / scale), "gain": np.zeros(2 * n), "depth": np.full(2 * n, depth + 1),
                       "parent": np.repeat(nodes.take(split), 2), "low": np.ones(2 * n, bool)})
        depth += 1
        live = np.flatnonzero(child_w >= least)
        if depth >= limit or not len(live):
            break
        places = np.full(2 * n, -1)
        places[live] = np.arange(len(live))
        child = np.full(2 * len(nodes), -1)
        child[2 * split], child[2 * split + 1] = places[0::2], places[1::2]
        value = flat.take(at_row + np.maximum(feature, 0).take(slot))
        below = value <= (cut + 1).astype(np.int32).take(slot)
        if not low[split].all():
            below &= (value > 0) | low.take(slot)
        new = child.take(2 * slot + ~below)
        kept = new >= 0
        order = np.concatenate([np.flatnonzero(below & kept), np.flatnonzero(kept & ~below)])
        slot, x, g, w = new.take(order), x.take(order, axis=0), g.take(order), w.take(order)
        nodes, first, opened = made + live, made, 2 * n
        all_g, all_w = child_g.take(live), child_w.take(live)
    for k in _Tree.FIELDS:
        setattr(tree, k, np.concatenate([level[k] for level in levels]))
    return tree


def _tree_salt(setting: BoostParams, number: int) -> int:
    return (setting.seed * 100_003 + 17) * 10_007 + number


def _drawn_weights(weight: np.ndarray, keys: np.ndarray, setting: BoostParams, number: int) -> np.ndarray:
    """Weights of the rows in one tree of a forest."""
    return weight * _poisson(_mix(keys, _tree_salt(setting, number))) if setting.bootstrap else weight


def _train_forest(block: dict, setting: BoostParams, scale: float, base: float, bins: int, numbers: Sequence[int]) -> list[_Tree]:
    """Some trees of a forest over the rows of a model."""
    scale = scale / 16  # room for bootstrap counts, so that sums stay exact
    x, weight, keys = block["x"], block["w"].astype(float), block["k"]
    y = np.rint((block["y"] - base) * scale)
    out = []
    for number in numbers:
        drawn = _drawn_weights(weight, keys, setting, number)
        out.append(_grow_whole(x, y, drawn, setting, _tree_salt(setting, number) + 1, bins, scale, 1.0 / setting.n_estimators))
    return out


def _tree_rows(block: dict, trees: Sequence[tuple[int, int]], tops: Sequence[tuple], params, columns, base, scale: float, tables: Sequence):
    """For each growing tree its place, the rows of the block that it draws, their node in its top, weights and gradients.

    ``tables``: those of the tops.
    """
    targets: dict[float, np.ndarray] = {}
    weights: dict[int, np.ndarray] = {}
    x = np.asfortranarray(block["x"])
    for place, ((m, number), top) in enumerate(zip(trees, tops)):
        if columns[m] not in weights:
            weights[columns[m]] = block["w"][:, columns[m]].astype(float)
        weight = _drawn_weights(weights[columns[m]], block["k"], params[m], number)
        rows = np.flatnonzero(weight)
        if len(rows):
            if base[m] not in targets:
                targets[base[m]] = np.rint((block["y"] - base[m]) * scale)
            node = _descend(x, top, tables[place]).take(rows) if 2 * len(rows) >= len(weight) else _descend(x.T.take(rows, axis=1).T, top, tables[place])
            yield place, rows, node, weight.take(rows), targets[base[m]].take(rows)


def _node_sums(blocks, waiting: dict[int, dict[int, list[int]]], *growing, bins: int):
    """Sums of one partition for the open nodes: ``(tree, {node: drawn features x (gradient, weight, rows) x bins})``.

    ``waiting``: the features that each open node of a tree looks at.
    """
    found: dict[int, np.ndarray] = {}
    tables, tops = [_leaf_tables(top) for top in growing[1]], growing[1]
    slots, looked = {}, {}
    for place, nodes in waiting.items():
        slots[place] = np.full(len(tops[place][0]), -1)
        slots[place][list(nodes)] = np.arange(len(nodes))
        looked[place] = np.array(list(nodes.values())).T
    for block in blocks:
        flat, row, column = _flat(np.asfortranarray(block["x"]))
        for place, rows, node, weight, target in _tree_rows(block, *growing, tables):
            if place not in waiting:
                continue
            slot = slots[place].take(node)
            inside = np.flatnonzero(slot >= 0)
            if not len(inside):
                continue
            slot, own, w = slot.take(inside), rows.take(inside), weight.take(inside)
            g, cells = target.take(inside) * w, len(waiting[place]) * bins
            sums = np.empty((len(looked[place]), 3, cells), np.int64)
            for k, asked in enumerate(looked[place]):
                cell = slot * bins + flat.take(own * row + asked.take(slot) * column)
                for n, v in enumerate((g, w, None)):
                    sums[k, n] = np.bincount(cell, v, cells)
            found[place] = found[place] + sums if place in found else sums
    for place, sums in found.items():
        parts = sums.reshape(*sums.shape[:2], -1, bins)
        # rows are counted: nodes without any have no sums
        yield place, {n: np.ascontiguousarray(parts[:, :, i]) for i, n in enumerate(waiting[place]) if parts[0, 2, i].any()}


def _both_sums(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    return {n: a[n] + b[n] if n in a and n in b else a.get(n, b.get(n)) for n in {*a, *b}}


def _node_cut(sums: np.ndarray, looked: Sequence[int], setting: BoostParams, scale: float) -> tuple[float, tuple | None]:
    """Mean of a node and its best cut ``(gain, feature, bin, low mean, high mean, missing low, low rows, high rows)``, as ``_grow_whole`` finds it."""
    totals = sums[0, :2].sum(axis=1, dtype=np.int64).astype(float)[:, None]
    (all_g,), (all_w,) = totals
    best, gain = None, 1e-12 * scale * scale
    for f, (g, w, n) in zip(looked, sums if all_w >= setting.min_samples_split else []):
        cells = np.flatnonzero(n)
        _, found, cut, low, low_g, low_w = (c[0] for c in _cell_cuts(
            cells, np.zeros(len(cells), np.int64), g[cells].astype(float), w[cells].astype(float), totals, sums.shape[2], setting.smallest))
        if found > gain:
            gain, rows = found, int(n[1 : cut + 2].sum() + (n[0] if low else 0))
            best = (float(found / scale**2), int(f), int(cut), float(low_g / low_w / scale), float((all_g - low_g) / (all_w - low_w) / scale), bool(low),
                    rows, int(n.sum()) - rows)
    return float(all_g / all_w / scale), best


def _grafted(top: _Tree, below: dict[int, tuple], sums: dict[int, dict], width: int) -> tuple[tuple, dict]:
    """The top of a tree and what was grown below its nodes as one folded tree, and its sums."""
    whole, facts = _folded(top), _tree_sums(top, width)
    depth, parts, roots, size = facts["depth"], [[whole[k]] for k in range(6)], [], len(top.feature)
    for node in sorted(below):
        part = list(below[node])
        part[2] = np.where(part[2] >= 0, part[2] + (size - 1), -1).astype(np.int32)  # its root takes the place of the node
        roots.append((node, [part[k][0] for k in (0, 1, 2, 3, 5)]))
        for k in (0, 1, 2, 3, 5):
            parts[k].append(part[k][1:])
        size += len(part[0]) - 1
        depth = max(depth, top.depth[node] + part[4])
        facts = {"leaves": facts["leaves"] + sums[node]["leaves"] - 1, **{k: facts[k] + sums[node][k] for k in ("gains", "splits")}}
    joined = [np.concatenate(parts[k]) for k in (0, 1, 2, 3, 5)]
    for node, values in roots:
        for column, value in zip(joined, values):
            column[node] = value
    return (*joined[:4], int(depth), joined[4]), {**facts, "depth": int(depth)}


def _level(blocks, open_slots, current, params, tree_no, scale, bins):
    """Histograms of the counted nodes of one partition: ``((model, slot), features x bins x 2)``."""
    found: dict[int, np.ndarray] = {}
    tables = {model: _leaf_tables(tree) for model, tree in current.items()}
    for block in blocks:
        columns = block["x"].T
        for model, slots in open_slots.items():
            weight = block["w"][:, model]
            rows = _sampled(block["k"], np.flatnonzero(weight), params[model], tree_no)
            if not len(rows):
                continue
            # most rows: cheaper to look at all than to pick
            most = 2 * len(rows) >= len(weight)
            node = _descend(block["x"], current[model], tables[model]).take(rows) if most else \
                _descend(columns.take(rows, axis=1).T, current[model], tables[model])
            slot = slots.take(node)
            inside = np.flatnonzero(slot >= 0)
            if not len(inside):
                continue
            rows, slot = rows.take(inside), slot.take(inside)
            weight = weight.take(rows).astype(float)
            gradient = np.rint((block["f"][:, model].take(rows) - block["y"].take(rows)) * scale) * weight
            count, mask = int(slots.max()) + 1, _column_mask(len(columns), params[model], tree_no)
            part = _count(columns.take(rows, axis=1).T, slot, gradient, weight, count, bins, mask)
            if model in found:
                found[model] += part
            else:
                found[model] = part
    return iter(((model, n), piece) for model, part in found.items() for n, piece in enumerate(part))


def _train_alone(block: dict, setting: BoostParams, scale: float, base: float, bins: int) -> list[_Tree]:
    """All trees of one boosted model over its rows; every row keeps its node while a tree grows.

    Rows are worked on in pieces that stay in a core's cache.
    """
    pieces, width = [], block["x"].shape[1]
    for start in range(0, len(block["y"]), PIECE_ROWS):
        cut = slice(start, start + PIECE_ROWS)
        weight = block["w"][cut].astype(float)
        pieces.append({"x": np.asfortranarray(block["x"][cut]), "y": block["y"][cut], "k": block["k"][cut], "w": None if (weight == 1).all() else weight,
                       "f": np.full(len(weight), base)})
    done = []
    roots = None  # weights at the root, where they are the same for all trees
    for number in range(setting.n_estimators):
        mask, tree = _column_mask(width, setting, number), _Tree()
        held = [h for h in (_started(piece, setting, number, scale, mask) for piece in pieces) if h is not None]
        held_counts, pairs, frontier = {}, [(0, None, None)], [0]
        while frontier and held:
            slots = np.full(len(tree.feature), -1, np.int64)
            slots[[p[0] for p in pairs]] = np.arange(len(pairs))
            known = roots if pairs[0][0] == 0 else None
            part = sum(_counted(own, slots, len(pairs), bins, mask, known is None) for own in held)
            if known is not None:
                part[..., 1] = known
            elif pairs[0][0] == 0 and setting.subsample >= 1.0 and mask.all():
                roots = part[..., 1].copy()
            for (light, heavy, parent), piece in zip(pairs, part):
                held_counts[light] = piece
                if heavy is not None:
                    held_counts[heavy] = held_counts[parent] - piece
            for n, found in zip(frontier, best_splits(np.stack([held_counts[n] for n in frontier]), scale, setting, mask)):
                if found is not None:
                    tree.best[n] = found
            ready = _ready(tree, setting, frontier)
            frontier, pairs = _split_all(tree, setting, ready)
            held_counts = {n: c for n, c in held_counts.items() if n in tree.best}
            if frontier:
                packed = tree.packed()
                for own in held:
                    _moved(own, packed)
        _finish(tree, setting)
        done.append(tree)
        if number + 1 < setting.n_estimators:
            packed = tree.packed()
            tables = _leaf_tables(packed)
            for piece in pieces:
                piece["f"] += packed[4].take(_descend(piece["x"], packed, tables))
    return done


def _started(piece: dict, setting: BoostParams, number: int, scale: float, mask: np.ndarray) -> dict | None:
    """The rows of a piece that a tree sees, all at its root."""
    gradient = piece["f"] - piece["y"]
    gradient *= scale
    np.rint(gradient, out=gradient)
    weight = piece["w"]
    if setting.subsample >= 1.0:
        if weight is not None:
            gradient *= weight
        return {"x": piece["x"].T, "g": gradient, "w": weight, "node": np.zeros(len(gradient), np.int64)}
    rows = np.flatnonzero(_sampled_flags(piece["k"], setting, number))
    if not len(rows):
        return None
    gradient = gradient.take(rows)
    if weight is not None:
        weight = piece["w"].take(rows)
        gradient *= weight
    columns = piece["x"].T
    own = np.empty((len(columns), len(rows)), columns.dtype)
    for f in np.flatnonzero(mask):
        np.take(columns[f], rows, out=own[f], mode="clip")
    return {"x": own, "g": gradient, "w": weight, "node": np.zeros(len(rows), np.int64)}


def _counted(own: dict, slots: np.ndarray, count: int, bins: int, mask: np.ndarray, weights: bool = True) -> np.ndarray:
    """``_count`` of the rows of a piece whose node has a slot, on request without the weights."""
    x, gradient, weight = own["x"], own["g"], own["w"]
    slot = slots.take(own["node"])
    inside = np.flatnonzero(slot >= 0)
    some = len(inside) < len(slot)
    if some:
        slot, gradient, weight = slot.take(inside), gradient.take(inside), None if weight is None else weight.take(inside)
    part, cells = np.zeros((count, len(x), bins, 2), np.int64), count * bins
    slot *= bins
    for f in np.flatnonzero(mask):
        cell = slot + (x[f].take(inside) if some else x[f])
        part[:, f, :, 0] = np.bincount(cell, gradient, cells).reshape(count, bins)
        if weights:
            part[:, f, :, 1] = np.bincount(cell, weight, cells).reshape(count, bins)
    return part


def _moved(own: dict, tree: tuple) -> None:
    """Send the rows of nodes just split to the children, which stand side by side; rows of leaves stay."""
    feature, cut, left, _, _, _, low = tree
    node, count = own["node"], len(own["node"])
    inner = feature >= 0
    x = own["x"].reshape(-1).take(np.where(inner, feature * np.int64(count), 0).take(node) + np.arange(count))
    below = x <= np.where(inner, cut + 1, _CODE_MASK).astype(own["x"].dtype).take(node)
    if not low[inner].all():
        below &= (x > 0) | (low | ~inner).take(node)
    own["node"] = np.where(inner, left, np.arange(len(feature))).take(node)
    own["node"] += ~below


def _fold(block: dict, trees: dict[int, tuple]) -> dict:
    """Add one finished tree per model to the margins."""
    margins = block["f"].copy()
    for model, tree in trees.items():
        margins[:, model] += tree[4].take(_descend(block["x"], tree))
    return {**block, "f": margins}


def quantile_edges(df: DataFrame, features: Sequence[str], max_bins: int = 255) -> list[list[float]]:
    """Inner bin edges per feature from one mergeable sketch pass; a row is in bin b when edge[b-1] < x <= edge[b]."""
    steps = [k / max_bins for k in range(1, max_bins)]
    row = df.agg(*[F.percentile_approx(quoted(c).cast("double"), steps, 10_000).alias(f"e{i}") for i, c in enumerate(features)]).first()
    return [sorted(set(row[i] or [])) for i in range(len(features))]


def bin_rows(values: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Bin numbers of raw feature rows, from 1; a missing value has 0."""
    out = np.zeros(values.shape, _kind(edges))
    for j, cuts in enumerate(edges):
        column = values[:, j]
        out[:, j] = np.where(np.isnan(column), 0, np.searchsorted(np.asarray(cuts, float), column, side="left") + 1)
    return out


def _kind(edges: Sequence[Sequence[float]]) -> type:
    return np.uint8 if all(len(e) < 255 for e in edges) else np.uint16


def _pack(features: int, models: int, edges: Sequence[Sequence[float]], block_rows: int, make: Callable | None = None):
    """mapInPandas function: rows to binary blocks of at most ``block_rows``, with sums over each weight and the smallest and largest weight."""
    names = [f"x{i}" for i in range(features)]

    def emit(frame: pd.DataFrame) -> pd.DataFrame:
        x = bin_rows(frame[names].to_numpy(dtype=float), edges)
        if make is not None:
            weights = make([None if k is None or k is pd.NA else k for k in frame["w"]])
        elif models > 1:
            weights = np.concatenate(frame["w"].to_numpy()).reshape(len(frame), -1).astype(np.int64)
        else:
            weights = np.array([w[0] for w in frame["w"]], dtype=np.int64)[:, None]
        y = frame["y"].to_numpy(dtype=float)
        return pd.DataFrame({
            "n": [len(frame)], "x": [x.tobytes()], "y": [y.tobytes()],
            "w": [np.ascontiguousarray(weights.clip(0, MOST_WEIGHT).astype(np.uint16)).tobytes()],
            "k": [frame["k"].to_numpy(dtype=np.int64).astype(np.uint64).tobytes()],
            "lo": [int(weights.min())], "hi": [int(weights.max())], "own": [(weights > 0).sum(axis=0).tobytes()],
            "whole": [weights.sum(axis=0, dtype=np.int64).tobytes()], "sums": [(y @ weights.astype(float)).tobytes()],
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            while len(batch):
                take = batch.iloc[: block_rows - size]
                held.append(take)
                size += len(take)
                batch = batch.iloc[len(take):]
                if size == block_rows:
                    yield emit(pd.concat(held))
                    held, size = [], 0
        if size:
            yield emit(pd.concat(held))

    return run


def _weight_sums(blocks: DataFrame) -> tuple[int, int, list[int], list[int], list[float]]:
    """Smallest and largest weight, and for each weight the rows that have it, its sum and that of the labels times it."""
    kinds = {"own": np.int64, "whole": np.int64, "sums": np.float64}

    def add(rows):
        found = None
        for row in rows:
            part = [row["lo"], row["hi"], *[np.frombuffer(row[k], kind) for k, kind in kinds.items()]]
            found = part if found is None else [min(found[0], part[0]), max(found[1], part[1]), *[a + b for a, b in zip(found[2:], part[2:])]]
        return [] if found is None else [found]

    parts = blocks.select("lo", "hi", *kinds).rdd.mapPartitions(add).collect()
    return min(p[0] for p in parts), max(p[1] for p in parts), *[np.sum([p[k] for p in parts], axis=0).tolist() for k in (2, 3, 4)]


def _folded(tree: _Tree) -> tuple:
    """A tree of ``_grow_whole`` for the shared folder: the children of a node stand side by side, and gains and parents are left out."""
    feature = np.asarray(tree.feature)
    cut = np.asarray(tree.bin, np.int32)  # -1: missing values against all others
    return (feature.astype(np.int8 if feature.max() < 127 else np.int32), cut.astype(np.int16 if cut.max() < 32_767 else np.int32), np.asarray(tree.left, np.int32), np.asarray(tree.value, float),
            int(np.max(tree.depth)), np.asarray(tree.low, bool))


def _opened(tree: tuple) -> tuple:
    """The form that ``_descend`` takes."""
    feature, cut, left, value, depth, low = tree
    return feature, cut.astype(np.int32), left, np.where(left >= 0, left + 1, -1), value, depth, low


def _unfolded(folded: tuple) -> _Tree:
    feature, cut, left, right, value, _, low = _opened(folded)
    inner = np.flatnonzero(feature >= 0)
    parent, depth = np.full(len(feature), -1), np.zeros(len(feature), np.int64)
    parent[left[inner]], parent[right[inner]] = inner, inner
    for node in range(1, len(feature)):
        depth[node] = depth[parent[node]] + 1
    return _Tree.of((feature.astype(np.int64), cut, left, right, value, np.full(len(feature), np.nan), depth, parent, low))


def _tree_sums(tree: _Tree, width: int) -> dict:
    feature = np.asarray(tree.feature)
    inner = feature >= 0
    return {"depth": int(np.max(tree.depth)), "leaves": int((~inner).sum()), "gains": np.bincount(feature[inner], np.asarray(tree.gain)[inner], width),
            "splits": np.bincount(feature[inner], minlength=width)}


def _by_block(records) -> Iterator[tuple[bytes, dict[int, list[np.ndarray]]]]:
    """For each block the values of its rows, and for each model the sums of its units in their order."""
    held: dict[int, list] = {}
    for block, record in records:
        held.setdefault(block, []).append(record)
    for parts in held.values():
        (_, _, values), *sums = sorted(parts, key=lambda p: p[:2])  # the values stand before the units
        found: dict[int, list[np.ndarray]] = {}
        for _, model, part in sums:
            found.setdefault(model, []).append(np.frombuffer(part))
        yield values, found


class BoostedModels:
    """Fitted ensembles over shared bin edges."""

    def __init__(self, features, edges, base, trees, params, stored: DataFrame | None = None, sums: list[list[dict]] | None = None):
        self.features, self.edges, self.base, self.params = list(features), edges, list(base), list(params)
        self._trees: list[list[_Tree]] | None = trees  # per model
        #: Trees too large for the driver: ``model, first, trees`` in the shared folder, a row for each unit.
        self.stored = stored
        self._sums = sums

    @property
    def trees(self) -> list[list[_Tree]]:
        """Trees of each model, which come to the driver if they were stored: for inspection of small forests."""
        if self._trees is not None:
            return self._trees
        out: list[list[_Tree]] = [[] for _ in self.base]
        for row in self.stored.orderBy("model", "first").collect():
            out[row["model"]] += [_unfolded(t) for t in pickle.loads(row["trees"])]
        return out

    @property
    def sums(self) -> list[list[dict]]:
        """For each model the depth, leaves, and gains and splits by feature of its trees."""
        if self._sums is None:
            self._sums = [[_tree_sums(t, len(self.features)) for t in own] for own in self._trees]
        return self._sums

    @property
    def models(self) -> int:
        return len(self.base)

    def part(self, model: int) -> BoostedModels:
        """One of the ensembles alone; for trees in the driver."""
        return BoostedModels(self.features, self.edges, [self.base[model]], [self.trees[model]], [self.params[model]])

    def score_column(self, model: int | Column = 0) -> Column:
        """Prediction of one model, or of the model named by an integer column, from the raw features."""
        edges, base = self.edges, self.base
        wanted = range(self.models) if isinstance(model, Column) else [model]
        packed = {m: [t.packed() for t in self.trees[m]] for m in wanted}
        scorers: dict[int, _Scorer] = {}  # made once in each task

        def evaluate(bins: np.ndarray, m: int) -> np.ndarray:
            if m not in scorers:
                scorers[m] = _Scorer(packed[m], base[m])
            return scorers[m](bins)

        @F.pandas_udf(DoubleType())
        def score(values: pd.DataFrame) -> pd.Series:
            names = [c for c in values.columns if c != "model"]
            bins = bin_rows(values[names].to_numpy(dtype=float), edges)
            if "model" not in values.columns:
                return pd.Series(evaluate(bins, wanted[0]))
            out = np.full(len(values), np.nan)
            chosen = values["model"].to_numpy(dtype=float)
            for m in np.unique(chosen[~np.isnan(chosen)]).astype(int):
                rows = np.flatnonzero(chosen == m)
                out[rows] = evaluate(bins[rows], m)
            return pd.Series(out)

        fields = [quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.features)]
        if isinstance(model, Column):
            fields.append(model.cast("double").alias("model"))
        return score(F.struct(*fields))

    def transform(self, df: DataFrame, model: int | Column = 0, name: str = "prediction") -> DataFrame:
        if self._trees is not None:
            return df.withColumn(name, self.score_column(model))
        number = "_row_number_"
        rows = materialise(df.withColumn(number, F.monotonically_increasing_id()), "rows-to-score")
        chosen = model if isinstance(model, Column) else F.lit(model)
        blocks, unit_sums = self._unit_sums(rows, F.col(number), np.int64, chosen, {m: [m] for m in range(self.models)})
        base = self.base

        def total(records):
            for rows, found in _by_block(records):
                for model, parts in found.items():
                    yield bytearray(rows), bytearray(sum(parts, np.full(len(rows) // 8, base[model])).tobytes())

        numbers = blocks.select("block", "r").rdd.map(lambda b: (b["block"], (-1, -1, bytes(b["r"]))))
        count = max(1, blocks.count())
        found = df.sparkSession.createDataFrame(
            numbers.union(unit_sums).partitionBy(count, lambda b: hash(b) % count).mapPartitions(total), "r binary, p binary")

        def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for r, p in zip(frame["r"], frame["p"]):
                    yield pd.DataFrame({number: np.frombuffer(r, np.int64), name: np.frombuffer(p)})

        scores = materialise(found.mapInPandas(spread, f"`{number}` long, `{name}` double"), "scores")
        return rows.drop(name).join(scores, number, "left").select(*[quoted(c) for c in df.columns if c != name], quoted(name))

    def _unit_sums(self, rows: DataFrame, value: Column, kind: type, tag: Column, serves: dict[int, list[int]]) -> tuple[DataFrame, RDD]:
        """Blocks of binned rows with a ``value`` each, and ``(block, (first, model, sums of the leaves of a unit's trees))`` for each block
        and unit of the models that serve the block's tag.

        A task holds one unit and at most about ``SCORE_ROWS`` rows; both come to it by a shuffle.
        """
        edges, width = self.edges, len(self.features)
        wide = rows.select(value.alias("r"), tag.cast("int").alias("tag"),
                           *[quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.features)]).where(
                               F.col("tag").isin(list(serves)))

        def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, list] = {}
            made = 0

            def emit(tag):
                nonlocal made
                frame = pd.concat(held.pop(tag))
                made += 1
                return pd.DataFrame({
                    "block": [(TaskContext.get().partitionId() << 32) + made], "tag": [tag], "n": [len(frame)], "r": [frame["r"].to_numpy(kind).tobytes()],
                    "x": [bin_rows(frame[[f"x{i}" for i in range(width)]].to_numpy(dtype=float), edges).tobytes()]})

            for frame in frames:
                for tag, part in frame.groupby("tag"):
                    held.setdefault(tag, []).append(part)
                    if sum(map(len, held[tag])) >= BLOCK_ROWS:
                        yield emit(tag)
            for tag in list(held):
                yield emit(tag)

        blocks = materialise(wide.mapInPandas(pack, "block long, tag int, n int, r binary, x binary"), "blocks-to-score")
        units = [(m, n) for m, p in enumerate(self.params) for n in range(0, p.n_estimators, FOREST_UNIT)]
        place = {u: i for i, u in enumerate(units)}
        own = {t: [u for m in models for u in units if u[0] == m] for t, models in serves.items()}
        slices = max(1, math.ceil((blocks.agg(F.sum("n")).first()[0] or 0) / SCORE_ROWS))
        whole = _kind(edges)

        def send_rows(b):
            x = bytes(b["x"])
            return [(place[u] * slices + hash(b["block"]) % slices, (b["block"], x)) for u in own[b["tag"]]]

        def send_trees(t):
            trees = bytes(t["trees"])
            return [(place[t["model"], t["first"]] * slices + k, (-1, trees)) for k in range(slices)]

        def score(index, records):
            m, first = units[index // slices]
            parts = [r for _, r in records]
            trees = [_opened(t) for block, held in parts if block == -1 for t in pickle.loads(held)]
            ways = [(t, _leaf_tables(t), _node_codes(t)) for t in trees]
            for block, held in parts:
                if block != -1:
                    bins = np.frombuffer(held, whole).reshape(-1, width)
                    yield block, (first, m, sum(w[0][4].take(_descend(bins, *w)) for w in ways).tobytes())

        everything = blocks.select("block", "tag", "x").rdd.flatMap(send_rows).union(self.stored.rdd.flatMap(send_trees))
        return blocks, everything.partitionBy(len(units) * slices, int).mapPartitionsWithIndex(score)

    def held_out_errors(self, rows: DataFrame, label: str, fold: str, folds: int) -> list[list[float | None]]:
        """Mean squared error of each fold (null: no rows) for each group of ``folds`` models, of which model ``k`` did not see fold ``k``."""
        groups = len(self.base) // folds
        if self._trees is not None:
            scored = rows
            for i in range(groups):
                scored = self.transform(scored, F.col(fold) + F.lit(i * folds), f"p{i}")
            errors = [F.avg(F.pow(F.col(label) - F.col(f"p{i}"), 2)).alias(f"m{i}") for i in range(groups)]
            found = scored.where(F.col(fold).isNotNull()).groupBy(fold).agg(*errors).collect()
            return [[row[f"m{i}"] for row in found] for i in range(groups)]
        serves = {k: [i * folds + k for i in range(groups)] for k in range(folds)}
        blocks, unit_sums = self._unit_sums(rows.where(quoted(label).isNotNull()), quoted(label).cast("double"), np.float64, F.col(fold), serves)
        base = self.base
        labels = blocks.select("block", "r").rdd.map(lambda b: (b["block"], (-1, -1, bytes(b["r"]))))

        def errors(records):
            for (y, found) in _by_block(records):
                y = np.frombuffer(y)
                for model, parts in found.items():
                    yield model, (float(((y - (sum(parts, np.full(len(y), base[model])))) ** 2).sum()), len(y))

        count = max(1, blocks.count())
        sums: dict[int, list] = {}
        for model, (squares, n) in labels.union(unit_sums).partitionBy(count, lambda b: hash(b) % count).mapPartitions(errors).collect():
            sums.setdefault(model, []).append((squares, n))
        means = {m: math.fsum(s for s, _ in parts) / sum(n for _, n in parts) for m, parts in sums.items()}
        return [[means.get(i * folds + k) for k in range(folds)] for i in range(groups)]

    def importance_rows(self) -> list[tuple[int, str, float]]:
        rows = []
        for m, trees in enumerate(self.sums):
            gains, counts = np.zeros(len(self.features)), np.zeros(len(self.features))
            for tree in trees:
                gains += tree["gains"]
                counts += tree["splits"]
            kind = self.params[m].importance
            score = {"total_gain": gains, "gain": gains / np.maximum(counts, 1), "split": counts}[kind]
            whole = score.sum() or 1.0
            rows += [(m, f, float(s / whole)) for f, s in zip(self.features, score)]
        return rows

    def importances(self, spark) -> DataFrame:
        """``model, feature, importance``, scaled to sum one per model."""
        return spark.createDataFrame(self.importance_rows(), "model int, feature string, importance double")

    def node_rows(self) -> list[tuple]:
        return [
            (m, t, i, *row)
            for m, trees in enumerate(self.trees) for t, tree in enumerate(trees)
            for i, row in enumerate(zip(*[np.asarray(getattr(tree, k)).tolist() for k in _Tree.FIELDS]))
        ]

    NODE_SCHEMA = ("model int, tree int, node int, feature int, bin int, left int, right int, value double, "
                   "gain double, depth int, parent int, low boolean")

    SUM_SCHEMA = "pos int, model int, depth int, leaves long, gains array<double>, splits array<long>"

    def save(self, spark, path: str) -> None:
        if self._trees is None:
            self.stored.write.mode("overwrite").parquet(f"{path}/trees")
            facts = [(m, t["depth"], t["leaves"], t["gains"].tolist(), t["splits"].tolist()) for m, own in enumerate(self.sums) for t in own]
            spark.createDataFrame([(i, *f) for i, f in enumerate(facts)], self.SUM_SCHEMA).write.mode("overwrite").parquet(f"{path}/sums")
        spark.createDataFrame([] if self._trees is None else self.node_rows(), self.NODE_SCHEMA).write.mode("overwrite").parquet(f"{path}/nodes")
        heads = [(m, b, *[getattr(p, k) for k in p.__dataclass_fields__]) for m, (b, p) in enumerate(zip(self.base, self.params))]
        types = {int: "int", float: "double", str: "string", bool: "boolean"}
        kinds = {"num_leaves": "int", **{k: types[type(v.default)] for k, v in BoostParams.__dataclass_fields__.items() if v.default is not None}}
        schema = "model int, base double, " + ", ".join(f"{k} {kinds[k]}" for k in BoostParams.__dataclass_fields__)
        heads = [tuple(float(v) if kinds.get(k) == "double" else v for k, v in zip(["model", "base", *BoostParams.__dataclass_fields__], h)) for h in heads]
        spark.createDataFrame(heads, schema).write.mode("overwrite").parquet(f"{path}/models")
        names = [(i, f, [float(e) for e in self.edges[i]]) for i, f in enumerate(self.features)]
        spark.createDataFrame(names, "pos int, feature string, edges array<double>").write.mode("overwrite").parquet(f"{path}/features")

    @classmethod
    def load(cls, spark, path: str) -> BoostedModels:
        names = spark.read.parquet(f"{path}/features").orderBy("pos").collect()
        heads = spark.read.parquet(f"{path}/models").orderBy("model").collect()
        params = [BoostParams(**{k: h[k] for k in BoostParams.__dataclass_fields__}) for h in heads]
        shared = [n["feature"] for n in names], [list(n["edges"]) for n in names], [h["base"] for h in heads]
        if _exists(spark, f"{path}/trees"):
            sums: list[list[dict]] = [[] for _ in heads]
            for row in spark.read.parquet(f"{path}/sums").orderBy("pos").collect():
                sums[row["model"]].append({"depth": row["depth"], "leaves": row["leaves"], "gains": np.array(row["gains"]), "splits": np.array(row["splits"])})
            return cls(*shared, None, params, spark.read.parquet(f"{path}/trees"), sums)
        trees: list[list[_Tree]] = [[] for _ in heads]
        for row in spark.read.parquet(f"{path}/nodes").orderBy("model", "tree", "node").collect():
            if row["node"] == 0:
                tree = _Tree()
                for k in _Tree.FIELDS:
                    setattr(tree, k, [])
                trees[row["model"]].append(tree)
            tree = trees[row["model"]][-1]
            for k in _Tree.FIELDS:
                getattr(tree, k).append(row[k])
        return cls(*shared, trees, params)


def _grow_order(tree: _Tree, leaves: int) -> set[int]:
    """Nodes a best-first grower would split within the leaf budget, given the gains known so far."""
    chosen, candidates = set(), [0] if 0 in tree.best else []
    while candidates and len(chosen) < leaves - 1:
        node = max(candidates, key=lambda n: (tree.best[n][0], -n))
        candidates.remove(node)
        chosen.add(node)
        candidates += [c for c in (tree.left[node], tree.right[node]) if c >= 0 and c in tree.best]
    return chosen


def _ready(tree: _Tree, setting: BoostParams, frontier: Sequence[int]) -> list[int]:
    """Nodes to split now, given the best cuts known."""
    if setting.num_leaves:
        # children of a node matter only if the node itself survives the leaf budget
        return sorted(n for n in _grow_order(tree, setting.num_leaves) if tree.feature[n] < 0)
    return [n for n in frontier if n in tree.best]


def _split_all(tree: _Tree, setting: BoostParams, ready: Sequence[int]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Split nodes; the new nodes that may be split in turn, and (lighter child, other child, parent) of each split that has such."""
    frontier, pairs = [], []
    for n in ready:
        children = tree.split(n, tree.best[n])
        if tree.depth[children[0]] < setting.depth_limit:
            frontier += children
            pairs.append((*tree.lighter(n), n))
    return frontier, pairs


def _finish(tree: _Tree, params: BoostParams) -> None:
    """Apply the leaf budget or the minimum gain, closing nodes that do not survive."""
    if params.num_leaves:
        chosen = _grow_order(tree, params.num_leaves)
        for node in range(len(tree.feature)):
            if tree.feature[node] >= 0 and node not in chosen:
                tree.close(node)
    for node in range(len(tree.feature) - 1, -1, -1):
        if tree.feature[node] < 0:
            continue
        ends = tree.feature[tree.left[node]] < 0 and tree.feature[tree.right[node]] < 0
        if ends and tree.gain[node] <= params.gamma:
            tree.close(node)
    reached, stack = [], [0]
    while stack:
        node = stack.pop()
        reached.append(node)
        if tree.feature[node] >= 0:
            stack += [tree.right[node], tree.left[node]]
    number = {old: new for new, old in enumerate(reached)}
    pick = lambda values: [values[n] for n in reached]
    tree.feature, tree.bin, tree.value = pick(tree.feature), pick(tree.bin), pick(tree.value)
    tree.gain, tree.depth, tree.low = pick(tree.gain), pick(tree.depth), pick(tree.low)
    tree.left = [number.get(n, -1) for n in pick(tree.left)]
    tree.right = [number.get(n, -1) for n in pick(tree.right)]
    tree.parent = [number.get(n, -1) for n in pick(tree.parent)]
    tree.best = {}


class _Trainer:
    """Blocks in the cluster and the jobs over them."""

    def __init__(self, df, key, features, label, weights, params, edges, max_bins, block_rows, whole=True, columns=None, make=None):
        spark = df.sparkSession
        self.spark, self.context = spark, spark.sparkContext
        self.params, self.features = params, list(features)
        # models with the same rows share a weight
        self.columns = list(range(len(params))) if columns is None else list(columns)
        models = max(self.columns) + 1
        weight = weights if weights is not None else F.array(F.lit(1))
        rows = df.select(
            F.xxhash64(F.col(key).cast("string")).alias("k"), quoted(label).cast("double").alias("y"),
            weight.cast("array<int>" if make is None else "string").alias("w"),
            *[quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)],
        )
        rows = settled(rows.where(F.col("y").isNotNull()), "boosting-rows")
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi")).first()
        self.rows = facts["n"]
        if not self.rows:
            raise ValueError("no rows with a label to train on")
        self.edges = edges if edges is not None else quantile_edges(
            rows.select(*[F.col(f"x{i}").alias(c) for i, c in enumerate(features)]), features, max_bins)
        self.bins = max(len(e) for e in self.edges) + 2
        block_rows = min(block_rows, BLOCK_ROWS)
        size = min(block_rows, max(4096, 8 * block_rows // max(8, models)))
        count = max(1, math.ceil(self.rows / size))
        packed = rows.repartition(count, "k").mapInPandas(
            _pack(len(self.features), models, self.edges, size, make),
            "n int, x binary, y binary, w binary, k binary, lo long, hi long, own binary, whole binary, sums binary")
        written = materialise(packed, "boosting-blocks")
        blocks = written.select("n", "x", "y", "w", "k")
        lightest, heaviest_row, largest, whole_weights, sums = _weight_sums(written)
        if lightest < 0 or heaviest_row > MOST_WEIGHT:
            raise ValueError(f"weights must be whole numbers from 0 to {MOST_WEIGHT}, not {lightest} to {heaviest_row}")
        means = [float(s / n) if n else 0.0 for s, n in zip(sums, whole_weights)]
        # ten digits: the last bits of a distributed sum depend on its order
        means = [float(f"{mean:.10g}") for mean in means]
        self.base = [means[c] for c in self.columns]
        heaviest, heaviest_row = max(1, *whole_weights), max(1, heaviest_row)
        # the widest gradient takes 2^bits; sums of a block stay exact in a double, total sums in 63 bits, and bits are the same both ways
        bits = min(52 - EXACT_BITS - math.ceil(math.log2(heaviest_row)), 60 - math.ceil(math.log2(heaviest)) - 1)
        self.scale = 2.0 ** (bits - math.ceil(math.log2(max(facts["hi"] - facts["lo"], 1e-300))))
        boosted = len(params) if not any(p.forest for p in params) else 0
        self.alone = whole and fits_one_block(max(largest), len(features), boosted)
        self.before, self.kept, self.level, self.blocks = None, None, None, None
        self.heaviest_row = heaviest_row
        if self.alone or all(p.forest for p in params) and whole:
            self.packed = blocks, models
            return
        width, base, kind, columns = len(self.features), np.array(self.base), _kind(self.edges), self.columns

        def load(row):
            return {
                "x": np.asfortranarray(np.frombuffer(row["x"], kind).reshape(-1, width)), "y": np.frombuffer(row["y"]),
                "w": np.frombuffer(row["w"], np.uint16).reshape(-1, models)[:, columns], "k": np.frombuffer(row["k"], np.uint64),
                "f": np.tile(base, (row["n"], 1)),
            }

        # the code and the settings go out once; a level's closure holds only its open nodes and trees
        self.level = self.context.broadcast(cloudpickle.dumps((_level, params, _fold)))
        self.folder = work_folder(spark)
        self.blocks = blocks.rdd.map(load).persist(StorageLevel.MEMORY_AND_DISK)
        self.parts = self.blocks.getNumPartitions()

    def histograms(self, open_slots, current, tree_no):
        level, scale, bins = self.level, self.scale, self.bins

        def run(blocks):
            code, params, _ = pickle.loads(level.value)
            return code(blocks, open_slots, current, params, tree_no, scale, bins)

        return self.blocks.mapPartitions(run)

    def best(self, open_slots, current, pairs, open_nodes, tree_no) -> dict[tuple[int, int], tuple]:
        """Best cuts of the new nodes: the lighter child of each of ``pairs`` is counted, its sibling is the rest of the parent.

        ``open_nodes``: those of earlier levels that may be split later; their histograms stay.
        """
        params, scale, width = self.params, self.scale, len(self.features)
        masks = {m: _column_mask(width, params[m], tree_no) for m in open_slots}
        # Counts of a pair travel under the key of the parent, where the parent's own histogram waits.
        names = {(m, slot): (m, n[2] if n[2] is not None else n[0]) for m, own in pairs.items() for slot, n in enumerate(own)}
        children = {(m, n[2]): n[:2] for m, own in pairs.items() for n in own if n[2] is not None}
        reducers = max(1, min(len(names), self.context.defaultParallelism))
        counted = self.histograms(open_slots, current, tree_no).map(lambda kv: (names[kv[0]], kv[1])).reduceByKey(lambda a, b: a + b, reducers)
        if children:
            def both(kv):
                (m, parent), (whole, light) = kv
                whole, light = next(iter(whole), None), next(iter(light), None)
                if (m, parent) not in children:
                    return [((m, parent), whole)] if (m, parent) in open_nodes else []
                light = np.zeros_like(whole) if light is None else light
                first, second = children[m, parent]
                return [((m, first), light), ((m, second), whole - light)]

            counted = self.kept.cogroup(counted, reducers).flatMap(both)
        counted = counted.persist(StorageLevel.MEMORY_AND_DISK)
        fresh = {(m, n) for m, own in pairs.items() for p in own for n in p[:2] if n is not None}
        found = dict(counted.filter(lambda kv: kv[0] in fresh).map(
            lambda kv: (kv[0], best_splits(kv[1][None], scale, params[kv[0][0]], masks[kv[0][0]])[0])).collect())
        if self.kept is not None:
            self.kept.unpersist()
        self.kept = counted
        return {k: v for k, v in found.items() if v is not None}

    def train_alone(self) -> BoostedModels:
        """Every boosted model by one task, forests by a few trees a task; a task gets the rows of its model by a shuffle."""
        (blocks, models), params, scale, base, bins = self.packed, self.params, self.scale, self.base, self.bins
        width, kind, columns, fields = len(self.features), _kind(self.edges), self.columns, _Tree.FIELDS
        code = self.context.broadcast(cloudpickle.dumps((_train_alone, _train_forest, _folded, _tree_sums)))
        units = [(m, n) for m, p in enumerate(params) for n in (range(0, p.n_estimators, FOREST_UNIT) if p.forest else [0])]
        readers: dict[int, list[int]] = {}
        for place, (m, _) in enumerate(units):
            readers.setdefault(columns[m], []).append(place)

        def send(row):
            x, y = np.frombuffer(row["x"], kind).reshape(-1, width), np.frombuffer(row["y"])
            w, k = np.frombuffer(row["w"], np.uint16).reshape(-1, models), np.frombuffer(row["k"], np.uint64)
            for column, places in readers.items():
                held = np.flatnonzero(w[:, column])
                if len(held):
                    part = (x[held].tobytes(), y[held].tobytes(), w[held, column].tobytes(), k[held].tobytes())
                    for place in places:
                        yield place, part

        def run(index, records):
            (model, first), (boosted, forest, folded, facts) = units[index], pickle.loads(code.value)
            plain = lambda trees: pickle.dumps([[getattr(t, k) for k in fields] for t in trees])
            parts = [p for _, p in records]
            join = lambda n, t: np.frombuffer(b"".join(p[n] for p in parts), t)
            block = {"x": join(0, kind).reshape(-1, width), "y": join(1, float), "w": join(2, np.uint16), "k": join(3, np.uint64)}
            parts.clear()
            setting = params[model]
            if not setting.forest:
                yield model, first, plain(boosted(block, setting, scale, base[model], bins)), None, None
                return
            trees = forest(block, setting, scale, base[model], bins, range(first, min(first + FOREST_UNIT, setting.n_estimators)))
            # a unit too large for the driver is not written in the driver's form as well
            small = sum(len(t.feature) for t in trees) <= DRIVER_NODES
            yield model, first, plain(trees) if small else None, pickle.dumps([folded(t) for t in trees]), pickle.dumps([facts(t, width) for t in trees])

        found = blocks.select("x", "y", "w", "k").rdd.flatMap(send).partitionBy(len(units), int).mapPartitionsWithIndex(run)
        schema = "model int, first int, grown binary, trees binary, sums binary"
        # written once: the driver reads boosted and small trees, sums of the others
        kept = materialise(self.spark.createDataFrame(
            found.map(lambda u: (*u[:2], *[None if b is None else bytearray(b) for b in u[2:]])), schema), "trees")
        code.unpersist()
        sums: list[list[dict]] = [[] for _ in params]
        for row in kept.where("sums is not null").select("model", "first", "sums").orderBy("model", "first").collect():
            sums[row["model"]] += pickle.loads(row["sums"])
        if sum(2 * t["leaves"] - 1 for own in sums for t in own) > DRIVER_NODES:
            return BoostedModels(self.features, self.edges, base, None, params, kept.select("model", "first", "trees"), sums)
        trees: list[list[_Tree]] = [[] for _ in params]
        for row in kept.select("model", "first", "grown").orderBy("model", "first").toLocalIterator():
            trees[row["model"]] += [_Tree.of(columns) for columns in pickle.loads(row["grown"])]
        return BoostedModels(self.features, self.edges, base, trees, params)

    def train_spread(self) -> BoostedModels:
        """Independent trees over more rows than a task takes: their tops level by level, what is below a node of few rows by one task.

        The driver holds the tops, a few nodes for each ``NODE_ROWS`` rows and tree.
        """
        units = [(m, n) for m, p in enumerate(self.params) for n in range(0, p.n_estimators, FOREST_UNIT)]
        stored = reduce(DataFrame.unionByName, [self.spread(units[k : k + UNITS_AT_ONCE]) for k in range(0, len(units), UNITS_AT_ONCE)])
        sums: list[list[dict]] = [[] for _ in self.params]
        for row in stored.select("model", "first", "sums").orderBy("model", "first").collect():
            sums[row["model"]] += pickle.loads(row["sums"])
        return BoostedModels(self.features, self.edges, self.base, None, self.params, stored.select("model", "first", "trees"), sums)

    def spread(self, units: Sequence[tuple[int, int]]) -> DataFrame:
        """Some units of trees, written as ``model, first, trees, sums``."""
        (blocks, models), params, columns, base, bins = self.packed, self.params, self.columns, self.base, self.bins
        width, kind, scale = len(self.features), _kind(self.edges), self.scale / 16
        small = np.uint8 if self.heaviest_row * 13 <= 255 else np.uint32
        packed = blocks.select("x", "y", "w", "k").rdd
        trees = [(m, n) for m, first in units for n in range(first, min(first + FOREST_UNIT, params[m].n_estimators))]

        def load(row):
            return {"x": np.frombuffer(row["x"], kind).reshape(-1, width), "y": np.frombuffer(row["y"]),
                    "w": np.frombuffer(row["w"], np.uint16).reshape(-1, models), "k": np.frombuffer(row["k"], np.uint64)}

        tops = [_Tree() for _ in trees]
        below: list[dict[int, int]] = [{} for _ in trees]  # nodes that a task takes on, with their rows
        open_: list[list[int]] = [[0] for _ in trees]
        while any(open_):
            waiting = {}
            for place, nodes in enumerate(open_):
                setting, salt = params[trees[place][0]], _tree_salt(params[trees[place][0]], trees[place][1]) + 1
                draws = {n: _mix(np.arange(width, dtype=np.uint64) + np.uint64((n + 1) * width), salt) for n in nodes}
                if nodes:
                    waiting[place] = {n: sorted(np.argsort(d, kind="stable")[: setting.drawn(width)].tolist()) for n, d in draws.items()}
            # trees without open nodes take no part
            going = sorted(waiting)
            growing = [trees[p] for p in going], [tops[p].packed() for p in going], params, columns, base, scale
            looked = {i: waiting[p] for i, p in enumerate(going)}

            def count(rows, growing=growing, looked=looked):
                return _node_sums(map(load, rows), looked, *growing, bins=bins)

            def cut(item, growing=growing, looked=looked):
                place, sums = item
                return [((place, n), _node_cut(found, looked[place][n], params[growing[0][place][0]], scale)) for n, found in sums.items()]

            reducers = max(1, min(len(going), self.context.defaultParallelism))
            found = dict(packed.mapPartitions(count).reduceByKey(_both_sums, reducers).flatMap(cut).collect())
            for i, place in enumerate(going):
                top, setting, nodes, open_[place] = tops[place], params[trees[place][0]], open_[place], []
                for node in nodes:
                    mean, best = found.get((i, node), (0.0, None))
                    part = 1.0 / setting.n_estimators
                    if node == 0:
                        top.value[0] = mean * part
                    if best is None:
                        continue
                    gain, feature, at, low_value, high_value, low, *rows = best
                    for child, n in zip(top.split(node, (gain, feature, at, low_value * part, high_value * part, low)), rows):
                        if setting.max_depth <= 0 or top.depth[child] < setting.max_depth:
                            if n > NODE_ROWS:
                                open_[place].append(child)
                            elif n > 1:
                                below[place][child] = n
        # tasks of about NODE_ROWS rows, each of one node or of several small ones
        tasks, task, held = [], -1, NODE_ROWS
        for place, nodes in enumerate(below):
            at = np.full(len(tops[place].feature), -1, np.int64)
            for node, n in nodes.items():
                if held + n > NODE_ROWS:
                    task, held = task + 1, 0
                at[node], held = task, held + n
            tasks.append(at)
        depths = [{node: tops[p].depth[node] for node in nodes} for p, nodes in enumerate(below)]
        growing = trees, [t.packed() for t in tops], params, columns, base, scale

        def send(rows):
            tables = [_leaf_tables(top) for top in growing[1]]
            for block in map(load, rows):
                for place, rows, node, weight, target in _tree_rows(block, *growing, tables):
                    # numbers of 16 bits are sorted many times faster
                    order = np.argsort(node.astype(np.uint16) if len(tasks[place]) <= 1 << 16 else node, kind="stable")
                    node = node.take(order)
                    ends = np.flatnonzero(np.diff(node, append=-1))
                    x, target, weight = block["x"].take(rows.take(order), axis=0), target.take(order).astype(np.int32), weight.take(order).astype(small)
                    start = 0
                    for n, end in zip(node.take(ends).tolist(), (ends + 1).tolist()):
                        if tasks[place][n] >= 0:
                            yield int(tasks[place][n]), (place, n, *(p[start:end].tobytes() for p in (x, target, weight)))
                        start = end

        unit = {u: i for i, u in enumerate(units)}
        owner = [unit[m, n // FOREST_UNIT * FOREST_UNIT] for m, n in trees]

        def grow(_, records):
            parts: dict[tuple[int, int], list] = {}
            for _, (place, node, *part) in records:
                parts.setdefault((place, node), []).append(part)
            for place, node in sorted(parts):
                x, y, w = (b"".join(p) for p in zip(*parts.pop((place, node))))
                m, number = trees[place]
                setting = params[m]
                if setting.max_depth > 0:
                    setting = replace(setting, max_depth=setting.max_depth - depths[place][node])
                tree = _grow_whole(np.frombuffer(x, kind).reshape(-1, width), np.frombuffer(y, np.int32).astype(float), np.frombuffer(w, small).astype(float), setting,
                             (_tree_salt(params[m], number) + 1) * 1_000_003 + node, bins, scale, 1.0 / setting.n_estimators)
                yield owner[place], (place, node, _folded(tree), _tree_sums(tree, width))

        def join(index, records):
            parts: dict[int, dict[int, list]] = {}
            for _, (place, node, *part) in records:
                parts.setdefault(place, {})[node] = part
            made = []
            for place in (p for p, u in enumerate(owner) if u == index):
                own = parts.pop(place, {})
                made.append(_grafted(tops[place], {n: p[0] for n, p in own.items()}, {n: p[1] for n, p in own.items()}, width))
            yield (*units[index], bytearray(pickle.dumps([t for t, _ in made])), bytearray(pickle.dumps([f for _, f in made])))

        grown = packed.mapPartitions(send).partitionBy(max(1, task + 1), int).mapPartitionsWithIndex(grow)
        made = grown.partitionBy(len(units), int).mapPartitionsWithIndex(join)
        return materialise(self.spark.createDataFrame(made, "model int, first int, trees binary, sums binary"), "trees")

    def fold(self, trees: dict[int, tuple], checkpoint: bool) -> None:
        """Queue the margin update; the next job computes and caches it."""
        self.release()
        level, self.before = self.level, self.blocks

        def run(blocks):
            code = pickle.loads(level.value)[2]
            return (code(block, trees) for block in blocks)

        self.blocks = self.before.mapPartitions(run, True).persist(StorageLevel.MEMORY_AND_DISK)
        if checkpoint:
            if self.context.getCheckpointDir() is None:
                self.context.setCheckpointDir(f"{self.folder}/panelkit/{self.context.applicationId}/checkpoints")
            self.blocks.checkpoint()

    def release(self) -> None:
        """Drop the blocks of the tree before last, which no later job reads."""
        if self.before is not None:
            self.before.unpersist()
            self.before = None

    def close(self) -> None:
        self.release()
        for held in (self.blocks, self.level, self.kept):
            if held is not None:
                held.unpersist()


def fits_one_block(rows: int, features: int, models: int = 1) -> bool:
    """Whether a model of so many rows is trained whole by a task; ``models``: boosted ones, none where forests are among them."""
    size = rows * (features + 18)
    if models >= BATCH_MODELS and ALONE_BYTES:
        return size <= BATCH_BYTES
    return rows <= 1 << EXACT_BITS and size <= ALONE_BYTES


def fit_boosted(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    params: BoostParams | Sequence[BoostParams] | None = None,
    weights: Column | None = None,
    edges: Sequence[Sequence[float]] | None = None,
    max_bins: int = 255,
    block_rows: int = BLOCK_ROWS,
    columns: Sequence[int] | None = None,
    make: Callable[[list[str | None]], np.ndarray] | None = None,
) -> BoostedModels:
    """Train one ensemble per entry of ``params``.

    ``weights`` is an array column with one whole-number weight (0 to 65535, else an error) per ensemble: bootstrap counts, fold or
    segment membership. Without it every row has weight one in the only ensemble. ``columns`` names the weight of each ensemble where several
    share one. With ``make``, ``weights`` is a key of which it makes the weights (rows x ensembles) in the task that packs the rows.
    """
    settings = [params or BoostParams()] if params is None or isinstance(params, BoostParams) else list(params)
    trainer = _Trainer(df, key, features, label, weights, settings, edges, max_bins, block_rows, columns=columns, make=make)
    done: list[list[_Tree]] = [[] for _ in settings]
    rounds = max(p.n_estimators for p in settings)
    try:
        if trainer.alone:
            return trainer.train_alone()
        if all(p.forest for p in settings):
            return trainer.train_spread()
        if any(p.forest for p in settings):
            raise ValueError("forests and boosted models of so many rows are fitted apart")
        for number in range(rounds):
            growing = {m: _Tree() for m, p in enumerate(settings) if number < p.n_estimators}
            _grow(trainer, growing, settings, number)
            for m, tree in growing.items():
                done[m].append(tree)
            if number + 1 < rounds:
                trainer.fold({m: t.packed() for m, t in growing.items()}, (number + 1) % CHECKPOINT_EVERY == 0)
    finally:
        trainer.close()
    return BoostedModels(features, trainer.edges, trainer.base, done, settings)


def _grow(trainer: _Trainer, growing: dict[int, _Tree], settings, number: int) -> None:
    """Grow one tree per model, all models level by level in the same jobs."""
    frontier = {m: [0] for m in growing}
    pairs: dict[int, list[tuple]] = {m: [(0, None, None)] for m in growing}
    while True:
        open_slots, current = {}, {}
        for m, own in pairs.items():
            if own:
                slots = np.full(len(growing[m].feature), -1, np.int32)
                slots[[p[0] for p in own]] = np.arange(len(own), dtype=np.int32)
                open_slots[m], current[m] = slots, growing[m].packed()
        if not open_slots:
            break
        waiting = {(m, n) for m, tree in growing.items() if settings[m].num_leaves for n in tree.best if tree.feature[n] < 0}
        found = trainer.best(open_slots, current, {m: pairs[m] for m in open_slots}, waiting, number)
        for m in open_slots:
            for node in frontier[m]:
                if (m, node) in found:
                    growing[m].best[node] = found[m, node]
            frontier[m], pairs[m] = _split_all(growing[m], settings[m], _ready(growing[m], settings[m], frontier[m]))
    for m, tree in growing.items():
        _finish(tree, settings[m])


def level_histogram(
    df: DataFrame, key: str, features: Sequence[str], label: str, edges: Sequence[Sequence[float]]
) -> DataFrame:
    """Root histogram of the first tree: ``feature, bin, gradient, weight``; missing values have bin -1."""
    trainer = _Trainer(df, key, features, label, None, [BoostParams()], edges, 64, BLOCK_ROWS, whole=False)
    names, scale = list(features), trainer.scale
    parts = trainer.histograms({0: np.zeros(1, np.int32)}, {0: _Tree().packed()}, 0).reduceByKey(lambda a, b: a + b)
    cells = parts.flatMap(lambda kv: [
        (names[f], int(b) - 1, float(kv[1][f, b, 0] / scale), int(kv[1][f, b, 1]))
        for f in range(kv[1].shape[0]) for b in range(kv[1].shape[1]) if kv[1][f, b, 1]
    ])
    return df.sparkSession.createDataFrame(cells, "feature string, bin int, gradient double, weight long")

