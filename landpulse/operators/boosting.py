"""Gradient-boosted trees grown from histograms that stay with the rows.

Spark's trainer reads every row of every feature on each level of each tree, and its rounds run through the JVM's shuffles and
caches. Here the rows are binned once and kept as numpy arrays in files beside the task that read them; a round is one small job
per level, which returns sums only. Rows drawn per tree, features drawn per node, candidate splits, gains, limits and weights are
those of ``GBTClassifier``: with few rows the trees are the same, with many they differ as sums of doubles in another order do
(equal gains may fall to another feature) and, in more than one task, as rows in other tasks draw other numbers. The result is a ``GBTClassificationModel``.

With many rows features share joint histograms (a row is counted once for two or three features), and of two siblings only the
smaller one is counted, the other is what remains of the parent.
"""

from __future__ import annotations

import json
import math
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Generator, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property, lru_cache, partial
from math import ceil
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from landpulse.operators.skew import FEW_ROWS, MANY_ROWS
from landpulse.session import scratch_folder

ONE_TASK, MOST_ROWS = 1_000_000, 2_000_000  # rows that one task fits on its own; rows whose arrays one of many tasks holds at a time
LEAST_CELLS, MOST_CELLS = 64, 32_768  # of a joint histogram
POSITIVE = float(1 << 26)  # rows and positives of a cell are counted in one double
PURE = 2.0 ** -52
KEPT = ["margin", "residual", "square"]
OUTSIDE = 128  # mark of a row that was not drawn for the tree
NODES = "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, " \
    "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
MODEL, TREE = "org.apache.spark.ml.classification.GBTClassificationModel", "org.apache.spark.ml.regression.DecisionTreeRegressionModel"


# --- the random numbers of Spark's trainer ------------------------------------------------------------------------

MASK = (1 << 64) - 1


def _rotated(x: int, n: int) -> int:
    return ((x << n) | (x >> (32 - n))) & 0xFFFFFFFF


def _murmur(data: bytes, h: int) -> int:
    for at in range(0, len(data), 4):
        k = _rotated(int.from_bytes(data[at:at + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        h = (_rotated(h ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def first_state(seed: int) -> int:
    """The state of ``XORShiftRandom(seed)``."""
    data = (seed & MASK).to_bytes(8, "big")
    low = _murmur(data, 0x3C074A61)
    return _murmur(data, low) << 32 | low


def _step(s):
    s = s ^ (s << 21 & MASK if isinstance(s, int) else s << np.uint64(21))
    s = s ^ (s >> 35 if isinstance(s, int) else s >> np.uint64(35))
    return s ^ (s << 4 & MASK if isinstance(s, int) else s << np.uint64(4))


def _jumped(jump: np.ndarray, states: np.ndarray) -> np.ndarray:
    """A step is linear over bits: ``jump`` holds where each bit of a state goes."""
    out = np.zeros_like(states)
    for bit in range(64):
        out ^= jump[bit] * (states >> np.uint64(bit) & np.uint64(1))
    return out


@lru_cache(8)
def _jumps(steps: int, doublings: int) -> list[np.ndarray]:
    power, done = _step(np.uint64(1) << np.arange(64, dtype=np.uint64)), np.uint64(1) << np.arange(64, dtype=np.uint64)
    while steps:
        done = _jumped(power, done) if steps & 1 else done
        power, steps = _jumped(power, power), steps >> 1
    out = [done]
    for _ in range(doublings - 1):
        out.append(_jumped(out[-1], out[-1]))
    return out


def drawn(seed: int, rows: int, rate: float) -> np.ndarray:
    """Which of ``rows`` successive numbers of ``XORShiftRandom(seed)`` are below ``rate``: many stretches of the sequence at a time."""
    doublings = max(1, min(13, rows.bit_length() - 7))
    stretch = ceil(rows / (1 << doublings))
    states = np.array([first_state(seed)], dtype=np.uint64)
    for jump in _jumps(2 * stretch, doublings):
        states = np.concatenate([states, _jumped(jump, states)])
    out, below = np.empty((stretch, len(states)), dtype=bool), np.uint64(ceil(rate * 2 ** 53))  # a number is a 53-bit integer over 2 ** 53
    for at in range(stretch):
        states = _step(states)
        high = (states & np.uint64((1 << 26) - 1)) << np.uint64(27)
        states = _step(states)
        np.less(high | states & np.uint64((1 << 27) - 1), below, out=out[at])
    return out.T.reshape(-1)[:rows]


class Features:
    """The features drawn for one node after the other, by a ``java.util.Random`` and a reservoir."""

    def __init__(self, seed: int, features: int, wanted: int):
        self.state, self.features, self.wanted = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1), features, wanted

    def _next(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        x = self.state >> 16
        return x - (1 << 32) if x >= 1 << 31 else x

    def draw(self) -> list[int]:
        if self.wanted >= self.features:
            return list(range(self.features))
        high = self._next()
        s, kept = first_state((high << 32) + self._next()), list(range(self.wanted))
        for item in range(self.wanted, self.features):
            s = _step(s)
            high, s = s & ((1 << 26) - 1), _step(s)
            place = int(((high << 27) + (s & ((1 << 27) - 1))) * 2.0 ** -53 * (item + 1))
            if place < self.wanted:
                kept[place] = item
        return kept


# --- what is grown ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Group:
    """Features with one joint histogram."""

    features: tuple[int, ...]
    sizes: tuple[int, ...]

    @property
    def cells(self) -> int:
        return math.prod(self.sizes)

    def bins(self, feature: int) -> np.ndarray:
        """The bin of ``feature`` in each cell."""
        return np.unravel_index(np.arange(self.cells), self.sizes)[self.features.index(feature)]


@dataclass(frozen=True)
class Plan:
    """What all tasks know: bins, limits and draws."""

    thresholds: tuple[tuple[float, ...] | None, ...]  # of a continuous feature; None if it is a category
    sizes: tuple[int, ...]  # bins per feature
    per_node: int
    trees: int
    depth: int
    step: float
    rate: float
    seed: int
    least: int  # rows of a node
    least_gain: float
    weights: tuple[float, float]  # of the labels 0 and 1
    cells: int  # of a joint histogram at most; 0: none are joint and every node is counted, as Spark does

    @cached_property
    def groups(self) -> list[Group]:
        out: list[list[int]] = []
        room: list[int] = []
        for f in sorted((f for f, n in enumerate(self.sizes) if n > 1), key=lambda f: (-self.sizes[f], f)):
            at = next((k for k, n in enumerate(room) if n * self.sizes[f] <= self.cells), None)
            if at is None:
                out, room = [*out, [f]], [*room, self.sizes[f]]
            else:
                out[at].append(f)
                room[at] *= self.sizes[f]
        return [Group(tuple(own), tuple(self.sizes[f] for f in own)) for own in out]

    @cached_property
    def group_of(self) -> dict[int, int]:
        return {f: k for k, group in enumerate(self.groups) for f in group.features}

    @cached_property
    def starts(self) -> np.ndarray:
        """Where the bins of each feature begin in a row of sums."""
        return np.concatenate([[0], np.cumsum(self.sizes)])

    @cached_property
    def places(self) -> np.ndarray:
        """Per feature and bin its place in a row of sums; absent bins point beyond the end."""
        bins = np.arange(max(self.sizes))
        return np.where(bins < np.array(self.sizes)[:, None], self.starts[:-1, None] + bins, self.starts[-1])

    def code(self, x: np.ndarray) -> list[np.ndarray]:
        """The cell of each row in each joint histogram."""
        def one(f: int) -> np.ndarray:
            return x[:, f].astype(np.int64) if self.thresholds[f] is None else np.searchsorted(np.array(self.thresholds[f]), x[:, f])

        return [np.ravel_multi_index([one(f) for f in g.features], g.sizes).astype(np.uint16) for g in self.groups]


Ways = dict[int, tuple[int, tuple[int, ...]]]  # node: feature, bins that go right


class Part:
    """The rows of one task: codes, labels, margins, residuals, and the node that each row has reached."""

    def __init__(self, plan: Plan, index: int, codes: list[np.ndarray], positive: np.ndarray):
        self.plan, self.index, self.codes, self.positive = plan, index, codes, positive
        self.margin = self.residual = self.square = self.node = None

    def _sums(self, nodes: int, rows: np.ndarray | None, slot: np.ndarray) -> np.ndarray:
        """Rows, positives and weighted residuals per node and bin, of ``rows`` in their ``slot``, or of all with the slot as a factor.

        The plain way: rows, weights, first and second moments.
        """
        plan = self.plan
        own = lambda x: x if rows is None else x.take(rows)
        positive, y = own(self.positive), own(self.residual)
        w, one = np.array(plan.weights).take(positive), slot * 1.0 if rows is None else np.ones(len(rows))
        weighted = w * y * one
        stats = [(positive * POSITIVE + 1.0) * one, weighted] if plan.cells else [one, w * one, weighted, weighted * y]
        out = np.zeros((nodes, len(stats), plan.starts[-1]))
        for group, code in zip(plan.groups, self.codes):
            key = own(code).astype(np.intp) if rows is None or nodes == 1 else own(code) + slot * group.cells
            for k, stat in enumerate(stats):
                joint = np.bincount(key, stat, nodes * group.cells).reshape(nodes, *group.sizes)
                for axis, f in enumerate(group.features, 1):
                    out[:, k, plan.starts[f]:plan.starts[f + 1]] = joint.sum(tuple(a for a in range(1, joint.ndim) if a != axis))
        if not plan.cells:
            return out
        positives = np.floor(out[:, 0] / POSITIVE)
        return np.stack([out[:, 0] - positives * POSITIVE, positives, out[:, 1]], 1)

    def _route(self, ways: Ways) -> None:
        if not ways:
            return
        node, at = np.array(self.node), self.node & (OUTSIDE - 1)
        for j, (feature, right) in ways.items():
            k = self.plan.group_of[feature]
            step = np.isin(self.plan.groups[k].bins(feature), right).astype(np.uint8) + np.uint8(j)  # j goes on to 2j or 2j + 1, the mark stays
            if len(ways) == 1 and j == 1:
                node += step.take(self.codes[k])
            else:
                rows = np.flatnonzero(at == j)
                node[rows] = node.take(rows) + step.take(self.codes[k].take(rows))
        self.node = node

    def _squares(self) -> np.ndarray:
        """Weighted squares of the residuals per node, of the rows drawn."""
        nodes = 2 << self.plan.depth
        return np.bincount(self.node, self.square, 2 * OUTSIDE)[:nodes] if self.plan.cells else np.zeros(nodes)

    def begin(self, tree: int, ways: Ways, values: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
        """End the tree before (its last splits, and ``values`` to add per node), draw rows and count the root."""
        plan, squares = self.plan, np.zeros(2 << self.plan.depth)
        sign = self.positive * 2.0 - 1.0
        if tree:
            self._route(ways)
            squares = self._squares()
            added = np.array(values).take(self.node & (OUTSIDE - 1))
            self.margin = added if tree == 1 else self.margin + added
            if tree == plan.trees:
                return np.zeros((0, 3 if plan.cells else 4, plan.starts[-1])), squares
            power = 2.0 * sign * self.margin
            # The plain way takes the C library's exponential, which agrees with Java's.
            grown = np.array([math.exp(v) if v < 709.0 else math.inf for v in power.tolist()]) if not plan.cells else np.exp(np.minimum(power, 709.0))
            self.residual = 4.0 * sign / (1.0 + grown)
        else:
            self.residual = sign
        self.square = np.array(plan.weights).take(self.positive) * self.residual * self.residual if plan.cells else None
        chosen = drawn(plan.seed + tree + self.index + 1, len(sign), plan.rate) if plan.rate < 1.0 else np.ones(len(sign), bool)
        self.node = np.where(chosen, 1, 1 + OUTSIDE).astype(np.uint8)
        return self._sums(1, None, chosen), squares

    def grow(self, ways: Ways, wanted: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Send rows on by the splits found and count the ``wanted`` nodes."""
        self._route(ways)
        own = [np.flatnonzero(self.node == j) for j in wanted]
        rows = np.concatenate(own) if own else np.empty(0, np.intp)
        return self._sums(len(own), rows, np.repeat(np.arange(len(own)), [len(o) for o in own])), self._squares()


Step, Sums = tuple[str, tuple], tuple[np.ndarray, np.ndarray]


@dataclass
class Node:
    """Rows, weight, and first and second moment of a node; its split if it has one."""

    stats: np.ndarray
    gain: float = -1.0
    feature: int | None = None
    left: tuple[int, ...] = ()
    right: tuple[int, ...] = ()
    refused: bool = False  # no split was allowed
    agreed: float | None = None  # the prediction of both sides, where they are equal

    @property
    def prediction(self) -> float:
        _, w, s, _ = self.stats
        if self.agreed is not None:
            return self.agreed
        return float(s / w) if w else 0.0

    def variance(self) -> float:
        return float(_variance(*self.stats[1:]))


def _variance(w, s, ss):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(w == 0.0, 0.0, (ss - s * s / w) / w)


def _split(plan: Plan, node: Node | None, sums: np.ndarray, features: list[int]) -> tuple[Node, Node | None, Node | None]:
    """The node with its best split among ``features``, and both sides of it; without a split that is allowed, a leaf."""
    own = np.append(sums, np.zeros((4, 1)), 1)[:, plan.places]  # statistic, feature, bin
    order = np.broadcast_to(np.arange(own.shape[2]), own.shape[1:]).copy()
    for f in (f for f in features if plan.thresholds[f] is None):  # categories in the order of their means, empty ones last
        w, s, size = own[1, f], own[2, f], plan.sizes[f]
        means = [float(s[b] / w[b]) if w[b] else math.inf for b in range(size)]
        order[f, :size] = sorted(range(size), key=means.__getitem__)
    running = np.cumsum(np.take_along_axis(own, order[None], 2), 2)
    usable = [f for f in features if plan.sizes[f] > 1]
    if node is None:
        first = running[:, usable[0]] if usable else running[:, 0]
        node = Node(first[:, 0] + (first[:, -1] - first[:, 0]))
    if not usable:
        node.refused = True
        return node, None, None
    left = running[:, :, :-1]
    right = running[:, :, -1:] - left
    total = left[1] + right[1]
    # In sums without squares all variances lack the same term, so that the gain is right.
    impurity = node.variance() if not plan.cells else float(_variance(node.stats[1], node.stats[2], 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = impurity - left[1] / total * _variance(*left[1:]) - right[1] / total * _variance(*right[1:])
    allowed = (left[0] >= plan.least) & (right[0] >= plan.least) & (gain >= plan.least_gain) & (np.arange(gain.shape[1]) < np.array(plan.sizes)[:, None] - 1)
    gain = np.where(allowed, gain, -math.inf)
    at = gain.argmax(1)
    best = max(usable, key=lambda f: gain[f, at[f]])  # the first of equals
    found = float(gain[best, at[best]])
    node.refused = found == -math.inf
    if found <= 0.0:
        return node, None, None
    ways = order[best, :plan.sizes[best]].tolist()
    node.gain, node.feature, node.left, node.right = found, best, tuple(ways[:at[best] + 1]), tuple(ways[at[best] + 1:])
    return node, Node(left[:, best, at[best]]), Node(right[:, best, at[best]])


def grow_trees(plan: Plan) -> Generator[Step, Sums, list[dict[int, Node]]]:
    """All trees, as nodes by number (the children of j are 2j and 2j + 1); asks for steps, and is sent their sums over all rows."""
    forest: list[dict[int, Node]] = []
    tree: dict[int, Node] = {}
    ways: Ways = {}
    for number in range(plan.trees + 1):
        values = _leaf_values(plan, tree, 1.0 if number == 1 else plan.step)
        sums, squares = yield "begin", (number, ways, values)
        _square(plan, tree, squares)
        if number == plan.trees:
            return forest
        draws, counted, open_nodes, tree, ways = Features(plan.seed + number, len(plan.sizes), plan.per_node), {1: _moments(plan, sums[0])}, [1], {}, {}
        forest.append(tree)
        for level in range(plan.depth):
            children: list[int] = []
            ways = {}
            for j in open_nodes:
                tree[j], left, right = _split(plan, tree.get(j), counted[j], draws.draw())
                if left is not None:
                    tree[2 * j], tree[2 * j + 1] = left, right
                    ways[j], children = (tree[j].feature, tree[j].right), [*children, 2 * j, 2 * j + 1]
            if level == plan.depth - 1 or not children:
                break
            if not plan.cells:
                wanted = [j for j in children if not _pure(tree[j])]
            else:
                wanted = [min(j, j + 1, key=lambda k: tree[k].stats[0]) for j in children[::2]]
            sums, squares = yield "grow", (ways, wanted)
            ways = {}
            _square(plan, tree, squares)
            found = {j: _moments(plan, s) for j, s in zip(wanted, sums)}
            if plan.cells:
                found |= {j ^ 1: _rest(counted[j // 2], found[j]) for j in wanted}
            counted = found
            open_nodes = [j for j in reversed(children) if not _pure(tree[j])]  # the last ones made are first to draw features
    return forest


def grown(plans: list[Plan], run: Callable[[dict[int, Step]], dict[int, Sums]]) -> list[list[dict[int, Node]]]:
    """The trees of several plans over the same rows, all steps asked for at a time together."""
    asking = [grow_trees(plan) for plan in plans]
    out: list = [None] * len(plans)
    wanted = {k: next(one) for k, one in enumerate(asking)}
    while wanted:
        sums, wanted = run(wanted), {}
        for k, own in sums.items():
            try:
                wanted[k] = asking[k].send(own)
            except StopIteration as end:
                out[k] = end.value
    return out


def _moments(plan: Plan, sums: np.ndarray) -> np.ndarray:
    if not plan.cells:
        return sums
    n, positives, s = sums
    return np.stack([n, (n - positives) * plan.weights[0] + positives * plan.weights[1], s, np.zeros_like(s)])


def _rest(parent: np.ndarray, child: np.ndarray) -> np.ndarray:
    """What a node's other side has: bins without rows are empty, whatever doubles leave there."""
    rest = parent - child
    return np.where(rest[0] > 0.0, rest, 0.0)


def _pure(node: Node) -> bool:
    return abs(node.variance()) < PURE


def _square(plan: Plan, tree: dict[int, Node], squares: np.ndarray) -> None:
    """With joint histograms second moments come per node, once its rows have reached it; its parent's is the sum of both sides."""
    for j in sorted(tree, reverse=True) if plan.cells else ():
        square = squares[j] if tree[j].feature is None else tree[2 * j].stats[3] + tree[2 * j + 1].stats[3]
        tree[j].stats = np.array([*tree[j].stats[:3], square])


def _leaf_values(plan: Plan, tree: dict[int, Node], weight: float) -> tuple[float, ...]:
    out = [0.0] * (2 << plan.depth)
    for j, node in tree.items():
        if node.feature is None:
            out[j] = node.prediction * weight
    return tuple(out)


# --- over one task or many ----------------------------------------------------------------------------------------


def _coded(plans: list[Plan], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features as their cells, two bytes for each joint histogram of each plan, and labels; rows travel in this form."""
    def packed(table: np.ndarray) -> pa.Array:
        ends = np.arange(len(table) + 1, dtype=np.int32) * (table.itemsize * table.shape[1])
        return pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(table.tobytes())])

    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(plans[0].sizes))
        cells = np.stack([np.zeros(len(x), np.uint16), *[code for plan in plans for code in plan.code(x)]], 1)
        labels = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int8) for c in batch.columns[2:]], 1)
        yield pa.RecordBatch.from_arrays([packed(cells), packed(labels), batch.column(1)], ["code", "positive", "part"])


def _columns(plans: list[Plan], batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Codes and labels of each plan, made one plan after the other."""
    ends = [1, *[1 + int(n) for n in np.cumsum([len(plan.groups) for plan in plans])]]
    codes, labels = [np.empty((0, ends[-1]), np.uint16)], [np.empty((0, len(plans)), np.int8)]
    for batch in batches:
        for own, column in zip((codes, labels), batch.columns):
            own.append(np.frombuffer(b"".join(column.to_pylist()), own[0].dtype).reshape(-1, own[0].shape[1]))
    column = lambda chunks, at: np.concatenate([chunk[:, at] for chunk in chunks])
    for k in range(len(plans)):
        yield [column(codes, c) for c in range(ends[k], ends[k + 1])], column(labels, k)


def _grown_here(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one task; they keep the parts they come in, which draws and sums go by."""
    own: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        index = batch.column(2).to_numpy()
        for k in np.unique(index).tolist():
            own.setdefault(k, []).append(batch.filter(pa.array(index == k)))
    parts = [Part(plan, k, *next(_columns([plan], chunks))) for k, chunks in sorted(own.items())]

    def run(asked: dict[int, Step]) -> dict[int, Sums]:
        found = [getattr(part, asked[0][0])(*asked[0][1]) for part in parts]
        return {0: (sum(f[0] for f in found), sum(f[1] for f in found))}

    forest = grown([plan], run)[0]
    yield pa.RecordBatch.from_arrays([pa.array([json.dumps(_rows(plan, forest))])], ["rows"])


def _kept(plans: list[Plan], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write a task's arrays to a folder of its own and give its path."""
    from pyspark import TaskContext

    folder, index = tempfile.mkdtemp(prefix="landpulse-fit-"), TaskContext.get().partitionId()
    for k, (codes, positive) in enumerate(_columns(plans, batches)):
        os.mkdir(f"{folder}/{k}")
        for c, code in enumerate(codes):
            _store(f"{folder}/{k}", f"code{c}", code)
        _store(f"{folder}/{k}", "positive", positive)
    yield pa.RecordBatch.from_arrays([pa.array([index], pa.int32()), pa.array([folder])], ["index", "folder"])


def _load(folder: str, name: str) -> np.ndarray | None:
    path = f"{folder}/{name}.npy"
    return np.load(path, mmap_mode="r" if os.path.getsize(path) > 4096 else None) if os.path.exists(path) else None


def _store(folder: str, name: str, array: np.ndarray) -> None:
    own = f"{folder}/{uuid.uuid4().hex}.npy"
    np.save(own, array)
    os.replace(own, f"{folder}/{name}.npy")


At = tuple[int, int]  # the tree and the level that arrays belong to


def _stepped(plan: Plan, index: int, folder: str, asked: Step, was: At, now: At) -> Sums | None:
    """One step of a task, from its arrays at ``was`` to those at ``now``; None if its folder is not here.

    Arrays are written under the number of their step and the ones of two trees before removed, so a step can be done again.
    """
    codes, positive, node = [_load(folder, f"code{c}") for c in range(len(plan.groups))], _load(folder, "positive"), _load(folder, f"node{was[0]}-{was[1]}")
    if positive is None or any(code is None for code in codes) or (was[0] >= 0 and node is None):
        return None
    part = Part(plan, index, codes, positive)
    part.node = node
    for name in KEPT:
        setattr(part, name, _load(folder, f"{name}{was[0]}"))
    step, facts = asked
    found = getattr(part, step)(*facts)
    _store(folder, f"node{now[0]}-{now[1]}", part.node)
    if step == "begin":
        for name in KEPT:
            if getattr(part, name) is not None:
                _store(folder, f"{name}{now[0]}", getattr(part, name))
        for name in [*[f"{name}{now[0] - 2}" for name in KEPT], *[f"node{now[0] - 2}-{level}" for level in range(plan.depth)]]:
            if os.path.exists(f"{folder}/{name}.npy"):
                os.remove(f"{folder}/{name}.npy")
    return found


def _steps(plans: list[Plan], asked: dict[int, Step], was: list[At], now: list[At], handles: Iterator) -> Iterator[tuple | None]:
    for index, folder in handles:
        found = {k: _stepped(plans[k], index, f"{folder}/{k}", step, was[k], now[k]) for k, step in asked.items()}
        yield None if any(f is None for f in found.values()) else (index, {k: (f[0].tobytes(), f[1].tobytes()) for k, f in found.items()})


def _removed(handles: Iterator) -> Iterator[int]:
    for _, folder in handles:
        shutil.rmtree(folder, ignore_errors=True)
        yield 1


class Spread:
    """Rows kept by many tasks. A task whose folder is not at hand (another machine) makes all start again from the rows, through the steps done so far."""

    def __init__(self, plans: list[Plan], rows: DataFrame, tries: int = 3):
        self.plans, self.rows, self.tries = plans, rows, tries
        self.handles: RDD | None = None
        self.done: list[dict[int, Step]] = []  # what led to the arrays as they are
        self.at: list[At] = []

    def open(self) -> None:
        self.close()
        handles = self.rows.mapInArrow(partial(_kept, self.plans), "index int, folder string").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
        handles.count()
        self.handles, self.at = handles, [(-1, 0)] * len(self.plans)

    def close(self) -> None:
        if self.handles is not None:
            self.handles.mapPartitions(_removed).count()
            self.handles.unpersist()
            self.handles = None

    def _step(self, asked: dict[int, Step]) -> dict[int, Sums] | None:
        now = [(asked[k][1][0], 0) if k in asked and asked[k][0] == "begin" else (at[0], at[1] + (k in asked)) for k, at in enumerate(self.at)]
        found = self.handles.mapPartitions(partial(_steps, self.plans, asked, self.at, now)).collect()
        if any(f is None for f in found):
            return None
        self.at, parts = now, [f[1] for f in sorted(found, key=itemgetter(0))]
        total = lambda k, which: sum(np.frombuffer(p[k][which]) for p in parts)
        return {k: (total(k, 0).reshape(-1, 3 if self.plans[k].cells else 4, self.plans[k].starts[-1]), total(k, 1)) for k in asked}

    def run(self, asked: dict[int, Step]) -> dict[int, Sums]:
        found = self._step(asked) if self.handles is not None else None
        for _ in range(self.tries):
            if found is not None:
                break
            self.open()
            again = all(self._step(old) is not None for old in self.done)
            found = self._step(asked) if again else None
        if found is None:
            raise RuntimeError("the arrays of the rows are not kept between steps")
        self.done.append(asked)
        return found


# --- from and to Spark's own classes ------------------------------------------------------------------------------


def _plan(classifier: GBTClassifier, rows: DataFrame, weights: tuple[float, float]) -> tuple[Plan, int]:
    """Bins and limits, and the number of rows; checks of labels, weights and features are Spark's."""
    spark, get = rows.sparkSession, classifier.getOrDefault
    ml, tree = spark.sparkContext._jvm.org.apache.spark.ml, spark.sparkContext._jvm.org.apache.spark.mllib.tree
    single = lambda package, name: getattr(getattr(package, f"{name}$"), "MODULE$")
    classifier._transfer_params_to_java()
    own = classifier._java_obj
    instances = single(ml.util, "DatasetUtils").extractInstances(own, rows._jdf, spark.sparkContext._jvm.scala.Some(2))
    categories = single(ml.util, "MetadataUtils").getCategoricalFeatures(rows._jdf.schema().apply(get("featuresCol")))
    strategy = own.getOldBoostingStrategy(categories, tree.configuration.Algo.Classification()).treeStrategy().copy()
    strategy.setAlgo("Regression")
    strategy.setImpurity(tree.impurity.Variance.instance())
    facts = ml.tree.impl.DecisionTreeMetadata.buildMetadata(instances, strategy, 1, get("featureSubsetStrategy"))
    splits = single(ml.tree.impl, "RandomForest").findSplits(instances, facts, get("seed"))
    features, count = facts.numFeatures(), int(facts.numExamples())
    thresholds = tuple(tuple(s.threshold() for s in splits[f]) if facts.isContinuous(f) else None for f in range(features))
    sizes = tuple(len(t) + 1 if t is not None else int(facts.numBins()[f]) for f, t in enumerate(thresholds))
    joint = 0 if count <= FEW_ROWS else min(MOST_CELLS, max(LEAST_CELLS, 1 << (count // _tasks(spark, count) // 16).bit_length()))
    return Plan(thresholds, sizes, int(facts.numFeaturesPerNode()), get("maxIter"), get("maxDepth"), get("stepSize"), get("subsamplingRate"), get("seed"),
                get("minInstancesPerNode"), get("minInfoGain"), weights, joint), count


def _tasks(spark: SparkSession, count: int) -> int:
    """One up to ``ONE_TASK`` rows: a job for every level takes longer than the rows do. Else as many for each core."""
    cores = spark.sparkContext.defaultParallelism
    return 1 if count <= ONE_TASK else min(cores * ceil(count / (cores * MOST_ROWS)), ceil(count / MANY_ROWS))


def _rows(plan: Plan, forest: list[dict[int, Node]]) -> list[list]:
    return [row for number, tree in enumerate(forest) for row in _tree_rows(plan, number, tree)]


def _tree_rows(plan: Plan, number: int, tree: dict[int, Node]) -> list[list]:
    """The tree as rows of the model's store, numbered from the root down, left before right; equal leaves become one."""
    out: list[list] = []

    def leaf(j: int) -> bool:
        node = tree[j]
        if node.feature is not None and all([leaf(2 * j), leaf(2 * j + 1)]) and tree[2 * j].prediction == tree[2 * j + 1].prediction:
            node.feature, node.agreed = None, tree[2 * j].prediction
        return node.feature is None

    def add(j: int) -> int:
        node, at = tree[j], len(out)
        n, *stats = map(float, node.stats)
        out.append([number, [at, node.prediction, -1.0 if node.refused else node.variance(), stats, int(n), -1.0, -1, -1, [-1, [], -1]]])
        if node.feature is not None:
            f, threshold = node.feature, plan.thresholds[node.feature]
            way = [f, [float(b) for b in node.left], plan.sizes[f]] if threshold is None else [f, [threshold[len(node.left) - 1]], -1]
            out[at][1][5:] = [node.gain, add(2 * j), add(2 * j + 1), way]
        return at

    leaf(1)
    add(1)
    return out


def _stored(spark: SparkSession, classifier: GBTClassifier, features: int, rows: list[list]) -> GBTClassificationModel:
    """The trees in the layout of Spark's own store, and the model it reads from there."""
    path, now = scratch_folder(spark), int(time.time() * 1000)
    given, default = ({p.name: v for p, v in m.items()} for m in (classifier._paramMap, classifier._defaultParamMap))
    facts = {"timestamp": now, "sparkVersion": spark.version}
    of_tree = {"featuresCol", "labelCol", "weightCol", "predictionCol", "leafCol", "maxDepth", "maxBins", "minInstancesPerNode", "minWeightFractionPerNode",
               "minInfoGain", "maxMemoryInMB", "cacheNodeIds", "checkpointInterval", "seed", "impurity"}
    own = lambda m: {k: v for k, v in m.items() if k in of_tree}
    model = json.dumps(facts | {"class": MODEL, "uid": classifier.uid, "paramMap": given, "defaultParamMap": default, "numFeatures": features, "numTrees": classifier.getMaxIter()})
    trees = [(k, json.dumps(facts | {"class": TREE, "uid": f"dtr_{uuid.uuid4().hex[:12]}", "paramMap": own(given), "defaultParamMap": own(default)}),
              classifier.getStepSize() if k else 1.0) for k in range(classifier.getMaxIter())]
    write = lambda data, schema: spark.createDataFrame(data, schema).coalesce(1).write
    write([(model,)], "value string").text(f"{path}/metadata")
    write(trees, "_1 int, _2 string, _3 double").parquet(f"{path}/treesMetadata")
    write(rows, NODES).parquet(f"{path}/data")
    return GBTClassificationModel.load(path)


def fit(rows: DataFrame, wanted: list[tuple[GBTClassifier, tuple[float, float]]]) -> list[GBTClassificationModel]:
    """What each classifier fits on ``rows`` if its weight column holds the weights given for its labels 0 and 1."""
    spark = rows.sparkSession

    def weighted(classifier: GBTClassifier, weights: tuple[float, float]) -> DataFrame:
        return rows.withColumn(classifier.getWeightCol(), F.when(F.col(classifier.getLabelCol()) == 1, weights[1]).otherwise(weights[0]))

    with ThreadPoolExecutor(len(wanted)) as pool:
        planned = [*pool.map(lambda one: _plan(one[0], weighted(*one), one[1]), wanted)]
        plans, tasks = [plan for plan, _ in planned], _tasks(spark, planned[0][1])

        def coded(own: list[int]) -> DataFrame:
            labels = [F.col(wanted[k][0].getLabelCol()).cast("double").alias(f"y{k}") for k in own]
            read = rows.select(vector_to_array(F.col(wanted[0][0].getFeaturesCol())).alias("x"), F.spark_partition_id().alias("part"), *labels)
            return read.mapInArrow(partial(_coded, [plans[k] for k in own]), "code binary, positive binary, part int")

        if tasks == 1:
            alone = lambda k: coded([k]).coalesce(1).mapInArrow(partial(_grown_here, plans[k]), "rows string").first()[0]
            found = [json.loads(one) for one in pool.map(alone, range(len(plans)))]
        else:
            spread = Spread(plans, coded([*range(len(plans))]).drop("part").repartition(tasks))
            try:
                found = [_rows(plan, forest) for plan, forest in zip(plans, grown(plans, spread.run))]
            finally:
                spread.close()
        return [*pool.map(lambda k: _stored(spark, wanted[k][0], len(plans[k].sizes), found[k]), range(len(plans)))]
