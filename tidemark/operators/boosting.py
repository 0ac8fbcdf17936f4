"""Second-order boosted trees: Newton leaves, L2, leaf limit, as an estimator of a pipeline.

Rows are put into quantile bins once, a byte for each feature, and written; blocks of them, the bins of a feature together,
stay in the executors' storage (memory, else disk) with their margins. A pass over them gives gradient, curvature and count
by node, feature and bin: summed in each task, then by Spark; what reaches the driver is bounded by nodes x features x bins x
cores, whatever the rows. Gradients are whole multiples of a power of two, so sums are the same in any order: bins (quantiles,
exact up to RANKS values of a feature in a task, beyond that to within a 20,000th of the rows where tasks read at most a
million) and draws given, a task that runs again or other partitions give the same trees. For the
same reason a node's sums may be its parent's less its sibling's, so of two siblings only the smaller is summed; of features
with equal bins in all rows only the first is kept, of one value none; and of a feature of two bins only the rows in the
upper one.

A tree grows best first, by the gain of its splits. A pass looks at all nodes that may still be reached within the leaf
limit, so a tree takes as many passes as it is deep, not one for each split. Where all rows are one file, of at most
FILE_BYTES, one task has all sums of a pass, so it grows ALONE trees at once by the same functions, with the same result.

Null or NaN features are refused (the pipeline fills them), as is a table without rows. With one class all leaves are
about zero. Equal gains: the first feature, then the lowest bin. A feature of one value is never split.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasSeed, HasStepSize, HasWeightCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import new_path, remove

#: After so many trees the margins are stored anew; until then a pass works them out from the trees since. After so many
#: trees they are written to a table, which cuts their lineage.
FOLD, CUT = 3, 99
#: Bytes of binned rows that one task may have all of; most bytes of a file beyond that; bytes of a row beside its bins.
FILE_BYTES, MOST_BYTES, ROW_BYTES = 48 << 20, 256 << 20, 33
#: Rows of a block and of the pieces that blocks are dealt in; partial sums that the driver adds up itself.
BLOCK, PIECE, PARTIAL = 1 << 15, 1 << 11, 32
#: Rows whose values a task holds before it thins them; ranks that a summary of more values is thinned to.
HELD, RANKS = 200_000, 60_000
#: Trees that a task grows which has all rows.
ALONE = 50
#: Rows over which `patience` takes effect, the part of them that is held out for it, and the least gain that counts.
STOP_ROWS, STOP_PART, STOP_GAIN = 10_000, 0.1, 1e-7

#: A gain up to this is rounding.
LEAST_GAIN = 1e-9


@dataclass
class Node:
    gradient: float
    curvature: float
    rows: int
    depth: int
    gain: float | None = None  # None: not looked at yet; 0: a leaf
    feature: int = -1
    cut: int = 0
    left: int = 0
    right: int = 0


@dataclass
class Tree:
    """Nodes by number, 0 the root. Rows whose bin is at most `cut` go left; a leaf has feature -1."""

    feature: list[int]
    cut: list[int]
    left: list[int]
    right: list[int]
    value: list[float] = field(default_factory=list)

    def descend(self, column: Callable[[int], np.ndarray], at: dict[int, np.ndarray], only: set[int] | None = None) -> dict[int, np.ndarray]:
        """at, the rows by node, led on to the leaves. only: nodes beside which none is needed."""
        for k in range(len(self.feature)):  # children come after their parents
            if self.feature[k] >= 0 and k in at:
                rows, f = at.pop(k), column(self.feature[k])
                below = f.take(rows) <= self.cut[k]
                for child, side in ((self.left[k], below), (self.right[k], ~below)):
                    if only is None or child in only:
                        at[child] = rows.take(np.flatnonzero(side))
        return at

    def above(self, nodes: list[int]) -> set[int]:
        """The nodes and those that lead to them."""
        out = set(nodes)
        for k in reversed(range(len(self.feature))):
            if self.feature[k] >= 0 and (self.left[k] in out or self.right[k] in out):
                out.add(k)
        return out

    def add_to(self, margin: np.ndarray, column: Callable[[int], np.ndarray], rows: np.ndarray) -> None:
        """Adds the tree's values to the margins of the rows."""
        for k, own in self.descend(column, {0: rows}).items():
            margin[own] += self.value[k]


def to_bins(x: np.ndarray, thresholds: list[list[float]]) -> np.ndarray:
    """feature x row: how many thresholds of its feature are below each cell of x, which is row x feature."""
    out = np.empty(x.shape[::-1], np.uint8)
    for k, t in enumerate(thresholds):
        out[k] = np.searchsorted(t, x[:, k], side="left")
    return out


@dataclass
class Block:
    """Rows, all or none of them held out. bins: of each feature of `Columns.many` x row; feature, row: the cells in the
    upper bin, of the features of `Columns.two`. mix: the hash of a row's id that draws go on from, if there are such."""

    bins: np.ndarray
    feature: np.ndarray
    row: np.ndarray
    y: np.ndarray
    w: np.ndarray
    margin: np.ndarray
    mix: np.ndarray
    held: bool

    SCHEMA = "n int, held boolean, bins binary, feature binary, row binary, y binary, w binary, margin binary, mix binary"
    TYPES = {"feature": np.uint16, "row": np.uint16, "y": np.float64, "w": np.float64, "margin": np.float64, "mix": np.uint64}

    @classmethod
    def of(cls, row: Row) -> Block:
        own = {k: np.frombuffer(row[k], t) for k, t in cls.TYPES.items()}
        return cls(np.frombuffer(row.bins, np.uint8).reshape(-1, row.n), **own | {k: _small(own[k]) for k in ("y", "w")}, held=row.held)

    def stored(self) -> tuple:
        return (len(self.y), self.held, self.bins.tobytes(), *(np.ascontiguousarray(getattr(self, k), t).tobytes() for k, t in self.TYPES.items()))

    def column(self, columns: Columns) -> Callable[[int], np.ndarray]:
        """The bins of a feature by its number."""

        def get(f: int) -> np.ndarray:
            kind, k = columns.place[f]
            if kind == "many":
                return self.bins[k]
            out = np.zeros(len(self.y), np.uint8)
            out[self.row[self.feature == k]] = 1
            return out

        return get

    def after(self, trees: list[Tree], columns: Columns, rows: np.ndarray | None = None) -> np.ndarray:
        """The margins after more trees; right in `rows` only, if these are given."""
        margin, rows = self.margin.copy(), np.arange(len(self.y)) if rows is None else rows
        for t in trees:
            t.add_to(margin, self.column(columns), rows)
        return margin


@dataclass
class Layout:
    """The cells of a node: `most` for each of the features `many`, one for each of `two` (its upper bin), one for all."""

    many: list[int]
    two: list[int]
    most: int

    @property
    def cells(self) -> int:
        return len(self.many) * self.most + len(self.two) + 1


def splits(cells: np.ndarray, l2: float, least_curvature: float, least_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """cells: node x feature x bin x (gradient, curvature, rows). For each node: the gain of its best split (0 if none),
    feature, cut, and the sums on its left."""
    left = cells.cumsum(axis=2)
    whole = left[:, :1, -1:, :]
    right = whole - left
    score = lambda s: np.divide(s[..., 0] ** 2, s[..., 1] + l2, out=np.zeros(s.shape[:-1]), where=s[..., 1] + l2 > 0)
    gain = (score(left) + score(right) - score(whole)) / 2
    for side in (left, right):
        gain[(side[..., 1] < least_curvature) | (side[..., 2] < max(least_rows, 1))] = 0.0
    flat = gain.reshape(len(cells), -1)
    at = flat.argmax(axis=1)
    feature, cut = np.divmod(at, cells.shape[2])
    nodes = np.arange(len(cells))
    best = flat[nodes, at]
    return np.where(best > LEAST_GAIN, best, 0.0), feature, cut, left[nodes, feature, cut]


def best_splits(cells: np.ndarray, layout: Layout, *limits) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What `splits` gives for nodes x cells of the layout x (gradient, curvature, rows), with the feature's own number."""
    n, wide = len(cells), len(layout.many) * layout.most
    upper, whole = cells[:, wide:-1], cells[:, -1:]
    parts = [(layout.many, cells[:, :wide].reshape(n, -1, layout.most, 3)), (layout.two, np.stack([whole - upper, upper], axis=2))]
    best = (np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, 3)))
    for own, of in parts:
        if own:
            gain, at, cut, left = splits(of, *limits)
            feature = np.asarray(own)[at]
            wins = (gain > best[0]) | ((gain == best[0]) & (feature < best[1]))
            best = tuple(np.where(wins[:, None] if x.ndim > 1 else wins, x, y) for x, y in zip((gain, feature, cut, left), best, strict=True))
    return best


class _Shared(HasFeaturesCol, HasLabelCol, HasWeightCol, HasMaxIter, HasStepSize, HasSeed):
    depth = Param(Params._dummy(), "depth", "deepest level of a leaf; 0: none", TypeConverters.toInt)
    leaves = Param(Params._dummy(), "leaves", "most leaves of a tree; 0: any number", TypeConverters.toInt)
    l2 = Param(Params._dummy(), "l2", "added to the curvature of a leaf", TypeConverters.toFloat)
    leastCurvature = Param(Params._dummy(), "leastCurvature", "least curvature of a leaf", TypeConverters.toFloat)
    leastRows = Param(Params._dummy(), "leastRows", "least rows of a leaf", TypeConverters.toInt)
    bins = Param(Params._dummy(), "bins", "most bins of a feature, up to 256", TypeConverters.toInt)
    rowPart = Param(Params._dummy(), "rowPart", "part of the rows that a tree is drawn from", TypeConverters.toFloat)
    featurePart = Param(Params._dummy(), "featurePart", "part of the features that a tree may use", TypeConverters.toFloat)
    patience = Param(Params._dummy(), "patience", "stop after so many trees without gain on held-out rows; 0: never", TypeConverters.toInt)


class NewtonBoosting(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(
        self, *, featuresCol=None, labelCol=None, weightCol=None, maxIter=None, stepSize=None, seed=None, depth=None, leaves=None, l2=None,
        leastCurvature=None, leastRows=None, bins=None, rowPart=None, featurePart=None, patience=None,
    ):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", maxIter=100, stepSize=0.1, seed=0, depth=0, leaves=0, l2=0.0, leastCurvature=1e-3, leastRows=1, bins=255, rowPart=1.0, featurePart=1.0, patience=0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        if not 2 <= self._of("bins") <= 256:
            raise ValueError("bins: 2 to 256")

    def _of(self, name: str):
        return self.getOrDefault(name)

    def _fit(self, df: DataFrame) -> NewtonBoostingModel:
        weight = F.col(self.getWeightCol()).cast("double") if self.isSet(self.weightCol) else F.lit(1.0)
        spark, path = df.sparkSession, new_path(df.sparkSession, "features")
        df.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"), weight.alias("w")).write.parquet(path)
        rows = spark.read.schema("x array<double>, y double, w double").parquet(path)
        n, features, total, positive, unfit = rows.agg(
            F.count("*"), F.max(F.size("x")), F.sum("w"), F.sum(F.col("w") * F.col("y")), F.count_if(F.exists("x", lambda v: v.isNull() | F.isnan(v)) | F.col("y").isNull())
        ).first()
        if not n or not total:
            raise ValueError("no rows to learn from")
        if unfit:
            raise ValueError(f"{unfit} rows with a missing feature or label")
        thresholds = self._thresholds(rows, features)
        mean = min(max(positive / total, 1e-9), 1 - 1e-9)
        base = float(np.log(mean / (1 - mean)))
        growth = self._growth(features)
        work = _Rows(rows, thresholds, base, n, total, self._of("patience") > 0 and n > STOP_ROWS, growth)
        remove(spark, path)
        trees: list[Tree] = []
        losses: list[float] = []
        patience, stopped = self._of("patience"), False
        try:
            while len(trees) < self.getMaxIter() and not stopped:
                for tree, loss in work.next_trees(trees, self.getMaxIter()):
                    if loss is not None:
                        losses.append(loss)
                        if stopped := len(losses) > patience and min(losses[-patience:]) > losses[-patience - 1] - STOP_GAIN:
                            break
                    trees.append(tree)
        finally:
            work.remove()
        made = {"base": base, "thresholds": thresholds, "trees": [[t.feature, t.cut, t.left, t.right, t.value] for t in trees]}
        return NewtonBoostingModel(featuresCol=self.getFeaturesCol(), made=json.dumps(made))

    def _thresholds(self, rows: DataFrame, features: int) -> list[list[float]]:
        """The quantiles of each feature but its highest: tasks summarise their rows, and the summaries of a feature are put
        together in one."""
        parts = np.arange(1, self._of("bins")) / self._of("bins")

        def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, raw = [[] for _ in range(features)], []

            def summed() -> None:
                x = np.concatenate(raw)
                raw.clear()
                for k in range(features):
                    held[k] = [thinned([*held[k], np.unique(x[:, k], return_counts=True)])]

            for b in batches:
                raw.append(_matrix(b.column("x"), features))
                if sum(map(len, raw)) >= HELD:
                    summed()
            if raw:
                summed()
            for k, found in enumerate(held):
                for v, n in found:
                    yield pa.RecordBatch.from_pydict({"k": [k], "v": [v.tobytes()], "n": [n.astype(np.int64).tobytes()]}, pa.schema([("k", pa.int32()), ("v", pa.binary()), ("n", pa.binary())]))

        def quantiles(of: pd.DataFrame) -> pd.DataFrame:
            v, n = merged([(np.frombuffer(a), np.frombuffer(b, np.int64)) for a, b in zip(of["v"], of["n"], strict=True)])
            upto = n.cumsum()
            cuts = v[np.searchsorted(upto, np.ceil(parts * upto[-1]))]
            return pd.DataFrame({"k": of["k"].iloc[:1], "q": [np.unique(cuts[cuts < v[-1]])]})

        found = rows.select("x").mapInArrow(summaries, "k int, v binary, n binary").groupBy("k").applyInPandas(quantiles, "k int, q array<double>").collect()
        return [[v + 0.0 for v in r.q] for r in sorted(found)]  # no -0.0, which is told apart in JSON

    def _growth(self, features: int) -> Growth:
        return Growth(features, *(self._of(x) for x in ("l2", "leastCurvature", "leastRows", "depth", "leaves", "stepSize", "rowPart", "featurePart")), self.getSeed())


#: (shape so far, nodes to look at, layout) -> their cells, and the loss on the rows held out at the root.
Histograms = Callable[[Tree, list[int], Layout], tuple[np.ndarray, float | None]]


@dataclass
class Growth:
    """How trees grow: the parameters of the estimator."""

    features: int
    l2: float
    least_curvature: float
    least_rows: int
    depth: int
    leaves: int
    step: float
    row_part: float
    feature_part: float
    seed: int

    def used(self, k: int) -> np.ndarray:
        """The features that the tree after k trees may use."""
        draw = np.random.RandomState([self.seed & 0x7FFFFFFF, k])
        return np.sort(draw.permutation(self.features)[: max(1, round(self.feature_part * self.features))])

    def drawn(self, k: int, mix: np.ndarray) -> np.ndarray:
        """Whether the tree after k trees is drawn from each row: the low bits of Spark's xxhash64 of id, seed and k."""
        return (_hash_on(mix, k) & np.uint64((1 << 20) - 1)) < int(self.row_part * (1 << 20)) if self.row_part < 1 else np.ones(len(mix), bool)

    def rows(self, k: int, b: Block) -> np.ndarray:
        """The rows of a block that the tree after k trees is drawn from."""
        return np.flatnonzero(self.drawn(k, b.mix)) if self.row_part < 1 else np.arange(len(b.y))

    def tree(self, k: int, histograms: Histograms, columns: Columns) -> tuple[Tree, float | None]:
        """The tree after k trees, and the loss of those on the rows held out, if there are such."""
        layout = columns.layout(self.used(k))
        nodes, loss = [Node(0.0, 0.0, 0, 0)], None
        pending, known, parent = [0], {}, {}
        while pending:
            asked, rest = _smaller(nodes, pending, parent)
            found, lost = histograms(_shape(nodes), asked, layout)
            loss = lost if pending == [0] else loss
            known |= dict(zip(asked, found, strict=True))
            for at, sibling in rest.items():
                known[at] = known[parent[at]] - known[sibling]
            looked = {parent[at] for at in pending if at in parent}
            known = {at: cells for at, cells in known.items() if at not in looked}
            gain, feature, cut, left = best_splits(np.stack([known[at] for at in pending]), layout, self.l2, self.least_curvature, self.least_rows)
            for j, at in enumerate(pending):
                node, whole = nodes[at], known[at][-1]
                node.gradient, node.curvature, node.rows, node.gain = whole[0], whole[1], int(whole[2]), float(gain[j])
                if node.gain > 0:
                    node.feature, node.cut, node.left, node.right = int(feature[j]), int(cut[j]), len(nodes), len(nodes) + 1
                    for s in (left[j], whole - left[j]):
                        child = Node(s[0], s[1], int(s[2]), node.depth + 1)
                        small = child.rows < 2 * max(self.least_rows, 1) or child.curvature < 2 * self.least_curvature
                        child.gain = 0.0 if small or (self.depth and child.depth >= self.depth) else None
                        parent[len(nodes)] = at
                        nodes.append(child)
            split, pending = best_first(nodes, self.leaves)
        return _finished(nodes, split, self.l2, self.step), loss


def _smaller(nodes: list[Node], pending: list[int], parent: dict[int, int]) -> tuple[list[int], dict[int, int]]:
    """The pending nodes to sum, and those that are the parent's cells less the sibling's: of two the one of more rows."""
    asked, rest, both = [], {}, set(pending)
    for at in pending:
        up = nodes[parent[at]] if at in parent else None
        sibling = up and (up.right if at == up.left else up.left)
        if sibling in both and (nodes[at].rows, at) > (nodes[sibling].rows, sibling):
            rest[at] = sibling
        else:
            asked.append(at)
    return asked, rest


@dataclass
class Columns:
    """How features are summed. bins: how many each has; same: the first feature with equal bins in all rows. place: whether
    a feature is one of the features `many`, of more than two bins, or of those of `two`, and the number there."""

    bins: list[int]
    same: list[int]
    many: list[int] = field(init=False)
    two: list[int] = field(init=False)
    place: dict[int, tuple[str, int]] = field(init=False)

    def __post_init__(self) -> None:
        first = sorted(set(self.same))
        self.many, self.two = [f for f in first if self.bins[f] > 2], [f for f in first if self.bins[f] == 2]
        at = {f: (kind, k) for kind, own in (("many", self.many), ("two", self.two)) for k, f in enumerate(own)}
        self.place = {f: at[g] for f, g in enumerate(self.same) if g in at}

    def layout(self, used: np.ndarray) -> Layout:
        """One of each set of equal features; none of those of one value."""
        first = {self.same[f]: int(f) for f in used[::-1] if self.bins[f] > 1}
        own = sorted(first.values())
        many = [f for f in own if self.bins[f] > 2]
        return Layout(many, [f for f in own if self.bins[f] == 2], max(2, *self.bins))


def best_first(nodes: list[Node], leaves: int) -> tuple[list[int], list[int]]:
    """The nodes that are split, the highest gain first, as far as the leaves go; and those that must be looked at before
    this is sure. A node not looked at yet competes with nobody, so none that the full tree splits is left out."""
    split: list[int] = []
    unknown: list[int] = []
    heap = [(-nodes[0].gain, 0)] if nodes[0].gain else []
    while heap and not (leaves and len(split) >= leaves - 1):
        _, at = heapq.heappop(heap)
        split.append(at)
        if leaves and len(split) >= leaves - 1:
            break
        for child in (nodes[at].left, nodes[at].right):
            if nodes[child].gain is None:
                unknown.append(child)
            elif nodes[child].gain > 0:
                heapq.heappush(heap, (-nodes[child].gain, child))
    return split, unknown


def _shape(nodes: list[Node]) -> Tree:
    return Tree([x.feature for x in nodes], [x.cut for x in nodes], [x.left for x in nodes], [x.right for x in nodes])


def _finished(nodes: list[Node], split: list[int], l2: float, step: float) -> Tree:
    """The tree of the nodes that are split and of their children, numbered anew from the root."""
    order = [0, *(c for at in split for c in (nodes[at].left, nodes[at].right))]
    number, inner = {at: k for k, at in enumerate(order)}, set(split)
    of = [(nodes[at], at in inner) for at in order]
    value = [-step * x.gradient / (x.curvature + l2) if x.curvature + l2 > 0 else 0.0 for x, _ in of]
    return Tree(
        [x.feature if s else -1 for x, s in of], [x.cut if s else 0 for x, s in of],
        [number[x.left] if s else 0 for x, s in of], [number[x.right] if s else 0 for x, s in of], [float(v) for v in value],
    )


def _drawn(of: str, part: float, seed: int, k: int | Column) -> Column:
    return F.pmod(F.xxhash64(of, F.lit(seed), k if isinstance(k, Column) else F.lit(k)), F.lit(1 << 20)) < int(part * (1 << 20))


def _hash_on(h: np.ndarray, k: int) -> np.ndarray:
    """Spark's xxhash64 of one more integer, from the hash of what is before it."""
    p1, p2, p3, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        h = (h + p5 + np.uint64(4)) ^ (np.uint64(k) * p1)
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def add_sums(out: np.ndarray, b: Block, margin: np.ndarray, rows: list[np.ndarray], layout: Layout, columns: Columns, scale: float) -> None:
    """Adds to out, which is node x cell x (gradient, curvature, rows), the sums of the rows of each node, in whole multiples
    of 1 / scale."""
    slots, own = len(rows), rows[0] if len(rows) == 1 else np.concatenate(rows)
    if not len(own):
        return
    every = len(own) == len(b.y) and slots == 1
    at = np.repeat(np.arange(slots), [len(r) for r in rows])
    y, w, margin = (x if every else x.take(own) for x in (b.y, b.w, margin))
    p = 1 / (1 + np.exp(-margin))
    g, h = np.rint(w * (p - y) * scale), np.rint(w * p * (1 - p) * scale)
    base, cell = at * layout.most, np.empty(len(own), np.int64)

    def add(cells: slice, cell: np.ndarray, each: int, g: np.ndarray, h: np.ndarray) -> None:
        for k, v in enumerate((np.bincount(cell, g, slots * each), np.bincount(cell, h, slots * each), np.bincount(cell, minlength=slots * each))):
            out[:, cells, k] += v.reshape(slots, each)

    for j, f in enumerate(layout.many):
        column = b.bins[columns.place[f][1]]
        np.add(base, column if every else column.take(own), out=cell)
        add(slice(j * layout.most, (j + 1) * layout.most), cell, layout.most, g, h)
    if layout.two:
        place = np.full(len(columns.two), -1)
        place[[columns.place[f][1] for f in layout.two]] = np.arange(len(layout.two))
        where = np.full(len(b.y), -1)
        where[own] = np.arange(len(own))
        feature, of = place.take(b.feature), where.take(b.row)
        some = np.flatnonzero((feature >= 0) & (of >= 0))
        feature, of = feature.take(some), of.take(some)
        wide = len(layout.many) * layout.most
        add(slice(wide, wide + len(layout.two)), at.take(of) * len(layout.two) + feature, len(layout.two), g.take(of), h.take(of))
    add(slice(layout.cells - 1, layout.cells), at, 1, g, h)


def loss_of(b: Block, margin: np.ndarray, scale: float) -> np.ndarray:
    """Loss and weight of the rows, in whole multiples of 1 / scale."""
    each = np.logaddexp(0, margin) - b.y * margin
    return np.array([np.rint(b.w * each * scale).sum(), np.rint(b.w * scale).sum()])


class _Rows:
    """The binned rows with their margins: blocks in the executors' storage, stored anew every FOLD trees. Lost ones are
    worked out again from the table that was written last. The hash of an id only draws rows: it is fixed when they are
    written."""

    def __init__(self, rows: DataFrame, thresholds: list[list[float]], base: float, n: int, total: float, hold: bool, growth: Growth):
        self.spark: SparkSession = rows.sparkSession
        self.scale = 2.0 ** min(40, 52 - int(np.ceil(np.log2(total + 1))))
        self.growth, self.recent, self.cut = growth, [], 0
        features, draws = len(thresholds), growth.row_part < 1

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = batch.column("held").to_numpy(zero_copy_only=False)
                x, y, w, mix = (_matrix(batch.column("x"), features), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "mix")))
                for side in (True, False):
                    own = np.flatnonzero(held == side)
                    for rows in (own[k : k + PIECE] for k in range(0, len(own), PIECE)):
                        mixed = mix[rows].tobytes() if draws else b""
                        yield pa.RecordBatch.from_pylist([{"n": len(rows), "held": side, "bins": to_bins(x[rows], thresholds).tobytes(), "y": y[rows].tobytes(), "w": w[rows].tobytes(), "mix": mixed}], _PIECE)

        made = rows.withColumn("id", F.monotonically_increasing_id())
        held = _drawn("id", STOP_PART, -1, -1) if hold else F.lit(False)
        made = made.select("x", "y", "w", F.xxhash64("id", F.lit(growth.seed)).alias("mix"), held.alias("held")).mapInArrow(pieces, "n int, held boolean, bins binary, y binary, w binary, mix binary")
        size = n * (features + ROW_BYTES)
        self.files = 1 if size <= FILE_BYTES else max(2, self.spark.sparkContext.defaultParallelism, -(-size // MOST_BYTES))
        self.path = new_path(self.spark, "boosting")
        (made.repartition(self.files) if self.files > 1 else made.coalesce(1)).write.parquet(self.path)
        table = self.spark.read.schema(made.schema).parquet(self.path).rdd
        bins, same = [len(t) + 1 for t in thresholds], np.arange(features)
        shaped = lambda r: np.frombuffer(r.bins, np.uint8).reshape(-1, r.n)
        apart = self._reduced(table, lambda own: _apart(map(shaped, own), bins), np.logical_or)
        self.columns = columns = Columns(bins, [int(np.flatnonzero(~apart[: f + 1, f])[0]) for f in same])
        self.rows = table.mapPartitions(lambda own: _blocks(own, columns, base)).persist(StorageLevel.MEMORY_AND_DISK_DESER)
        self.old: RDD | None = None

    def _reduced(self, rows: RDD, f: Callable[[Iterator], object], add: Callable) -> object:
        """f of each partition, put together: by the driver, or by tasks first where there are many."""
        parts = rows.mapPartitions(lambda own: [f(own)])
        return parts.treeReduce(add) if parts.getNumPartitions() > PARTIAL else parts.reduce(add)

    def remove(self) -> None:
        for rows in (self.rows, self.old):
            if rows is not None:
                rows.unpersist()
        remove(self.spark, self.path)

    def _add(self, tree: Tree) -> None:
        self.recent.append(tree)
        if len(self.recent) < FOLD:
            return
        recent, columns = self.recent, self.columns

        def moved(own: Iterator[Block]) -> Iterator[Block]:
            for b in own:
                b.margin = b.after(recent, columns)
                yield b

        self.old, self.rows, self.recent = self.rows, self.rows.mapPartitions(moved), []
        self.cut += FOLD
        if self.cut >= CUT:
            path, self.cut = new_path(self.spark, "boosting"), 0
            self.spark.createDataFrame(self.rows.map(Block.stored), Block.SCHEMA).write.parquet(path)
            self.rows = self.spark.read.schema(Block.SCHEMA).parquet(path).rdd.map(Block.of)
            remove(self.spark, self.path)
            self.path = path
        self.rows = self.rows.persist(StorageLevel.MEMORY_AND_DISK_DESER)

    def next_trees(self, trees: list[Tree], most: int) -> Iterator[tuple[Tree, float | None]]:
        """One or more of the trees that follow, and the loss on the rows held out before each."""
        if self.files == 1:
            yield from self._alone(trees, min(most, len(trees) + ALONE))
            return
        k = len(trees)
        found = self.growth.tree(k, lambda shape, pending, layout: self._histograms(shape, pending, layout, k), self.columns)
        yield found
        self._add(found[0])

    def _alone(self, trees: list[Tree], end: int) -> Iterator[tuple[Tree, float | None]]:
        """The trees up to number `end`, from a task that has all rows."""
        growth, scale, columns, begin = self.growth, self.scale, self.columns, len(trees)

        def grown(rows: Iterator[Block]) -> Iterator[tuple]:
            own = list(rows)
            for b in own:
                b.margin = b.after(trees, columns)
            for k in range(begin, end):
                at = [{0: growth.rows(k, b)} for b in own]

                def histograms(shape: Tree, pending: list[int], layout: Layout, at=at) -> tuple[np.ndarray, float | None]:
                    sums, losses = np.zeros((len(pending), layout.cells, 3)), np.zeros(2)
                    for b, a in zip(own, at, strict=True):
                        if not b.held:
                            shape.descend(b.column(columns), a)
                            add_sums(sums, b, b.margin, [a[node] for node in pending], layout, columns, scale)
                        elif pending == [0]:
                            losses += loss_of(b, b.margin, scale)
                    return _unscaled(sums, losses, scale)

                tree, loss = growth.tree(k, histograms, columns)
                yield [tree.feature, tree.cut, tree.left, tree.right, tree.value], loss
                for b in own:
                    b.margin = b.after([tree], columns)

        for tree, loss in self.rows.coalesce(1).mapPartitions(grown).collect():
            yield Tree(*tree), loss

    def _histograms(self, shape: Tree, pending: list[int], layout: Layout, k: int) -> tuple[np.ndarray, float | None]:
        """pending nodes x cells x (gradient, curvature, rows) of the rows drawn, and the mean loss of the rows held out, when
        the root is looked at."""
        growth, scale, columns, recent, only = self.growth, self.scale, self.columns, self.recent, shape.above(pending)

        def summed(blocks: Iterator[Block]) -> tuple[np.ndarray, np.ndarray]:
            sums, losses = np.zeros((len(pending), layout.cells, 3)), np.zeros(2)
            for b in blocks:
                if not b.held:
                    at = shape.descend(b.column(columns), {0: growth.rows(k, b)}, only)
                    rows = [at[node] for node in pending]
                    add_sums(sums, b, b.after(recent, columns, np.concatenate(rows)), rows, layout, columns, scale)
                elif pending == [0]:
                    losses += loss_of(b, b.after(recent, columns), scale)
            return sums, losses

        found = self._reduced(self.rows, summed, lambda a, b: (a[0] + b[0], a[1] + b[1]))
        if self.old is not None:  # the new blocks are stored
            self.old.unpersist()
            self.old = None
        return _unscaled(*found, scale)


_PIECE = pa.schema([("n", pa.int32()), ("held", pa.bool_()), *((c, pa.binary()) for c in ("bins", "y", "w", "mix"))])


def _matrix(x: pa.Array, features: int) -> np.ndarray:
    """row x feature, of lists without nulls."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), features)


def _blocks(pieces: Iterator[Row], columns: Columns, base: float) -> Iterator[Block]:
    """Blocks of the rows of the pieces, BLOCK at most at once."""
    waiting: dict[bool, list[Row]] = {False: [], True: []}

    def block(own: list[Row]) -> Block:
        bins = np.concatenate([np.frombuffer(r.bins, np.uint8).reshape(-1, r.n) for r in own], axis=1)
        feature, row = np.nonzero(bins[columns.two])
        y, w, mix = (np.frombuffer(b"".join(r[c] for r in own), t) for c, t in (("y", np.float64), ("w", np.float64), ("mix", np.uint64)))
        return Block(bins[columns.many], feature.astype(np.uint16), row.astype(np.uint16), *map(_small, (y, w)), np.full(len(y), base), mix, own[0].held)

    for r in pieces:
        if sum(x.n for x in waiting[r.held]) + r.n > BLOCK:
            yield block(waiting[r.held])
            waiting[r.held] = []
        waiting[r.held].append(r)
    for own in waiting.values():
        if own:
            yield block(own)


def _small(x: np.ndarray) -> np.ndarray:
    """x in a byte each, if these are the same numbers."""
    small = np.clip(x, 0, 255).astype(np.uint8)
    return small if np.array_equal(small, x) else x


#: Values in order, and how many rows each stands for.
Summary = tuple[np.ndarray, np.ndarray]


def merged(parts: list[Summary]) -> Summary:
    """The distinct values of all parts, with the rows of each."""
    if len(parts) == 1:
        return parts[0]
    v, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(v, kind="stable")
    v, n = v[order], n[order]
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    return v[first], np.add.reduceat(n, first)


def thinned(parts: list[Summary]) -> Summary:
    """All parts as one; of over RANKS values only those that ranks fall to and those of a rank's rows or more, each for the
    rows up to it."""
    v, n = merged(parts)
    if len(v) <= RANKS:
        return v, n
    upto = n.cumsum()
    rank = -(-upto * RANKS // upto[-1])
    last = np.flatnonzero(np.append(rank[1:] != rank[:-1], True) | (n * RANKS >= upto[-1]))
    return v[last], np.diff(upto[last], prepend=0)


def _apart(pieces: Iterable[np.ndarray], bins: list[int]) -> np.ndarray:
    """feature x feature: whether their bins differ in some row. pieces: feature x row."""
    out = np.not_equal.outer(bins, bins)
    for b in pieces:
        for i, j in zip(*np.nonzero(np.triu(~out, 1)), strict=True):
            out[i, j] = not np.array_equal(b[i], b[j])
    return out


def _unscaled(sums: np.ndarray, losses: np.ndarray, scale: float) -> tuple[np.ndarray, float | None]:
    return sums / np.array([scale, scale, 1.0]), float(losses[0] / losses[1]) if losses[1] else None


class NewtonBoostingModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `probability`, the chances of 0 and 1. A NaN feature goes to the highest bin."""

    made = Param(Params._dummy(), "made", "first margin, thresholds and trees, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", made=None):
        super().__init__()
        self._set(featuresCol=featuresCol, **({"made": made} if made else {}))

    def trees(self) -> list[Tree]:
        return [Tree(*t) for t in json.loads(self.getOrDefault("made"))["trees"]]

    def _transform(self, df: DataFrame) -> DataFrame:
        made, trees = json.loads(self.getOrDefault("made")), self.trees()
        base, thresholds = made["base"], made["thresholds"]

        def chances(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            bins, margin, rows = to_bins(np.stack(x.to_numpy()), thresholds), np.full(len(x), base), np.arange(len(x))
            for t in trees:
                t.add_to(margin, bins.__getitem__, rows)
            return pd.Series(1 / (1 + np.exp(-margin)))

        p = F.pandas_udf(chances, "double")(vector_to_array(self.getFeaturesCol()))
        return df.withColumn("probability", p).withColumn("probability", array_to_vector(F.array(1 - F.col("probability"), F.col("probability"))))
