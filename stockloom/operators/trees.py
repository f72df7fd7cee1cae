"""Histogram regression trees grown by Spark: forests, and boosting level by level, best leaf first or by symmetric levels.

Rows are binned once. A pass over them sums gradients and counts by node, feature and bin in every task, Spark adds the sums up, and
the driver picks splits from them: what it holds grows with nodes, features and bins, never with rows. Of two children only the one with
fewer rows is summed up, the other has the rest of their parent's sums. A pass serves all trees that grow
at the time, of all learners. Best-first growth asks for the children of every leaf that would be split if unknown leaves gained
nothing, so it needs about as many passes as the tree is deep, and ends with the tree that one split at a time gives.

Targets, margins and leaf values are whole numbers in units of 1 / ``GRID``, so sums don't depend on how rows are partitioned, and a
repeated or recovered pass gives the same trees. With gradient sum ``G`` and weight ``N`` a leaf is worth ``-T(G) / (N + l2)`` and a
node scores ``T(G)**2 / (N + l2)``, where ``T`` moves ``G`` towards 0 by ``l1``. Ties go to the first feature and bin, or the first node.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.session import pin

GRID = 1 << 20
HASH = 1 << 28
#: Cells of a pass: nodes times features times bins. More nodes than that take several passes.
CELLS = 1 << 20
#: Rounds after which the rows are written anew with their margins, so that a pass walks few trees.
KEEP_ROUNDS = 10


@dataclass(frozen=True)
class Learner:
    """One ensemble. ``policy`` is ``depth``, ``leaf`` (best first, up to ``leaves``) or ``symmetric`` (one split a level)."""

    name: str
    features: tuple[str, ...]
    trees: int
    depth: int
    policy: str = "depth"
    leaves: int = 0
    boosted: bool = True
    rate: float = 0.1
    l1: float = 0.0
    l2: float = 0.0
    row_share: float = 1.0
    feature_share: float = 1.0
    least_leaf: int = 1
    least_split: int = 2
    seed: int = 42

    def tree_features(self, tree: int) -> list[int]:
        """The features that a tree may use, by the order of a digest."""
        def place(i: int) -> str:
            return hashlib.md5(f"{self.seed}|{tree}|{self.features[i]}".encode()).hexdigest()

        wanted = max(1, math.ceil(self.feature_share * len(self.features)))
        return sorted(sorted(range(len(self.features)), key=place)[:wanted])


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    """Gradient sums moved towards 0 by the L1 penalty."""
    g = np.asarray(g, dtype=np.float64)
    return np.sign(g) * np.maximum(np.abs(g) - l1 * GRID, 0.0)


def score(g: np.ndarray, n: np.ndarray, l1: float, l2: float) -> np.ndarray:
    t = shrunk(g, l1)
    weight = np.asarray(n, dtype=np.float64) + l2
    return np.divide(t * t, weight, out=np.zeros_like(weight), where=weight > 0)


def leaf_value(g: int, n: int, learner: Learner) -> int:
    rate = learner.rate if learner.boosted else 1.0
    weight = n + learner.l2
    return math.floor(-rate * float(shrunk(g, learner.l1)) / weight + 0.5) if weight else 0


@dataclass
class Node:
    g: int
    n: int
    depth: int
    sums: np.ndarray | None = None  # features x bins x (gradient, weight)
    split: tuple[float, int, int] | None = None  # gain, feature, last bin to the left


@dataclass
class Growing:
    """A tree under way. Nodes are numbered as in a heap: the children of ``i`` are ``2 i`` and ``2 i + 1``."""

    learner: Learner
    number: int
    bins: int
    nodes: dict[int, Node] = field(default_factory=dict)
    splits: dict[int, tuple[int, int]] = field(default_factory=dict)  # known splits, some only asked about
    wanted: list[int] = field(default_factory=lambda: [1])
    final: set[int] | None = None

    def __post_init__(self) -> None:
        self.features = self.learner.tree_features(self.number)

    def give(self, code: int, sums: np.ndarray) -> None:
        """Take the sums of a node that was asked for; its sibling's are what they leave of their parent's."""
        if code not in self.nodes:
            self.nodes[code] = Node(int(sums[0, :, 0].sum()), int(sums[0, :, 1].sum()), 0)
        if code == 1:
            return self._take(code, sums)
        for c, own in ((code, sums), (code ^ 1, self.nodes[code // 2].sums - sums)):
            if self.nodes[c].sums is None and self.may_split(self.nodes[c]):
                self._take(c, own)

    def _take(self, code: int, sums: np.ndarray) -> None:
        node = self.nodes[code]
        node.sums = sums
        if self.learner.policy != "symmetric":
            gain = self.gains(node)
            best = int(gain.argmax())
            if gain.flat[best] > 0:
                node.split = (float(gain.flat[best]), self.features[best // gain.shape[1]], best % gain.shape[1])

    def gains(self, node: Node) -> np.ndarray:
        """Gain of cutting behind each bin of each feature; 0 where a side would be too small."""
        lr = self.learner
        left = np.cumsum(node.sums, axis=1)[:, :-1]
        lg, ln = left[..., 0], left[..., 1]
        rg, rn = node.g - lg, node.n - ln
        gain = score(lg, ln, lr.l1, lr.l2) + score(rg, rn, lr.l1, lr.l2) - score(np.array(node.g), np.array(node.n), lr.l1, lr.l2)
        allowed = (ln >= lr.least_leaf) & (rn >= lr.least_leaf) & (node.n >= lr.least_split)
        return np.where(allowed, gain, 0.0)

    def open(self, code: int, feature: int, cut: int) -> list[int]:
        """Split a node; if a child may be split again and its sums are not known, the child with fewer rows, which tells them."""
        node = self.nodes[code]
        if code not in self.splits:
            g, n = node.sums[self.features.index(feature), : cut + 1].sum(axis=0).tolist()
            self.splits[code] = (feature, cut)
            self.nodes[2 * code] = Node(g, n, node.depth + 1)
            self.nodes[2 * code + 1] = Node(node.g - g, node.n - n, node.depth + 1)
        children = (2 * code, 2 * code + 1)
        unknown = any(self.nodes[c].sums is None and self.may_split(self.nodes[c]) for c in children)
        return [min(children, key=lambda c: self.nodes[c].n)] if unknown else []

    def may_split(self, node: Node) -> bool:
        if self.learner.policy == "symmetric":
            return node.depth < self.learner.depth and node.n > 0
        return node.depth < self.learner.depth and node.n >= max(self.learner.least_split, 2 * self.learner.least_leaf)

    def advance(self) -> None:
        """Find which nodes are still wanted; if none is, the tree is final."""
        if self.learner.policy == "symmetric":
            return self._advance_level()
        limit = self.learner.leaves if self.learner.policy == "leaf" else math.inf
        done: set[int] = set()
        self.wanted = []
        heap = [(-self.nodes[1].split[0], 1)] if self.nodes[1].split else []
        while heap and len(done) + 1 < limit:
            code = heapq.heappop(heap)[1]
            done.add(code)
            self.wanted += self.open(code, *self.nodes[code].split[1:])
            for child in (2 * code, 2 * code + 1):
                if self.nodes[child].split:
                    heapq.heappush(heap, (-self.nodes[child].split[0], child))
        if not self.wanted:
            self.final = done

    def _advance_level(self) -> None:
        self.wanted = []
        level = [c for c in self.nodes if 2 * c not in self.nodes]
        ready = [c for c in level if self.nodes[c].sums is not None]
        if ready and self.nodes[ready[0]].depth < self.learner.depth:
            total = sum(self.gains(self.nodes[c]) for c in sorted(ready))
            best = int(total.argmax())
            if total.flat[best] > 0:
                for c in sorted(level):
                    if self.nodes[c].sums is None:  # an empty node is split all the same
                        self.nodes[c].sums = np.zeros((len(self.features), self.bins, 2), dtype=np.int64)
                    self.wanted += self.open(c, self.features[best // total.shape[1]], best % total.shape[1])
                if self.wanted:
                    return
        self.final = set(self.splits)

    def tree(self) -> Tree:
        return Tree.of(self.splits, self.nodes, self.final, self.learner)


@dataclass
class Tree:
    """Flat arrays; ``feature`` is -1 at a leaf."""

    code: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, splits: dict, nodes: dict[int, Node], inner: set[int], learner: Learner | None = None) -> Tree:
        codes = [1]
        for code in codes:
            if code in inner:
                codes += [2 * code, 2 * code + 1]
        at = {c: i for i, c in enumerate(codes)}
        split = [splits[c] if c in inner else (-1, 0) for c in codes]
        known = [nodes.get(c) for c in codes]
        return cls(
            np.array(codes, dtype=object), np.array([f for f, _ in split]), np.array([b for _, b in split]),
            np.array([at.get(2 * c, 0) for c in codes]), np.array([at.get(2 * c + 1, 0) for c in codes]),
            np.array([0 if c in inner or n is None or learner is None else leaf_value(n.g, n.n, learner) for c, n in zip(codes, known, strict=True)]),
            np.array([n.split[0] if c in inner and n and n.split else 0.0 for c, n in zip(codes, known, strict=True)]),
            np.array([n.n if n else 0 for n in known]),
        )

    def bare(self) -> Tree:
        """What is needed to walk the tree."""
        none = np.zeros(0)
        return Tree(none, self.feature, self.cut, self.left, self.right, self.value, none, none)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row, a level of all rows at a time."""
        at = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        while len(rows):
            feature = self.feature[at[rows]]
            rows, feature = rows[feature >= 0], feature[feature >= 0]
            here = at[rows]
            at[rows] = np.where(bins[rows, feature] > self.cut[here], self.right[here], self.left[here])
        return at


@dataclass
class Ensemble:
    """A fitted learner; ``columns`` are the places of its features in the binned row.

    ``passed`` holds the milliseconds from the start of the fit to the end of each tree that this fit grew.
    """

    learner: Learner
    columns: list[int]
    base: int
    trees: list[Tree] = field(default_factory=list)
    passed: list[int] = field(default_factory=list)

    def margins(self, bins: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """Margins of boosted trees, on from ``start`` if these are not all, or the sum of a forest's, in units of the grid."""
        own = bins[:, self.columns]
        out = np.full(len(bins), self.base, dtype=np.int64) if start is None else start.copy()
        for tree in self.trees:
            out += tree.value[tree.leaves(own)]
        return out

    def predict(self, bins: np.ndarray) -> np.ndarray:
        margins = self.margins(bins)
        return margins / (1.0 if self.learner.boosted else max(len(self.trees), 1)) / GRID


def bag(hashes: np.ndarray, tree: int) -> np.ndarray:
    """A number below ``HASH`` for each row and tree."""
    factor = 2654435 * (2 * tree + 1) % HASH
    return (hashes.astype(np.int64) * factor + 12345 * tree) % HASH


def poisson_steps() -> list[int]:
    """Where a number below ``HASH`` has one more copy of its row in a sample with replacement."""
    out, p, total = [], math.exp(-1.0), 0.0
    for k in range(8):
        total += p
        out.append(math.floor(total * HASH))
        p /= k + 1
    return out


def weights(learner: Learner, hashes: np.ndarray, tree: int) -> np.ndarray:
    """How often each row counts in a tree."""
    if not learner.boosted:
        return np.searchsorted(np.array(poisson_steps()), bag(hashes, tree), side="right").astype(np.int64)
    if learner.row_share >= 1.0:
        return np.ones(len(hashes), dtype=np.int64)
    return (bag(hashes, tree) < math.floor(learner.row_share * HASH)).astype(np.int64)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The bins of a batch, a row for each row."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def _pass(rows: DataFrame, ensembles: Sequence[Ensemble], asked: list[tuple[int, Growing, list[int]]], kept: int, width: int, bins: int) -> dict:
    """Sums of the asked nodes, ``(place in asked, node) -> features x bins x 2``."""
    plan, cells = [], 0
    for e, tree, codes in asked:
        walk = Tree.of(tree.splits, tree.nodes, set(tree.splits))
        slot = {c: i for i, c in enumerate(codes)}
        slots = np.array([slot.get(c, -1) for c in walk.code])
        plan.append((e, tree.number, tree.features, walk, slots, cells, len(codes)))
        cells += len(codes) * len(tree.features) * bins
    # what travels to the tasks is no more than the trees that the stored margins lack
    known = [Ensemble(e.learner, e.columns, e.base, [t.bare() for t in e.trees[kept:]] if e.learner.boosted else []) for e in ensembles]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((cells, 2), dtype=np.int64)
        for batch in batches:
            binned = matrix(batch.column(2), width)
            hashes, target = (batch.column(i).to_numpy() for i in (0, 1))
            margins = np.array(batch.column(3).flatten()).reshape(len(target), -1)
            gradient: dict[int, np.ndarray] = {}
            columns: dict[int, np.ndarray] = {}
            for e, number, features, walk, slots, first, count in plan:
                ensemble = known[e]
                if e not in gradient:
                    gradient[e] = ensemble.margins(binned, margins[:, e]) - target if ensemble.learner.boosted else -target
                    columns[e] = binned[:, ensemble.columns]
                own = columns[e]
                weight = weights(ensemble.learner, hashes, number)
                slot = slots[walk.leaves(own)]
                pick = np.flatnonzero((slot >= 0) & (weight > 0))
                if not len(pick):
                    continue
                place = (slot[pick, None] * len(features) + np.arange(len(features))) * bins + own[np.ix_(pick, features)]
                for side, value in enumerate((gradient[e][pick] * weight[pick], weight[pick])):
                    # batches are small enough for doubles to add whole numbers exactly
                    sums = np.bincount(place.ravel(), np.repeat(value, len(features)).astype(np.float64), count * len(features) * bins)
                    total[first : first + len(sums), side] += sums.astype(np.int64)
        at = np.flatnonzero(total[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at, 0]), pa.array(total[at, 1])], names=["cell", "g", "n"])

    parts = rows.select("hash", "target", "bins", "margins").mapInArrow(run, "cell long, g long, n long")
    found = parts.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toPandas()
    total = np.zeros((cells, 2), dtype=np.int64)
    total[found["cell"].to_numpy(dtype=np.int64)] = found[["g", "n"]].to_numpy(dtype=np.int64)
    out = {}
    for i, ((_, tree, codes), (*_, first, count)) in enumerate(zip(asked, plan, strict=True)):
        size = len(tree.features) * bins
        for j, code in enumerate(codes):
            out[i, code] = total[first + j * size : first + (j + 1) * size].reshape(len(tree.features), bins, 2)
    return out


def fit(
    rows: DataFrame, learners: Sequence[Learner], columns: Sequence[str], bins: int, cells: int = CELLS, keep: int = KEEP_ROUNDS,
    known: Sequence[Ensemble] = (), each: Callable[[list[Ensemble]], None] | None = None,
) -> list[Ensemble]:
    """Fit all learners side by side on ``hash, target, bins``: a row hash, the target on the grid, and a byte for each of ``columns``.

    Trees of ``known`` ensembles are not grown again. ``each`` gets the ensembles so far whenever one is complete or has ``keep`` more
    trees than at the last call; a fit that goes on from them ends with the same trees.
    """
    first = rows.agg(F.sum("target"), F.count(F.lit(1))).first()
    base = math.floor(first[0] / first[1] + 0.5) if first[1] else 0
    out = [Ensemble(lr, [columns.index(f) for f in lr.features], base if lr.boosted else 0) for lr in learners]
    if not first[1]:
        return out
    for e in out:
        e.trees += next((k.trees for k in known if k.learner.name == e.learner.name), [])
    told = [len(e.trees) for e in out]
    begun = time.monotonic()
    start = F.array(*[F.lit(e.base).cast("long") for e in out])
    rows = pin(rows.select("hash", "target", "bins", start.alias("margins")))
    width, kept = len(columns), 0
    growing: dict[int, list[Growing]] = {}
    while True:
        for e, ensemble in enumerate(out):
            lr = ensemble.learner
            if not growing.get(e) and len(ensemble.trees) < lr.trees:
                # trees of a forest don't wait for each other
                together = min(lr.trees - len(ensemble.trees), 1 if lr.boosted else 16)
                growing[e] = [Growing(lr, len(ensemble.trees) + i, bins) for i in range(together)]
        if not any(growing.values()):
            return out
        most = min((len(out[e].trees) for e in growing if out[e].learner.boosted and growing[e]), default=0)
        if most - kept >= keep:
            rows, kept = _with_margins(rows, out, kept, most, width), most
        asked, used = [], 0
        for e, trees in growing.items():
            for tree in trees:
                room = max((cells - used) // (len(tree.features) * bins), 0 if asked else 1)
                codes = tree.wanted[:room]
                if codes:
                    asked.append((e, tree, codes))
                    used += len(codes) * len(tree.features) * bins
        sums = _pass(rows, out, asked, kept, width, bins)
        for i, (_, tree, codes) in enumerate(asked):
            for code in codes:
                tree.give(code, sums[i, code])
            tree.wanted = tree.wanted[len(codes) :]
            if not tree.wanted:
                tree.advance()
        for e, trees in growing.items():
            if trees and all(t.final is not None for t in trees):
                out[e].trees += [t.tree() for t in trees]
                out[e].passed += [int((time.monotonic() - begun) * 1000)] * len(trees)
                growing[e] = []
        now = [len(e.trees) for e in out]
        if each and any(n > t and (n - t >= keep or n == e.learner.trees) for n, t, e in zip(now, told, out, strict=True)):
            each(out)
            told = now


def _with_margins(rows: DataFrame, ensembles: list[Ensemble], kept: int, upto: int, width: int) -> DataFrame:
    """The rows with the margins of the first ``upto`` trees, written anew."""
    known = [Ensemble(e.learner, e.columns, e.base, [t.bare() for t in e.trees[kept:upto]]) for e in ensembles]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            binned = matrix(batch.column(2), width)
            old = np.array(batch.column(3).flatten()).reshape(batch.num_rows, -1)
            new = [e.margins(binned, old[:, i]) if e.learner.boosted else old[:, i] for i, e in enumerate(known)]
            arrays = [*batch.columns[:3], pa.array(list(np.stack(new, axis=1)), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["hash", "target", "bins", "margins"])

    return pin(rows.mapInArrow(run, rows.schema))


# --- rows and predictions ---


def on_grid(target: Column) -> Column:
    """The target in whole units of the grid."""
    return F.floor(target * float(GRID) + 0.5).cast("long")


def row_hash(keys: Sequence[str]) -> Column:
    """A number below ``HASH`` from a row's key."""
    return F.conv(F.substr(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), F.lit(1), F.lit(7)), 16, 10).cast("long")


def binned(columns: Sequence[str], edges: dict[str, list[float]]) -> Column:
    """A byte for each column: how many of its edges are below the value. A null counts as 0."""
    cuts = [np.array(edges[c]) for c in columns]

    @F.pandas_udf("binary")
    def find(rows: pd.Series) -> pd.Series:
        values = np.vstack(rows.to_numpy()) if len(rows) else np.zeros((0, len(cuts)))
        out = np.stack([np.searchsorted(e, values[:, i], side="left") for i, e in enumerate(cuts)], axis=1).astype(np.uint8)
        return pd.Series([r.tobytes() for r in out])

    return find(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]))


def with_predictions(df: DataFrame, ensembles: Sequence[Ensemble], bins: str, width: int) -> DataFrame:
    """Each ensemble's prediction as a column of its name: one pass, no join."""
    schema = ", ".join(f"{e.learner.name} double" for e in ensembles)
    known = [Ensemble(e.learner, e.columns, e.base, [t.bare() for t in e.trees]) for e in ensembles]

    @F.pandas_udf(schema)
    def predicted(rows: pd.Series) -> pd.DataFrame:
        found = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, width)
        return pd.DataFrame({e.learner.name: e.predict(found) for e in known})

    return df.withColumn("_predicted", predicted(bins)).select("*", "_predicted.*").drop("_predicted")


def node_table(spark: SparkSession, ensembles: Sequence[Ensemble], edges: dict[str, list[float]]) -> DataFrame:
    """One row for each node of each tree; a row goes left if its feature is at most the threshold. Values are on the grid."""
    rows = []
    for e in ensembles:
        for number, t in enumerate(e.trees):
            for i, code in enumerate(t.code):
                f = int(t.feature[i])
                name = e.learner.features[f] if f >= 0 else None
                rows.append((
                    e.learner.name, number, int(code), name, float(edges[name][int(t.cut[i])]) if name else None, int(t.value[i]),
                    float(t.gain[i]), int(t.rows[i]),
                ))
    return spark.createDataFrame(rows, "model string, tree int, node long, feature string, threshold double, value long, gain double, rows long")


def from_nodes(
    nodes: DataFrame, learners: Sequence[Learner], columns: Sequence[str], base: dict[str, int], edges: dict[str, list[float]]
) -> list[Ensemble]:
    """The ensembles of a table of nodes."""
    out = {lr.name: Ensemble(lr, [columns.index(f) for f in lr.features], base[lr.name]) for lr in learners}
    by_tree: dict[tuple[str, int], list] = {}
    for r in nodes.collect():  # as many as the learners' sizes allow
        by_tree.setdefault((r["model"], r["tree"]), []).append(r)
    for (model, _), rows in sorted(by_tree.items()):
        ensemble = out[model]
        place = {f: i for i, f in enumerate(ensemble.learner.features)}
        rows.sort(key=lambda r: r["node"])
        at = {r["node"]: i for i, r in enumerate(rows)}
        ensemble.trees.append(Tree(
            np.array([r["node"] for r in rows], dtype=object), np.array([place.get(r["feature"], -1) for r in rows]),
            np.array([edges[r["feature"]].index(r["threshold"]) if r["feature"] else 0 for r in rows]),
            np.array([at.get(2 * r["node"], 0) for r in rows]), np.array([at.get(2 * r["node"] + 1, 0) for r in rows]),
            np.array([r["value"] for r in rows]), np.array([r["gain"] for r in rows]), np.array([r["rows"] for r in rows]),
        ))
    return list(out.values())


def importance(nodes: DataFrame) -> DataFrame:
    """``model, feature, importance``: a feature's share of the gains of a tree, averaged over the trees that gain anything."""
    by_tree = nodes.filter("feature is not null").groupBy("model", "tree", "feature").agg(F.sum("gain").alias("gain"))
    totals = nodes.groupBy("model", "tree").agg(F.sum("gain").alias("total")).filter("total > 0")
    counts = totals.groupBy("model").agg(F.count(F.lit(1)).alias("trees"))
    shares = by_tree.join(totals, ["model", "tree"]).groupBy("model", "feature").agg(F.sum(F.col("gain") / F.col("total")).alias("shares"))
    return shares.join(counts, "model").select("model", "feature", (F.col("shares") / F.col("trees")).alias("importance"))


def learning_curve(df: DataFrame, ensemble: Ensemble, bins: str, target: str, width: int) -> DataFrame:
    """``iter, rmse``: error of a boosted ensemble on the given rows after each tree, in units of the target."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = ensemble
        for batch in batches:
            found = matrix(batch.column(0), width)
            actual = batch.column(1).to_numpy()
            margin = np.full(len(found), e.base, dtype=np.int64)
            errors = []
            for tree in e.trees:
                margin = margin + tree.value[tree.leaves(found[:, e.columns])]
                errors.append(float((((margin - actual) / GRID) ** 2).sum()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(errors), dtype=np.int32)), pa.array(errors, pa.float64()), pa.array([len(found)] * len(errors), pa.int64())],
                names=["iter", "squares", "n"],
            )

    parts = df.select(bins, target).mapInArrow(run, "iter int, squares double, n long")
    return parts.groupBy("iter").agg(F.sqrt(F.sum("squares") / F.sum("n")).alias("rmse"))
