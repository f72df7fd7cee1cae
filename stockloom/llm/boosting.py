"""Quality classifier: gradient-boosted trees on histograms of document statistics.

Features are cut into at most 255 bins by quantiles; a tree grows level by level on sums of gradients and second derivatives by
bin. Fitted trees are flattened into arrays (feature, threshold, leaf value in heap order), and scoring walks all trees of a batch
at once, one level a step.

Null and empty texts have all statistics 0 and get the score of such a document; ties between splits go to the earlier feature
and bin; labels of one kind only, or none, give the share of good labels (0.5 without any) as every score; an empty table gives
no rows. Columns besides ``doc_id`` and ``text`` are ignored; repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.docstats import FEATURES, document_statistics, held_out, labelled_sample
from stockloom.llm.shared import by_batch, stored

SAMPLE_ROWS = 60_000
THRESHOLD = 0.7


@dataclass(frozen=True)
class Trees:
    """All trees, in heap order: inner nodes 0 to 2**depth - 2, then leaves. A row goes right above the threshold."""

    base: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))[:, None]
        trees = np.arange(len(self.feature))[None, :]
        for start in range(0, len(x), 4096):
            part = x[start : start + 4096]
            node = np.zeros((len(part), len(self.feature)), dtype=np.int64)
            for _ in range(self.depth):
                right = part[rows[: len(part)], self.feature[trees, node]] > self.threshold[trees, node]
                node = 2 * node + 1 + right
            out[start : start + 4096] += self.leaf[trees, node - (2**self.depth - 1)].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 255,
    l2: float = 1.0, least: float = 5.0,
) -> Trees:
    """Boost the logistic loss. ``least``: second derivatives a leaf needs at least."""
    inner = 2**depth - 1
    positive = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or positive in (0.0, 1.0):
        share = min(max(positive, 1e-6), 1 - 1e-6)
        none = np.zeros((0, inner))
        return Trees(float(np.log(share / (1 - share))), none.astype(int), none, np.zeros((0, 2**depth)), depth)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    width = bins + 1
    base = float(np.log(positive / (1 - positive)))
    margin = np.full(len(y), base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = (node - first) * width
            gain, cut = np.full(count, 1e-9), np.zeros(count, dtype=np.int64)
            chosen = np.full(count, -1)
            for j in range(len(cuts)):
                gl = np.bincount(at + binned[j], g, count * width).reshape(count, width)
                hl = np.bincount(at + binned[j], h, count * width).reshape(count, width)
                gs, hs = gl.sum(1, keepdims=True), hl.sum(1, keepdims=True)
                gl, hl = gl.cumsum(1), hl.cumsum(1)
                value = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                value = np.where((hl >= least) & (hs - hl >= least), value, 0.0)[:, : max(1, len(cuts[j]))]
                best = value.argmax(1)
                better = value[np.arange(count), best] > gain * (1 + 1e-9)
                gain = np.where(better, value[np.arange(count), best], gain)
                cut, chosen = np.where(better, best, cut), np.where(better, j, chosen)
            for i in np.flatnonzero(chosen >= 0):
                feature[first + i], threshold[first + i] = chosen[i], cuts[chosen[i]][cut[i]]
            own = node - first
            right = (chosen[own] >= 0) & (binned[np.maximum(chosen[own], 0), np.arange(len(y))] > cut[own])
            node = 2 * node + 1 + right
        leaf_of = node - inner
        gs, hs = np.bincount(leaf_of, g, inner + 1), np.bincount(leaf_of, h, inner + 1)
        leaf = -rate * gs / (hs + l2)
        margin += leaf[leaf_of]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(base, np.array(features), np.array(thresholds), np.array(leaves), depth)


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted``; learned from labelled documents that are not held out.

    At most about ``sample_rows`` of them are fitted, chosen by a hash of their id.
    """
    stats = stored(document_statistics(docs), "statistics")
    fits = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    x, y = labelled_sample(stats.filter(fits), labels, label, sample_rows)
    model = fit(x, y)

    def each(rows: dict[str, list]) -> dict[str, list]:
        matrix = np.array([rows[c] for c in FEATURES], dtype=np.float64).T
        score = model.score(matrix)
        return {
            "doc_id": rows["doc_id"], "held_out": [held_out(x) for x in rows["doc_id"]], "score": score,
            "predicted": (score >= THRESHOLD).astype(np.int32),
        }

    return by_batch(stats, each, "doc_id long, held_out boolean, score double, predicted int")
