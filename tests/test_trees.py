"""Tree learners against one split at a time in plain loops, and what they are trained on."""

import datetime
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.operators import encode, ordering, stacking, trees
from stockloom.operators.trees import GRID, HASH, Learner

BINS = 8
NAMES = ("a", "b", "c", "d", "e")


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(12)
    bins = rng.integers(0, BINS, (400, len(NAMES)))
    y = 0.3 * bins[:, 0] - 0.2 * (bins[:, 1] > 4) * bins[:, 2] + rng.normal(0, 0.3, 400)
    bins[:40] = bins[0]
    return rng.integers(0, HASH, 400), np.floor(y * GRID + 0.5).astype(np.int64), bins


@pytest.fixture(scope="module")
def rows(spark, table):
    data = [(int(h), int(t), bytes(b.astype(np.uint8))) for h, t, b in zip(*table, strict=True)]
    return spark.createDataFrame(data, "hash long, target long, bins binary").repartition(5)


def plain_tree(lr, number, bins, g, w):
    """node -> (feature, cut) or value; one split after another."""
    def shrunk(x):
        return math.copysign(max(abs(x) - lr.l1 * GRID, 0.0), x) if x else 0.0

    def score(g_, n_):
        return shrunk(g_) ** 2 / (n_ + lr.l2) if n_ + lr.l2 > 0 else 0.0

    allowed = sorted(sorted(range(len(NAMES)), key=lambda i: hashlib.md5(f"{lr.seed}|{number}|{NAMES[i]}".encode()).hexdigest())
                     [: max(1, math.ceil(lr.feature_share * len(NAMES)))])

    def gain(at, f, cut):
        left = at[bins[at, f] <= cut]
        gl, nl, ga, na = int((g * w)[left].sum()), int(w[left].sum()), int((g * w)[at].sum()), int(w[at].sum())
        if nl < lr.least_leaf or na - nl < lr.least_leaf or na < lr.least_split:
            return 0.0
        return score(gl, nl) + score(ga - gl, na - nl) - score(ga, na)

    def best(at):
        found = (0.0, None, None)
        for f in allowed:
            for cut in range(BINS - 1):
                x = gain(at, f, cut)
                if x > found[0]:
                    found = (x, f, cut)
        return found

    leaves = {1: np.arange(len(g))}
    splits = {}

    def split(code, f, cut):
        at = leaves.pop(code)
        splits[code] = (f, cut)
        leaves[2 * code], leaves[2 * code + 1] = at[bins[at, f] <= cut], at[bins[at, f] > cut]

    if lr.policy == "symmetric":
        for _ in range(lr.depth):
            total, f, cut = max(((sum(gain(leaves[c], f, cut) for c in sorted(leaves)), -f, -cut) for f in allowed for cut in range(BINS - 1)))
            if total <= 0:
                break
            for code in sorted(leaves):
                split(code, -f, -cut)
    else:
        while lr.policy == "depth" or len(leaves) < lr.leaves:
            options = [(*best(leaves[c]), c) for c in sorted(leaves) if c.bit_length() <= lr.depth]
            options = [o for o in options if o[0] > 0]
            if not options:
                break
            _, f, cut, code = max(options, key=lambda o: (o[0], -o[3]))
            split(code, f, cut)
    values = {}
    for code, at in leaves.items():
        n = int(w[at].sum())
        rate = lr.rate if lr.boosted else 1.0
        values[code] = math.floor(-rate * shrunk(int((g * w)[at].sum())) / (n + lr.l2) + 0.5) if n + lr.l2 else 0
    return splits, values, leaves


LEARNERS = [
    Learner("deep", NAMES, 3, 3, rate=0.3, l1=0.4, l2=1.5, row_share=0.9, feature_share=0.7),
    Learner("wide", NAMES, 5, 30, "leaf", 11, rate=0.3, l2=1.0, least_leaf=5),
    Learner("level", NAMES, 3, 4, "symmetric", rate=0.5, l2=3.0),
    Learner("forest", NAMES, 3, 4, boosted=False, least_leaf=2, least_split=5),
]


@pytest.mark.parametrize("cells,keep", [(trees.CELLS, 10), (200, 2)])
def test_learners_equal_plain_loops(rows, table, cells, keep):
    hashes, target, bins = table
    fitted = trees.fit(rows, LEARNERS, NAMES, BINS, cells, keep)
    for lr, got in zip(LEARNERS, fitted, strict=True):
        margin = np.full(len(target), math.floor(target.sum() / len(target) + 0.5)) if lr.boosted else np.zeros(len(target), dtype=np.int64)
        total = margin.copy()
        assert len(got.trees) == lr.trees
        for number, tree in enumerate(got.trees):
            u = (hashes * (2654435 * (2 * number + 1) % HASH) + 12345 * number) % HASH
            if lr.boosted:
                w = (u < math.floor(lr.row_share * HASH)).astype(np.int64) if lr.row_share < 1 else np.ones(len(u), dtype=np.int64)
            else:
                shares = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
                w = (u[:, None] >= np.floor(shares * HASH)).sum(axis=1)
            splits, values, leaves = plain_tree(lr, number, bins, total - target if lr.boosted else -target, w)
            at = {int(c): i for i, c in enumerate(tree.code)}
            assert {c: (int(tree.feature[i]), int(tree.cut[i])) for c, i in at.items() if tree.feature[i] >= 0} == splits, (lr.name, number)
            assert {c: int(tree.value[i]) for c, i in at.items() if tree.feature[i] < 0} == values
            for code, rows_ in leaves.items():
                total[rows_] += values[code]
        assert (got.margins(bins.astype(np.uint8)) == total).all()


def test_penalties_of_a_leaf():
    lr = Learner("x", NAMES, 1, 1, rate=0.5, l1=2.0, l2=3.0)
    assert trees.leaf_value(-10 * GRID, 5, lr) == 0.5 * 8 / 8 * GRID  # 10 moved by 2, over 5 + 3, half of it
    assert trees.leaf_value(int(1.5 * GRID), 5, lr) == 0
    assert trees.score(np.array([-10 * GRID]), np.array([5]), 2.0, 3.0)[0] == (8 * GRID) ** 2 / 8


def test_no_rows_and_equal_targets(spark, rows):
    none = trees.fit(rows.limit(0), LEARNERS, NAMES, BINS)
    assert [len(e.trees) for e in none] == [0] * 4 and none[0].predict(np.zeros((2, 5), dtype=np.uint8)).tolist() == [0.0, 0.0]
    flat = trees.fit(rows.withColumn("target", F.lit(3 * GRID)), LEARNERS, NAMES, BINS)
    for e in flat:
        np.testing.assert_allclose(e.predict(np.zeros((2, 5), dtype=np.uint8)), 3.0)


def test_node_table_keeps_the_model(spark, rows, table):
    fitted = trees.fit(rows, LEARNERS, NAMES, BINS)
    edges = {c: [float(i) for i in range(BINS - 1)] for c in NAMES}
    nodes = trees.node_table(spark, fitted, edges)
    back = trees.from_nodes(nodes, LEARNERS, NAMES, {e.learner.name: e.base for e in fitted}, edges)
    for a, b in zip(fitted, back, strict=True):
        assert (a.predict(table[2].astype(np.uint8)) == b.predict(table[2].astype(np.uint8))).all()
    shares = trees.importance(nodes.filter("model = 'wide'")).collect()
    assert sum(r.importance for r in shares) == pytest.approx(1.0) and max(shares, key=lambda r: r.importance).feature == "a"


def test_order_statistics(spark):
    rng = np.random.default_rng(1)
    columns = {
        "even": rng.uniform(-5, 5, 3000), "ties": rng.integers(0, 7, 3000).astype(float), "steep": np.exp(rng.uniform(-300, 300, 3000)),
        "same": np.full(3000, 2.5), "ends": np.concatenate([[-1e308, 1e308], rng.normal(0, 1e-9, 2998)]),
    }
    data = [tuple(None if i % 10 == 9 else float(v[i]) for v in columns.values()) + (None,) for i in range(3000)]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in columns) + ", empty double").repartition(6)
    ranks = [0, 1, 17, 1350, 2698, 2699]
    got = ordering.order_statistics(df, dict.fromkeys([*columns, "empty"], ranks), buckets=64)
    for i, c in enumerate(columns):
        want = sorted(r[i] for r in data if r[i] is not None)
        assert got[c] == {k: want[k] for k in ranks}, c
    assert got["empty"] == {} and ordering.exact_quantile(df, "empty", 0.5).first()[0] is None


def test_ordered_means(spark):
    rows = [(datetime.date(2024, 1, 1) + datetime.timedelta(days=i), "S", "P%d" % (i % 3), "abc"[i % 2] if i % 7 else None, i * 10) for i in range(300)]
    df = spark.createDataFrame(rows, "sale_date date, store_id string, product_id string, category string, y long").repartition(4)
    got = {r.sale_date: r for r in encode.ordered_means(df, "y", 50.0, ("product_id", "category")).collect()}
    order = sorted(rows, key=lambda r: hashlib.md5(f"{r[0]}|{r[1]}|{r[2]}".encode()).hexdigest())
    assert len(got) == 300
    for column in ("product_id", "category"):
        seen = {}
        for r in order:
            label = r[2] if column == "product_id" else r[3]
            s, n = seen.get(label, (0, 0))
            assert got[r[0]][f"{column}_mean"] == (s + 50.0) / (n + 1)
            seen[label] = (s + r[4], n + 1)


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(50, 20, (200, 4))
    y = x @ np.array([0.4, 0.1, -0.2, 0.6]) + 7 + rng.normal(0, 5, 200)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], [*stacking.MODELS, "actual"])
    solution = stacking.ridge(df, stacking.MODELS, "actual", 1.0)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(4), xc.T @ yc)
    got = {r.term: r.coefficient for r in stacking.ridge_coefficients(solution, stacking.MODELS).collect()}
    np.testing.assert_allclose([got[m] for m in stacking.MODELS], want, atol=1e-9)
    assert abs(got["intercept"] - (y.mean() - x.mean(0) @ want)) < 1e-6
    first = stacking.with_ridge(df, solution, stacking.MODELS).first()
    assert first.hybrid == pytest.approx(got["intercept"] + sum(first[m] * got[m] for m in stacking.MODELS))
    weights = spark.createDataFrame([("random_forest", 0.25), ("boosted_wide", 0.75)], "model string, weight double")
    mixed = stacking.weighted_by(df, weights, stacking.MODELS).first()
    assert mixed.hybrid == pytest.approx(0.25 * mixed.random_forest + 0.75 * mixed.boosted_wide)
    none = stacking.weighted_by(df, weights.limit(0), stacking.MODELS).first()
    assert none.hybrid == pytest.approx(sum(none[m] for m in stacking.MODELS) / 4)
