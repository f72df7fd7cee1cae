"""Work that a query or a pass of the learners does once, however often its result is read."""

import re

import numpy as np
import pytest

from stockloom.operators import trees
from stockloom.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def derived(monkeypatch):
    """How often the rows of the sales fact are read: scans of lineitem in the plans that are written."""
    plans = []

    def pinned(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df)

    kept = catalog.pin
    monkeypatch.setattr(catalog, "pin", pinned)
    scans = re.compile(r"Relation \[[^\]]*l_shipdate#")
    return lambda *frames: sum(
        len(scans.findall(p)) for p in [*plans, *[f._jdf.queryExecution().optimizedPlan().toString() for f in frames]]
    )


def test_alert_events_derive_the_fact_once(spark, derived):
    events = catalog._alert_events(spark, DATA)
    assert derived(events) == 1
    medium = events.filter("severity = 'MEDIUM'").groupBy("event").count().collect()
    assert len({r["count"] for r in medium}) == 1


def test_stored_history_and_alerts_share_the_fact(spark, derived):
    found = catalog.QUERIES["stored_history_with_alerts"](spark, DATA)
    assert derived(found) == 1
    assert found.select("prediction_id").distinct().count() == catalog.retail_fact(spark, DATA).count()


def test_models_are_trained_and_score_on_one_stored_fact(spark, derived):
    sales = catalog._training_sales(spark, DATA)
    assert sales is catalog._training_sales(spark, DATA)
    assert derived(sales) <= 1
    assert "l_shipdate#" not in sales._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("policy", ["depth", "leaf", "symmetric"])
def test_one_child_of_two_is_summed_up(policy):
    """The sibling's sums are the rest of the parent's, and only one of the two is asked for."""
    rng = np.random.default_rng(3)
    bins, target = rng.integers(0, 4, (300, 2)), rng.integers(-1000, 1000, 300)
    tree = trees.Growing(trees.Learner("m", ("a", "b"), 1, 3, policy, leaves=8), 0, 4)

    def sums(rows):
        out = np.zeros((2, 4, 2), dtype=np.int64)
        for f in range(2):
            np.add.at(out[f, :, 0], bins[rows, f], target[rows])
            np.add.at(out[f, :, 1], bins[rows, f], 1)
        return out

    def rows_of(code):
        if code == 1:
            return np.arange(300)
        rows, (f, cut) = rows_of(code // 2), tree.splits[code // 2]
        return rows[(bins[rows, f] > cut) == bool(code % 2)]

    while tree.final is None:
        assert not any(c ^ 1 in tree.wanted for c in tree.wanted if c > 1)
        for code in tree.wanted:
            assert code == 1 or tree.nodes[code].n <= tree.nodes[code ^ 1].n
            tree.give(code, sums(rows_of(code)))
        tree.wanted = []
        tree.advance()
    known = [c for c in tree.nodes if tree.nodes[c].sums is not None and tree.nodes[c].n]
    assert len(known) > 3
    for code in known:
        assert (tree.nodes[code].sums == sums(rows_of(code))).all()
