"""Quality rules as a decision list learned by sequential covering.

On labelled statistics, rules for bad documents are found one after another. A rule grows by the threshold that gains most
information until it covers no good document or no threshold pays for itself, is pruned from its end on rows kept aside for that, and
joins the list if it is precise and covers enough of them. The bad rows it covers are then done, those of a rule that fails are set aside,
and the search goes on for the others until nothing more is found. The list becomes one Spark conditional expression, in order, whose
last branch keeps the document.

Null and empty texts have all statistics 0 and fail the base rule on their words; ties between thresholds go to the earlier
feature and lower threshold; with no labels, or of one kind only, the list is empty and the base rule alone decides; an empty
table gives no rows; the statistics of a long text are counted in its row. Columns besides ``doc_id`` and ``text`` are ignored; repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.docstats import FEATURES, document_statistics, labelled_sample
from stockloom.llm.shared import packed, stored

SAMPLE_ROWS = 60_000


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= F.lit(self.threshold) if self.at_least else value <= F.lit(self.threshold)

    def mask(self, x: np.ndarray) -> np.ndarray:
        value = x[:, FEATURES.index(self.feature)]
        return value >= self.threshold if self.at_least else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    mask = np.ones(len(x), dtype=bool)
    for c in rule:
        mask &= c.mask(x)
    return mask


def best_condition(x: np.ndarray, bad: np.ndarray, bins: int) -> Condition | None:
    """The threshold with the most information gained over the rows, weighted by the bad rows that stay.

    It must gain more bits than it takes to say which of all thresholds it is; noise seldom does.
    """
    p0, n0 = int(bad.sum()), int((~bad).sum())
    base = np.log2(p0 / (p0 + n0))
    best, found = np.log2(2 * bins * len(FEATURES)), None
    for j, name in enumerate(FEATURES):
        value = x[:, j]
        cuts = np.unique(np.quantile(value, np.linspace(0, 1, bins + 1), method="lower"))
        # rows at or above each cut, and those at or below it
        above, upto = np.searchsorted(cuts, value, side="right"), np.searchsorted(cuts, value, side="left")
        counts = []
        for at_least, place in ((True, above), (False, upto)):
            for kind in (bad, ~bad):
                n = np.bincount(place[kind], minlength=len(cuts) + 1)
                counts.append(n[::-1].cumsum()[::-1][1:] if at_least else n.cumsum()[:-1])
        for at_least, p, n in ((True, *counts[:2]), (False, *counts[2:])):
            allowed = (p > 0) & (p + n < len(bad))
            gain = np.where(allowed, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), -1.0)
            i = int(gain.argmax())
            if gain[i] > best * (1 + 1e-12):
                best, found = float(gain[i]), Condition(name, at_least, float(cuts[i]))
    return found


def grow(x: np.ndarray, bad: np.ndarray, bins: int) -> Rule:
    """Conditions one after another until only bad rows are left or none pays."""
    rule: list[Condition] = []
    while bad.any() and not bad.all():
        condition = best_condition(x, bad, bins)
        if condition is None:
            break
        rule.append(condition)
        stay = condition.mask(x)
        x, bad = x[stay], bad[stay]
    return tuple(rule)


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The shortest beginning of the rule that does best on rows it was not grown on."""

    def worth(r: Rule) -> float:
        mask = covers(r, x)
        p, n = (mask & bad).sum(), (mask & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def learn(x: np.ndarray, y: np.ndarray, precision: float = 0.95, least: int = 5, bins: int = 64) -> list[Rule]:
    """Ordered rules for label 0. A rule needs ``precision`` on all rows it covers, and ``least`` bad ones among them.

    The bad rows under a rule that fails are set aside, and others are sought for the rest, until no condition pays any more. They
    still count for the precision of later rules. Neither the number of rules nor their length is bounded.
    """
    bad = y == 0
    rng = np.random.default_rng(0)
    aside = rng.random(len(y)) < 1 / 3
    left = np.ones(len(y), dtype=bool)
    sought = bad.copy()
    rules: list[Rule] = []
    while True:
        seen = left & (sought | ~bad)  # what rules grow on: rows set aside are neither good nor sought
        fit, check = seen & ~aside, seen & aside
        if not (fit & bad).any() or not (fit & ~bad).any():
            return rules
        rule = prune(grow(x[fit], bad[fit], bins), x[check], bad[check])
        mask = covers(rule, x) & left if rule else np.zeros(len(y), dtype=bool)
        if not (mask & sought).any():
            return rules
        p, n = int((mask & bad).sum()), int((mask & ~bad).sum())
        if p >= least and p >= precision * (p + n):
            rules.append(rule)
            left &= ~mask
        sought &= ~mask


def rule_expression(rules: list[Rule]) -> Column:
    """Which rule decides, from 1, or 0 if none does: the first that holds."""
    out = None
    for number, rule in enumerate(rules, 1):
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, number) if out is None else out.when(holds, number)
    return F.lit(0) if out is None else out.otherwise(0)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics of every document with ``base_failed``, the deciding ``rule`` and ``kept``.

    Rules are learned on at most about ``sample_rows`` labelled documents.
    """
    stats = stored(document_statistics(docs), "statistics")
    x, y = labelled_sample(stats, labels, "quality", sample_rows)
    rules = learn(x, y) if len(set(y.tolist())) > 1 else []
    judged = stats.withColumn("base_failed", base_failed()).withColumn("rule", rule_expression(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def kept_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns, of any name; a row is known by its id and a hash of its text."""
    rejected = judge(docs, labels, sample_rows).filter(~F.col("kept"))
    rejected = rejected.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    row = F.col("row")
    keyed = packed(docs).withColumns({"doc_id": row["doc_id"].cast("long"), "text_key": F.xxhash64(row["text"])})
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))
    return keyed.join(rejected, same, "left_anti").select("row.*")
