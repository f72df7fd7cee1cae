import math
import random
import re

import numpy as np
import pytest

from stockloom.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k):
    bags = [(i, plain_terms(t)) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(len(b) for _, b in bags)
    out = []
    queries = {}
    for item, text in items:
        queries.setdefault(item, []).extend(plain_terms(text))
    for item, query in queries.items():
        scores = []
        for i, bag in bags:
            m = 75 + 25 * len(bag) * n_docs // total
            score = 0
            for t in query:
                tf = bag.count(t)
                if tf:
                    df = sum(t in b for _, b in bags)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(docs, items, **how):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in search.search(docs, items, **how).collect()), key=repr)


QUERIES = [
    (1, "the thing and that thing"), (2, "größe über SCHEIN"), (3, ""), (4, None), (5, "nosuchword"), (6, "word two words"),
    (7, "x a b the the the 1234"), (8, "anon ering"), (None, "have from"), (8, "thent"),
]


@pytest.mark.parametrize("postings", [10**6, 300])
def test_search_of_awkward_rows(spark, docs, rows, none, postings):
    items = spark.createDataFrame(QUERIES, "item_id long, text string")
    got = found(docs, items, shard_postings=postings)
    assert got == plain_search([r[:2] for r in rows], QUERIES, 20)
    assert search.search(none, items).count() == 0 and search.search(docs, items.limit(0)).count() == 0


def test_queries_in_blocks_and_ties(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    texts = [(i % 50, " ".join(rng.choice(words[: 1 + i % 30]) for _ in range(6))) for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(9))) for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(9)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = plain_search(texts, items, 5)
    assert found(docs, asked, k=5, shard_postings=200) == want
    assert found(docs, asked, k=5, block_bytes=100) == want


def test_reading_stops_early_and_is_right():
    rng = np.random.default_rng(3)
    n, terms = 4000, 4
    impact = np.floor(rng.pareto(1.2, (terms, n)) * 1000).astype(np.int64) + 1
    held = rng.random((terms, n)) < 0.7
    term, doc = np.nonzero(held)
    shard = search.Shard(term, doc, impact[term, doc], terms)
    total = (impact * held * np.array([[1], [2], [1], [1]])).sum(axis=0)
    want = sorted(zip((-total).tolist(), range(n), strict=True))[:10]
    got, read = search.best(shard, [(0, 1), (1, 2), (2, 1), (3, 1)], 10)
    assert got == [(-s, d) for s, d in want] and read < held.sum() / 4
    assert search.best(shard, [(0, 1)], 10, floor=10**12)[1] <= 64


def test_equal_scores_at_the_threshold_are_read():
    """Forty documents of one score: the ten of the lowest numbers must be found although ten are known after the first round."""
    doc = np.arange(40)[::-1].copy()
    shard = search.Shard(np.zeros(40, dtype=np.int64), doc, np.full(40, 7), 1)
    assert search.best(shard, [(0, 1)], 10, depth=2)[0] == [(7, i) for i in range(10)]
