"""Columns of any name, repeated rows, noisy labels, and the stages of the pipeline against plain forms."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stockloom.llm import mixing, rules, secrets, simhash
from stockloom.llm.docstats import FEATURES
from tests.llm.test_documents import WORDS, components, plain_counts, plain_fingerprint

CLASHES = ["row", "id", "key", "place", "unnamed", "copies", "from", "size", "text_key", "doc", "_kept_id", "_mix_size", "_rejected_id", "a.b", "kept"]


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.drop("size", "key").withColumns({c: F.lit(-5 - i) for i, c in enumerate(CLASHES)})


def test_columns_of_any_name_pass_through(clashing, docs, labels):
    for run in (simhash.one_of_each, mixing.mixed, lambda d: rules.kept_documents(d, labels), secrets.redact):
        got = run(clashing)
        assert got.columns == clashing.columns
        plain = run(docs)
        assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in plain.collect())
        values = got.select(*[f"`{c}`" for c in CLASHES]).distinct().collect()
        assert [tuple(r) for r in values] == [tuple(-5 - i for i in range(len(CLASHES)))]


def test_the_same_one_of_repeated_rows_stays(spark):
    rows = [(1, "one two three four", i, {"a": i}) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int, m map<string,int>")
    kept = {simhash.one_of_each(docs.repartition(n)).collect()[0]["extra"] for n in (1, 3, 8)}
    assert len(kept) == 1


def test_many_equal_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LOT", 7)
    docs = spark.range(100).select(F.lit(4).alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    got = mixing.mix(docs).collect()
    assert len(got) == 100 and {r["size"] for r in got} == {3}


def test_a_noisy_kind_does_not_hide_a_clean_one():
    rng = np.random.default_rng(5)
    x = rng.random((9000, len(FEATURES)))
    noisy = x[:, 3] > 0.7
    clean = (x[:, 8] > 0.95) & ~noisy
    bad = np.where(noisy, rng.random(9000) < 0.9, clean)
    found = rules.learn(x, (~bad).astype(int))
    covered = np.any([rules.covers(r, x) for r in found], axis=0)
    assert (covered & clean).sum() > 0.95 * clean.sum()
    assert (covered & ~bad).sum() < 0.05 * covered.sum()


def test_more_kinds_than_any_fixed_number():
    rng = np.random.default_rng(6)
    x = rng.random((24000, len(FEATURES)))
    kind = rng.integers(0, 80, 24000)
    for k in range(40):  # forty small kinds, each in a narrow stretch of one of the features
        j, at = k % 10, 0.1 + 0.2 * (k // 10)
        x[:, j] = np.where(kind == k, at + 0.01 * x[:, j], np.where(kind >= 40, np.where(np.abs(x[:, j] - at - 0.005) < 0.02, 0.99, x[:, j]), x[:, j]))
    bad = kind < 40
    found = rules.learn(x, (~bad).astype(int))
    covered = np.any([rules.covers(r, x) for r in found], axis=0)
    assert len(found) > 24 and (covered & bad).sum() > 0.8 * bad.sum() and (covered & ~bad).sum() < 0.06 * covered.sum()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory, docs, labels):
    """The fixture as a data folder, and what goes into and comes out of every stage."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    out, rows = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = rows.collect()
        rows = stage(spark, rows, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            rows.write.parquet(f"{folder}/{name}")
            rows = spark.read.parquet(f"{folder}/{name}")
            assert rows.columns == plain.columns
        out[name] = before, rows.collect()
    out["run"] = corpus_pipeline.run(spark, folder).collect()
    return out


def counted(rows):
    return Counter(tuple(r) for r in rows)


def test_quality_stage(stages, spark, labels):
    before, after = stages["quality_rules"]
    docs = spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")
    rule = {(r["doc_id"], r["text_key"]): r["rule"] for r in rules.judge(docs, labels).collect()}
    keys = {tuple(r): r["key"] for r in docs.withColumn("key", F.xxhash64("text")).collect()}
    want = []
    for r in before:
        n, *_, repeats = plain_counts(r["text"])
        key = next(v for k, v in keys.items() if k[:5] == tuple(r))
        if n >= 10 and 100 * repeats <= 20 * n and rule[r["doc_id"], key] == 0:
            want.append(r)
    assert counted(after) == counted(want) and len(want) > 40


def test_duplicate_stage(stages):
    before, after = stages["near_duplicates"]
    roots = components([plain_fingerprint(r["text"]) for r in before], 2)
    groups = {}
    for r, root in zip(before, roots, strict=True):
        groups.setdefault(root, []).append(r)
    assert len(after) == len(groups)
    for rows in groups.values():
        least = min(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))["doc_id"]
        stays = [r for r in after if r in rows]
        assert len(stays) == 1 and stays[0]["doc_id"] == least


def test_secret_stage(stages):
    before, after = stages["secret_scan"]
    want = []
    # counted the plain way: in how many texts each word is
    counts = Counter(w for r in before for w in {x.lower() for x in re.findall("[A-Z]?[a-z]{2,}", r["text"])} if 3 <= len(w) <= 24)
    words = sorted(counts, key=lambda w: (-counts[w], w))[: secrets.CORPUS_WORDS][::-1]
    for r in before:
        text = r["text"]
        spans = secrets.find_spans(text, secrets.Novelty(words))[1]
        if spans:
            text = secrets.redacted(text, spans, "<secret>")
        want.append((r["doc_id"], text, r["lang"], r["source"], len(text) if spans else r["n_chars"]))
    assert counted(after) == Counter(want)
    assert not any("hunter2hunter2" in r["text"] for r in after)


def test_mix_stage(stages):
    before, after = stages["source_mix"]
    words = {}
    for r in before:
        words[r["source"]] = words.get(r["source"], 0) + len(WORDS.findall(r["text"]))
    taken = {}
    assert set(counted(after)) <= set(counted(before))
    for r in after:
        taken[r["source"]] = taken.get(r["source"], 0) + len(WORDS.findall(r["text"]))
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(words.values()), set()
    while True:
        level = (budget - sum(2 * words[s] for s in full)) / max(sum(w for s, w in weight.items() if s not in full), 1)
        more = {s for s in order if s not in full and 2 * words[s] <= level * weight[s]}
        if not more:
            break
        full |= more
    longest = {s: max(len(WORDS.findall(r["text"])) for r in before if r["source"] == s) for s in order}
    for s in order:
        target = 2 * words[s] if s in full else level * weight[s]
        assert abs(taken.get(s, 0) - target) <= max(longest[s], 1)
    assert max(counted(after)[k] / n for k, n in counted(before).items()) <= 2


def test_packing_stage(stages):
    before, after = stages["packing"]
    assert {r["length"] for r in after} and max(r["length"] for r in after) <= 2048
    filled = {}
    for r in after:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    ids = Counter(r["doc_id"] for r in before)
    assert Counter(r["doc_id"] for r in after if r["piece"] == 0) == ids
    digest = hashlib.sha256(repr(sorted(map(repr, after))).encode()).hexdigest()
    again = [r for r in stages["run"]]
    shown = [c for c in after[0].asDict() if c not in ("sequence_id", "offset")]
    assert Counter(tuple(r[c] for c in shown) for r in again) == Counter(tuple(r[c] for c in shown) for r in after), digest
