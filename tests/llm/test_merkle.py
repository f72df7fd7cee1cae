import hashlib
import random
import string
import zlib

import pytest
from pyspark.sql import functions as F

from stockloom.llm import merkle


def plain_hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return plain_hash(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves, fanout):
    """The root, and for each leaf its siblings left and right, level by level."""
    paths = [[] for _ in leaves]
    nodes, under = list(leaves), [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        above, held = [], []
        for i in range(0, len(nodes), fanout):
            run = nodes[i : i + fanout]
            for j in range(len(run)):
                for leaf in under[i + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(plain_hash(*run))
            held.append([x for u in under[i : i + fanout] for x in u])
        nodes, under = above, held
    return nodes[0], paths


def plain_manifest(rows, fanout):
    """rows: (doc_id, text, lang, source, n_chars)."""
    def tampered(r):
        return r[1].translate({i: i + 32 for i in range(65, 91)}) if r[1] and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[0] is not None else r[1]

    groups = {}
    for r in rows:
        leaf = plain_leaf((r[0], r[3], r[2], r[4], r[1]))
        claim = plain_leaf((r[0], r[3], r[2], r[4], tampered(r)))
        groups.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), leaf, claim, r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = plain_tree([x[1] for x in groups[g]], fanout)
    if not order:
        return []
    root, above = plain_tree([trees[g][0] for g in order], fanout)
    out = []
    for i, g in enumerate(order):
        subroot, paths = trees[g]
        for (_, leaf, claim, doc_id), path in zip(groups[g], paths, strict=True):
            path = path + above[i]
            node = claim
            for left, right in path:
                node = plain_hash(left, node, right)
            proof = plain_hash(*(left + right for left, right in path))
            out.append((doc_id, leaf, subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def spark_manifest(docs, fanout=8):
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    got = merkle.manifest(docs, {"text": F.when(tampered, lowered).otherwise(F.col("text"))}, fanout=fanout)
    return sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr)


def test_manifest_of_awkward_rows(docs, rows, none):
    got = spark_manifest(docs)
    assert got == plain_manifest([r[:5] for r in rows], 8)
    assert len({r[3] for r in got}) == 1
    assert merkle.manifest(none).count() == 0


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (16, 17, 15), (300, 129, 64, 1)])
def test_manifest_of_many_blocks(spark, sizes):
    """Fanout 2 has blocks of 16 leaves, so several rounds run and last subtrees are incomplete."""
    rng = random.Random(3)
    rows = []
    for g, n in enumerate(sizes):
        rows += [(rng.randrange(10**6), "Some Text %d" % rng.randrange(50), f"l{g}" if g else None, None, i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    got = spark_manifest(docs, 2)
    assert got == plain_manifest(rows, 2) and (len(rows) < 4 or {r[6] for r in got} == {True, False})


def test_more_groups_than_a_block(spark):
    rows = [(i, "X", f"g{i % 40:02d}é", "s", 1) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = spark_manifest(docs, 2)
    assert got == plain_manifest(rows, 2) and (len(rows) < 4 or {r[6] for r in got} == {True, False})


def test_paths_prove_a_row_alone(docs):
    got = merkle.manifest(docs.withColumn("leaf", F.lit(1)).withColumn("path", F.lit(2)).withColumn("named", F.lit("x")), with_paths=True)
    for r in got.limit(20).collect():
        assert merkle.folded(r["leaf"], [(s["left"], s["right"]) for s in r["path"]]) == r["root"] and r["verified"]
