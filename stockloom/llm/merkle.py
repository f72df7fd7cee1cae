"""Merkle manifest of a dataset with a proof for every row, by butterfly exchange.

A row's leaf is the SHA-256 of its fields. The leaves of a group, in order, are cut into aligned blocks of ``fanout ** BLOCK_LEVELS``;
a task builds the lower levels of a block alone. Then the blocks of a group swap subtree roots round by round: in round ``r`` a block
hears from one block of each of the other subtrees of ``fanout ** r`` blocks under the same parent, the one at its own place in that
subtree, and every block hashes the parent itself. After as many rounds as there are levels each block holds its upper proof and the
group's root; nothing is passed down again. A last subtree of fewer blocks serves the places it lacks in turn, so what a round sends to
a block is at most ``fanout`` digests. The groups' roots, in order of their names, are the leaves of a second tree built alike.

A null field is written ``-``; a null group is a group of its own and comes first, as does a null id in its group. Rows of equal
group and id follow each other by leaf, and equal rows have equal leaves, so it doesn't matter which comes first. A leaf that is alone
is its group's root, and the only group's root the root. An empty table gives no rows. A text of any length is hashed in its row and
never shuffled. Columns besides those named are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.shared import arrow_schema, stored
from stockloom.operators.ordering import group_position

FANOUT = 8
BLOCK_LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A group's name as two columns without nulls; a null name sorts first.
GROUP = ("named", "name")

Levels = list[list[str]]


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 over all fields, each as its byte count, a colon and its text, or ``-`` for a null."""
    written = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*written), 256)


def lower_levels(leaves: list[str], alone: bool, fanout: int = FANOUT, most: int = BLOCK_LEVELS) -> Levels:
    """The levels of a block from its leaves up: ``most`` times, or for a block that is ``alone`` until one node remains."""
    levels = [leaves]
    while len(levels) <= most and not (alone and len(levels[-1]) == 1):
        below = levels[-1]
        levels.append([digest(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def siblings(levels: Levels, place: int, fanout: int = FANOUT) -> list[tuple[str, str]]:
    """What stands left and right of a leaf's ancestors in their runs, level by level."""
    out = []
    for nodes in levels[:-1]:
        start = place - place % fanout
        out.append(("".join(nodes[start:place]), "".join(nodes[place + 1 : start + fanout])))
        place //= fanout
    return out


def folded(leaf: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in path:
        leaf = digest(left, leaf, right)
    return leaf


def blocks_of(rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row a block, ``named, name, block, rows``: leaves are dealt by place, and no block has more than its fixed number of them.

    ``rows`` has ``named, name, id, leaf, claim``.
    """
    placed = group_position(rows, GROUP, ["id", "leaf"], "place")
    width = fanout**BLOCK_LEVELS
    placed = placed.withColumn("block", F.floor(F.col("place") / width).cast("long"))
    content = F.sort_array(F.collect_list(F.struct("place", "id", "leaf", "claim")))
    return stored(placed.groupBy(*GROUP, "block").agg(content.alias("rows")), "merkle-blocks")


def block_nodes(blocks: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The top node of each block, ``named, name, block, node``."""
    schema = "named boolean, name string, block long, node string"
    target = arrow_schema(schema)
    width = fanout**BLOCK_LEVELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                block, leaves = one.column(2)[0].as_py(), one.column(3)[0].as_py()
                node = lower_levels(leaves, block == 0 and len(leaves) < width, fanout)[-1][0]
                yield pa.RecordBatch.from_arrays([*one.columns[:3], pa.array([node])], schema=target)

    return blocks.select(*GROUP, "block", F.col("rows.leaf").alias("leaves")).mapInArrow(run, schema)


def butterfly(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``named, name, block, node, path``: the group's root and the siblings on the way there from the block's top node.

    Every round is one shuffle of at most ``fanout`` digests a block, dealt by the block that hears them, and is written to the shared
    folder. The number of blocks of each group is all that is counted beforehand.
    """
    counts = nodes.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("blocks"))
    empty = F.array().cast("array<struct<left:string,right:string>>")
    state = stored(nodes.join(counts, list(GROUP)).withColumn("path", empty), "merkle-round")
    most = state.agg(F.max("blocks")).first()[0] or 0
    span = 1
    while span < most:
        state = stored(_round(state, span, fanout), "merkle-round")
        span *= fanout
    return state.drop("blocks")


def _round(state: DataFrame, span: int, fanout: int) -> DataFrame:
    """Every block hears the roots of the subtrees of ``span`` blocks beside its own and hashes their parent."""
    active = F.col("blocks") > span
    subtree = F.floor(F.col("block") / span).cast("long")
    first = F.col("block") - subtree * span  # its place in the subtree
    parent = F.floor(subtree / fanout).cast("long")
    last_subtree = F.floor((F.col("blocks") - 1) / span).cast("long")

    def size(s: Column) -> Column:
        return F.least(F.lit(span), F.col("blocks") - s * span)

    def hearers(s: Column) -> Column:
        """Blocks of subtree ``s`` whose place is this block's, or comes to it in steps of the own subtree's size."""
        places = F.when(first < size(s), F.sequence(first, size(s) - 1, size(subtree))).otherwise(F.array().cast("array<bigint>"))
        heard = F.transform(places, lambda p: s * span + p)
        return F.when(s == subtree, F.array("block")).otherwise(heard)

    beside = F.sequence(parent * fanout, F.least(parent * fanout + fanout - 1, last_subtree))
    to = F.when(active, F.flatten(F.transform(beside, hearers))).otherwise(F.array("block"))
    sent = state.select(*GROUP, "block", "blocks", "node", "path", subtree.alias("subtree"), F.explode(to).alias("hearer"))
    own = F.col("hearer") == F.col("block")
    heard = sent.groupBy(*GROUP, F.col("hearer").alias("block"), "blocks").agg(
        F.sort_array(F.collect_list(F.struct("subtree", "node"))).alias("nodes"),
        F.first(F.when(own, F.col("path")), ignorenulls=True).alias("path"),
    )

    def joined(keep) -> Column:
        return F.array_join(F.transform(F.filter("nodes", keep), lambda n: n["node"]), "")

    everyone = joined(lambda n: F.lit(True))
    left, right = joined(lambda n: n["subtree"] < subtree), joined(lambda n: n["subtree"] > subtree)
    step = F.array(F.struct(left.alias("left"), right.alias("right")))
    return heard.select(
        *GROUP, "block", "blocks", F.when(active, F.sha2(everyone, 256)).otherwise(F.col("nodes")[0]["node"]).alias("node"),
        F.when(active, F.concat("path", step)).otherwise(F.col("path")).alias("path"),
    )


def tree(rows: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """Blocks of leaves and, for each block, the root of its group and the upper proof."""
    blocks = blocks_of(rows, fanout)
    return blocks, butterfly(block_nodes(blocks, fanout), fanout)


PATH = "array<struct<left:string,right:string>>"
SCHEMA = "id {id}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(blocks: DataFrame, upper: DataFrame, id_type: str = "bigint", with_paths: bool = False, fanout: int = FANOUT) -> DataFrame:
    """One row a leaf, with the digest of all its siblings up to the root and what its claimed leaf folds to.

    ``upper`` has ``named, name, block, subroot, root, path``, the path from the block's top node to the root. ``with_paths`` adds
    ``path``, the siblings left and right of the leaf and of each of its ancestors.
    """
    schema = SCHEMA.format(id=id_type) + f", path {PATH}" * with_paths
    target = arrow_schema(schema)
    width = fanout**BLOCK_LEVELS

    def each(block: int, content: list[dict], subroot: str, root: str, path: list[dict]) -> list[tuple]:
        leaves = [r["leaf"] for r in content]
        levels = lower_levels(leaves, block == 0 and len(leaves) < width, fanout)
        above = [(step["left"], step["right"]) for step in path]
        rest = "".join(left + right for left, right in above).encode()
        out = []
        tops: dict[str, str] = {}
        for place, r in enumerate(content):
            below = siblings(levels, place, fanout)
            proof = hashlib.sha256("".join(left + right for left, right in below).encode())
            proof.update(rest)
            top = folded(r["claim"], below)
            if top not in tops:
                tops[top] = folded(top, above)
            row = (r["id"], r["leaf"], subroot, root, proof.hexdigest(), tops[top], tops[top] == root)
            out.append((*row, [{"left": a, "right": b} for a, b in below + above]) if with_paths else row)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = each(*(c[i].as_py() for c in batch.columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    joined = blocks.join(upper, [*GROUP, "block"]).select("block", "rows", "subroot", "root", "path")
    return joined.mapInArrow(run, schema)


def manifest(
    docs: DataFrame, claimed: dict[str, Column] | None = None, fields: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id",
    with_paths: bool = False, fanout: int = FANOUT,
) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and whether the claimed row leads to the root.

    ``claimed`` replaces fields by the values to verify; without it each row is verified as it stands.
    """
    leaf = leaf_digest([F.col(f) for f in fields])
    changed = [F.lit(False)] + [~F.col(f).eqNullSafe(c) for f, c in (claimed or {}).items()]
    altered = changed[0]
    for c in changed[1:]:
        altered = altered | c
    claim = F.when(altered, leaf_digest([(claimed or {}).get(f, F.col(f)) for f in fields])).otherwise(F.col("leaf"))
    named = F.col(group).isNotNull()
    rows = docs.select(*dict.fromkeys([*fields, group, key])).withColumn("leaf", leaf)
    rows = rows.select(named.alias("named"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("name"), F.col(key).alias("id"), "leaf", claim.alias("claim"))
    rows = stored(rows, "merkle-leaves")  # the only pass over the texts
    blocks, inner = tree(rows, fanout)
    subroots = inner.filter("block = 0").select(
        F.lit(True).alias("named"), F.lit("").alias("name"), F.struct(*GROUP).alias("id"), F.col("node").alias("leaf"), F.col("node").alias("claim")
    )
    top_blocks, top = tree(subroots, fanout)
    top = top.select(*GROUP, "block", F.lit("").alias("subroot"), F.col("node").alias("root"), "path")
    outer = proofs(top_blocks, top, "struct<named:boolean,name:string>", True, fanout)
    outer = outer.select("id.named", "id.name", F.col("leaf").alias("subroot"), "root", F.col("path").alias("outer"))
    upper = inner.join(outer, list(GROUP)).select(*GROUP, "block", "subroot", "root", F.concat("path", "outer").alias("path"))
    return proofs(blocks, upper, docs.schema[key].dataType.simpleString(), with_paths, fanout).withColumnRenamed("id", key)
