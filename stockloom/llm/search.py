"""Ranked lexical search by the Best Position Algorithm.

Documents become rows of term numbers and counts, kept for terms of the queries only; document frequencies and lengths are sums over
these rows. A task then takes a shard of documents and turns it into impact lists: for each term its documents by falling impact, with
direct access from a document to its place in the list. For a query all its lists are read in parallel from the top. Every document
met is looked up in the other lists at once, which gives its score and marks its places as seen there; the best position of a list is
the last of those seen without a gap, and sorted reading goes on behind it. No unseen document can score more than the sum of the
impacts there, and reading stops when that sum is strictly below the ``k``-th best score, so that documents of equal score are still
found. A shard gives each query its ``k`` best; these are ranked in two steps, first by groups of tasks.

A null text has no terms; documents without terms count for nothing and are never found. Rows are documents of their own, also those
of equal id; a null id comes last among equal scores. Queries without terms, or whose terms are in no document, give no rows, as do
empty tables. Query ids are told apart, and rows of one query id are one query of all their terms. A term in the query twice counts
twice. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.shared import arrow_schema, slices, stored
from stockloom.llm.simhash import lower_ascii

# Fixed values of the scoring rule.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, LENGTH_SHARE, SATURATION = 1_000_000_000, 25, 12
TOP = 20
#: Bytes of query texts that are searched for in one pass over the documents; more queries take more passes.
BLOCK_BYTES = 8 << 20
#: Postings of a shard.
SHARD_POSTINGS = 1_000_000
GROUPS = 64

_terms = re.compile(TERM).findall


def terms(text: str | None) -> list[str]:
    return _terms(lower_ascii(text)) if text else []


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_factor(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 for a document of mean length; whole numbers, rounded down."""
    return 100 - LENGTH_SHARE + LENGTH_SHARE * n * documents // total


def impacts(weight: np.ndarray, tf: np.ndarray, factor: np.ndarray) -> np.ndarray:
    return weight * (SCALE * tf // (1000 * tf + SATURATION * factor))


class Shard:
    """Impact lists over some documents, numbered from 0 in the order of their ids.

    ``starts[t]`` to ``starts[t + 1]`` is the list of term ``t``: ``doc`` and ``impact`` by falling impact, and for direct access
    ``by_doc``, the documents in order, and ``place``, where each stands in the list.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, vocabulary: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        ranked = term[order]
        self.starts = np.searchsorted(ranked, np.arange(vocabulary + 1))
        back = np.lexsort((self.doc, ranked))
        self.by_doc = self.doc[back]
        self.place = back - self.starts[ranked[back]]

    def read(self, t: int, first: int, last: int) -> np.ndarray:
        """Sorted access: the documents at places ``first`` to ``last`` of a list."""
        return self.doc[self.starts[t] + first : min(self.starts[t] + last, self.starts[t + 1])]

    def look_up(self, t: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Direct access: which of ``docs`` are in the list, and their places there."""
        a, b = self.starts[t], self.starts[t + 1]
        at = np.minimum(np.searchsorted(self.by_doc[a:b], docs), b - a - 1)
        found = self.by_doc[a:b][at] == docs
        return found, self.place[a:b][at[found]]

    def size(self, t: int) -> int:
        return int(self.starts[t + 1] - self.starts[t])

    def at(self, t: int, places: np.ndarray | int) -> np.ndarray:
        return self.impact[self.starts[t] + places]


def best(shard: Shard, query: list[tuple[int, int]], k: int, floor: int = 0, depth: int = 32) -> tuple[list[tuple[int, int]], int]:
    """The ``k`` best ``(score, document)`` above 0, equal scores by document, and how many list entries were read in order.

    ``query`` has terms with their number. ``floor`` is a score that ``k`` documents elsewhere are known to reach: reading also stops
    strictly below it. All lists are read ``depth`` entries a round, then twice as many.
    """
    lists = [(t, times) for t, times in query if shard.size(t)]
    if not lists:
        return [], 0
    seen = [np.zeros(shard.size(t) + 1, dtype=bool) for t, _ in lists]  # one more place, never seen, ends every list
    positions = [0] * len(lists)  # the first unseen place, behind the best position
    known = np.zeros(0, dtype=np.int64)
    top_score, top_doc = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    read = 0
    while True:
        met = [shard.read(t, bp, bp + depth) for (t, _), bp in zip(lists, positions, strict=True)]
        read += sum(map(len, met))
        fresh = np.setdiff1d(np.concatenate(met), known)
        if len(fresh):
            score = np.zeros(len(fresh), dtype=np.int64)
            for i, (t, times) in enumerate(lists):
                found, places = shard.look_up(t, fresh)
                score[found] += times * shard.at(t, places)
                seen[i][places] = True
            known = np.union1d(known, fresh)
            top_score, top_doc = np.concatenate([top_score, score]), np.concatenate([top_doc, fresh])
            keep = np.lexsort((top_doc, -top_score))[:k]
            keep = keep[top_score[keep] > 0]
            top_score, top_doc = top_score[keep], top_doc[keep]
        positions = [bp + int(np.argmin(s[bp:])) for s, bp in zip(seen, positions, strict=True)]
        bound = 0
        for (t, times), bp in zip(lists, positions, strict=True):
            # an unseen document stands behind the best position, or isn't in the list
            bound += times * int(shard.at(t, bp)) if bp < shard.size(t) else 0
        kth = int(top_score[-1]) if len(top_score) == k else 0
        if bound < max(kth, floor) or bound == 0:
            return list(zip(top_score.tolist(), top_doc.tolist(), strict=True)), read
        depth *= 2


INDEX = "doc_id long, n long, term array<int>, tf array<int>"


def index_of(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """``doc_id, n`` of every document with a term, and which terms of the vocabulary it holds how often."""
    target = arrow_schema(INDEX)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = terms(text)
                if found:
                    counts = sorted((number[t], c) for t, c in Counter(found).items() if t in number)
                    rows.append((doc_id, len(found), [t for t, _ in counts], [c for _, c in counts]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


def search_block(
    index: DataFrame, queries: list[tuple[int, dict[int, int]]], weights: np.ndarray, documents: int, total: int, k: int, shard_postings: int
) -> DataFrame:
    """``item, part, score, doc_id``: the ``k`` best documents of every shard, some of them beaten by those of earlier shards of the task."""
    schema = "item int, part int, score long, doc_id long"
    target = arrow_schema(schema)
    size = len(weights)
    shared = index.sparkSession.sparkContext.broadcast(([(i, sorted(q.items())) for i, q in queries], weights))

    def searched(batches: list[pa.RecordBatch], floors: dict[int, list[int]]) -> pa.RecordBatch:
        wanted, weight = shared.value
        table = pa.Table.from_batches(batches).sort_by([("doc_id", "ascending")]).combine_chunks()  # nulls come last
        ids = table.column("doc_id").to_pylist()
        n = table.column("n").to_numpy().astype(np.int64)
        lists = table.column("term").combine_chunks()
        doc = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        term = lists.flatten().to_numpy().astype(np.int64)
        tf = table.column("tf").combine_chunks().flatten().to_numpy().astype(np.int64)
        impact = impacts(weight[term], tf, length_factor(n, documents, total)[doc])
        shard = Shard(term, doc, impact, size)
        out = []
        for item, query in wanted:
            best_here = floors.setdefault(item, [])
            found, _ = best(shard, query, k, best_here[-1] if len(best_here) == k else 0)
            floors[item] = sorted(best_here + [s for s, _ in found], reverse=True)[:k]
            out += [(item, int(s), ids[d]) for s, d in found if s >= floors[item][-1]]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        parts = [TaskContext.get().partitionId() % GROUPS] * len(out)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([columns[0], parts, *columns[1:]], target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, postings = [], 0
        floors: dict[int, list[int]] = {}
        for batch in slices(batches):
            held.append(batch)
            postings += len(batch.column(2).flatten()) + batch.num_rows
            if postings >= shard_postings:
                yield searched(held, floors)
                held, postings = [], 0
        if held:
            yield searched(held, floors)

    return index.mapInArrow(run, schema)


def query_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """Queries ``(id, term counts)``, so many at a time that their texts are about ``block_bytes``.

    Each block is all that is on the driver; which queries are in it is told by a hash, with as many blocks as the texts need.
    """
    items = items.select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    for block in range(blocks):
        counts: dict = {}
        for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toLocalIterator():
            counts.setdefault(r["item_id"], Counter()).update(terms(r["text"]))
        yield sorted(counts.items(), key=lambda x: (x[0] is None, x[0] or 0))


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP, shard_postings: int = SHARD_POSTINGS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every query."""
    spark = docs.sparkSession
    out = None
    for queries in query_blocks(items, block_bytes):
        words = sorted({t for _, q in queries for t in q})
        vocabulary = {t: i for i, t in enumerate(words)}
        index = stored(index_of(docs, vocabulary), "search-index")
        sums = index.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        holding = index.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()
        weights = np.zeros(len(words), dtype=np.int64)
        for r in holding:  # at most one row for each word of the block
            weights[r["t"]] = term_weight(sums["documents"], r["df"])
        numbered = [(i, {vocabulary[t]: c for t, c in q.items()}) for i, (_, q) in enumerate(queries)]
        found = search_block(index, numbered, weights, sums["documents"], sums["total"], k, shard_postings)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(queries)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        found = found.join(names, "item").drop("item")
        out = found if out is None else out.union(found)
    best_first = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for groups in (["item_id", "part"], ["item_id"]):
        rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*best_first))
        out = out.withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select("item_id", "rank", "doc_id", "score")
