"""Best-fit packing of documents into sequences after Martello and Toth's dominance reduction.

Pieces of one length are interchangeable, so the packing is decided on how many pieces there are of each length: at most
``capacity`` numbers, whatever the size of the corpus. The reduction fixes sequences that dominate all alternatives for their
longest piece, many equal ones at a time; best fit, longest pieces first, fills the rest. The result is a list of kinds of
sequences with their number; each round of best fit adds at most four kinds, each of at most ``sqrt(2 * capacity)`` different
lengths, so the list has a proven bound too. Spark numbers the pieces of a length and finds their places in it.

Null texts count as empty: their end id is a piece of length one. Repeated document ids are separate documents, an empty table
gives no pieces. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.bpe import WordEncoder
from stockloom.llm.shared import arrow_schema, slices, stored

CAPACITY = 2048
SALT_ROWS = 2_000

Kind = tuple[int, list[tuple[int, int]]]  # number of sequences; (length, pieces) in each


class Stock:
    """How many pieces are left of each length."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 2, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n

    def largest(self, most: int, without: tuple[int, ...] = ()) -> int:
        """Largest length up to ``most`` of which a piece is left besides ``without``; 0 if none."""
        for length in np.flatnonzero(self.left[: max(most, 0) + 1])[::-1]:
            if self.left[length] > without.count(int(length)):
                return int(length)
        return 0

    def smallest(self, number: int, without: int) -> list[int]:
        found: list[int] = []
        for length in np.flatnonzero(self.left):
            n = int(self.left[length]) - (length == without)
            found += [int(length)] * min(n, number - len(found))
            if len(found) == number:
                break
        return found

    def take(self, lengths: list[int]) -> Kind:
        """As many sequences of these pieces as there are."""
        each = {x: lengths.count(x) for x in lengths}
        n = min(int(self.left[x]) // c for x, c in each.items())
        for x, c in each.items():
            self.left[x] -= n * c
        return n, sorted(each.items(), reverse=True)


def dominating(stock: Stock, longest: int, capacity: int) -> list[int] | None:
    """Pieces of a sequence with ``longest`` that dominates every other sequence for it; None if none of up to three is found.

    One set dominates another if the other's pieces can be laid into the places of its own. A single piece that leaves no room
    dominates; so does the largest that fits, if it fills the sequence, or if no second one fits beside any, or if no two that
    fit are longer together. With room for two at most, the largest and the largest beside it dominate if each pair with a
    longer second piece would fit into the place of the first.
    """
    room = capacity - longest
    first = stock.largest(room, (longest,))
    if not first:
        return [longest]
    if first == room:
        return [longest, first]
    least = stock.smallest(3, longest)
    if len(least) < 2 or least[0] + least[1] > room:
        return [longest, first]
    if len(least) == 3 and sum(least) <= room:
        return None
    second = stock.largest(room - first, (longest, first))
    beyond = 0  # longest pair with a second piece above `second`
    total = 0  # longest pair of all
    for x in (int(x) for x in np.flatnonzero(stock.left[: room // 2 + 1])):
        if stock.left[x] <= (x == longest):
            continue
        y = stock.largest(room - x, (longest, x))
        if y >= x:
            total = max(total, x + y)
            if x > second:
                beyond = max(beyond, x + y)
    if total <= first:
        return [longest, first]
    return [longest, first, second] if second and beyond <= first else None


def reduce(stock: Stock, capacity: int) -> list[Kind]:
    """Fix dominating sequences from the longest piece down; what stays in ``stock`` is the smaller instance."""
    kinds = []
    for longest in range(capacity, 0, -1):
        while stock.left[longest]:
            found = dominating(stock, longest, capacity)
            if found is None:
                break
            kinds.append(stock.take(found))
    return kinds


def best_fit(stock: Stock, capacity: int) -> list[Kind]:
    """Best fit, longest pieces first, for many equal sequences at a time.

    A sequence that has taken a piece is the fullest that still fits the next of the same length, so sequences fill up one by one.
    """
    kinds: dict[int, list[Kind]] = {}  # by room left
    rooms: list[int] = []

    def put(room: int, n: int, pieces: list[tuple[int, int]]) -> None:
        if n:
            if room not in kinds:
                kinds[room] = []
                heapq.heappush(rooms, room)
            kinds[room].append((n, pieces))

    for length in range(capacity, 0, -1):
        left = int(stock.left[length])
        stock.left[length] = 0
        while left:
            room = min((r for r in kinds if r >= length and kinds[r]), default=None)
            if room is None:
                each = capacity // length
                full, rest = divmod(left, each)
                put(capacity - each * length, full, [(length, each)])
                put(capacity - rest * length, int(rest > 0), [(length, rest)])
                break
            n, pieces = kinds[room].pop()
            each = room // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            put(room - each * length, full, [*pieces, (length, each)])
            if rest:
                put(room - rest * length, 1, [*pieces, (length, rest)])
            put(room, n - full - (rest > 0), pieces)
            left -= full * each + rest
    return [kind for found in kinds.values() for kind in found]


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[Kind]:
    """Kinds of sequences that hold ``counts[length]`` pieces of each length."""
    stock = Stock(counts, capacity)
    return reduce(stock, capacity) + best_fit(stock, capacity)


def places(kinds: list[Kind], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Runs of places, by length and by number of the piece within its length: first number, first sequence, pieces a sequence, offset."""
    runs, used, base = [], dict.fromkeys(range(capacity + 1), 0), 0
    for n, pieces in kinds:
        offset = 0
        for length, each in pieces:
            runs.append((length, used[length], base, each, offset))
            used[length] += n * each
            offset += length * each
        base += n
    runs.sort()
    columns = np.array(runs, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "sequence", "each", "offset"), columns, strict=True))


def pieces_of(
    docs: DataFrame, vocabulary: str, keeps_space: bool, end_id: int, capacity: int, with_ids: bool, escape: bool = False
) -> DataFrame:
    """Token ids of every document, its end id last, in pieces of at most ``capacity``."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    target = arrow_schema(schema)
    end, width = struct.pack("<I", end_id), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(vocabulary, keeps_space, escape=escape)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encoder.encode(text) + end
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, part) if with_ids else row)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(cut, schema)


def pack_documents(
    docs: DataFrame, vocabulary: str = "word_bpe_49k.json", keeps_space: bool = False, end_id: int = 0,
    capacity: int = CAPACITY, with_ids: bool = False, escape: bool = False,
) -> DataFrame:
    """Place every piece of every document: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    Special strings in texts get their own ids, as the tokenizer does by default, unless ``escape`` is set.
    Pieces of a length are numbered within salts of about ``SALT_ROWS`` rows, so a length that most pieces share is spread
    over many tasks.
    """
    spark = docs.sparkSession
    pieces = stored(pieces_of(docs, vocabulary, keeps_space, end_id, capacity, with_ids, escape), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = spark.sparkContext.broadcast(places(pack_counts(counts, capacity), capacity))
    salts = [1 + counts.get(length, 0) // SALT_ROWS for length in range(capacity + 1)]
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(F.lit(salts), F.col("length").cast("int") + 1))
    salted = pieces.withColumn("salt", salt)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    numbered = salted.withColumn("number", within - 1).join(starts, ["length", "salt"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        runs = found.value
        length, number = length.to_numpy(), number.to_numpy()
        order = runs["length"] * (1 << 48) + runs["first"]
        at = np.searchsorted(order, length * (1 << 48) + number, side="right") - 1
        sequence, nth = np.divmod(number - runs["first"][at], runs["each"][at])
        return pd.DataFrame({"sequence_id": runs["sequence"][at] + sequence, "offset": runs["offset"][at] + nth * length})

    placed = numbered.withColumn("place", place("length", F.col("base") + F.col("number")))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset"]
    return placed.select(*columns, *(["ids"] if with_ids else []))
