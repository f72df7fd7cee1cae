"""SimHash fingerprints and their near-duplicate groups by bit-sliced comparison.

Fingerprints within the radius agree in two of ``radius + 2`` bands of bits, so they meet in a bucket of two equal bands. A bucket
of more than ``HOT_BUCKET`` fingerprints is split once more by two of the bands of its other bits, which leaves few enough free
bits that no bucket can hold more than 2**16 fingerprints at radius 2. Only distinct fingerprints are compared, each with the
number of its documents gone, so copies cost nothing.

A null or empty text, or one without words, has fingerprint zero and is linked like any other; equal texts share a component;
a component of documents without ids has a null id; a long text is read whole, its hashes counted in rounds; an empty table gives no rows. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.components import component_roots
from stockloom.llm.shared import WORD, arrow_schema, by_batch, packed, row_hash, stored

BITS = 64
HOT_BUCKET = 4096


def lower_ascii(text: str) -> str:
    if text.isascii():
        return text.lower()
    return text.translate(_LOWER)


_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def fingerprint(text: str | None, words: int = 3, seed: int = 42, find=re.compile(WORD).findall) -> int:
    """A bit is 1 if over half the shingles' hashes have it; a shorter text is one shingle, none gives 0."""
    found = find(lower_ascii(text or ""))
    if not found:
        return 0
    if len(found) < words:
        shingles = [" ".join(found)]
    else:
        shingles = map(" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, seed) for s in shingles], dtype=np.uint64)
    return int(np.packbits(2 * bit_counts(h) > len(h), bitorder="little").view("<u8")[0])


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, in rounds that keep byte-wide sums."""
    total = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(h), 4096):
        bits = np.unpackbits(h[start : start + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return total


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id``, a hash of the text, and the fingerprint as a signed long."""

    def each(rows: dict[str, list]) -> dict[str, list]:
        found = np.array([fingerprint(t, words, seed) for t in rows["text"]], dtype=np.uint64).view(np.int64)
        return {"doc_id": rows["doc_id"], "text_key": rows["text_key"], "fingerprint": found}

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return by_batch(keyed, each, "doc_id long, text_key long, fingerprint long")


def band_edges(bits: int, bands: int) -> list[int]:
    return [bits * i // bands for i in range(bands + 1)]


def two_band_keys(value: Column, low: int, high: int, bands: int) -> list[tuple[Column, tuple[int, ...]]]:
    """For each pair of bands of the bits ``low`` to ``high``: those bits as a number, and which bits they are."""
    edges = [low + x for x in band_edges(high - low, bands)]
    keys = []
    for i, j in combinations(range(bands), 2):
        wide = edges[i + 1] - edges[i]
        one = F.shiftrightunsigned(value, edges[i]).bitwiseAND((1 << wide) - 1)
        other = F.shiftrightunsigned(value, edges[j]).bitwiseAND((1 << (edges[j + 1] - edges[j])) - 1)
        keys.append((F.shiftleft(other, wide).bitwiseOR(one), (*range(edges[i], edges[i + 1]), *range(edges[j], edges[j + 1]))))
    return keys


class BitPlanes:
    """Fingerprints of neighbouring buckets, stored as one bit vector for each bit of the fingerprint.

    ``links(k)`` compares every fingerprint with the one ``k`` places on: each word of a vector holds that bit of 64
    fingerprints, so one XOR gives a bit of 64 differences, and a carry-save counter of few bit planes counts them all at once.
    """

    def __init__(self, values: np.ndarray, bits: list[int], radius: int):
        self.n = len(values)
        self.words = -(-self.n // 64)
        self.radius = radius
        rows = np.zeros((self.words * 64, 8), dtype=np.uint8)
        rows[: self.n] = values.astype("<u8").view(np.uint8).reshape(-1, 8)
        flat = np.unpackbits(rows, axis=1, bitorder="little")
        planes = np.packbits(np.ascontiguousarray(flat.T[bits]), axis=1, bitorder="little")
        self.planes = np.zeros((len(bits), self.words + 2), dtype=np.uint64)
        self.planes[:, : self.words] = planes.view("<u8")

    def links(self, k: int, together: np.ndarray) -> np.ndarray:
        """Places ``i`` with ``together[i]`` whose fingerprint is within the radius of that at ``i + k``."""
        mask = np.zeros(self.words * 64, dtype=bool)
        mask[: len(together)] = together
        alive = np.packbits(mask, bitorder="little").view("<u8").copy()
        at = np.flatnonzero(alive)
        alive = alive[at]
        counters = [np.zeros(len(at), dtype=np.uint64) for _ in range(max(1, self.radius.bit_length()))]
        skip, shift = divmod(k, 64)
        for number, plane in enumerate(self.planes):
            if not len(at):
                break
            moved = plane[np.minimum(at + skip, self.words)]
            if shift:
                moved = (moved >> np.uint64(shift)) | (plane[np.minimum(at + skip + 1, self.words)] << np.uint64(64 - shift))
            carry = plane[at] ^ moved
            for i, counter in enumerate(counters):
                counters[i], carry = counter ^ carry, counter & carry
            alive &= ~(carry | self._above(counters))
            if number % 4 == 3:  # blocks of 64 comparisons that have all left the radius are abandoned
                keep = np.flatnonzero(alive)
                if len(keep) < len(at):
                    at, alive, counters = at[keep], alive[keep], [c[keep] for c in counters]
        found = np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 64)
        word, bit = np.nonzero(found)
        return at[word] * 64 + bit

    def _above(self, counters: list[np.ndarray]) -> np.ndarray:
        """Bits whose counter has passed the radius, from the highest plane down."""
        above = np.zeros_like(counters[0])
        equal = ~above
        for i in reversed(range(len(counters))):
            if self.radius >> i & 1:
                equal = equal & counters[i]
            else:
                above |= equal & counters[i]
                equal = equal & ~counters[i]
        return above


def star_links(keys: np.ndarray, values: np.ndarray, bits: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of equal keys, ``values`` sorted by key: each value with the first of those it is connected with in its bucket."""
    group = np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]]))
    size = np.bincount(group)[group]
    parent = np.arange(len(values))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    k, planes, places = 1, None, np.arange(len(values))
    while True:
        if planes is None or k & (k - 1) == 0:  # smaller buckets are done: go on with the others
            places = places[size[places] > k]
            if len(places) < 2:
                break
            planes = BitPlanes(values[places], bits, radius)
        own = group[places]
        for i in planes.links(k, own[k:] == own[:-k]).tolist():
            a, b = root(places[i]), root(places[i + k])
            parent[max(a, b)] = min(a, b)
        k += 1
        if k >= len(places):
            break
    roots = np.array([root(i) for i in range(len(values))], dtype=np.int64)
    linked = np.flatnonzero(roots != np.arange(len(values)))
    return values[linked], values[roots[linked]]


def near_links(values: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints of ``values`` within the radius of each other.

    Inside a bucket a chain of links stands for all its pairs; none between different components is made, none is lost.
    """
    bands = radius + 2
    value = F.col("fingerprint")
    first = two_band_keys(value, 0, BITS, bands)
    keyed = values.select("fingerprint", F.posexplode(F.array(*(k for k, _ in first))).alias("combo", "key"))
    sizes = keyed.groupBy("combo", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_BUCKET)
    keyed = keyed.join(sizes.withColumn("hot", F.lit(True)).drop("n"), ["combo", "key"], "left")
    free = [[b for b in range(BITS) if b not in used] for _, used in first]
    # the free bits, moved together, are banded again
    rest = F.lit(None).cast("long")
    for combo, bits in enumerate(free):
        rest = F.when(F.col("combo") == combo, _gather(value, bits)).otherwise(rest)
    keyed = keyed.withColumn("rest", rest)
    width = min(len(b) for b in free)
    second = two_band_keys(F.col("rest"), 0, width, bands)
    subs = F.array(*(F.struct(F.lit(i).alias("sub"), k.alias("subkey")) for i, (k, _) in enumerate(second)))
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("subkey")))
    keyed = keyed.select("combo", "key", "fingerprint", F.inline(F.when(F.col("hot"), subs).otherwise(whole)))
    order = ["combo", "key", "sub", "subkey"]
    keyed = keyed.repartition(*order).sortWithinPartitions(*order, "fingerprint")
    used_second = [set(used) for _, used in second]

    def compared_bits(combo: int, sub: int) -> list[int]:
        return [b for i, b in enumerate(free[combo]) if sub < 0 or i not in used_second[sub]]

    schema = "a long, b long"
    target = arrow_schema(schema)

    def compare(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        combo, key, sub, subkey, found = columns
        kind = combo.astype(np.int64) * 64 + sub
        for cut in np.split(np.arange(len(kind)), np.flatnonzero(kind[1:] != kind[:-1]) + 1):
            if len(cut) < 2:
                continue
            step = (key[cut][1:] != key[cut][:-1]) | (subkey[cut][1:] != subkey[cut][:-1])
            bucket = np.concatenate([[0], np.cumsum(step)])
            a, b = star_links(bucket, found[cut].view(np.uint64), compared_bits(int(combo[cut[0]]), int(sub[cut[0]])), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in [*order, "fingerprint"]]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            if not len(columns[0]):
                continue
            same = np.all([c == c[-1] for c in columns[:4]], axis=0)
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last bucket may go on
            yield from compare([c[:last] for c in columns])
            held = [c[last:] for c in columns]
        if held is not None:
            yield from compare(held)

    return keyed.mapInArrow(run, schema)


def _gather(value: Column, bits: list[int]) -> Column:
    """The bits moved together, lowest first."""
    out, at = F.lit(0).cast("long"), 0
    while at < len(bits):
        run = 1
        while at + run < len(bits) and bits[at + run] == bits[at] + run:
            run += 1
        part = F.shiftrightunsigned(value, bits[at]).bitwiseAND((1 << run) - 1)
        out = out.bitwiseOR(F.shiftleft(part, at))
        at += run
    return out


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document; the component's smallest document id names it.

    ``text_key`` is a hash of the document's text, ``component_key`` that of the document the component is named after.
    """
    marked = stored(fingerprints(docs, words, seed), "simhash")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("least")
    values = stored(marked.groupBy("fingerprint").agg(least), "simhash-values")
    roots = component_roots(near_links(values.select("fingerprint"), radius))
    rooted = values.join(roots, values["fingerprint"] == roots["node"], "left")
    rooted = rooted.select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("least"))
    classes = rooted.drop("least").join(named, "root").select(
        "fingerprint", F.col("least.doc_id").alias("component_id"), F.col("least.text_key").alias("component_key")
    )
    shown = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return marked.join(classes, "fingerprint").select("doc_id", shown, "component_id", "text_key", "component_key")


def one_of_each(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """One row of ``docs`` for each component, with its own columns: the one that names it.

    The join and the choice among repeated rows share their key, and so one shuffle of the texts; for that a null id is told by a
    flag, as a null-safe comparison would hide the key. Of rows equal in id and text the one with the smallest hash of all its columns
    stays, so that a repeated run keeps the same one. Columns may have any name.
    """

    def key(doc_id: Column, text_key: Column) -> dict[str, Column]:
        doc_id = doc_id.cast("long")
        return {"unnamed": doc_id.isNull(), "id": F.coalesce(doc_id, F.lit(0)), "key": text_key}

    names = ["unnamed", "id", "key"]
    kept = near_duplicates(docs, words, radius, seed).select(
        *[c.alias(n) for n, c in key(F.col("component_id"), F.col("component_key")).items()]
    )
    rows = packed(docs)
    keyed = rows.withColumns(key(F.col("row")["doc_id"], F.xxhash64(F.col("row")["text"])))
    first = F.row_number().over(Window.partitionBy(*names).orderBy(row_hash(rows)))
    chosen = keyed.join(kept.distinct(), names, "left_semi").withColumn("place", first)
    return chosen.filter("place = 1").select("row.*")
