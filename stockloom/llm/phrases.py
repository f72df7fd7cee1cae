"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases, the phrases into longer ones, and so on. At each level runs of one symbol become one symbol; rounds
of deterministic coin tossing then give every place a label below 6 that differs from its neighbour's and depends on a few symbols
before it only; phrases begin where a label is a local maximum, so they have two to about ten symbols; and a phrase is named by a
hash of its symbols. Equal substrings are therefore cut alike, except near their ends, wherever they stand.

A fingerprint keeps the smallest hashes of a text's different phrase names: those of the third level (about 25 characters each), and
for short texts of the second and first too. Its likeness to another is the share of common hashes at the finest level both have.

Null and empty texts have the empty fingerprint ``-``, of likeness 1 to itself and 0 to others; equal texts have equal fingerprints;
one document is its own successor; rows of equal document id follow each other by text; a null id comes last; an empty table gives
no rows. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.shared import arrow_schema, id_bounds, part_count, part_of, slices

LEVELS = 3
KEEP = (16, 24, 48)
#: A level is kept if the next one has fewer phrases than this.
FEW = 24
BATCH_CHARS = 1 << 19

_NONE = np.iinfo(np.int64).min
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers() -> np.ndarray:
    out = [1]
    for _ in range(63):
        out.append(out[-1] * 0xA0761D6478BD642F % 2**64)
    return np.array(out, dtype=np.uint64)


_POWERS = _powers()


def toss(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing: the lowest bit in which a symbol differs from the one before, and that bit's value.

    The first symbol of a document is told from its own complement in bit 0, which keeps neighbours different.
    """
    one = symbols.dtype.type(1)
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[first] = symbols[first] ^ one
    differ = symbols ^ before
    place = np.bitwise_count((differ & (~differ + one)) - one)
    return (2 * place + ((symbols >> place.astype(symbols.dtype)) & one).astype(np.uint8)).astype(np.uint8)


def level(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level's phrases, and where each document's first is. ``first``: ascending places in ``symbols``."""
    start = np.ones(len(symbols), dtype=bool)
    start[1:] = symbols[1:] != symbols[:-1]
    start[first] = True
    at = np.flatnonzero(start)
    run = np.diff(at, append=len(symbols))
    names = symbols[at]
    names = np.where(run > 1, mix(names + run.astype(np.uint64) * _STEP), names)
    first = np.searchsorted(at, first)
    labels = names
    for _ in range(4):
        labels = toss(labels, first)
    before = np.empty(len(labels), dtype=np.int8)
    before[1:] = labels[:-1]
    before[first] = -1
    after = np.empty(len(labels), dtype=np.int8)
    after[:-1] = labels[1:]
    after[first[1:] - 1] = -1
    after[-1] = -1
    cut = (labels > before) & (labels > after)
    cut[first] = True
    at = np.flatnonzero(cut)
    size = np.diff(at, append=len(names))
    inside = np.arange(len(names)) - np.repeat(at, size)
    total = np.add.reduceat(names * _POWERS[np.minimum(inside, 63)], at)
    return mix(total + size.astype(np.uint64) * _STEP), np.searchsorted(at, first)


def smallest(names: np.ndarray, first: np.ndarray, wanted: np.ndarray, keep: int) -> list[list[int]]:
    """The smallest ``keep`` different 32-bit hashes of each wanted document's names."""
    count = np.diff(first, append=len(names))
    doc = np.repeat(np.arange(len(first)), count)
    pick = wanted[doc]
    key = np.unique((doc[pick].astype(np.uint64) << np.uint64(32)) | (names[pick] >> np.uint64(32)))
    doc = (key >> np.uint64(32)).astype(np.int64)
    begin = np.searchsorted(doc, np.arange(len(first) + 1))
    values = (key & np.uint64(0xFFFFFFFF)).tolist()
    return [values[a : min(b, a + keep)] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


Sketch = tuple[tuple[int, ...], ...]  # the hashes of each level, coarsest last; empty where a level isn't kept


def sketches(texts: list[str]) -> list[Sketch]:
    """Parse the texts together; the result of each is what it would be alone."""
    out: list[Sketch] = [((),) * LEVELS] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    symbols = np.frombuffer("".join(texts[i] for i in full).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    first = np.cumsum([0, *(len(texts[i]) for i in full[:-1])])
    found = []
    for _ in range(LEVELS):
        symbols, first = level(symbols, first)
        found.append((symbols, first))
    counts = [np.diff(f, append=len(s)) for s, f in found]
    kept = []
    for n, (names, starts) in enumerate(found):
        wanted = np.ones(len(full), dtype=bool) if n == LEVELS - 1 else counts[n + 1] < FEW
        kept.append(smallest(names, starts, wanted, KEEP[n]))
    for i, *levels in zip(full, *kept, strict=True):
        out[i] = tuple(map(tuple, levels))
    return out


def shown(sketch: Sketch) -> str:
    return "-".join("".join(f"{x:08x}" for x in part) for part in sketch) if sketch[-1] else "-"


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated share of common phrases among all, at the finest level that both keep."""
    if not a[-1] or not b[-1]:
        return float(a == b)
    for n in range(LEVELS):
        if a[n] and b[n]:
            merged = sorted({*a[n], *b[n]})[: KEEP[n]]
            both = {*a[n]} & {*b[n]}
            return sum(x in both for x in merged) / len(merged)
    return 0.0


def edited(text: str, following: str) -> str:
    """The second half is replaced by the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Documents by descending id in one partition for each range of ids, and the number of ranges.

    Rows ``doc_id, text, ghost``: the last row of a partition is followed by a ghost of the next range's first, and the last range by
    a ghost of the very first row. Texts are shuffled once; only a bound and the highest id of each range reach the driver.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE))
    docs = docs.select(key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = id_bounds(docs, part_count(docs), "key")
    docs = docs.withColumn("part", part_of(F.col("key"), bounds))
    tops = sorted((r["part"], r["key"]) for r in docs.groupBy("part").agg(F.max("key").alias("key")).collect())
    parts = [p for p, _ in tops]
    ids = np.array([k for _, k in tops], dtype=np.int64)
    goes = np.array([*parts[1:], *parts[:1]], dtype=np.int32)

    @F.pandas_udf("int")
    def ghost_part(keys: pd.Series) -> pd.Series:
        k = keys.to_numpy()
        at = np.minimum(np.searchsorted(ids, k), len(ids) - 1)
        return pd.Series(np.where(ids[at] == k, goes[at], -1).astype("int32"))

    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost"))
    other = F.struct(F.col("goes").alias("part"), F.lit(True).alias("ghost"))
    targets = F.when(F.col("goes") >= 0, F.array(own, other)).otherwise(F.array(own))
    if not tops:
        targets = F.array(own)
        docs = docs.withColumn("goes", F.lit(-1))
    else:
        docs = docs.withColumn("goes", ghost_part("key"))
    placed = docs.withColumn("targets", targets).select("key", "text", F.inline("targets"))
    n = len(bounds) + 1
    placed = placed.repartitionById(n, "part").sortWithinPartitions("ghost", F.col("key").desc(), "text")
    return placed.select("key", "text", "ghost"), n


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness and that of the next document."""
    target = arrow_schema(SCHEMA)

    def finished(keys: list[int], texts: list[str]) -> pa.RecordBatch:
        """Rows of all documents but the last, which only follows."""
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        found = sketches(texts + changed)
        own, other = found[: len(texts)], found[len(texts) :]
        columns = [
            [None if k == _NONE else k for k in keys[:-1]], [len(t) for t in texts[:-1]],
            [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            [shown(s) for s in own[:-1]], [shown(s) for s in other],
            [likeness(a, b) for a, b in zip(own, other, strict=False)], [likeness(a, b) for a, b in zip(own, own[1:], strict=False)],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int] = []
        texts: list[str] = []
        held, ended = 0, False
        for batch in slices(batches, BATCH_CHARS):
            for key, text, ghost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ended:  # further ghosts of the same id
                    continue
                ended = ghost
                keys.append(key)
                texts.append(text)
                held += len(text)
                if held > BATCH_CHARS and len(texts) > 1:
                    yield finished(keys, texts)
                    keys, texts, held = keys[-1:], texts[-1:], len(texts[-1])
        if len(texts) > 1:
            yield finished(keys, texts)

    return with_next(docs)[0].mapInArrow(run, SCHEMA)
