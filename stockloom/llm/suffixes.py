"""Repeated passages by longest-previous-factor arrays over suffixes dealt by anchors.

A position is repeated if the ``length`` bytes from it are found at another position too. Every string of ``length`` bytes has an
anchor: of all its ``gram``-byte pieces the one of the smallest hash, the first of equals. Equal strings have equal anchors at equal
places, so suffixes that share so long a prefix meet in their anchor's bucket, and buckets can be worked on apart. The stretch of
positions with one anchor, and the bytes they reach over, is the anchor's context.

Anchors found once have no repeats. Where all contexts of an anchor are equal, all of its positions are repeats and no text is
needed. Only where contexts differ is one text of each context fetched; its suffixes are sorted with those of the bucket, neighbours'
common prefixes are measured, and previous and next smaller positions in suffix order give each suffix its longest previous factor and
where that is. A suffix with a previous factor of ``length`` is a later copy, and the place of that factor an earlier one. A bucket
of more than ``HOT_CONTEXTS`` different contexts is cut into smaller ones by what surrounds the anchor, as often as need be.

``keep_first`` leaves the first copy, in order of id and place, and removes the later ones; without it all copies go. Removal is
judged on the input. Null texts count as empty; a text shorter than ``length`` has no repeats; rows with a null id come last in order;
rows equal in id and text are copies of each other, any one of them the first; an empty table gives no rows. Long texts are read in
pieces, a removed stretch may end inside a character. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.shared import arrow_schema, slices, stored

LENGTH, GRAM = 200, 40
HOT_CONTEXTS = 1024
CHUNK = 1 << 20
SORTED_WINDOWS = 1 << 16

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOW32 = np.uint64(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number, in place."""
    x ^= x >> np.uint64(32)
    x *= _B
    x ^= x >> np.uint64(29)
    return x


_BYTES = mixed(mixed((np.arange(1, 257, dtype=np.uint64)) * _A))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a string from those of its halves."""
    out = left * _A
    out += right
    return mixed(out)


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the 32 bytes from each position."""
    h, half = _BYTES[data], 1
    while half < 32:
        h = joined(h[:-half], h[half:])
        half *= 2
    return h


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring numbers, from running minima of blocks in both directions."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def anchors(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Contexts of the windows that begin at ``starts`` (a mask): first window, count, anchor's place, anchor and context hash."""
    pieces = piece_hashes(data)
    grams = joined(pieces[: len(data) - gram + 1], pieces[gram - 32 : len(data) - 31])
    ranked = grams & ~_LOW32
    ranked |= np.arange(len(grams), dtype=np.uint64)
    place = (window_minima(ranked, length - gram + 1) & _LOW32).astype(np.int64)
    at = np.flatnonzero(starts[: len(place)])
    if not len(at):
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),) * 2
    place = place[at]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
    begin = np.flatnonzero(new)
    first, count = at[begin], np.diff(begin, append=len(at))
    place = place[begin]
    last = first + count - 1 + length - 32
    context = (count * 1024 + (place - first)).astype(np.uint64)
    for step in range(0, 2 * length - gram, 32):
        context = joined(context, pieces[np.minimum(first + step, last)])
    return first, count, place, grams[place], context


def runs_of(doc: np.ndarray, place: np.ndarray, anchor: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring equal contexts at equal steps, as in periodic text: where each run begins, its step and length."""
    if not len(place):
        return (np.zeros(0, dtype=np.int64),) * 3
    step = np.diff(place)
    same = (doc[1:] == doc[:-1]) & (anchor[1:] == anchor[:-1]) & (context[1:] == context[:-1])
    go_on = np.concatenate([[False], same[1:] & same[:-1] & (step[1:] == step[:-1])])
    # a run is a first member, a second that fixes the step, and others at the same step
    begins = np.flatnonzero(~np.concatenate([[False], same & (go_on | ~np.concatenate([[False], same[:-1]]))]))
    times = np.diff(begins, append=len(place))
    return begins, np.where(times > 1, np.append(step, 0)[begins], 0), times


MARKS = "rid long, doc_id long, text_key long, anchor long, context long, at long, step long, times long"


def marked(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """A row for each document, with its number ``rid``, and one for each context (or run of equal ones) in it.

    ``at`` is the anchor's place, the windows before it and the number of windows less one, eight bits each for the last two.
    """
    target = arrow_schema(MARKS)

    def rows(rid, doc_id, key, text: list[bytes]) -> Iterator[pa.RecordBatch]:
        none = pa.nulls(len(rid), pa.int64())
        yield pa.RecordBatch.from_arrays([rid, doc_id, key, *[none] * 5], schema=target)
        numbers = rid.to_numpy()
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for n, t in zip(numbers.tolist(), text, strict=True):
            for begin in range(0, max(len(t) - length + 1, 0), CHUNK):
                piece = t[begin : begin + CHUNK + length - 1]
                held.append((n, begin, piece))
                size += len(piece)
                if size >= CHUNK:
                    yield contexts(held)
                    held, size = [], 0
        if held:
            yield contexts(held)

    def contexts(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        sizes = np.array([len(p) for _, _, p in held])
        data = np.frombuffer(b"".join(p for _, _, p in held), dtype=np.uint8)
        owner = np.repeat(np.arange(len(held)), sizes)
        base = np.cumsum(sizes) - sizes
        starts = np.arange(len(data)) - base[owner] <= sizes[owner] - length
        first, count, place, anchor, context = anchors(data, starts, length, gram)
        doc = owner[first]
        local = place - base[doc] + np.array([b for _, b, _ in held])[doc]
        begins, step, times = runs_of(doc, place, anchor, context)
        at = (local << 16) | (place - first << 8) | (count - 1)
        number = np.array([n for n, _, _ in held])[doc]
        none = pa.nulls(len(begins), pa.int64())
        columns = [number[begins], none, none, anchor[begins].view(np.int64), context[begins].view(np.int64), at[begins], step, times]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield from rows(*batch.columns[:3], batch.column(3).to_pylist())

    keyed = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    return keyed.mapInArrow(run, MARKS)


def previous_factors(order: list[int], common: list[int]) -> tuple[dict[int, int], dict[int, int]]:
    """Longest previous factor of each position and where it is, from the suffix order and neighbours' common prefixes.

    The stack holds the previous smaller positions of the suffix at hand; a suffix leaves it when its next smaller one comes.
    """
    longest: dict[int, int] = {}
    source: dict[int, int] = {}
    stack: list[tuple[int, int]] = []
    for here, shared in [*zip(order, common, strict=True), (-1, 0)]:
        while stack and stack[-1][0] > here:
            place, back = stack.pop()
            longest[place] = max(back, shared)
            source[place] = here if shared > back else stack[-1][0] if stack else -1
            shared = min(back, shared)
        stack.append((here, shared))
    return longest, source


def copies(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the strings (rows, in order of position) have an earlier copy, and which have any.

    They are sorted as suffixes; previous factors are sought in stretches of the order whose neighbours share all bytes.
    """
    length = windows.shape[1]
    order = np.argsort(windows.view(f"S{length}").ravel(), kind="stable")
    ranked = windows[order]
    differ = ranked[1:] != ranked[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    earlier, repeated = np.zeros(len(windows), dtype=bool), np.zeros(len(windows), dtype=bool)
    edges = np.flatnonzero(np.concatenate([[True], common < length, [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > 1:
            longest, source = previous_factors(order[a:b].tolist(), [0, *common[a : b - 1].tolist()])
            for place, shared in longest.items():
                if shared >= length:
                    earlier[place] = repeated[place] = repeated[source[place]] = True
    return earlier, repeated


def stretches(flags: np.ndarray, length: int) -> list[dict[str, int]]:
    """Bytes under the windows that are flagged, as ``lo, hi`` from the first window on; ends that meet are joined."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    return [{"lo": int(a), "hi": int(b) + length} for a, b in zip(at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)], strict=True)]


SPANS = "array<struct<lo:long,hi:long>>"
VERDICTS = f"anchor long, context long, earlier {SPANS}, repeated {SPANS}"


def judged(pieces: DataFrame, length: int) -> DataFrame:
    """Verdicts on the contexts of buckets that one task can sort: ``pieces`` has their bytes and ``order``, equal contexts may recur."""
    target = arrow_schema(VERDICTS)

    def decide(group: list[tuple]) -> pa.RecordBatch:
        group.sort(key=lambda r: r[2])
        windows = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(r[3], dtype=np.uint8), length) for r in group]
        earlier, repeated = copies(np.ascontiguousarray(np.concatenate(windows)))
        ends = np.cumsum([len(w) for w in windows])[:-1]
        columns = [
            [r[0] for r in group], [r[1] for r in group], [stretches(x, length) for x in np.split(earlier, ends)],
            [stretches(x, length) for x in np.split(repeated, ends)],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole buckets, and the one that is still coming in
        size, last = 0, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for anchor, context, order, piece in zip(*columns, strict=True):
                if (anchor, context) == last:
                    continue
                if held and anchor != held[-1][0] and size > SORTED_WINDOWS:
                    yield decide(held)
                    held, size = [], 0
                last = (anchor, context)
                held.append((anchor, context, tuple(order.values()), piece))
                size += len(piece) - length + 1
        if held:
            yield decide(held)

    dealt = pieces.select("anchor", "context", "order", "piece").repartition("anchor").sortWithinPartitions("anchor", "context")
    return dealt.mapInArrow(run, VERDICTS)


def families(pieces: DataFrame, width: int, length: int) -> DataFrame:
    """Cut contexts into parts whose windows have the anchor at places of one family of ``width``.

    All windows of a family share the bytes around the anchor that each of them reaches, at least ``length - width + 1``; a hash of
    these names the part's bucket. ``base`` is the part's first window in its context, ``before`` the windows before its anchor.
    """
    order = pieces.schema["order"].dataType.simpleString()
    schema = f"anchor long, context long, order {order}, base long, bucket long, content long, before long, piece binary"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            out = []
            for anchor, context, order, before, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lowest = before - (len(piece) - length)
                for low in range(lowest - lowest % width, before + 1, width):
                    first, last = before - min(before, low + width - 1), before - max(lowest, low)
                    part = piece[first : last + length]
                    common = piece[before - low : before - low - width + 1 + length]
                    out.append({
                        "anchor": anchor, "context": context, "order": order, "base": first, "before": before - first, "piece": part,
                        "bucket": _signed(xxhash.xxh3_64_intdigest(common, low)), "content": _signed(xxhash.xxh3_64_intdigest(part, before - first)),
                    })
            yield pa.RecordBatch.from_pylist(out, schema=target)

    return pieces.select("anchor", "context", "order", "before", "piece").mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def judged_hot(pieces: DataFrame, length: int, hot: int, width: int) -> DataFrame:
    """The same verdicts for buckets of any size.

    Contexts are cut into families and meet only those that share more bytes; equal parts are one, with the number of them and the
    first. A bucket still above ``hot`` different parts is cut finer; at width 1 a bucket's parts are all equal.
    """
    parts = stored(families(pieces.dropDuplicates(["anchor", "context"]), width, length), "repeat-parts")
    counted = parts.groupBy("bucket", "content").agg(
        F.min("order").alias("least"), F.count(F.lit(1)).alias("n"), F.first("before").alias("before"), F.first("piece").alias("piece")
    )
    counted = stored(counted, "repeat-different")
    sizes = counted.groupBy("bucket").agg(F.count(F.lit(1)).alias("different")).filter("different > 1")
    mixed_ones = counted.join(sizes, "bucket").select(
        F.col("bucket").alias("anchor"), F.col("content").alias("context"), F.col("least").alias("order"), "before", "piece", "different"
    )
    found = judged(mixed_ones.filter(F.col("different") <= hot), length)
    finer = mixed_ones.filter(F.col("different") > hot)
    if width > 1 and not finer.isEmpty():
        found = found.union(judged_hot(stored(finer, "repeat-finer"), length, hot, width // 2))
    found = stored(found.withColumnsRenamed({"anchor": "bucket", "context": "content"}), "repeat-found")
    verdicts = counted.filter("n > 1").select("bucket", "content").union(found.select("bucket", "content")).distinct()
    verdicts = verdicts.join(counted.select("bucket", "content", "least", "n"), ["bucket", "content"]).join(found, ["bucket", "content"], "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.octet_length("piece").cast("long").alias("hi")))
    none = F.array().cast(SPANS)
    joined_ones = parts.join(verdicts, ["bucket", "content"]).select(
        "anchor", "context", "base", F.when(F.col("order") > F.col("least"), whole).otherwise(F.coalesce("earlier", none)).alias("earlier"),
        F.when(F.col("n") > 1, whole).otherwise(F.coalesce("repeated", none)).alias("repeated"),
    )

    def placed(name: str) -> Column:
        moved = F.transform(name, lambda s: F.struct((s["lo"] + F.col("base")).alias("lo"), (s["hi"] + F.col("base")).alias("hi")))
        return F.flatten(F.collect_list(moved)).alias(name)

    return stored(joined_ones.groupBy("anchor", "context").agg(placed("earlier"), placed("repeated")), "repeat-judged")


def _bytes(docs: DataFrame) -> DataFrame:
    """Texts as bytes under a key without nulls."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.isNull().alias("unnamed"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64("text").alias("text_key"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )


KEY = ["unnamed", "id", "text_key"]


def context_pieces(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted contexts, read from their documents; rows of one document after another give them once.

    ``wanted`` has a document's key, and ``anchor, context, at, order, hot``.
    """
    order = wanted.schema["order"].dataType.simpleString()
    schema = f"anchor long, context long, hot boolean, order {order}, before long, piece binary"
    target = arrow_schema(schema)
    lists = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "context", "hot", "order", "at")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in slices(batches, 1 << 20):
            out = []
            for unnamed, doc_id, key, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (unnamed, doc_id, key) == last:
                    continue
                last = (unnamed, doc_id, key)
                for w in asked:
                    at = w.pop("at")
                    begin = (at >> 16) - (at >> 8 & 255)
                    out.append({**w, "before": at >> 8 & 255, "piece": text[begin : begin + (at & 255) + length]})
            yield pa.RecordBatch.from_pylist(out, schema=target)

    return _bytes(docs).join(lists, KEY).select(*KEY, "text", "wanted").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, gram: int = GRAM, hot: int = HOT_CONTEXTS) -> DataFrame:
    """``unnamed, id, text_key, rows, spans``: bytes to remove of every different document; spans ``lo, hi`` may overlap."""
    if not 32 <= gram < length <= 255:
        raise ValueError("needs 32 <= gram < length <= 255")
    marks = stored(marked(docs, length, gram), "repeat-marks")
    names = marks.filter("anchor is null").select(
        "rid", F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_key"
    )
    found = marks.filter("anchor is not null").drop("doc_id", "text_key")
    seen = found.groupBy("anchor").agg(F.sum("times").alias("n"), F.min("context").alias("low"), F.max("context").alias("high"))
    seen = seen.filter("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed"))
    members = found.join(seen, "anchor")
    place = F.shiftright("at", 16)
    if keep_first:
        members = members.join(names, "rid").withColumn("order", F.struct("unnamed", "id", "text_key", place.alias("place"))).drop(*KEY)
    else:
        members = members.withColumn("order", F.struct("rid", place.alias("place")))
    members = stored(members, "repeat-members")

    first = F.min(F.struct("order", "rid", "at")).alias("first")
    judged_ones = members if keep_first else members.filter("mixed")
    contexts = judged_ones.groupBy("anchor", "context", "mixed").agg(F.sum("times").alias("n"), first)
    contexts = stored(contexts, "repeat-contexts")
    large = contexts.filter("mixed").groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > hot)
    wanted = contexts.filter("mixed").join(large.withColumn("hot", F.lit(True)).drop("c"), "anchor", "left")
    wanted = wanted.select("anchor", "context", F.coalesce("hot", F.lit(False)).alias("hot"), "first.order", "first.rid", "first.at")
    pieces = stored(context_pieces(docs, wanted.join(names, "rid"), length), "repeat-pieces")
    widest = 1 << (length - gram).bit_length() - 1
    verdicts = judged(pieces.filter("not hot"), length).union(judged_hot(pieces.filter("hot"), length, hot, widest))
    verdicts = contexts.join(verdicts, ["anchor", "context"], "left").select("anchor", "context", "n", "first", "earlier", "repeated")

    begin = place - F.shiftright("at", 8).bitwiseAND(255)
    reach = F.col("at").bitwiseAND(255) + length
    end = begin + (F.col("times") - 1) * F.col("step") + reach

    def span(lo: Column, hi: Column) -> Column:
        return F.array(F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi")))

    def moved(spans: str) -> Column:
        return F.transform(F.coalesce(spans, F.array().cast(SPANS)), lambda s: F.struct((s["lo"] + begin).alias("lo"), (s["hi"] + begin).alias("hi")))

    whole = span(begin, end)
    if keep_first:
        others = F.when(F.col("times") > 1, span(begin + F.col("step"), end)).otherwise(F.array().cast(SPANS))
        is_first = F.col("first.order") == F.col("order")
        spans = members.join(verdicts, ["anchor", "context"]).select("rid", F.when(is_first, F.concat(moved("earlier"), others)).otherwise(whole).alias("spans"))
    else:
        decided = members.filter("mixed").join(verdicts, ["anchor", "context"])
        spans = decided.select("rid", F.when(F.col("n") > 1, whole).otherwise(moved("repeated")).alias("spans"))
        spans = members.filter("not mixed").select("rid", whole.alias("spans")).union(spans)
    spans = spans.groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    once = names.groupBy(*KEY).agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("rows"))
    return once.join(spans, "rid", "left").drop("rid")


RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, gram: int = GRAM, hot: int = HOT_CONTEXTS) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of every document: the maximal stretches removed, and the bytes that remain."""
    spans = repeated_spans(docs, length, keep_first, gram, hot)
    schema = RESULT + ", unnamed boolean, text_key long, rows long" * keep_first
    target = arrow_schema(schema)

    def cut(text: bytes, spans: list[dict] | None) -> tuple[list[dict], bytes]:
        merged: list[list[int]] = []
        for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        edges = [0, *(x for span in merged for x in span), len(text)]
        return [{"start": a, "end": b} for a, b in merged], b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            unnamed, ids, key, text, rows, found = (c.to_pylist() for c in batch.columns)
            done = [cut(t, s) for t, s in zip(text, found, strict=True)]
            columns = [[None if u else i for u, i in zip(unnamed, ids, strict=True)], [len(t) for t in text], *map(list, zip(*done, strict=True))]
            columns += [unnamed, key, rows] if keep_first else []
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    out = _bytes(docs).join(spans, KEY, "left").select(*KEY, "text", "rows", "spans").mapInArrow(run, schema)
    if not keep_first:
        return out
    out = stored(out.withColumn("row", F.monotonically_increasing_id()), "repeat-removed")
    least = out.filter("rows > 1").groupBy("unnamed", "doc_id", "text_key").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("least"))
    gone = (F.col("rows") > 1) & F.col("least").isNull() & (F.col("n_bytes") >= length)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return out.join(least, "row", "left").select(
        "doc_id", "n_bytes", F.when(gone, all_of_it).otherwise(F.col("spans")).alias("spans"),
        F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
