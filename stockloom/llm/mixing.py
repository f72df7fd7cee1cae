"""Mix sources to target weights by entropy balancing.

Document rates are as near to 1 as the targets allow, in relative entropy: with a target number of words for each source and a
highest rate, that optimum is ``min(highest, exp(tilt * size))`` with one tilt for each source, the maximum of a concave dual.
Newton steps on all sources at once find the tilts; each is one grouped sum over how many documents a source has of each size,
in exact decimals, so reruns agree to the last bit. Rates become whole copies by error diffusion from the longest document to
the shortest, so a source ends within about half its shortest documents of its target.

A null text has size 0, a null source is a source of its own and comes last. Repeated rows of one document id, source and size
all get the same number of copies. Documents of size 0 are taken once and count nothing; a long text counts by its words, which are
counted in its row; an empty table gives no rows. Columns besides
``doc_id``, ``text`` and ``source`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.shared import WORD, arrow_schema, packed, stored
from stockloom.operators.ordering import row_position

SEGMENT_ROWS = 2_000
LOT = 1 << 16
EXACT = "decimal(38,6)"
CLOSE = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size``: the number of words."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size"))


def word_count(text: Column | str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``sid, source, source_size, target, full`` of every source, numbered by name.

    Every source gets the same number of words for its weight, but no more than ``most`` times its size; the common number rises
    until all is given out. Each round is one sum over the sources.
    """
    sums = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("docs"))
    sources = row_position(sums.withColumn("unnamed", F.col("source").isNull()), ["unnamed", "source"], "sid")
    weight = F.element_at(F.lit(list(weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    sources = stored(sources.select("sid", "source", "source_size", "docs", weight.alias("weight")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget, level = share * total, 0.0
    while True:
        full = F.col("source_size") * most <= F.lit(level) * F.col("weight")
        row = sources.agg(
            F.sum(F.when(full, F.col("source_size"))).alias("size"), F.sum(F.when(~full, F.col("weight"))).alias("weight")
        ).first()
        risen = (budget - most * (row["size"] or 0)) / row["weight"] if row["weight"] else level
        if risen <= level:
            break
        level = risen
    full = F.col("source_size") * most <= F.lit(level) * F.col("weight")
    target = F.when(full, F.col("source_size") * most).otherwise(F.lit(level) * F.col("weight"))
    return sources.select("sid", "source", "source_size", "docs", target.cast("double").alias("target"), full.alias("full"))


def tilts(histogram: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """``sid, tilt`` with ``sum(n * size * min(most, exp(tilt * size))) = target`` for every source that isn't full.

    Newton steps stay inside a bracket that every step narrows; a step that leaves it is replaced by its middle. At the lowest
    tilt all documents together are too few, at the highest all have the highest rate.
    """
    low = F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")))
    open_ = (~F.col("full")) & (F.col("target") > 0)
    state = targets.filter(open_).select(
        "sid", "target", F.lit(0.0).alias("tilt"), low.alias("low"), F.lit(math.log(most)).alias("high"), F.lit(1.0).alias("error")
    )
    state = stored(state, "tilts")
    while True:
        rate = F.exp(F.col("tilt") * F.col("size"))
        clipped = rate >= most
        words = F.col("n") * F.col("size") * F.when(clipped, F.lit(most)).otherwise(rate)
        slope = F.when(clipped, F.lit(0.0)).otherwise(F.col("n") * F.col("size") * F.col("size") * rate)
        sums = histogram.join(state, "sid").groupBy("sid").agg(
            *(F.first(c).alias(c) for c in ("target", "tilt", "low", "high")),
            F.sum(words.cast(EXACT)).cast("double").alias("words"),
            F.sum(slope.cast(EXACT)).cast("double").alias("slope"),
        )
        over = F.col("words") > F.col("target")
        sums = sums.withColumn("high", F.when(over, F.col("tilt")).otherwise(F.col("high")))
        sums = sums.withColumn("low", F.when(over, F.col("low")).otherwise(F.col("tilt")))
        newton = F.col("tilt") - (F.col("words") - F.col("target")) / F.nullif("slope", F.lit(0.0))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        error = F.abs(F.col("words") / F.col("target") - 1)
        narrow = F.col("high") - F.col("low") <= F.lit(1e-15) * F.greatest(F.abs("low"), F.abs("high"))
        error = F.when(narrow, F.lit(0.0)).otherwise(error)
        step = F.when(error <= CLOSE, F.col("tilt")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        state = stored(sums.select("sid", "target", step.alias("tilt"), "low", "high", error.alias("error")), "tilts")
        worst = state.agg(F.max("error")).first()[0]
        if worst is None or worst <= CLOSE:
            return state.select("sid", "tilt")


def copies(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """``doc_id, source, size, rows, copies, source_size, target`` of every distinct document; each of ``rows`` equal rows gets ``copies``.

    Error diffusion runs along a source's documents, the most words first. A source is cut into segments of about ``SEGMENT_ROWS``
    documents by a hash, each with its own remainder, so no source is bound to one task.
    """
    sized = sizes(docs).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    sized = stored(sized, "sizes")
    targets = stored(source_targets(sized, weights, share, float(most)), "targets")
    histogram = sized.groupBy("source", "size").agg(F.sum("rows").cast("double").alias("n")).alias("h")
    named = targets.select("sid", F.col("source").alias("name"))
    histogram = histogram.join(named, F.col("source").eqNullSafe(F.col("name"))).select("sid", "size", "n")
    found = tilts(stored(histogram.filter("size > 0"), "histogram"), targets, float(most))
    rates = targets.join(found, "sid", "left").select(
        "sid", "tilt", "full", F.col("source").alias("name"), (1 + F.floor(F.col("docs") / SEGMENT_ROWS)).alias("segments")
    )
    highest = F.lit(float(most))
    tilted = F.least(highest, F.exp(F.coalesce("tilt", F.lit(0.0)) * F.col("size")))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("full"), highest).otherwise(tilted)
    segment = F.pmod(F.xxhash64("doc_id", "size"), F.col("segments"))
    rated = sized.join(rates, F.col("source").eqNullSafe(F.col("name"))).select(
        "sid", segment.alias("segment"), "size", "doc_id", "rows", rate.alias("rate")
    )
    words = F.col("size") * F.col("rows")
    ordered = rated.repartition("sid", "segment").sortWithinPartitions("sid", "segment", words.desc(), "size", "doc_id")
    schema = "sid long, doc_id long, size long, rows long, copies long"
    target = arrow_schema(schema)

    def diffuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, owed = None, 0.0
        for batch in batches:
            sid, segment, size, _, rows, rate = (c.to_pylist() for c in batch.columns)
            out = []
            for i in range(len(sid)):
                if (sid[i], segment[i]) != at:
                    at, owed = (sid[i], segment[i]), 0.0
                n = 1
                if size[i]:
                    all_words = size[i] * rows[i]
                    owed += rate[i] * all_words
                    n = max(math.floor(rate[i]), min(math.ceil(rate[i]), round(owed / all_words)))
                    owed -= n * all_words
                out.append(n)
            arrays = [batch.column(0), batch.column(3), batch.column(2), batch.column(4), pa.array(out, pa.int64())]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, target, strict=True)], schema=target)

    decided = ordered.mapInArrow(diffuse, schema)
    return decided.join(targets.select("sid", "source", "source_size", "target"), "sid").drop("sid")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row for every document: ``doc_id, source, size, source_size, target, copies, taken``.

    Equal rows come back as as many rows, dealt out in lots before they are unfolded, so no task writes all of them.
    """
    decided = copies(docs, weights, share, most)
    lots = decided.withColumn("lot", F.explode(F.sequence(F.lit(1), F.ceil(F.col("rows") / LOT)))).repartition("doc_id", "size", "lot")
    inside = F.least(F.lit(LOT).cast("long"), F.col("rows") - (F.col("lot") - 1) * LOT)
    return lots.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), inside))).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """The documents themselves, each row as often as the mix takes it.

    The words are counted once, into a column: as part of the join's condition they would be counted for every comparison.
    """

    def key(doc_id: Column, source: Column, size: Column) -> dict[str, Column]:
        return {
            "unnamed": doc_id.isNull(), "id": F.coalesce(doc_id, F.lit(0)), "nowhere": source.isNull(), "from": F.coalesce(source, F.lit("")),
            "size": size,
        }

    taken = copies(docs, weights, share, most).filter("copies > 0")
    taken = taken.select(*(c.alias(n) for n, c in key(F.col("doc_id"), F.col("source"), F.col("size")).items()), F.col("copies").cast("int"))
    row = F.col("row")
    keyed = packed(docs).withColumns(key(row["doc_id"].cast("long"), row["source"], word_count(row["text"])))
    joined = keyed.join(taken, [c for c in taken.columns if c != "copies"])
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
