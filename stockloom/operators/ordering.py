"""Order-dependent operators without a single-task sort.

Rows are range-partitioned on the complete sort key, which also cuts a group that holds a large share of all rows
into several ranges. The range number is pinned as a reserved column; whatever has to cross ranges is carried by
tables of at most one row per range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.session import pin

# Reserved: the column remembers, in its metadata, the order it was built on.
SEGMENT = "__segment"
ORDER = "order"


def segment_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_segments(df: DataFrame, order: Sequence[str], segments: int | None = None) -> DataFrame:
    """Add the segment number: rows of one segment sort before all rows of the next.

    The result is pinned. Range bounds come from a sample of the input, and a recomputed branch must not see others. A table that
    already has segments of this order is returned as it is; segments of another order are an error.
    """
    if SEGMENT in df.columns:
        built = df.schema[SEGMENT].metadata.get(ORDER)
        if built != list(order):
            raise ValueError(f"the table is in segments of {built}, not of {list(order)}")
        return df
    ranged = df.repartitionByRange(segments or segment_count(df), *order)
    return pin(ranged.withColumn(SEGMENT, F.spark_partition_id().alias(SEGMENT, metadata={ORDER: list(order)})))


def by_segment(df: DataFrame) -> DataFrame:
    """Bring each segment into one partition, ready for windows by segment."""
    return df.repartitionById(segment_count(df), F.col(SEGMENT))


def spanning_groups(segmented: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups found in more than one segment. Each crosses a boundary, so there are fewer of them than segments."""
    ends = segmented.groupBy(*keys).agg(F.min(SEGMENT).alias("first_segment"), F.max(SEGMENT).alias("last_segment"))
    return ends.filter(F.col("first_segment") < F.col("last_segment"))


def row_position(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Zero-based position of each row in the order of the whole table."""
    segmented = range_segments(df, order)
    counts = segmented.groupBy(SEGMENT).count()
    before = Window.orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(SEGMENT, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy(SEGMENT).orderBy(*order))
    placed = by_segment(segmented).withColumn(name, within)
    # one row per segment
    placed = placed.join(F.broadcast(starts), SEGMENT)
    return placed.withColumn(name, F.col(name) + F.col("start") - 1).drop("start")


def group_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """Zero-based position of each row in its group; a group may be spread over many segments."""
    segmented = range_segments(df, [*keys, *order])
    spanning = spanning_groups(segmented, keys).select(*keys)
    # fewer groups than segments
    counts = segmented.join(F.broadcast(spanning), list(keys), "left_semi").groupBy(*keys, SEGMENT).count()
    before = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, SEGMENT, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy(*keys, SEGMENT).orderBy(*order))
    placed = by_segment(segmented).withColumn(name, within)
    # fewer than two rows per segment: only the first and the last group of a segment can span
    placed = placed.join(F.broadcast(starts), [*keys, SEGMENT], "left")
    return placed.withColumn(name, F.col(name) + F.coalesce("start", F.lit(0)) - 1).drop("start", SEGMENT)


def order_statistics(df: DataFrame, ranks: dict[str, Sequence[int]], buckets: int = 1024) -> dict[str, dict[int, float]]:
    """Values of numeric columns at zero-based ranks of their ascending order; values are finite, nulls and NaN have no rank.

    The interval that holds a rank is cut into buckets whose rows are counted, and the rank's bucket, shrunk to its least and greatest
    value, is the next interval. Each pass over the rows serves all columns and ranks; no row is shuffled, sorted or written, and two or
    three passes are enough unless values lie very unevenly. Passes and driver grow with the number of ranks alone.
    """
    columns = [c for c in ranks if ranks[c]]
    found: dict[str, dict[int, float]] = {c: {} for c in ranks}
    if not columns:
        return found
    values = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    ends = values.agg(*[f(F.col(f"c{i}")).alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    # column -> interval -> ranks in it, counted from the interval's first row
    open_: dict[int, dict[tuple[float, float], dict[int, int]]] = {}
    for i, c in enumerate(columns):
        if ends[f"lo{i}"] is not None:
            open_[i] = {(ends[f"lo{i}"], ends[f"hi{i}"]): {r: r for r in ranks[c]}}
    while True:
        for i in list(open_):
            for lo, hi in list(open_[i]):
                if lo == hi:
                    found[columns[i]] |= dict.fromkeys(open_[i].pop((lo, hi)), lo)
            if not open_[i]:
                del open_[i]
        if not open_:
            return found
        cuts = {i: sorted(spans) for i, spans in open_.items()}
        per = max(2, buckets // max(len(x) for x in cuts.values()))
        counts = {
            (r["col"], r["span"], r["bucket"]): r
            for r in _bucket_counts(values, cuts, per).groupBy("col", "span", "bucket")
            .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
        }
        following: dict[int, dict[tuple[float, float], dict[int, int]]] = {i: {} for i in open_}
        for i, spans in cuts.items():
            for s, span in enumerate(spans):
                before = 0
                waiting = sorted(open_[i][span].items(), key=lambda x: x[1])
                for b in range(per):
                    r = counts.get((i, s, b))
                    if r is None:
                        continue
                    while waiting and waiting[0][1] < before + r["n"]:
                        rank, inside = waiting.pop(0)
                        following[i].setdefault((r["lo"], r["hi"]), {})[rank] = inside - before
                    before += r["n"]
        open_ = following


def _bucket_counts(values: DataFrame, cuts: dict[int, list[tuple[float, float]]], per: int) -> DataFrame:
    """Rows, least and greatest value of each bucket of each interval, from every task."""
    schema = "col int, span int, bucket int, n long, lo double, hi double"
    asked = sorted(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, i in enumerate(asked):
                v = batch.column(k).drop_null().to_numpy()
                low, high = (np.array(x) for x in zip(*cuts[i], strict=True))
                span = np.searchsorted(low, v, side="right") - 1
                v, span = v[span >= 0], span[span >= 0]
                inside = v <= high[span]
                v, span = v[inside], span[inside]
                if not len(v):
                    continue
                # halves first: the width of an interval may be more than the greatest double
                share = (v / 2 - low[span] / 2) / (high[span] / 2 - low[span] / 2)
                key = span * per + np.minimum((share * per).astype(np.int64), per - 1)
                order = np.argsort(key, kind="stable")
                keys, first, n = np.unique(key[order], return_index=True, return_counts=True)
                lo, hi = np.minimum.reduceat(v[order], first), np.maximum.reduceat(v[order], first)
                columns = [np.full(len(keys), i, np.int32), (keys // per).astype(np.int32), (keys % per).astype(np.int32), n.astype(np.int64), lo, hi]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["col", "span", "bucket", "n", "lo", "hi"])

    return values.select(*[f"c{i}" for i in asked]).mapInArrow(run, schema)


def exact_quantile(df: DataFrame, column: str, q: float, name: str = "quantile") -> DataFrame:
    """One row with the linearly interpolated quantile, found without ordering the rows."""
    rows = df.select(F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")).alias("v")).filter("v is not null")
    place = (rows.count() - 1) * q
    value = None
    if place >= 0:
        low, high = math.floor(place), math.ceil(place)
        at = order_statistics(rows, {"v": [low, high]})["v"]
        value = at[low] + (at[high] - at[low]) * (place - low)
    return df.sparkSession.createDataFrame([(value,)], f"`{name}` double")
