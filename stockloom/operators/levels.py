"""Whole-table order in two levels: rows inside a series, series among each other.

A series has a row a day, so a task can order it, and lags have brought it together already. What the other series add is found in a
table of one row for each series, which is put into ranges of its own: the rows are shuffled once and written nowhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.operators.ordering import SEGMENT, by_segment, range_segments
from stockloom.operators.series import KEYS
from stockloom.session import pin


def nearest_values(series: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each series, ``_later_<c>`` and ``_earlier_<c>``: the first value of the next series that has one, the last of one before.

    ``series`` has ``_first_<c>`` and ``_last_<c>``, its own first and last value.
    """
    segmented = range_segments(pin(series), KEYS)  # the ranges are sampled from the pinned table, not from the rows again
    place = F.struct(*KEYS)
    ends = segmented.groupBy(SEGMENT).agg(
        *[F.min(F.when(F.col(f"_first_{c}").isNotNull(), F.struct(place.alias("at"), F.col(f"_first_{c}").alias("v"))))["v"].alias(f"_f_{c}") for c in columns],
        *[F.max(F.when(F.col(f"_last_{c}").isNotNull(), F.struct(place.alias("at"), F.col(f"_last_{c}").alias("v"))))["v"].alias(f"_l_{c}") for c in columns],
    )
    before = (Window.unboundedPreceding, -1)
    behind, ahead = Window.orderBy(F.col(SEGMENT).desc()).rowsBetween(*before), Window.orderBy(SEGMENT).rowsBetween(*before)
    beyond = ends.select(  # one row a segment
        SEGMENT, *[F.last(f"_f_{c}", ignorenulls=True).over(behind).alias(f"_f_{c}") for c in columns],
        *[F.last(f"_l_{c}", ignorenulls=True).over(ahead).alias(f"_l_{c}") for c in columns],
    )
    down = Window.partitionBy(SEGMENT).orderBy(*[F.col(k).desc() for k in KEYS]).rowsBetween(*before)
    up = Window.partitionBy(SEGMENT).orderBy(*KEYS).rowsBetween(*before)
    inside = by_segment(segmented).withColumns(
        {f"_later_{c}": F.last(f"_first_{c}", ignorenulls=True).over(down) for c in columns}
        | {f"_earlier_{c}": F.last(f"_last_{c}", ignorenulls=True).over(up) for c in columns}
    )
    return inside.join(F.broadcast(beyond), SEGMENT).select(
        *KEYS, *[F.coalesce(f"_later_{c}", f"_f_{c}").alias(f"_later_{c}") for c in columns],
        *[F.coalesce(f"_earlier_{c}", f"_l_{c}").alias(f"_earlier_{c}") for c in columns],
    )


def filled(df: DataFrame, columns: Sequence[str], tie: Sequence[str] = (), scope: str = "frame") -> DataFrame:
    """Replace a null by the next value of its column in (store, product, date) order, else by the previous one."""
    order = ["sale_date", *tie]
    upto = (Window.unboundedPreceding, Window.currentRow)
    nexts = Window.partitionBy(*KEYS).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(*upto)
    prevs = Window.partitionBy(*KEYS).orderBy(*order).rowsBetween(*upto)
    inside = df.withColumns(
        {f"_next_{c}": F.last(c, ignorenulls=True).over(nexts) for c in columns}
        | {f"_prev_{c}": F.last(c, ignorenulls=True).over(prevs) for c in columns}
    )
    if scope != "frame":
        return inside.withColumns({c: F.coalesce(f"_next_{c}", f"_prev_{c}") for c in columns}).select(*df.columns)
    place = F.struct(*order)
    ends = df.groupBy(*KEYS).agg(*[
        agg(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"_{side}_{c}")
        for c in columns for side, agg in (("first", F.min_by), ("last", F.max_by))
    ])
    around = inside.join(nearest_values(ends, columns), list(KEYS))
    return around.withColumns({
        c: F.coalesce(f"_next_{c}", f"_later_{c}", f"_prev_{c}", f"_earlier_{c}") for c in columns
    }).select(*df.columns)


def positions(df: DataFrame, tie: Sequence[str] = (), name: str = "position") -> DataFrame:
    """Zero-based position of each row in (store, product, date) order, and ``_total``, the number of rows."""
    sizes = range_segments(pin(df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_size"))), KEYS)
    sums = sizes.groupBy(SEGMENT).agg(F.sum("_size").alias("_sum"))
    before = Window.orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(  # one row a segment
        SEGMENT, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"), F.sum("_sum").over(Window.partitionBy()).alias("_total")
    )
    inside = Window.partitionBy(SEGMENT).orderBy(*KEYS).rowsBetween(Window.unboundedPreceding, -1)
    placed = by_segment(sizes).withColumn("_before", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(F.broadcast(starts), SEGMENT)
    placed = placed.select(*KEYS, (F.col("_base") + F.col("_before")).alias("_start"), "_total")
    numbered = df.withColumn(name, F.row_number().over(Window.partitionBy(*KEYS).orderBy("sale_date", *tie)) - 1)
    return numbered.join(placed, list(KEYS)).withColumn(name, F.col(name) + F.col("_start")).drop("_start")
