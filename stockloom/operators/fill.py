"""Backward-then-forward fill of missing numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.operators import levels
from stockloom.operators.ordering import SEGMENT, by_segment, range_segments, spanning_groups
from stockloom.operators.series import KEYS


def fill_nulls(
    df: DataFrame, columns: Sequence[str], tie: Sequence[str] = (), scope: str = "frame"
) -> DataFrame:
    """Replace a null by the next value of its column, else by the previous one.

    A table that comes in segments is filled segment by segment, any other in two levels (:func:`stockloom.operators.levels.filled`):
    inside its series, then from a table of one row a series.

    ``scope='frame'`` runs over the whole table in (store, product, date) order, so a short series takes values of the
    next one; ``scope='series'`` stays inside a series. Each segment is filled on its own; what lies beyond it comes
    from a table of the first and last value per segment. Next values are found by scanning the segment in descending
    order, because a frame that ends at the last row is evaluated anew for each row.
    """
    if SEGMENT not in df.columns:
        return levels.filled(df, columns, tie, scope)
    order = [*KEYS, "sale_date", *tie]
    segmented = range_segments(df, order)
    part = [SEGMENT] if scope == "frame" else [SEGMENT, *KEYS]
    descending = [F.col(c).desc() for c in order]
    upto = (Window.unboundedPreceding, Window.currentRow)
    before = (Window.unboundedPreceding, -1)

    ends_of = segmented
    if scope != "frame":
        # fewer series than segments
        ends_of = segmented.join(F.broadcast(spanning_groups(segmented, KEYS).select(*KEYS)), list(KEYS), "left_semi")
    place = F.struct(*order)
    present = [
        agg(F.when(F.col(c).isNotNull(), F.struct(place.alias("at"), F.col(c).alias("v"))))["v"].alias(f"_{side}_{c}")
        for c in columns
        for side, agg in (("first", F.min), ("last", F.max))
    ]
    ends = ends_of.groupBy(*part).agg(*present)
    groups = [k for k in part if k != SEGMENT]
    later = Window.partitionBy(*groups).orderBy(F.col(SEGMENT).desc()).rowsBetween(*before)
    earlier = Window.partitionBy(*groups).orderBy(SEGMENT).rowsBetween(*before)
    beyond = ends.select(
        *part,
        *[F.last(f"_first_{c}", ignorenulls=True).over(later).alias(f"_later_{c}") for c in columns],
        *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_earlier_{c}") for c in columns],
    )

    nexts = Window.partitionBy(*part).orderBy(*descending).rowsBetween(*upto)
    prevs = Window.partitionBy(*part).orderBy(*order).rowsBetween(*upto)
    scanned = by_segment(segmented).withColumns(
        {f"_next_{c}": F.last(c, ignorenulls=True).over(nexts) for c in columns}
        | {f"_prev_{c}": F.last(c, ignorenulls=True).over(prevs) for c in columns}
    )
    # one row per segment, or fewer than two per segment by series
    joined = scanned.join(F.broadcast(beyond), part, "left")
    filled = {
        c: F.coalesce(f"_next_{c}", f"_later_{c}", f"_prev_{c}", f"_earlier_{c}")
        for c in columns
    }
    return joined.withColumns(filled).select(*segmented.columns)
