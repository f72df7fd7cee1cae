"""Lag and rolling features by store and product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stockloom.operators.ordering import SEGMENT, by_segment, range_segments, spanning_groups
from stockloom.session import pin

KEYS = ("store_id", "product_id")
LAGS = (1, 2, 3, 7, 14, 28)
SPANS = (7, 14, 30)
STATS = ("mean", "std", "median")


def lag_columns(lags: Sequence[int] = LAGS) -> list[str]:
    return [f"{c}_lag_{k}" for k in lags for c in ("units_sold", "inventory")]


def rolling_columns(spans: Sequence[int] = SPANS, stats: Sequence[str] = STATS) -> list[str]:
    return [f"units_sold_rolling_{s}_{k}" for k in spans for s in stats]


def _median(values: Column) -> Column:
    ordered = F.sort_array(values)
    n = F.size(ordered)
    low = F.element_at(ordered, ((n + 1) / 2).cast("int"))
    high = F.element_at(ordered, (n / 2).cast("int") + 1)
    return F.when(n > 0, (low + high) / 2)


def _features(
    w: WindowSpec, lags: Sequence[int], spans: Sequence[int], stats: Sequence[str], include_current: bool
) -> dict[str, Column]:
    last = 0 if include_current else -1
    out: dict[str, Column] = {}
    for k in lags:
        out[f"units_sold_lag_{k}"] = F.lag("units_sold", k).over(w)
        out[f"inventory_lag_{k}"] = F.lag("inventory_level", k).over(w)
    for k in spans:
        frame = w.rowsBetween(last - k + 1, last)
        if "mean" in stats:
            out[f"units_sold_rolling_mean_{k}"] = F.avg("units_sold").over(frame)
        if "std" in stats:
            out[f"units_sold_rolling_std_{k}"] = F.stddev_samp("units_sold").over(frame)
        if "median" in stats:
            out[f"units_sold_rolling_median_{k}"] = F.collect_list("units_sold").over(frame)
    return out


def _halo(segmented: DataFrame, order: Sequence[str], depth: int) -> DataFrame:
    """For each segment, the ``depth`` rows that precede it in the series it continues.

    Only series that span segments matter, and only their last ``depth`` rows in each segment.
    """
    values = ["units_sold", "inventory_level"]
    # fewer series than segments
    spanning = F.broadcast(spanning_groups(segmented, KEYS).select(*KEYS))
    rows = segmented.select(*KEYS, SEGMENT, *order, *values).join(spanning, list(KEYS), "left_semi")
    newest = Window.partitionBy(*KEYS, SEGMENT).orderBy(*[F.col(c).desc() for c in order])
    tails = rows.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= depth)
    series = Window.partitionBy(*KEYS).orderBy(SEGMENT, *order)
    earlier = F.collect_list(F.struct(*order, *values)).over(series.rowsBetween(-depth, -1))
    opening = F.lag(SEGMENT).over(series) != F.col(SEGMENT)
    return (
        tails.withColumn("_earlier", earlier).withColumn("_opening", opening).filter("_opening")
        .select(*KEYS, SEGMENT, F.explode("_earlier").alias("e"))
        .select(*KEYS, SEGMENT, "e.*", F.lit(True).alias("_halo"))
    )


def _with_medians(df: DataFrame, spans: Sequence[int], stats: Sequence[str]) -> DataFrame:
    names = [c for c in rolling_columns(spans, stats) if "_median_" in c]
    return df.withColumns({c: _median(F.col(c)) for c in names})


def whole_series_features(
    df: DataFrame,
    lags: Sequence[int] = LAGS,
    spans: Sequence[int] = SPANS,
    stats: Sequence[str] = STATS,
    include_current: bool = True,
    tie: Sequence[str] = (),
) -> DataFrame:
    """``series_features`` with each series ordered by one task; for series of a known length."""
    w = Window.partitionBy(*KEYS).orderBy("sale_date", *tie)
    return _with_medians(df.withColumns(_features(w, lags, spans, stats, include_current)), spans, stats)


def series_features(
    df: DataFrame,
    lags: Sequence[int] = LAGS,
    spans: Sequence[int] = SPANS,
    stats: Sequence[str] = STATS,
    include_current: bool = True,
    tie: Sequence[str] = (),
    ranged: bool = False,
) -> DataFrame:
    """Row lags of units sold and inventory, and rolling statistics of units sold, in date order.

    One shuffle and one sort serve all columns; a series has a row for each day, so one task can order it. With ``ranged``, or when
    the table already comes in segments, the windows run by segment and series instead, on rows extended by the few that precede
    the segment: for tables whose series are too long for one task. The result has the same columns either way.
    ``include_current=False`` leaves a row's own value out of its rolling statistics.
    """
    if SEGMENT not in df.columns and not ranged:
        return whole_series_features(df, lags, spans, stats, include_current, tie)
    order = ["sale_date", *tie]
    segmented = range_segments(df, [*KEYS, *order])
    depth = max([*lags, *[k - 1 if include_current else k for k in spans]])
    extended = segmented.withColumn("_halo", F.lit(False)).unionByName(
        _halo(segmented, order, depth), allowMissingColumns=True
    )
    w = Window.partitionBy(SEGMENT, *KEYS).orderBy(*order)
    out = by_segment(extended).withColumns(_features(w, lags, spans, stats, include_current))
    kept = [SEGMENT] if SEGMENT in df.columns else []
    return _with_medians(out.filter(~F.col("_halo")), spans, stats).select(
        *kept, *[c for c in df.columns if c != SEGMENT], *lag_columns(lags), *rolling_columns(spans, stats)
    )


def sales_velocity(df: DataFrame, tie: Sequence[str] = (), ranged: bool = False) -> DataFrame:
    """Rolling 7- and 30-row mean of units sold."""
    out = series_features(df, lags=(), spans=(7, 30), stats=("mean",), tie=tie, ranged=ranged)
    return out.withColumnsRenamed(
        {"units_sold_rolling_mean_7": "sales_velocity_7d", "units_sold_rolling_mean_30": "sales_velocity_30d"}
    )


def _newest(df: DataFrame, depth: int, tie: Sequence[str]) -> DataFrame:
    """The ``depth`` newest rows of each series, numbered from 1 in ``_age``.

    A top-k that runs before the shuffle, so a long series does not reach one task.
    """
    newest = Window.partitionBy(*KEYS).orderBy(F.col("sale_date").desc(), *[F.col(c).desc() for c in tie])
    return df.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= depth)


def latest_features(df: DataFrame, tie: Sequence[str] = (), include_current: bool = True) -> DataFrame:
    """The features of each series' latest row, as ``series_features`` gives them."""
    depth = max(max(LAGS) + 1, *(k if include_current else k + 1 for k in SPANS))
    recent = whole_series_features(_newest(df, depth, tie), tie=tie, include_current=include_current)
    return recent.filter(F.col("_age") == 1).drop("_age")


def next_features(df: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """A row for the day after each series' latest, with the features that a training row of that day would have.

    The day's own sales are not known yet, so they are null and no statistic holds them (``include_current=False``); what else the
    row carries is taken from the latest row.
    """
    recent = pin(_newest(df, max(*LAGS, *SPANS), tie))  # read twice
    following = recent.filter(F.col("_age") == 1).withColumns({
        "_age": F.lit(0), "sale_date": F.date_add("sale_date", 1), "units_sold": F.lit(None).cast(df.schema["units_sold"].dataType),
    })
    out = whole_series_features(recent.unionByName(following), tie=tie, include_current=False)
    return out.filter(F.col("_age") == 0).drop("_age")
