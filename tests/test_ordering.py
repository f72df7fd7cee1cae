"""Windows, fill, positions and quantiles against pandas; long series cut into ranges."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stockloom.operators import fill, lookup, ordering, series, split

KEYS = ["store_id", "product_id", "sale_date"]


def frame(df):
    return df.toPandas().sort_values(KEYS).reset_index(drop=True)


def expected(pdf):
    by = pdf.groupby(["store_id", "product_id"])
    out = pdf.copy()
    for k in series.LAGS:
        out[f"units_sold_lag_{k}"] = by["units_sold"].shift(k)
        out[f"inventory_lag_{k}"] = by["inventory_level"].shift(k)
    for k in series.SPANS:
        for stat in series.STATS:
            out[f"units_sold_rolling_{stat}_{k}"] = by["units_sold"].transform(
                lambda x, k=k, stat=stat: getattr(x.rolling(k, min_periods=1), stat)())
    return out


def test_series_features(sales):
    want = expected(frame(sales))
    columns = [*series.lag_columns(), *series.rolling_columns()]
    whole = frame(series.series_features(sales))
    ranged = frame(series.series_features(sales, ranged=True))
    for got in (whole, ranged):
        assert len(got) == len(want)
        for c in columns:
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-9, err_msg=c)


def test_excluding_the_current_row(sales):
    a = frame(series.series_features(sales, include_current=False))
    b = frame(series.series_features(sales, include_current=False, ranged=True))
    columns = series.rolling_columns()
    for c in columns:
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), atol=1e-9)
    assert a.groupby(["store_id", "product_id"]).head(1)["units_sold_rolling_mean_7"].isna().all()


def test_fill_over_the_frame(sales):
    segmented = ordering.range_segments(sales, KEYS)
    columns = [*series.lag_columns(), *series.rolling_columns()]
    got = frame(fill.fill_nulls(series.series_features(segmented), columns))
    want = expected(frame(sales))[columns].bfill().ffill()
    for c in columns:
        np.testing.assert_allclose(got[c].astype(float), want[c], atol=1e-9, err_msg=c)


def test_fill_inside_a_series(sales):
    segmented = ordering.range_segments(sales, KEYS)
    columns = series.lag_columns()
    got = frame(fill.fill_nulls(series.series_features(segmented), columns, scope="series"))
    want = expected(frame(sales)).groupby(["store_id", "product_id"])[columns].transform(lambda x: x.bfill().ffill())
    for c in columns:
        np.testing.assert_allclose(got[c].astype(float), want[c], err_msg=c)


def test_positions(sales):
    got = frame(ordering.row_position(sales, KEYS))
    assert got["position"].tolist() == list(range(len(got)))
    inside = frame(ordering.group_position(sales, ["store_id", "product_id"], ["sale_date"]))
    assert (inside["position"] == inside.groupby(["store_id", "product_id"]).cumcount()).all()


def test_split(sales):
    got = frame(split.position_split(sales, 0.8))
    assert (got["part"] == "head").sum() == int(0.8 * len(got)) and (got["part"].iloc[: int(0.8 * len(got))] == "head").all()
    dated = frame(split.date_split(sales, 0.8))
    assert dated[dated.part == "head"].sale_date.max() < dated[dated.part == "tail"].sale_date.min()


def test_quantile(spark, sales):
    values = sales.toPandas()["price"]
    for q in (0.0, 0.37, 0.5, 0.99, 1.0):
        assert abs(ordering.exact_quantile(sales, "price", q).first()[0] - np.percentile(values, 100 * q)) < 1e-9
    same = spark.range(1000).select(F.when(F.col("id") < 900, 1.0).otherwise(2.0).alias("v"))
    assert ordering.exact_quantile(same, "v", 0.5).first()[0] == 1.0


def test_lookup_broadcast_or_salted(sales):
    dim = sales.groupBy("product_id").agg(F.max("price").alias("top"))
    a = frame(lookup.lookup_join(sales, dim, ["product_id"], KEYS))
    b = frame(lookup.lookup_join(sales, dim, ["product_id"], KEYS, salts=8))
    pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(b)])


def test_latest_features(sales):
    want = expected(frame(sales)).groupby(["store_id", "product_id"]).tail(1).reset_index(drop=True)
    got = frame(series.latest_features(sales))
    for c in [*series.lag_columns(), *series.rolling_columns()]:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-9)


def test_fill_in_two_levels_equals_segments(sales):
    columns = [*series.lag_columns(), *series.rolling_columns()]
    plain, segmented = series.series_features(sales), series.series_features(ordering.range_segments(sales, [*series.KEYS, "sale_date"], 5))
    for scope in ("frame", "series"):
        a = frame(fill.fill_nulls(plain, columns, scope=scope))
        b = frame(fill.fill_nulls(segmented, columns, scope=scope).select(*plain.columns))
        pd.testing.assert_frame_equal(a, b)
