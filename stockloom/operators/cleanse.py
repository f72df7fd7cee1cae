"""Request cleansing: mapping, defaults, coercion, domains."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.scalar import flag, no_nan, number
from stockloom.functions.values import BULK_DEFAULTS, DOMAINS, REQUEST_DEFAULTS
from stockloom.schemas import BULK_COLUMNS

REJECT = "_reject_reason"
MALFORMED = "_malformed"


def map_bulk_columns(df: DataFrame) -> DataFrame:
    """The thirteen upload columns in fixed order; an absent one is null."""
    return df.select([F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in BULK_COLUMNS])


def normalize_bulk(
    df: DataFrame, units_from_inventory: bool = False, keep: Iterable[str] = ()
) -> DataFrame:
    """Uploaded text as typed columns, missing values replaced by their defaults.

    Text that should be a number but isn't puts the reason into ``_reject_reason`` and leaves the other rows alone.
    Whole-number fields drop their fraction. Region, weather and units ordered are not carried on.
    """
    integers = ("inventory_level", "units_sold", "promotion")
    doubles = ("price", "competitor_price", "discount")
    parsed = {c: number(F.col(c)) for c in (*integers, *doubles)}
    bad = [
        F.when(F.col(c).isNotNull() & parsed[c].isNull(), F.concat(F.lit(f"{c}: "), F.col(c)))
        for c in (*integers, *doubles)
    ]

    malformed = [F.when(F.col(MALFORMED).isNotNull(), F.concat(F.lit("malformed row: "), F.col(MALFORMED)))] if MALFORMED in df.columns else []

    def filled(c: str, default: Column) -> Column:
        return F.coalesce(parsed[c], default)

    inventory = filled("inventory_level", F.lit(float(BULK_DEFAULTS["inventory_level"])))
    units_default = F.lit(float(BULK_DEFAULTS["units_sold"]))
    if units_from_inventory:
        units_default = 0.2 * inventory
    price = filled("price", F.lit(BULK_DEFAULTS["price"]))
    return df.select(
        *keep,
        *[F.coalesce(c, F.lit(BULK_DEFAULTS[c])).alias(c) for c in ("store_id", "product_id", "category", "season")],
        price.alias("price"),
        inventory.try_cast("int").alias("inventory_level"),
        filled("competitor_price", price).alias("competitor_price"),
        filled("promotion", F.lit(float(BULK_DEFAULTS["promotion"]))).try_cast("int").alias("promotion"),
        filled("units_sold", units_default).try_cast("int").alias("units_sold"),
        filled("discount", F.lit(BULK_DEFAULTS["discount"])).alias("discount"),
        F.nullif(F.concat_ws("; ", *malformed, *bad), F.lit("")).alias(REJECT),
    )


def validate(df: DataFrame, zero_is_missing: bool = True) -> DataFrame:
    """The seven numeric request fields as doubles.

    Text without a number is 0, a missing field its default; ``zero_is_missing`` also replaces 0 by the default, as
    the reference rules do, so that a true stock-out can only be scored with it off.
    """
    kinds = dict(df.dtypes)
    columns = {}
    for name, default in REQUEST_DEFAULTS.items():
        if name not in kinds:
            columns[name] = F.lit(default)
            continue
        raw = F.col(name)
        if kinds[name] == "string":
            value = F.when(raw.isNotNull(), F.coalesce(number(raw), F.lit(0.0)))
        else:
            value = no_nan(raw.cast("double"))
        if zero_is_missing:
            value = F.nullif(value, F.lit(0.0))
        columns[name] = F.coalesce(value, F.lit(default))
    return df.withColumns(columns)


def coerce(df: DataFrame) -> DataFrame:
    """The offline rules' numbers: what is missing or not a number becomes 0, and a zero stays zero.

    A field that the table lacks altogether gets the default of a single request.
    """
    kinds = dict(df.dtypes)
    columns = {}
    for name, default in REQUEST_DEFAULTS.items():
        if name not in kinds:
            columns[name] = F.lit(default)
        else:
            raw = F.col(name)
            value = number(raw) if kinds[name] == "string" else no_nan(raw.cast("double"))
            columns[name] = F.coalesce(value, F.lit(0.0))
    return df.withColumns(columns)


def request_date(df: DataFrame, as_of: str) -> DataFrame:
    """``sale_date`` as a date; the run date where it is missing or unreadable."""
    return df.withColumn("sale_date", F.coalesce(F.col("sale_date").try_cast("date"), F.lit(as_of).cast("date")))


def parse_flag(df: DataFrame, column: str, accepted: Iterable[str]) -> DataFrame:
    return df.withColumn(column, flag(F.col(column), accepted))


def check_domains(df: DataFrame) -> DataFrame:
    """Category, region, weather and season outside their lists become the first class of the list."""
    return df.withColumns({
        c: F.when(F.col(c).isin(*allowed), F.col(c)).otherwise(allowed[0])
        for c, allowed in DOMAINS.items()
        if c in df.columns
    })
