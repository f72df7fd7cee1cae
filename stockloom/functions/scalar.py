"""Column functions: guarded casts, half-even rounding and text, keyed noise."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockloom.functions.values import NULL_TOKENS

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
TWO32 = 4294967296.0
WHOLE = 4503599627370496.0  # 2**52: a double this large has no fraction
SPLITTER = 134217729.0  # 2**27 + 1: cuts a double's 53 digits into two halves


def blank_to_null(c: Column) -> Column:
    """Null out the spellings a CSV upload uses for a missing value."""
    return F.when(~c.isin(*NULL_TOKENS), c)


def number(c: Column) -> Column:
    """The number a text holds, null if it holds none."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def no_nan(c: Column) -> Column:
    """NaN as null: ``greatest``/``least`` then skip it instead of letting it win."""
    return F.when(~F.isnan(c), c)


def percent(c: Column, default: Column) -> Column:
    """A number that may carry ``%`` signs, else ``default``."""
    return F.coalesce(number(F.replace(c, F.lit("%"), F.lit(""))), default)


def flag(c: Column, accepted: Iterable[str]) -> Column:
    """1 where the text is one of the accepted spellings (case matters), else 0."""
    return F.when(c.cast("string").isin(*accepted), 1).otherwise(0)


def round_half_even(c: Column, digits: int = 0) -> Column:
    """Round the exact binary value of a double to ``digits`` decimals, ties to even, as Python's ``round`` does.

    Scaling can hide which side of a tie a value is on. The rounding error of the product is recovered exactly by
    splitting the factor into two halves, and decides where the scaled value looks like a tie. ``c`` is read several
    times: pass a column, not a long expression.
    """
    if digits == 0:
        return F.rint(c)
    scale = float(10**digits)
    scaled = c * scale
    upper = c * SPLITTER - (c * SPLITTER - c)
    error = (upper * scale - scaled) + (c - upper) * scale
    tie = (F.abs(scaled - F.rint(scaled)) == 0.5) & (error != 0)
    rounded = F.when(tie, scaled + 0.5 * F.signum(error)).otherwise(F.rint(scaled)) / scale
    return F.when(F.abs(scaled) < WHOLE, rounded).otherwise(c)


def fixed_text(c: Column, digits: int) -> Column:
    """Fixed-point text, half-even."""
    return round_half_even(c, digits).try_cast(f"decimal(38,{digits})").cast("string")


def float_text(c: Column) -> Column:
    """A double as its shortest decimal text, with ``.0`` on whole numbers and no exponent below 1e16."""
    plain = F.regexp_replace(c.try_cast("decimal(38,12)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when((F.abs(c) >= 1e7) & (F.abs(c) < 1e16), plain).otherwise(c.cast("string"))


def _word(digest: Column, nth: int | Column) -> Column:
    return F.conv(F.substr(digest, 1 + 8 * (F.lit(nth) if isinstance(nth, int) else nth), F.lit(8)), 16, 10).cast("double")


def keyed_digest(keys: Iterable[Column], salt: Column, seed: int) -> Column:
    """Digest of a row's key: the same on every run, partitioning and engine, unlike ``rand``."""
    return F.md5(F.concat_ws("|", *[k.cast("string") for k in keys], salt.cast("string"), F.lit(str(seed))))


def digest_uniform(digest: Column) -> Column:
    """Uniform on [0, 1) from the first word of a digest."""
    return _word(digest, 0) / TWO32


def digest_normal(digest: Column) -> Column:
    """Standard normal (Box-Muller) from the first two words of a digest."""
    u1 = (_word(digest, 0) + 0.5) / TWO32
    u2 = _word(digest, 1) / TWO32
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def digest_polar(digest: Column, first: Column) -> Column:
    """Radius and angle (Box-Muller) from two words of a digest: radius times cosine and radius times sine are two normals."""
    radius = F.sqrt(-2.0 * F.log((_word(digest, first) + 0.5) / TWO32))
    return F.struct(radius.alias("radius"), (2.0 * math.pi * (_word(digest, first + 1) / TWO32)).alias("angle"))


def uniform(keys: Iterable[Column], salt: str, low: float, high: float, mode: str, seed: int = 42) -> Column:
    """Uniform factor on [low, high); its mean in mode ``off``."""
    if mode == "off":
        return F.lit((low + high) / 2.0)
    return low + (high - low) * digest_uniform(keyed_digest(keys, F.lit(salt), seed))


def normal(keys: Iterable[Column], salt: str, sd: float, mode: str, seed: int = 42) -> Column:
    """Normal factor with mean 1; 1 in mode ``off``."""
    if mode == "off":
        return F.lit(1.0)
    return 1.0 + sd * digest_normal(keyed_digest(keys, F.lit(salt), seed))
