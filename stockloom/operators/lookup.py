"""Many-to-one joins that can spread a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(
    df: DataFrame, dim: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "left", salts: int = 1
) -> DataFrame:
    """Join ``df`` to ``dim``, which has one row per key.

    Spark broadcasts ``dim`` if its measured bytes allow it, and otherwise shuffles both and splits partitions that turn out too
    large. With ``salts`` every row of ``dim`` is repeated once per salt and the rows of ``df`` take a salt from a hash of their
    ``spread`` columns: for keys that are known to hold a large share of the rows where adaptive execution is off.
    """
    if salts <= 1:
        return df.join(dim, list(on), how)
    salted = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    return df.withColumn("_salt", salt).join(salted, [*on, "_salt"], how).drop("_salt")
