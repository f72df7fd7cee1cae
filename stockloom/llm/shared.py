"""Helpers of several operators: reading tables, tables in the shared folder, batch functions, whole-table order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stockloom.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
PART_BYTES = 48 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later steps read it back, whatever executors are lost."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> DataFrame:
    """All columns in one, ``row``, so that a helper column beside it can have any name; ``select("row.*")`` unpacks them."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_hash(df: DataFrame) -> Column:
    """A hash of all fields of ``row``; those that Spark has no hash for count by their JSON text."""
    fields = df.schema["row"].dataType.fields
    values = [F.col("row")[f.name] for f in fields]
    return F.xxhash64(*[F.to_json(F.struct(v)) if "map<" in f.dataType.simpleString() else v for f, v in zip(fields, values, strict=True)])


def by_batch(df: DataFrame, each: Callable[[dict[str, list]], dict[str, list]], schema: str | StructType) -> DataFrame:
    """Apply ``each`` (columns as lists in, columns as lists out) to slices of about four million characters."""
    names = df.columns
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = each({n: batch.column(i).to_pylist() for i, n in enumerate(names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    # places, not names: those may hold dots
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema)


def arrow_schema(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def slices(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that none holds much more than ``most`` bytes; a longer row stands alone."""
    for batch in batches:
        rows = batch.num_rows
        if rows:
            step = max(1, int(rows * most / max(batch.nbytes, 1)))
            for start in range(0, rows, step):
                yield batch.slice(start, step)


def part_count(df: DataFrame, text: str = "text", part_bytes: int = PART_BYTES) -> int:
    """Parts of about ``part_bytes`` of text."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-int(total) // part_bytes))


def id_bounds(df: DataFrame, parts: int, key: str = "doc_id") -> list[int]:
    """At most ``parts - 1`` ascending key values that cut the rows into about equal parts.

    The list is all that reaches the driver: one number a part.
    """
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(key, F.array(*map(F.lit, shares)), F.lit(max(10_000, 20 * parts)))).first()[0]
    return sorted(set(found or []))


def part_of(key: Column, bounds: list[int]) -> Column:
    """Number of the part that holds the key: how many bounds are at or below it; a null key is in part 0."""
    if not bounds:
        return F.lit(0)
    edges = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def find(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, values.to_numpy(), side="right").astype("int32"))

    # the null is replaced first: integers of pandas know none
    return F.when(key.isNull(), F.lit(0)).otherwise(find(F.coalesce(key.cast("long"), F.lit(0))))
