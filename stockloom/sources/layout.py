"""Tables stored by key: bucketed by it, and sorted by it within a bucket.

A read by key opens the files of one bucket, and in them the row groups and pages whose least and greatest key enclose it. Joins and
aggregates by the key need no shuffle. Buckets are chosen by the hash of the key, so a key of few rows (an id) fills them evenly.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F


def write_by_key(df: DataFrame, path: str, key: str, buckets: int | None = None) -> DataFrame:
    """Store ``df`` as a new table under ``path``; without ``buckets`` as many as there are shuffle partitions.

    The rows are shuffled once, and each bucket is one file. The table is known to the session's catalog by a name of its own;
    :func:`open_by_key` makes it known to another session. A null key is a key like any other. A path in use is an error.
    """
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        raise FileExistsError(path)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = _name()
    _writer(df, key, buckets).option("path", path).saveAsTable(name)
    return spark.table(name)


def open_by_key(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """A table stored earlier under ``path``, with the same key and number of buckets."""
    return spark.table(_known(spark, path, key, buckets))


def append_by_key(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """The table under ``path`` with the rows of one more run: at most one file more in each bucket, until it is compacted."""
    spark = df.sparkSession
    name = _known(spark, path, key, buckets)
    _writer(df.select(*spark.table(name).columns), key, buckets).mode("append").saveAsTable(name)
    return spark.table(name)


def compact_by_key(spark: SparkSession, path: str, to: str, key: str, buckets: int) -> DataFrame:
    """The table under ``path`` written anew under ``to``, with one file a bucket. Readers of the old one are not disturbed."""
    # read as plain files: of a table in the same buckets Spark would leave out the shuffle that brings a bucket's files together
    return write_by_key(spark.read.parquet(path), to, key, buckets)


def _known(spark: SparkSession, path: str, key: str, buckets: int) -> str:
    name = _name()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return name


def _writer(df: DataFrame, key: str, buckets: int) -> DataFrameWriter:
    # Spark deals rows to shuffle partitions and to buckets by the same hash: a task writes one bucket
    dealt = df.repartition(buckets, F.col(key)).sortWithinPartitions(key)
    return dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key)


def _name() -> str:
    return f"stored_{uuid.uuid4().hex}"
