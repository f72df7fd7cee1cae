"""Label dictionaries and encoding by join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.operators.features import CATEGORICAL
from stockloom.operators.lookup import lookup_join
from stockloom.operators.ordering import SEGMENT, by_segment, group_position, range_segments
from stockloom.session import pin

ROW_KEY = ("sale_date", "store_id", "product_id")


def _cells(columns: Sequence[str]) -> Column:
    return F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("label"))
        for c in columns
    ])


def label_dictionary(df: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Sorted classes of each column with their index; a null is the class ``nan``.

    All columns are read in one pass and reduced before the shuffle. Indexes are positions, so a column with very many
    classes is not numbered by one task.
    """
    classes = df.select(F.explode(_cells(columns)).alias("cell")).select("cell.*").distinct()
    return group_position(classes, ["column"], ["label"], "index").withColumn("index", F.col("index").cast("int"))


def target_sums(df: DataFrame, target: str, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Sum ``s`` and count ``n`` of the target for each class of each column."""
    cells = df.select(target, F.explode(_cells(columns)).alias("cell"))
    return cells.groupBy("cell.column", "cell.label").agg(F.sum(target).alias("s"), F.count(target).alias("n"))


def smoothed_mean(s: Column, n: Column, prior: Column) -> Column:
    """Mean of a class that has seen the prior once."""
    return (s + prior) / (n + 1)


def ordered_means(
    df: DataFrame, target: str, prior: float, columns: Sequence[str] = CATEGORICAL, keys: Sequence[str] = ROW_KEY, suffix: str = "_mean"
) -> DataFrame:
    """Add, for each column, the mean target of the rows of a row's class that come before it in a shuffled order, and the prior once.

    The order is that of a digest of the row's key, so it is the same on every run, and no row's own target or a later one is in its
    features. Rows are put into ranges of the digest; sums run inside a range, and what earlier ranges hold of a class comes from a
    table of the sums of each class in each range.
    """
    order = ["_place", *keys]
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    placed = range_segments(df.drop(SEGMENT).withColumn("_place", digest), order)
    sums = placed.select(SEGMENT, target, F.explode(_cells(columns)).alias("cell")).groupBy(SEGMENT, "cell.column", "cell.label")
    sums = sums.agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    earlier = Window.partitionBy("column", "label").orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carried = pin(sums.select(SEGMENT, "column", "label", F.sum("s").over(earlier).alias("_s"), F.sum("n").over(earlier).alias("_n")))
    out = by_segment(placed)
    inside = {}
    for c in columns:
        before = Window.partitionBy(SEGMENT, c).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        inside |= {f"_s_{c}": F.coalesce(F.sum(target).over(before), F.lit(0)), f"_n_{c}": F.count(target).over(before)}
    out = out.withColumns(inside)
    for c in columns:
        dim = carried.filter(F.col("column") == c).select(SEGMENT, F.col("label").alias("_label"), "_s", "_n")
        out = out.withColumn("_label", F.coalesce(F.col(c).cast("string"), F.lit("nan")))
        out = lookup_join(out, dim, [SEGMENT, "_label"], keys)
        s, n = (F.col(f"_{x}_{c}") + F.coalesce(f"_{x}", F.lit(0)) for x in ("s", "n"))
        out = out.withColumn(c + suffix, smoothed_mean(s, n, F.lit(prior))).drop("_label", "_s", "_n", f"_s_{c}", f"_n_{c}")
    return out.drop("_place", SEGMENT)


def _lookup_classes(
    df: DataFrame, classes: DataFrame, columns: Sequence[str], value: str, suffix: str, default: Column
) -> DataFrame:
    classes = pin(classes)
    spread = [k for k in ROW_KEY if k in df.columns] or list(columns)
    out = df
    for c in columns:
        dim = classes.filter(F.col("column") == c).select(F.col("label").alias("_label"), F.col(value).alias("_value"))
        out = out.withColumn("_label", F.coalesce(F.col(c).cast("string"), F.lit("nan")))
        out = lookup_join(out, dim, ["_label"], spread)
        out = out.withColumn(c + suffix, F.coalesce("_value", default)).drop("_label", "_value")
    return out


def encode(df: DataFrame, dictionary: DataFrame, columns: Sequence[str] = CATEGORICAL, suffix: str = "") -> DataFrame:
    """Replace classes by their index (or add it under ``suffix``); an unseen class gets the first index."""
    return _lookup_classes(df, dictionary, columns, "index", suffix, F.lit(0))


def with_target_means(df: DataFrame, means: DataFrame, unseen: float, columns: Sequence[str] = CATEGORICAL, suffix: str = "_mean") -> DataFrame:
    """Add each class's ``target_mean`` under ``suffix``; ``unseen`` stands in for a class without one."""
    return _lookup_classes(df, means, columns, "target_mean", suffix, F.lit(unseen))


def unseen_categories(df: DataFrame, dictionary: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Classes of ``df`` that the dictionary lacks, with their row counts."""
    seen = df.select(F.explode(_cells(columns)).alias("cell")).groupBy("cell.column", "cell.label")
    counted = seen.agg(F.count(F.lit(1)).alias("rows"))
    return counted.join(dictionary.select("column", "label"), ["column", "label"], "left_anti")
