"""Results of a job's finished stages, kept in a folder, so that a job that starts again goes on behind the last of them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.session import pin


class Stages:
    """Stages of one job on one input.

    A stage counts as finished when its marker exists. The marker is written after the stage's table and comes to its place by a
    rename, so a job that dies in between repeats the stage, whose table is then replaced.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def finished(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/done/{name}"))

    def _finish(self, name: str, value: str = "") -> None:
        draft, marker = (self._path(f"{self.folder}/{place}/{name}") for place in ("drafts", "done"))
        self.spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(draft.toString())
        self._fs.mkdirs(marker.getParent())
        if not self._fs.rename(draft, marker):
            raise OSError(f"stage {name}: {marker.toString()} is in the way")

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table; ``make`` is called only if it is not there yet."""
        path = f"{self.folder}/tables/{name}"
        if not self.finished(name):
            make().write.mode("overwrite").parquet(path)
            self._finish(name)
        return self.spark.read.parquet(path)

    def value(self, name: str, make: Callable[[], Any]) -> Any:
        """A small result, kept as JSON."""
        if not self.finished(name):
            self._finish(name, json.dumps(make()))
        return json.loads(self.spark.read.text(f"{self.folder}/done/{name}").first()["value"])


class Unkept:
    """Stages that no later job takes up: tables are pinned, values just made."""

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return pin(make())

    def value(self, name: str, make: Callable[[], Any]) -> Any:
        return make()


def input_mark(spark: SparkSession, path: str, *settings: Any) -> str:
    """A name that changes with the settings, and with the files under ``path``: their paths, sizes and times, not their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    found = files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    return hashlib.sha256(json.dumps([*settings, *found]).encode()).hexdigest()[:16]
