"""A manifest of files whose bundles are known, so that a scan parses only what has changed.

A manifest is a Parquet table of (path, length, modified, bundle columns). Each run writes a new version in a folder of
its own and then names it in one small file, so a reader sees a whole version, and a failed run changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.digest import TIERS
from siltstone.operators import code
from siltstone.session import delete

KEY = ("path", "length", "modified")
SCHEMA = "path string, length long, modified timestamp, " + ", ".join(f"{t} string" for t in TIERS) + ", error string"


def look_up(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): files whose path, length and time to the second are in `known`, with its columns; the others."""
    files = files.withColumn("modified", F.date_trunc("second", "modified"))
    held = known.withColumn("modified", F.date_trunc("second", "modified")).dropDuplicates(KEY)
    return files.select(*KEY).join(held, [*KEY]), files.join(held.select(*KEY), [*KEY], "left_anti")


def merge(known: DataFrame, made: DataFrame) -> DataFrame:
    """`known` with the rows of `made` in place of those of the same paths."""
    return known.join(made.select("path"), "path", "left_anti").unionByName(made.select(*known.columns))


def prune(known: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of paths that still exist."""
    return known.join(files.select("path"), "path", "left_semi")


def bundles(files: DataFrame, known: DataFrame) -> DataFrame:
    """The bundles of `files` (path, content, length, modified) with KEY, read from `known` where they are there."""
    hits, misses = look_up(files, known)
    made = misses.select(*KEY).join(code.bundles(misses), "path")
    return hits.unionByName(made.select(*hits.columns))


def check(known: DataFrame) -> DataFrame:
    """One row (entries, broken, repeated): rows, those without a source digest of 64 digits, paths held twice."""
    whole = F.coalesce(F.col("source").rlike("^[0-9a-f]{64}$"), F.lit(False))
    per = known.groupBy("path").agg(F.count("*").alias("n"), F.count_if(~whole).alias("broken"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries"),
        F.coalesce(F.sum("broken"), F.lit(0)).alias("broken"),
        F.count_if(F.col("n") > 1).alias("repeated"),
    )


class Manifest:
    """A manifest in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.where = spark, where.rstrip("/")

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.where + "/CURRENT")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def version(self) -> str | None:
        system, path = self._files()
        return self.spark.read.text(self.where + "/CURRENT").first()[0] if system.exists(path) else None

    def read(self) -> DataFrame:
        """The current version; empty if there is none."""
        at = self.version()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.where}/{at}") if at else self.spark.createDataFrame([], SCHEMA)

    def write(self, rows: DataFrame) -> None:
        """Make `rows`, which may read the current version, the current one; the one before is deleted."""
        old, new = self.version(), f"v-{uuid.uuid4().hex}"
        rows.select(*(f.name for f in self.read().schema)).write.parquet(f"{self.where}/{new}")
        system, path = self._files()
        # A new name takes the old one's place in one step where the file system can do so.
        waiting = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.where}/CURRENT-{new}")
        out = system.create(waiting)
        out.write(bytearray(new.encode()))
        out.close()
        if old:
            system.delete(path, False)
        system.rename(waiting, path)
        if old:
            delete(self.spark, f"{self.where}/{old}")

    def clear(self) -> None:
        delete(self.spark, self.where)
