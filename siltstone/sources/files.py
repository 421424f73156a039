"""Scans of source trees and git revisions."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text

#: Largest file and deepest path that are read.
MAX_BYTES, MAX_DEPTH = 52_428_800, 64


def source_files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(path, content, length, modified, language) of the source files below `root`, paths relative to it.

    Names and sizes are filtered on the file index, before contents are read.
    """
    glob = "*.{" + ",".join(e[1:] for e in text.EXTENSIONS) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    top = root.removeprefix("file://").rstrip("/") + "/"
    relative = F.substring_index(F.regexp_replace("path", "^file:/+", "/"), top, -1)
    named = found.where(F.col("length") <= max_bytes).withColumn("path", relative)
    kept = named.where(text.is_source(F.col("path")) & (F.size(F.split("path", "/")) <= max_depth))
    return kept.select("path", "content", "length", F.col("modificationTime").alias("modified"), text.language(F.col("path")).alias("language"))


def safe_path(root: str, path: str) -> str:
    """The real path of `path`, taken below `root` if it is relative; an error if it leads out of `root`.

    Links are followed first, so one that leads out is refused as well.
    """
    if "\0" in root + path:
        raise ValueError("a path holds a null byte")
    top = os.path.realpath(root, strict=True)
    real = os.path.realpath(os.path.join(top, path))
    if real != top and not real.startswith(top.rstrip("/") + "/"):
        raise ValueError(f"{path!r} leads out of {root!r}")
    return real


def seen_before(visited: set[tuple[int, int]], directory: str) -> bool:
    """Whether a walk has been in a directory, by device and file number; a directory that cannot be read counts so."""
    try:
        at = os.stat(directory)
    except OSError:
        return True
    if (at.st_dev, at.st_ino) in visited:
        return True
    visited.add((at.st_dev, at.st_ino))
    return False


def git_revision(spark: SparkSession, repository: str, revision: str, partitions: int = 8) -> DataFrame:
    """(path, content) of the source files of a revision; names are listed once, contents are read by tasks.

    The repository must be on a path that all executors see. Bytes stay bytes.
    """
    listed = subprocess.run(["git", "-C", repository, "ls-tree", "-r", "-z", "--name-only", revision], capture_output=True, check=True)
    names = [(n.decode("utf-8", "surrogateescape"),) for n in listed.stdout.split(b"\0") if n]
    paths = spark.createDataFrame(names, "path string").where(text.is_source(F.col("path"))).repartition(partitions)

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            wanted = batch.column(0).to_pylist()
            shown = [subprocess.run(["git", "-C", repository, "show", f"{revision}:{p}"], capture_output=True, check=True).stdout for p in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.string()), pa.array(shown, pa.binary())], ["path", "content"])

    return paths.mapInArrow(read, "path string, content binary")
