"""Digests of files, directories and repositories."""

from __future__ import annotations

import _hashlib
import ctypes
from collections.abc import Iterable
from functools import cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import Scratch, ship


def repository_digest(files: DataFrame) -> DataFrame:
    """One row (files, repository_digest): SHA-256 over path:digest; of all files in the order of path and digest.

    A hash of everything in order is sequential by its nature: Spark sorts, and one task after the other hashes its
    partition from the state that the one before it left. The driver passes the state on and sees no file. Files
    without a path or digest are counted only.
    """
    spark = files.sparkSession
    ship(spark)
    line = F.concat("path", F.lit(":"), "digest", F.lit(";"))
    pieces = files.select("path", "digest").orderBy("path", "digest").select(line.alias("line")).mapInArrow(_pieces, "n long, piece binary").rdd
    n, state = 0, b""
    for at in range(pieces.getNumPartitions()):
        # Without such a library on the executors, pieces come to the driver, one partition after the other.
        (told,) = spark.sparkContext.runJob(pieces, lambda rows, state=state: [_hash_on(rows, state)], [at])
        if told is None or _crypto() is None:
            return _repository_digest(spark, *_hash_here(pieces.toLocalIterator()))
        n, state = n + told[0], told[1]
    return _repository_digest(spark, n, _finished(state))


def _repository_digest(spark, n: int, digest: str) -> DataFrame:
    return spark.createDataFrame([(n, digest)], "files long, repository_digest string")


def _pieces(batches):
    """The lines of each batch end to end, and how many there are."""
    for batch in batches:
        piece = "".join(x for x in batch.column(0).to_pylist() if x is not None).encode()
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([piece], pa.binary())], ["n", "piece"])


#: Bytes that hold OpenSSL's SHA256_CTX, which is 112 bytes of plain numbers.
_STATE = 128


@cache
def _crypto() -> ctypes.CDLL | None:
    """The library behind hashlib, whose SHA-256 leaves its state where it can be read; None where it is not to be had."""
    try:
        found = ctypes.CDLL(_hashlib.__file__)
        for name in ("SHA256_Init", "SHA256_Update", "SHA256_Final"):
            getattr(found, name)
        return found
    except (AttributeError, OSError):
        return None


def _hash_on(rows: Iterable, state: bytes) -> tuple[int, bytes] | None:
    """Lines and state after the pieces of `rows`, from the state before them, empty at the start."""
    crypto = _crypto()
    if crypto is None:
        return None
    held, n = ctypes.create_string_buffer(state, _STATE), 0
    if not state:
        crypto.SHA256_Init(held)
    for count, piece in rows:
        crypto.SHA256_Update(held, bytes(piece), ctypes.c_size_t(len(piece)))
        n += count
    return n, held.raw


def _finished(state: bytes) -> str:
    if not state:
        return sha256().hexdigest()
    held, out = ctypes.create_string_buffer(state, _STATE), ctypes.create_string_buffer(32)
    _crypto().SHA256_Final(out, held)
    return out.raw.hex()


def _hash_here(rows: Iterable) -> tuple[int, str]:
    state, n = sha256(), 0
    for count, piece in rows:
        state.update(piece)
        n += count
    return n, state.hexdigest()


def merkle_tree(files: DataFrame) -> DataFrame:
    """(path, parent, depth, is_file, digest) of files and of all directories above them, the root being the empty path.

    A directory's digest is the SHA-256 of path:digest lines of its children in the order of path; levels are joined
    from the deepest up, a groupBy each.
    """
    scratch = Scratch(files.sparkSession, "merkle")
    depth = F.size(F.split("path", "/"))
    parent = F.when(F.col("path").contains("/"), F.expr("substring(path, 1, length(path) - locate('/', reverse(path)))")).otherwise("")
    leaves = scratch.keep(files.select("path", "digest").withColumn("depth", depth).withColumn("parent", parent).withColumn("is_file", F.lit(True)))
    deepest = leaves.agg(F.max("depth")).first()[0]
    levels = [leaves]
    below = None
    for level in range(deepest or 0, 0, -1):
        here = leaves.where(F.col("depth") == level).select("path", "parent", "digest")
        if below is not None:
            here = here.unionByName(below.select("path", "parent", "digest"))
        line = F.concat("path", F.lit(":"), "digest", F.lit("\n"))
        children = F.array_sort(F.collect_list(F.struct("path", line.alias("line"))))
        text = F.array_join(F.transform(children, lambda x: x["line"]), "")
        made = here.groupBy(F.col("parent").alias("path")).agg(F.sha2(text, 256).alias("digest"))
        below = made.withColumn("depth", F.lit(level - 1)).withColumn("parent", F.when(F.col("path") == "", F.lit(None)).otherwise(parent))
        below = scratch.keep(below.withColumn("is_file", F.lit(False)))
        levels.append(below)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.select("path", "parent", "depth", "is_file", "digest")


def merkle_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of files whose digest differs between two trees; equal directories are never opened.

    Children are met only below directories that differ, level by level from the root.
    """
    scratch = Scratch(old.sparkSession, "merkle-diff")
    deepest = max((t.agg(F.max("depth")).first()[0] or 0) for t in (old, new))
    wanted = old.select(F.lit("").alias("parent")).limit(1).unionByName(new.select(F.lit("").alias("parent")).limit(1)).distinct()
    found = None
    for level in range(1, deepest + 1):
        sides = []
        for tree, name in ((old, "was"), (new, "now")):
            at = tree.where(F.col("depth") == level).join(wanted, "parent", "left_semi")
            sides.append(at.select("path", "is_file", F.col("digest").alias(name)))
        both = scratch.keep(sides[0].join(sides[1], ["path", "is_file"], "full_outer").where("NOT was <=> now"))
        status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
        here = both.where("is_file").select("path", status.alias("status"))
        found = here if found is None else found.unionByName(here)
        wanted = both.where("NOT is_file").select(F.col("path").alias("parent"))
        if wanted.isEmpty():
            break
    return found if found is not None else old.select("path", F.lit("changed").alias("status")).limit(0)


def update_tree(tree: DataFrame, changed: DataFrame) -> DataFrame:
    """A tree after changes (path, digest) of files; a null digest removes the file, and directories left empty go.

    Only the directories above changed files are made again; all other rows are kept as they are.
    """
    scratch = Scratch(tree.sparkSession, "merkle-update")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    touched = scratch.keep(changed.select(F.explode(above).alias("path")).distinct())
    parent = F.when(F.col("path").contains("/"), F.expr("substring(path, 1, length(path) - locate('/', reverse(path)))")).otherwise("")
    put = changed.where("digest IS NOT NULL").select("path", parent.alias("parent"), F.size(parts).alias("depth"), F.lit(True).alias("is_file"), "digest")
    kept = tree.join(changed.select("path"), "path", "left_anti").join(touched, "path", "left_anti")
    known = scratch.keep(kept.select("path", "parent", "depth", "is_file", "digest").unionByName(put))
    deepest = touched.agg(F.max(F.when(F.col("path") == "", 0).otherwise(F.size(parts)))).first()[0]
    for level in range(deepest if deepest is not None else -1, -1, -1):
        at = touched.where(F.when(F.col("path") == "", 0).otherwise(F.size(parts)) == level).select(F.col("path").alias("parent"))
        line = F.concat("path", F.lit(":"), "digest", F.lit("\n"))
        children = F.array_sort(F.collect_list(F.struct("path", line.alias("line"))))
        text = F.array_join(F.transform(children, lambda x: x["line"]), "")
        made = known.join(at, "parent", "left_semi").groupBy(F.col("parent").alias("path")).agg(F.sha2(text, 256).alias("digest"))
        made = made.select("path", F.when(F.col("path") != "", parent).alias("parent"), F.lit(level).alias("depth"), F.lit(False).alias("is_file"), "digest")
        known = known.unionByName(scratch.keep(made))
    return known
