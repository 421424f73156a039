"""Command line: `python -m siltstone COMMAND ...`; one JSON line per row. Exit: 0 same or done, 1 different, 3 not parsed, 4 not read."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import code, diff, export, merkle
from siltstone.session import get_spark
from siltstone.sources import files, manifest


def _one(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A file as a table of one row, named `name` with the file's extension."""
    return spark.createDataFrame([(name + Path(path).suffix, bytearray(Path(path).read_bytes()))], "path string, content binary")


def _show(rows: DataFrame) -> int:
    """Print the rows as they come, one partition at a time; returns how many."""
    n = 0
    for row in rows.select(F.to_json(F.struct("*")).alias("line")).toLocalIterator():
        print(row.line)
        n += 1
    return n


def fingerprint(spark, args) -> int:
    found = code.bundles(_one(spark, args.file, "file"))
    _show(found)
    return 3 if found.where("error IS NOT NULL").count() else 0


def compare(spark, args) -> int:
    old, new = (code.bundles(_one(spark, f, "file")).withColumn("path", F.lit("file")) for f in (args.old, args.new))
    if old.unionByName(new).where("error IS NOT NULL").count():
        return 3
    told = diff.compare_tiers(old, new, "path")
    _show(told)
    # Bytes may differ where what the files say does not.
    return 1 if told.where("composite = 'different'").count() else 0


def program_diff(spark, args) -> int:
    old, new = (_one(spark, f, "file").withColumn("path", F.lit("file" + Path(f).suffix)) for f in (args.old, args.new))
    if code.bundles(old.unionByName(new)).where("error IS NOT NULL").count():
        return 3
    return 1 if _show(code.program_diff(old, new).drop("path").orderBy("part", "action", "target")) else 0


def repository(spark, args) -> int:
    scanned = files.source_files(spark, args.root)
    if args.cache:
        held = manifest.Manifest(spark, args.cache)
        found = manifest.bundles(scanned, held.read())
        held.write(found)
        found = held.read()
    else:
        found = code.bundles(scanned)
    _show(merkle.repository_digest(found.select("path", F.col("source").alias("digest"))))
    return 0


def cache(spark, args) -> int:
    held = manifest.Manifest(spark, args.cache)
    if args.action == "clean":
        held.clear()
        return 0
    if args.action == "prune":
        held.write(manifest.prune(held.read(), files.source_files(spark, args.root or ".")))
    told = manifest.check(held.read())
    _show(told)
    return 1 if args.action == "verify" and told.where("broken + repeated > 0").count() else 0


def flows(spark, args) -> int:
    _show(code.flow_graph(files.source_files(spark, args.root)).orderBy("src", "dst", "place", "variable"))
    return 0


def calls(spark, args) -> int:
    edges = code.call_graph(files.source_files(spark, args.root))
    if args.dot:
        print("digraph calls {")
        for row in export.dot_lines(edges.select("src", "dst", F.col("calls").cast("string").alias("label"))).toLocalIterator():
            print(row[0])
        print("}")
    else:
        _show(edges.orderBy("src", "dst"))
    return 0


def symbols(spark, args) -> int:
    edges = code.call_graph(files.source_files(spark, args.root))
    return 0 if _show(code.symbol_slice(edges, args.symbol).orderBy("side", "node")) else 1


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser("siltstone", description="Digests, comparisons and graphs of source files.")
    known = parser.add_subparsers(dest="command", required=True)
    for name, run, given in (
        ("fp", fingerprint, ["file"]),
        ("compare", compare, ["old", "new"]),
        ("diff", program_diff, ["old", "new"]),
        ("repository", repository, ["root"]),
        ("flow", flows, ["root"]),
        ("graph", calls, ["root"]),
        ("slice", symbols, ["root", "symbol"]),
    ):
        one = known.add_parser(name)
        one.set_defaults(run=run)
        for g in given:
            one.add_argument(g)
        if name == "repository":
            one.add_argument("--cache", help="folder of a manifest: only files that changed are parsed")
        if name == "graph":
            one.add_argument("--dot", action="store_true", help="print Graphviz lines")
    kept = known.add_parser("cache")
    kept.set_defaults(run=cache)
    kept.add_argument("action", choices=["info", "verify", "prune", "clean"])
    kept.add_argument("cache")
    kept.add_argument("root", nargs="?", help="prune: the tree whose files stay")
    args = parser.parse_args(argv)
    missing = [x for x in (getattr(args, k, None) for k in ("file", "old", "new", "root")) if x and not Path(x).exists()]
    if missing:
        print(f"cannot read {missing[0]}", file=sys.stderr)
        return 4
    return args.run(spark or get_spark(), args)


if __name__ == "__main__":
    sys.exit(main())
