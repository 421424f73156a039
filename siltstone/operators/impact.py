"""What a change reaches: callers by reverse reachability, files, tests, the share of work saved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.digest import saved_percent
from siltstone.operators.graph import reachable


def impacted(edges: DataFrame, symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """(node, file, hops): every symbol that reaches a symbol of the changed files (column file), those included."""
    seeds = symbols.join(changed, "file", "left_semi").select("node")
    return reachable(edges, seeds, backward=True).join(symbols.select("node", "file"), "node")


def impact_summary(reached: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files reached, all files, and the percentage of files that need no new work."""
    n, total = reached.agg(F.countDistinct("file").alias("affected")), files.agg(F.countDistinct("file").alias("total"))
    both = n.crossJoin(total)  # one row each
    return both.select("affected", "total", saved_percent(F.col("affected"), F.col("total")).alias("saved_percent"))


def matching_tests(tests: DataFrame, changed: DataFrame, grams: int = 8) -> DataFrame:
    """Tests (path, base) whose base name contains a changed file's (base), or the other way round.

    A name that contains another has a suffix that starts with it. The first `grams` characters of every suffix are met
    with those that names begin with, a row for each beginning, which tells how long these names are; what stands there
    in that length is then met as a whole. So no join has more than one row of the other side for a row.
    """

    def contained(long: DataFrame, short: DataFrame) -> DataFrame:
        """(long, short): distinct names of `short` that stand in names of `long`."""
        width = F.least(F.length("short"), F.lit(grams))
        needles = short.select(F.col("base").alias("short")).distinct().where("short <> ''")
        heads = needles.groupBy(F.substring("short", 1, grams).alias("gram")).agg(F.collect_set(F.length("short")).alias("lengths"))
        widths = [r.width for r in needles.select(width.alias("width")).distinct().collect()]  # at most `grams` rows
        names = long.select(F.col("base").alias("long")).distinct()
        pieces = names.select("long", F.explode(F.sequence(F.lit(1), F.greatest(F.length("long"), F.lit(1)))).alias("at"))
        pieces = pieces.select("long", "at", F.explode(F.array(*(F.lit(w) for w in sorted(widths))).cast("array<int>")).alias("width"))
        pieces = pieces.withColumn("gram", F.expr("substring(long, at, width)")).where("length(gram) = width")
        met = pieces.join(heads, "gram").select("long", "at", F.explode("lengths").alias("n")).where("at + n - 1 <= length(long)")
        return met.select("long", F.expr("substring(long, at, n)").alias("short")).join(needles, "short", "left_semi")

    a = contained(tests, changed).select(F.col("long").alias("base"))
    b = contained(changed, tests).select(F.col("short").alias("base"))
    return tests.join(a.unionByName(b).distinct(), "base", "left_semi").select("path", "base")


def test_command(tests: DataFrame) -> DataFrame:
    """One row: the command that runs the tests, by the first language that has any."""
    ext = F.regexp_extract("path", r"\.([^.]+)$", 1)
    runner = (
        F.when(ext.isin("py", "pyi"), F.struct(F.lit(0).alias("rank"), F.lit("pytest").alias("run")))
        .when(ext == "go", F.struct(F.lit(1).alias("rank"), F.lit("go test").alias("run")))
        .when(ext == "rs", F.struct(F.lit(2).alias("rank"), F.lit("cargo test").alias("run")))
        .otherwise(F.struct(F.lit(3).alias("rank"), F.lit("npx jest").alias("run")))
    )
    by = tests.groupBy(runner.alias("runner")).agg(F.array_sort(F.collect_set("path")).alias("paths"))
    first = by.agg(F.min(F.struct("runner", "paths")).alias("first"))
    return first.select(F.concat_ws(" ", "first.runner.run", F.array_join("first.paths", " ")).alias("command"))
