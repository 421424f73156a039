"""Verification: what must not change a file's digests, what must, and whether repeated runs agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.digest import TIERS
from siltstone.operators.code import bundles


def transforms(content: Column) -> dict[str, Column]:
    """Edits that keep a program's meaning."""
    return {
        "trailing_blank_lines": F.concat(content, F.lit("\n\n\n")),
        "comment_added": F.concat(F.lit("# a comment\n"), content),
        "carriage_returns": F.replace(content, F.lit("\n"), F.lit("\r\n")),
        "wider_operators": F.replace(content, F.lit(" + "), F.lit("  +  ")),
    }


def mutations(content: Column) -> dict[str, Column]:
    """Edits that change it, where they apply."""
    edit = lambda a, b: F.replace(content, F.lit(a), F.lit(b))
    return {
        "arithmetic": edit(" + ", " - "),
        "comparison": edit(" < ", " <= "),
        "literal": F.regexp_replace(content, r"\b1\b", "2"),
        "condition": edit("if ", "if not "),
        "dropped_return": edit("return ", ""),
        "parameter": F.regexp_replace(content, r"(def \w+\()", "$1extra, "),
    }


def suite(files: DataFrame) -> DataFrame:
    """(path, kind, expects, applied, holds) for each edit of each file (path, content).

    A transform holds if everything but the source digest stays; a mutation if the structure or the composite changes.
    Mutations that leave the text as it is are not applied and hold.
    """
    content = F.col("content").cast("string")
    edits = [("invariant", k, c) for k, c in transforms(content).items()] + [("divergent", k, c) for k, c in mutations(content).items()]
    made = F.explode(F.array(*(F.struct(F.lit(e).alias("expects"), F.lit(k).alias("kind"), c.alias("after")) for e, k, c in edits)))
    tried = files.select("path", content.alias("before"), made.alias("x")).select("path", "before", "x.*")
    changed = tried.where("before <> after")
    named = changed.select(F.concat_ws("\x00", "path", "kind").alias("path"), F.col("after").alias("content"))
    new = bundles(named).select(F.split("path", "\x00")[0].alias("path"), F.split("path", "\x00")[1].alias("kind"), *(F.col(t).alias(f"n_{t}") for t in TIERS))
    both = changed.select("path", "kind", "expects").join(bundles(files), "path").join(new, ["path", "kind"])
    same = F.lit(True)
    for t in TIERS[1:]:
        same &= F.col(t).eqNullSafe(F.col(f"n_{t}"))
    moved = ~(F.col("structural").eqNullSafe(F.col("n_structural")) & F.col("composite").eqNullSafe(F.col("n_composite")))
    told = both.select("path", "kind", F.when(F.col("expects") == "invariant", same).otherwise(moved).alias("holds"))
    out = tried.select("path", "kind", "expects", (F.col("before") != F.col("after")).alias("applied")).join(told, ["path", "kind"], "left")
    return out.withColumn("holds", F.coalesce("holds", F.lit(True)))


def summary(verdicts: DataFrame) -> DataFrame:
    """(expects, trials, applied, held)."""
    return verdicts.groupBy("expects").agg(F.count("*").alias("trials"), F.count_if("applied").alias("applied"), F.count_if(F.col("applied") & F.col("holds")).alias("held"))


def determinism(files: DataFrame, runs: int = 2) -> DataFrame:
    """(path, agrees): whether repeated runs, differently partitioned, give one bundle."""
    made = bundles(files.repartition(1))
    for i in range(1, runs):
        made = made.unionByName(bundles(files.repartition(i + 1)))
    return made.groupBy("path").agg((F.count_distinct(F.struct(*TIERS)) <= 1).alias("agrees"))
