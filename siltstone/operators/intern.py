"""Dictionaries of symbols: ids by first occurrence, keywords first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Symbols of a part of the dictionary that one task numbers.
PART = 65_536


def intern(symbols: DataFrame, seeds: list[str] | None = None) -> DataFrame:
    """(symbol, id) of distinct symbols (columns symbol, position) in the order of their first position.

    Raw identifiers lose their r#. Seeds have the first ids in their order. Positions are cut into parts by value; a
    part's size comes from partial counts, so that no task numbers everything.
    """
    spark = symbols.sparkSession
    first = symbols.select(F.regexp_replace("symbol", "^r#", "").alias("symbol"), "position").groupBy("symbol").agg(F.min("position").alias("position"))
    seeded = spark.createDataFrame([(s, i) for i, s in enumerate(dict.fromkeys(seeds or []))], "symbol string, id long")
    rest = first.join(F.broadcast(seeded.select("symbol")), "symbol", "left_anti").withColumn("part", F.expr(f"position DIV {PART}"))
    sizes = rest.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("part").orderBy("position", "symbol")) - 1
    numbered = rest.join(sizes.select("part", before.alias("before")), "part").select("symbol", (F.col("before") + place + F.lit(len(set(seeds or [])))).alias("id"))
    return seeded.unionByName(numbered)


def lookup(asked: DataFrame, dictionary: DataFrame) -> DataFrame:
    """`asked` (symbol) with its id, null if it has none."""
    return asked.join(dictionary, "symbol", "left")
