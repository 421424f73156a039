"""Symbol resolution: ordered fallback over equi-joins, import usage, nearest scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """`refs` (ref_id, module, path, name) with (symbol, how): by module and name, else by path and name, else by a name
    that only one symbol has. Unresolved ones have nulls.

    `symbols` has (symbol, module, path, name). Of several symbols under one key the smallest is meant.
    """
    by_module = symbols.groupBy("module", "name").agg(F.min("symbol").alias("m"))
    by_path = symbols.groupBy("path", "name").agg(F.min("symbol").alias("p"))
    by_name = symbols.groupBy("name").agg(F.min("symbol").alias("u"), F.count("*").alias("n")).where("n = 1").drop("n")
    out = refs.join(by_module, ["module", "name"], "left").join(by_path, ["path", "name"], "left").join(by_name, "name", "left")
    how = F.when(F.col("m").isNotNull(), "module").when(F.col("p").isNotNull(), "path").when(F.col("u").isNotNull(), "unique_name")
    return out.select(*refs.columns, F.coalesce("m", "p", "u").alias("symbol"), how.alias("how"))


def import_usage(inherited: Column, called: Column, referenced: Column, typed: Column) -> Column:
    """The strongest use of an imported name."""
    return (
        F.when(inherited, "inheritance").when(called, "call").when(referenced, "value_reference").when(typed, "type_only").otherwise("unused")
    )


def last_before(rows: DataFrame, key: str, order: list[str], definition: Column, name: str) -> DataFrame:
    """The latest definition at or before each row of its key, by a window that skips rows without one."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(definition, ignorenulls=True).over(w))


def binding_ordinals(rows: DataFrame, scope: str, name: str, position: str) -> DataFrame:
    """(scope, name, ordinal, canonical): names of a scope numbered by where they first stand."""
    first = rows.groupBy(scope, name).agg(F.min(position).alias("first"))
    w = Window.partitionBy(scope).orderBy("first", name)
    n = F.row_number().over(w) - 1
    return first.select(scope, name, n.alias("ordinal"), F.format_string("@v0.%d", n).alias("canonical"))
