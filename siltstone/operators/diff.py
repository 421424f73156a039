"""Comparison of versions: bundles by tier, severity, keyed diffs, edge diffs, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.digest import TIERS


def compare_tiers(old: DataFrame, new: DataFrame, key: str, tiers=TIERS) -> DataFrame:
    """identical or different for each tier of the keys that both versions have."""
    a, b = old.alias("a"), new.alias("b")
    told = [F.when(F.col(f"a.{t}").eqNullSafe(F.col(f"b.{t}")), "identical").otherwise("different").alias(t) for t in tiers]
    return a.join(b, key).select(key, *told)


def severity(changed) -> Column:
    """How far a change reaches; `changed` gives the column that says whether a tier changed.

    Declarations and contracts are an interface change, then dependencies, then whatever else is structural.
    """
    inner = changed("structural") | changed("call_graph") | changed("control_flow") | changed("data_flow")
    return (
        F.when(changed("declaration") | changed("type_contract"), "interface")
        .when(changed("dependency"), "dependency")
        .when(inner, "internal_logic")
        .otherwise("trivia")
    )


def mutated_tiers(changed, tiers=TIERS) -> Column:
    return F.array_join(F.array_compact(F.array(*(F.when(changed(t), F.lit(t)) for t in tiers))), ",")


def keyed_diff(old: DataFrame, new: DataFrame, key: list[str], value: str, changed: str = "changed") -> DataFrame:
    """(key, status, before, after) of rows added, removed or changed in `value`, by one full outer join."""
    a = old.select(*key, F.col(value).alias("before"), F.lit(1).alias("in_old"))
    b = new.select(*key, F.col(value).alias("after"), F.lit(1).alias("in_new"))
    status = (
        F.when(F.col("in_old").isNull(), "added")
        .when(F.col("in_new").isNull(), "removed")
        .when(~F.col("before").eqNullSafe(F.col("after")), changed)
    )
    return a.join(b, key, "full_outer").withColumn("status", status).where("status IS NOT NULL").select(*key, "status", "before", "after")


def multiset_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of one version that the other lacks, counted as often as they lack, with their status."""
    gone, come = old.exceptAll(new), new.exceptAll(old)
    return gone.withColumn("status", F.lit("removed")).unionByName(come.withColumn("status", F.lit("added")))


def snapshot_events(old: DataFrame, new: DataFrame, key: str, *attributes: str) -> DataFrame:
    """What a watcher reports between two snapshots: (key, action) for rows added, modified or deleted."""
    a = old.select(key, F.struct(*attributes).alias("was"), F.lit(1).alias("in_old"))
    b = new.select(key, F.struct(*attributes).alias("now"), F.lit(1).alias("in_new"))
    action = (
        F.when(F.col("in_old").isNull(), "added")
        .when(F.col("in_new").isNull(), "deleted")
        .when(~F.col("was").eqNullSafe(F.col("now")), "modified")
    )
    return a.join(b, key, "full_outer").select(key, action.alias("action")).where("action IS NOT NULL")
