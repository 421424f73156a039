"""Normal forms of structural types as sorted arrays, and containment of contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_form(members: Column) -> Column:
    """Distinct members in order joined by |; none is never, one stands alone."""
    kept = F.array_sort(F.array_distinct(members))
    return F.when(F.size(kept) == 0, "never").otherwise(F.array_join(kept, "|"))


def intersection_form(members: Column) -> Column:
    """Distinct members in order joined by &; none is any."""
    kept = F.array_sort(F.array_distinct(members))
    return F.when(F.size(kept) == 0, "any").otherwise(F.array_join(kept, "&"))


def is_subtype(sub: Column, sup: Column) -> Column:
    """Whether a contract has every member of another."""
    return F.size(F.array_except(sup, sub)) == 0


def subtypes(contracts: DataFrame, key: str, within: list[str], members: str = "members") -> DataFrame:
    """(sub, sup): keys of two contracts that agree in the columns `within`, of which the first has the second's members.

    Only distinct sets of members are compared, each with those that hold its first member; rows are met by equality
    with the sets found, so that the work is that of the result.
    """
    form = F.array_sort(F.array_distinct(members)).alias("form")
    rows = contracts.where(F.col(members).isNotNull()).select(*within, form, F.col(key).alias("key"))
    sets = rows.select(*within, "form").distinct()
    # A set without members, or with nulls only, is met through the null that each set sends as well.
    held = sets.select(*within, F.col("form").alias("sub_form"), F.explode(F.array_union("form", F.array(F.lit(None)))).alias("lead"))
    asked = sets.select(*(F.col(c).alias(f"sup_{c}") for c in within), F.col("form").alias("sup_form"), F.get("form", F.lit(0)).alias("sup_lead"))
    same = F.col("lead").eqNullSafe(F.col("sup_lead"))
    for c in within:
        same = same & (F.col(c) == F.col(f"sup_{c}"))
    found = held.join(asked, same).where(is_subtype(F.col("sub_form"), F.col("sup_form"))).select(*within, "sub_form", "sup_form")
    subs = rows.withColumnsRenamed({"form": "sub_form", "key": "sub"}).join(found, [*within, "sub_form"])
    sups = rows.withColumnsRenamed({"form": "sup_form", "key": "sup"})
    return subs.join(sups, [*within, "sup_form"]).where("sub <> sup").select("sub", "sup")


#: Containers of several languages and their common names.
CONTAINERS = {
    "list": "Array", "List": "Array", "Vec": "Array", "Slice": "Array", "Array": "Array", "Sequence": "Array",
    "Option": "Optional", "Optional": "Optional", "dict": "Map", "Dict": "Map", "HashMap": "Map", "Map": "Map", "Record": "Map",
}


def container(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in CONTAINERS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, name), name)


def erased_lifetimes(text: Column) -> Column:
    """The lifetimes 'a, 'b and 'c under one name."""
    return F.regexp_replace(text, r"'[abc]\b", "'_")
