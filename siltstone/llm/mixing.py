"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document gets an exponential key divided by its quality weight. A source's target is met by whole epochs over
all its documents first; what remains goes to its documents in the order of their keys until the budget is spent.
The order is never one sort over a source: keys are bucketed by value, bucket sums give each source's boundary bucket,
and only that bucket's rows are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import n_words
from siltstone.session import Scratch

#: Source weights by rank, repeating; share of all words to take; most epochs of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Buckets of keys in a source, in two levels: a boundary bucket holds about 1/BUCKETS**2 of its source.
BUCKETS = 1024
#: The symbols that lower a document's quality weight.
SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column) -> Column:
    """0.25 to 1: less the more of the text is symbols; 1 for null and empty texts."""
    length = F.length(text)
    symbols = length - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(length > 0, F.lit(1.0) - 0.75 * F.least(F.lit(1.0), 4.0 * symbols / length)).otherwise(F.lit(1.0))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the weighted share of all words, capped at `most`
    times the source with the excess reshared by weight until none is above.

    A source is full if the level at which all not yet full sources are served is above its own cap; in the order of
    cap over weight these come first, so running sums find the level. One row per source meets here.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every) * float(share)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    place = F.row_number().over(Window.orderBy("ratio", F.col("source").asc_nulls_last()))
    ranked = ranked.withColumn("level", level).withColumn("place", place)
    # The first source that is not full decides; without words there is none.
    served = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(every)["level"]
    target = F.coalesce(F.least(served * F.col("weight"), F.col("cap")), F.col("cap"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: int = 0, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source, source_size, target, taken, version (the text's hash).

    size is the number of words, 0 for a null text. taken counts the words that the mix takes with repeats: whole
    epochs times the size, plus the size if the document's key comes before the boundary, plus at the boundary as many
    words as are left of the rounded target. So each source's taken words equal its rounded target and no document has
    more than the next whole number of epochs. Keys depend on doc_id, text and seed only, so reruns agree; rows that tie
    in all of key, doc_id, size and text are alike. A null source is a source of its own, ranked last. A null doc_id
    gets a key by its text. Columns of `docs` other than doc_id, text and source are ignored. An empty table gives no
    rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    text = F.col("text")
    version = F.xxhash64(text)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), version, F.lit(seed)), 11).cast("double") + 1.0) / float(2**53)
    key = -F.log(uniform) / quality_weight(text)
    # 1 - exp(-key) is monotone in the key and lies in [0, 1), so it deals keys to buckets without a sort.
    at = F.least(F.floor((1.0 - F.exp(-F.col("key"))) * float(BUCKETS**2)), F.lit(BUCKETS**2 - 1))
    sized = docs.select("doc_id", "source", n_words(text).alias("size"), key.alias("key"), version.alias("version"))
    rows = scratch.keep(sized.withColumn("bucket", at.cast("int")))
    coarse = scratch.keep(
        rows.groupBy("source", F.expr(f"CAST(bucket DIV {BUCKETS} AS INT)").alias("part")).agg(F.sum("size").alias("words"))
    )
    targets = source_targets(coarse.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    goal = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plans = targets.withColumn("epochs", epochs).withColumn("budget", goal - epochs * F.col("source_size"))
    plans = scratch.keep(plans)
    first = _boundary(coarse, plans, "part", F.lit(0).cast("long"))
    fine = rows.join(_tag(first, "part"), _same_source() & F.expr(f"bucket DIV {BUCKETS} = edge"), "left_semi")
    fine = fine.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    inside = plans.join(first.select("source", F.col("before").alias("base")).withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s")
    edges = scratch.keep(_boundary(fine, inside, "bucket", F.col("base")))
    plan = plans.join(edges.withColumnRenamed("source", "s"), F.expr("source <=> s"), "left").drop("s")
    plan = plan.select(F.col("source").alias("p_source"), "source_size", "target", "epochs", "budget", "part", "before")
    joined = rows.join(plan.withColumnRenamed("part", "edge"), F.expr("source <=> p_source")).drop("p_source")
    # Without a boundary the budget is 0 or the source has no words.
    whole = F.when(F.col("edge").isNotNull() & (F.col("bucket") < F.col("edge")), F.col("size")).otherwise(F.lit(0))
    clear = joined.where(~F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False)))
    clear = clear.withColumn("taken", F.col("epochs") * F.col("size") + whole)
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size", "version").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = joined.where(F.col("bucket") == F.col("edge"))
    left = F.col("budget") - F.col("before") - F.coalesce(F.sum("size").over(order), F.lit(0))
    partly = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    edge_rows = at_edge.withColumn("taken", F.col("epochs") * F.col("size") + partly)
    columns = ["doc_id", "size", "source", "source_size", "target", F.col("taken").cast("long").alias("taken"), "version"]
    return clear.select(*columns).unionByName(edge_rows.select(*columns))


def _same_source() -> Column:
    return F.expr("source <=> e_source")


def _tag(edges: DataFrame, name: str) -> DataFrame:
    return edges.select(F.col("source").alias("e_source"), F.col(name).alias("edge"))


def _boundary(sums: DataFrame, plans: DataFrame, name: str, base: Column) -> DataFrame:
    """(source, part, before): the bucket in which a source's budget runs out, and the words in the buckets before."""
    told = plans.select(F.col("source").alias("p_source"), "budget", base.alias("base"))
    held = sums.join(told, F.expr("source <=> p_source")).where("budget > 0")
    order = Window.partitionBy("source").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("before", F.col("base") + F.coalesce(F.sum("words").over(order), F.lit(0)))
    edge = held.where("before < budget AND before + words >= budget")
    return edge.select("source", F.col(name).alias("part"), "before")


def mixed_documents(docs: DataFrame, seed: int = 0, **how) -> DataFrame:
    """`docs` with the column `taken`, the words that the mix takes of a row, without rows that it leaves out.

    Rows that repeat doc_id, text and source share their words evenly, rounded down to whole words but never to none.
    Rows without a doc_id are told apart by their texts. An input column named `taken` gives way to the new one; all
    others pass through, whatever their names and types. An empty table stays empty.
    """
    taken = mix(docs, seed, **how).groupBy("doc_id", "version", "source").agg(F.sum("taken").alias("words"), F.count("*").alias("n"))
    taken = taken.where("words > 0").select("doc_id", "version", "source", F.expr("greatest(1L, words DIV n)").alias("words"))
    # Columns stand in one struct meanwhile, so that no name can clash.
    columns = [c for c in docs.columns if c != "taken"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.xxhash64("text").alias("v"))
    same = F.expr("row.doc_id <=> doc_id AND v = version AND row.source <=> source")
    return rows.join(taken, same).select(*(F.col("row")[c].alias(c) for c in columns), F.col("words").alias("taken"))
