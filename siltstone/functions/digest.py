"""Digests as columns: sources, composites, checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tiers of a file's bundle in their order; the composite is made of those after the source.
TIERS = ("source", "structural", "declaration", "dependency", "call_graph", "control_flow", "data_flow", "type_contract", "composite")
COMPOSED = TIERS[1:8]
COMPOSED_BEFORE_CONTRACTS = TIERS[1:7]


def source_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def composite_digest(*tiers: Column) -> Column:
    """SHA-256 of the digests in double quotes, joined by colons."""
    return F.sha2(F.concat_ws(":", *(F.concat(F.lit('"'), t, F.lit('"')) for t in tiers)), 256)


def joined_digest(*digests: Column) -> Column:
    """SHA-256 of digests one after the other, as a repository's composite is made."""
    return F.sha2(F.concat(*digests), 256)


def path_hash(path: Column) -> Column:
    """64-bit FNV-1a of the path's bytes, 16 hex digits. Its product is made of 32-bit halves, which stay within a long.

    The prime is 2**40 + 435: the upper half of the product takes the lower one eight bits up.
    """
    digits = F.hex(path.cast("binary"))
    data = F.transform(F.sequence(F.lit(1), F.octet_length(path)), lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    half = F.lit(0xFFFFFFFF)

    def step(h, b):
        low = h["low"].bitwiseXOR(b)
        product = low * 435
        high = h["high"] * 435 + F.shiftleft(low, 8) + F.shiftright(product, 32)
        return F.struct(high.bitwiseAND(half).alias("high"), product.bitwiseAND(half).alias("low"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))
    made = F.when(F.octet_length(path) > 0, F.aggregate(data, start, step)).when(path.isNotNull(), start)
    return F.lower(F.concat(F.lpad(F.hex(made["high"]), 8, "0"), F.lpad(F.hex(made["low"]), 8, "0")))


def canonical_float(value: Column) -> Column:
    """One zero and one NaN."""
    return F.when(F.isnan(value), F.lit(float("nan"))).when(value == 0.0, F.lit(0.0)).otherwise(value)


def saved_percent(affected: Column, total: Column) -> Column:
    """Share of files that need no new computation, in percent, two decimals, halves to even, never below 0."""
    share = F.when(total > 0, (total - affected).cast("decimal(38,10)") * 100 / total).otherwise(F.lit(100).cast("decimal(38,10)"))
    return F.greatest(F.lit(0.0), F.bround(share, 2).cast("double"))
