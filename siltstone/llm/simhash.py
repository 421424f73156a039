"""SimHash near-duplicates: every pair of fingerprints within a radius, found by bit-sliced comparison.

Fingerprints are compared once each, however many documents share one. Any two within `radius` bits agree on all but
`radius` of b blocks of bits, so each combination of b - radius blocks is a bucket key and no link is lost. Inside a
bucket the fingerprints stand as 64 bit planes; one query updates 64 distances a word by carry-save counters, and a
word is abandoned once all its distances exceed the radius. A bucket gives a spanning forest, not its pairs. A large
bucket is cut into chunks, and each pair of chunks is a task's work of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import map_rows, spaced_words, spread
from siltstone.llm.components import connected_components
from siltstone.session import Scratch

#: Fingerprints in a chunk of a large bucket, and rows compared at once in a task.
CHUNK, BATCH = 1024, 32768
#: A bucket of unrelated fingerprints holds about this many at most; more blocks are used beyond.
BUCKET = 64


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned 64-bit SimHash over XXH64 (seed 42) of `width`-word shingles; 0 for a text without words."""
    words = spaced_words(text)
    if not words:
        return 0
    words = [w.lower() for w in words]
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= width:
        ends, starts = ends[width - 1 :], starts[: len(starts) - width + 1]
    else:
        ends, starts = ends[-1:], starts[:1]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[s:e], 42) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)
    )
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, bits) of every row; bits is the fingerprint as a signed long. Null and empty texts have 0."""

    def make():
        def each(cols):
            out = np.array([fingerprint(t, width) for t in cols["text"]], np.uint64).view(np.int64)
            return {"doc_id": cols["doc_id"], "bits": out}

        return each

    return map_rows(docs.select("doc_id", "text"), "doc_id long, bits long", make)


def _masks(blocks: int, radius: int) -> list[int]:
    """A signed 64-bit mask for each choice of blocks that a linked pair may agree on."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in pairwise(edges)]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(n: int, radius: int) -> int:
    """Fewest blocks with which n unrelated fingerprints leave about BUCKET to a bucket."""
    for blocks in range(radius + 1, 2 * radius + 1):
        if n <= BUCKET * 2 ** (64 * (blocks - radius) / blocks):
            return blocks
    return 2 * radius + 1


def _exceeds(c2, c1, c0, radius: int):
    """Lanes whose 3-bit counter is above radius (0 to 6)."""
    over = np.zeros_like(c0)
    equal = ~over
    for plane, bit in ((c2, 4), (c1, 2), (c0, 1)):
        if radius & bit:
            equal = equal & plane
        else:
            over |= equal & plane
            equal = equal & ~plane
    return over


def bit_sliced_links(group: np.ndarray, bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of one group and within radius; rows of a group stand together."""
    n = len(bits)
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(cuts, n))
    words = (sizes + 63) // 64
    first_word = np.cumsum(words) - words
    offset = spread(sizes)
    lane = np.repeat(first_word, sizes) * 64 + offset
    held = np.zeros(int(words.sum()) * 64, np.uint64)
    held[lane] = bits
    used = np.zeros(len(held), np.uint8)
    used[lane] = 1
    row_of = np.zeros(len(held), np.int64)
    row_of[lane] = np.arange(n)
    empty = ~np.packbits(used, bitorder="little").view("<u8")
    # A query meets its own word and the later ones of its group: the earlier ones have met it.
    own = offset // 64
    todo = np.repeat(words, sizes) - own
    query = np.repeat(np.arange(n), todo)
    word = np.repeat(np.repeat(first_word, sizes) + own, todo) + spread(todo)
    c0, c1, c2 = (np.zeros(len(query), np.uint64) for _ in range(3))
    over = empty[word]
    one = np.uint64(1)
    for p in range(0, 64, 2):
        pair = []
        for q in (p, p + 1):
            plane = np.packbits(((held >> np.uint64(q)) & one).astype(np.uint8), bitorder="little").view("<u8")
            asked = np.uint64(0) - ((bits >> np.uint64(q)) & one)
            pair.append(plane[word] ^ asked[query])
        x, y = pair
        u = x ^ y
        carry = (x & y) | (u & c0)
        c0 ^= u
        carry2 = c1 & carry
        c1 ^= carry
        over |= c2 & carry2
        c2 ^= carry2
        if p % 8 == 6:
            dead = over | _exceeds(c2, c1, c0, radius)
            live = np.flatnonzero(dead != ~np.uint64(0))
            if len(live) < len(query):
                query, word, c0, c1, c2, over = (v[live] for v in (query, word, c0, c1, c2, over))
            if not len(query):
                break
    near = ~(over | _exceeds(c2, c1, c0, radius))
    hit = np.flatnonzero(near)
    lanes = np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    which, bit = np.nonzero(lanes)
    a, b = query[hit[which]], row_of[word[hit[which]] * 64 + bit]
    later = b > a
    return a[later], b[later]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that it is linked to through pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _compare(radius: int, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(group, bits):
            a, b = bit_sliced_links(group, bits.view(np.uint64), radius)
            label = forest(len(bits), a, b)
            at = np.flatnonzero(label != np.arange(len(bits)))
            return pa.RecordBatch.from_arrays([pa.array(bits[at]), pa.array(bits[label[at]])], ["a", "b"])

        rest = [np.zeros((0, len(keys)), np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys]
            held = np.concatenate([rest[0], np.stack(columns, axis=1)])
            bits = np.concatenate([rest[1], batch.column("bits").to_numpy()])
            change = np.flatnonzero((held[1:] != held[:-1]).any(axis=1)) + 1
            start = 0
            while len(bits) - start > BATCH and len(change) and change[-1] > start:
                inside = change[(change > start) & (change <= start + BATCH)]
                cut = inside[-1] if len(inside) else change[change > start][0]
                group = np.concatenate([[0], np.cumsum((held[start + 1 : cut] != held[start : cut - 1]).any(axis=1))])
                yield flush(group, bits[start:cut])
                start = cut
            rest = [held[start:], bits[start:]]
        if len(rest[1]):
            held, bits = rest
            yield flush(np.concatenate([[0], np.cumsum((held[1:] != held[:-1]).any(axis=1))]), bits)

    return run


def links(distinct: DataFrame, n: int, radius: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column bits) that span every set linked within radius."""
    masks = _masks(blocks_for(n, radius), radius)
    keys = distinct.select(
        "bits",
        F.explode(
            F.array(*(F.struct(F.lit(i).alias("part"), F.col("bits").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(masks)))
        ).alias("k"),
    ).select("bits", "k.part", "k.value")
    sizes = keys.groupBy("part", "value").count().where("count > 1")
    held = keys.join(sizes, ["part", "value"]).withColumn("chunks", F.ceil(F.col("count") / CHUNK))
    mine = F.pmod(F.xxhash64("bits"), F.col("chunks"))
    tiles = (
        held.withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select("part", "value", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "bits")
    )
    group = ["part", "value", "i", "j"]
    dealt = tiles.repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(_compare(radius, group), "a long, b long")


def components(distinct: DataFrame, scratch: Scratch, radius: int) -> DataFrame:
    """(bits, component) of every fingerprint of `distinct` (column bits, kept); a component is named by one of them."""
    found = connected_components(links(distinct.select("bits"), distinct.count(), radius), scratch)
    joined = distinct.select("bits").join(found.withColumnRenamed("node", "bits"), "bits", "left")
    return joined.select("bits", F.coalesce("component", "bits").alias("component"))


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over fingerprints that differ in at most `radius` (0 to 6) bits.
    Null and empty texts share the fingerprint zero and are linked like any other. Repeated rows give equal rows. A
    null doc_id is kept; it names a component only if no other does. Other columns are ignored. An empty table gives
    no rows.
    """
    if not 0 <= radius <= 6:
        raise ValueError("radius is 0 to 6")
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    prints = scratch.keep(fingerprints(docs, width))
    distinct = scratch.keep(prints.groupBy("bits").agg(F.min("doc_id").alias("first")))
    joined = distinct.join(components(distinct, scratch, radius), "bits")
    smallest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = scratch.keep(joined.join(smallest, "component").select("bits", "component_id"))
    return prints.join(named, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )
