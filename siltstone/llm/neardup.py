"""Near-duplicate documents by the Jaccard similarity of their word shingles, beside the fingerprints of `simhash`.

Equal texts share a node. Nodes get MinHash signatures over all their shingles; members of a band's bucket meet as the
lines of `linededup` do, and candidates are verified by the exact similarity of their shingle sets.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import linededup, simhash
from siltstone.llm.common import map_rows, spaced_words
from siltstone.llm.components import connected_components
from siltstone.session import Scratch

#: Words of a shingle and least similarity of a link.
WIDTH, SIMILAR = 5, 0.8
#: Bands of a signature and minima a band: of two texts with similarity 0.8 more than 99 of 100 share a band.
BANDS, ROWS = 14, 5
_SALTS = np.array([xxhash.xxh64_intdigest(bytes([k]), 7) | 1 for k in range(BANDS * ROWS)], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of the shingles of lower-cased words; a shorter text is one shingle, one without words has none."""
    words = [w.lower() for w in spaced_words(text)]
    digest = xxhash.xxh64_intdigest
    several = (b" ".join(words[i : i + WIDTH]) for i in range(max(1, len(words) - WIDTH + 1)))
    return np.unique(np.fromiter((digest(s) for s in several), np.uint64)) if words else np.zeros(0, np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of each of BANDS * ROWS hashes."""
    least = np.full(len(_SALTS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[None, at : at + 4096] * _SALTS[:, None]).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> list[int]:
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(rows[b].tobytes(), b) - (1 << 63) for b in range(BANDS)]


def sketch(least: np.ndarray) -> int:
    """Two bits of each of the first minima, as many as linededup.CLOSE is meant for."""
    n = linededup.SKETCH
    bits = (least[:n] >> np.uint64(32)) & np.uint64(3)
    return int((bits << (np.uint64(2) * np.arange(n, dtype=np.uint64))).sum())


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, node, proof, text): node is 58 bits of the text's hash, proof 64 bits of another one."""
    node = F.shiftrightunsigned(F.xxhash64("text"), 64 - linededup._NODE_BITS)
    return docs.select("doc_id", node.alias("node"), F.xxhash64("text", F.lit(1)).alias("proof"), "text")


def prints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, node, proof, bits, sketch, keys) of every row: its text's fingerprint and signature, from one pass."""

    def make():
        def each(cols):
            found = [shingles(t) for t in cols["text"]]
            least = [minima(h) if len(h) else None for h in found]
            out = {k: cols[k] for k in ("doc_id", "node", "proof")}
            out["bits"] = np.array([simhash.fingerprint(t, width) for t in cols["text"]], np.uint64).view(np.int64)
            out["sketch"] = [0 if m is None else sketch(m) for m in least]
            return out | {"keys": [[] if m is None else band_keys(m) for m in least]}

        return each

    return map_rows(_named(docs), "doc_id long, node long, proof long, bits long, sketch long, keys array<bigint>", make)


def _similar(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    def make():
        def each(cols):
            shares = []
            for x, y in zip(cols["text_a"], cols["text_b"], strict=True):
                x, y = shingles(x), shingles(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                shares.append(both / max(1, len(x) + len(y) - both))
            return {"a": cols["a"], "b": cols["b"], "share": shares}

        return each

    at_a, at_b = (texts.select(F.col("node").alias(n), F.col("text").alias(f"text_{n}")) for n in ("a", "b"))
    joined = pairs.join(at_a, "a").join(at_b, "b").select("a", "b", "text_a", "text_b")
    return map_rows(joined, "a long, b long, share double", make).where(F.col("share") >= similar).select("a", "b")


def similar_texts(docs: DataFrame, rows: DataFrame, scratch: Scratch, similar: float = SIMILAR) -> DataFrame:
    """Links (a, b) between nodes that span the sets of similar texts; `rows` are the prints of `docs`, kept."""
    signed = rows.groupBy("node").agg(F.min("doc_id").alias("home"), F.count("*").alias("occurs"), F.min("sketch").alias("sketch"), F.min("keys").alias("keys"))
    packed = linededup.packed(F.col("node"), F.col("occurs")).alias("packed")
    signed = scratch.keep(signed.select("node", "home", packed, "sketch", "keys"))
    members = linededup.bucket_members(signed, scratch)
    pairs = scratch.keep(linededup.candidate_pairs(members))

    def texts_of(wanted: DataFrame) -> DataFrame:
        homes = signed.select("node", F.col("home").alias("doc_id")).join(wanted, "node", "left_semi")
        # Not a semi-join, which would be moved below the filter.
        found = linededup.wanted_lines(_named(docs), wanted).join(homes, ["node", "doc_id"])
        return scratch.keep(found.groupBy("node").agg(F.min(F.struct("proof", "text"))["text"].alias("text")))

    links = scratch.keep(_similar(pairs, texts_of(linededup.ends_of(pairs)), similar))
    held = scratch.keep(linededup.with_partners(linededup.split_members(members, connected_components(links, scratch))))
    if held.isEmpty():
        return links
    more = texts_of(held.select("node").distinct())
    others = scratch.keep(linededup.other_pairs(held, signed.select("node", "keys"), marks_of(more), similar))
    return links.unionByName(scratch.keep(_similar(others, more, similar)))


def marks_of(texts: DataFrame) -> DataFrame:
    """(node, size, bits): the number of a text's distinct shingles, and a set of bits, in words, with one for each."""
    words = linededup.WORDS

    def make():
        def each(cols):
            found = [shingles(t) for t in cols["text"]]
            bits = np.zeros((len(found), words), np.uint64)
            for row, hashes in zip(bits, found, strict=True):
                np.bitwise_or.at(row, (hashes >> np.uint64(6)) % np.uint64(words), np.uint64(1) << (hashes & np.uint64(63)))
            return {"node": cols["node"], "size": [len(h) for h in found], "bits": list(bits.view(np.int64))}

        return each

    return map_rows(texts, "node long, size int, bits array<bigint>", make)


def keep_one(docs: DataFrame, similar: float = SIMILAR, radius: int = 4, width: int = 4) -> DataFrame:
    """The rows of `docs` without those whose set of near copies has an earlier text.

    Two texts are near copies if their fingerprints of `width`-word shingles differ in at most `radius` bits or their
    5-word shingle sets have this similarity at least; sets are closed over both. Of a set the first row by doc_id stays,
    whatever other texts share its doc_id; of rows that repeat both its doc_id and its text one stays, the first by its
    other columns as JSON. Null and empty texts share a fingerprint and are near copies. Rows without a doc_id all stay:
    nothing orders them. A text whose hash collides with another's is never taken for it. All columns pass through,
    whatever their names and types; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    some = docs.where("doc_id IS NOT NULL")
    rows = scratch.keep(prints(some, width))
    distinct = scratch.keep(rows.select("bits").distinct())
    alike = rows.select("node", "bits").distinct().join(simhash.components(distinct, scratch, radius), "bits")
    least = alike.groupBy("component").agg(F.min("node").alias("b"))
    edges = alike.join(least, "component").select(F.col("node").alias("a"), "b").where("a <> b")
    links = similar_texts(some, rows, scratch, similar)
    component = connected_components(scratch.keep(edges).unionByName(links), scratch)
    # Only the text that was compared stands for its node.
    proofs = rows.groupBy("node").agg(F.min("proof").alias("proof"))
    known = rows.groupBy("doc_id", "node", "proof").agg(F.count("*").alias("n")).join(proofs, ["node", "proof"])
    known = known.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = known.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    told = known.join(first, "component").withColumn("stays", F.expr("doc_id = first.doc_id AND node = first.node"))
    marked = scratch.keep(told.where("n > 1 OR NOT stays").select("doc_id", "node", "proof", "stays"))
    return _without(docs, marked)


def _without(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """`docs` less the rows that are marked, and of several that are marked to stay all but one.

    Only rows that a filter of fixed size does not clear of a mark are moved. Columns stand in one struct meanwhile, so
    that no name can clash.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    other = F.to_json(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")))).alias("other")
    node = F.shiftrightunsigned(F.xxhash64("text"), 64 - linededup._NODE_BITS).alias("node")
    named = docs.select(whole, F.col("doc_id").alias("d"), node, F.xxhash64("text", F.lit(1)).alias("p"), other)
    asked, clear = linededup.asked_and_clear(named, marked.select("node"))
    told = asked.join(marked.withColumnRenamed("node", "m"), F.expr("d = doc_id AND node = m AND p = proof"), "left")
    free = told.where("stays IS NULL").select("row")
    one = told.where("stays").groupBy("d", "m", "p").agg(F.min_by("row", "other").alias("row")).select("row")
    kept = clear.select("row").unionByName(free).unionByName(one)
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
