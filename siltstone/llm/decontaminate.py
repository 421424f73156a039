"""Benchmark decontamination: hashed n-grams of the benchmark, broadcast in bounded blocks, hit and then verified.

The driver hashes the words and windows of a block of items into sorted arrays and broadcasts these. A document's words
are hashed; where enough words that the block knows stand in a row, their window is looked up, and every hit is
verified word for word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from siltstone.llm.common import alnum_words, map_rows
from siltstone.session import Scratch, ship

#: Fixed value: words in a window.
WINDOW = 10
#: UTF-8 bytes of benchmark text in one broadcast block, which takes about six times that in arrays; a larger benchmark
#: is scanned block by block.
BLOCK_BYTES = 8_000_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _windows(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` words from each place in `at`."""
    out = np.zeros(len(at), np.uint64)
    for i in range(width):
        out = (out ^ words[at + i]) * _STEP
        out ^= out >> np.uint64(29)
    return out


class NGrams:
    """The windows of some benchmark items: their words' hashes, and sorted window hashes with places for each width."""

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int = WINDOW):
        self.names, held = [], []
        for name, text in items:
            words = alnum_words(text)
            if words:
                self.names.append(name)
                held.append(_hashed(words))
        sizes = np.array([len(h) for h in held], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.words = np.concatenate(held) if held else np.zeros(0, np.uint64)
        self.vocabulary = np.unique(self.words)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        widths = np.minimum(sizes, window)
        for width in np.unique(widths).tolist():
            own = np.flatnonzero(widths == width)
            at = np.concatenate([np.arange(self.starts[i], self.starts[i] + sizes[i] - width + 1) for i in own])
            hashes = _windows(self.words, at, width)
            order = np.argsort(hashes, kind="stable")
            self.windows[width] = hashes[order], at[order]

    def scan(self, words: list[bytes]) -> tuple[list[int], list[int], set[str]]:
        """Starts and ends (exclusive) of verified windows in `words`, and the items they are of."""
        starts, ends, items = [], [], set()
        if not words or not len(self.vocabulary):
            return starts, ends, items
        own = _hashed(words)
        found = np.searchsorted(self.vocabulary, own)
        found[found == len(self.vocabulary)] = 0
        unknown = np.concatenate([[0], np.cumsum(self.vocabulary[found] != own)])
        for width, (hashes, places) in self.windows.items():
            if len(own) < width:
                continue
            at = np.flatnonzero(unknown[width:] == unknown[:-width])
            if not len(at):
                continue
            asked = _windows(own, at, width)
            low, high = np.searchsorted(hashes, asked), np.searchsorted(hashes, asked, "right")
            for k in np.flatnonzero(low < high).tolist():
                s = int(at[k])
                held = places[low[k] : high[k]]
                same = held[(self.words[held[:, None] + np.arange(width)] == own[s : s + width]).all(axis=1)]
                if len(same):
                    starts.append(s)
                    ends.append(s + width)
                    items.update(self.names[i] for i in np.unique(np.searchsorted(self.starts, same, "right") - 1).tolist())
        return starts, ends, items


def _blocks(benchmark: DataFrame, limit: int) -> Iterable[list[Row]]:
    """Rows of the benchmark in lists of about `limit` bytes of text; the driver holds one list at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item"), "text").toLocalIterator():
        block.append(row)
        size += len((row.text or "").encode())
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def _shared(spark, benchmark: DataFrame, window: int, block_bytes: int) -> Iterator:
    """The blocks of a benchmark as broadcasts; one without items if it is empty."""
    ship(spark)
    some = False
    for block in _blocks(benchmark, block_bytes):
        some = True
        yield spark.sparkContext.broadcast(NGrams(((r.item, r.text) for r in block), window))
    if not some:
        yield spark.sparkContext.broadcast(NGrams([], window))


_HITS = "n_words long, starts array<int>, ends array<int>, items array<string>"


def _scan(docs: DataFrame, shared, only_hits: bool = False) -> DataFrame:
    """(doc_id, version, n_words, starts, ends, items) of every row, or of those with hits; version is the text's hash."""

    def make() -> Callable:
        grams = shared.value

        def each(cols):
            out = {k: [] for k in ("doc_id", "version", "n_words", "starts", "ends", "items")}
            for doc_id, version, text in zip(cols["doc_id"], cols["version"], cols["text"], strict=True):
                words = alnum_words(text)
                starts, ends, items = grams.scan(words)
                if starts or not only_hits:
                    for k, v in zip(out, (doc_id, version, len(words), starts, ends, sorted(items)), strict=True):
                        out[k].append(v)
            return out

        return each

    return map_rows(docs.select("doc_id", F.xxhash64("text").alias("version"), "text"), f"doc_id long, version long, {_HITS}", make)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, version, n_words, starts, ends, items) for every row: verified windows as word offsets, in no order.

    Of a benchmark of several blocks the later ones give rows with hits alone, which meet the first one's by doc_id and
    text; equal rows have equal hits.
    """
    blocks = _shared(docs.sparkSession, benchmark, window, block_bytes)
    first = _scan(docs, next(blocks))
    scratch = Scratch(docs.sparkSession, "decontaminate")
    later = [scratch.keep(_scan(docs, b, only_hits=True).dropDuplicates(["doc_id", "version"])) for b in blocks]
    if not later:
        return first
    every = later[0]
    for part in later[1:]:
        every = every.unionByName(part)
    # At most one row a block meets here.
    flat = [F.flatten(F.collect_list(c)).alias(f"more_{c}") for c in ("starts", "ends", "items")]
    every = every.groupBy(F.col("doc_id").alias("d"), F.col("version").alias("v")).agg(*flat)
    joined = first.join(every, F.expr("doc_id <=> d AND version = v"), "left")
    both = [F.concat(c, F.coalesce(f"more_{c}", F.array().cast(first.schema[c].dataType))).alias(c) for c in ("starts", "ends")]
    items = F.array_distinct(F.concat("items", F.coalesce("more_items", F.array().cast("array<string>")))).alias("items")
    return joined.select("doc_id", "version", "n_words", *both, items)


def _covered(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Union of spans, in order."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts, ends, strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. An item with fewer words than a
    window but not none is one window; an item without words and a null item text match nothing. A null or empty
    text has no words and is clean. items_sha256 hashes the matching item ids sorted as strings and joined by commas
    (of none: the hash of the empty string). Repeated rows give equal rows; an empty benchmark hits nothing; items with
    a null item_id are not counted. Other columns of either table are ignored.
    """
    found = find(docs, benchmark.where("item_id IS NOT NULL"), window, block_bytes)

    def make():
        def each(cols):
            hit = [sum(e - s for s, e in _covered(a, b)) for a, b in zip(cols["starts"], cols["ends"], strict=True)]
            items = [sorted(x) for x in cols["items"]]
            return {
                "doc_id": cols["doc_id"],
                "n_words": cols["n_words"],
                "n_hit": hit,
                "n_items": [len(x) for x in items],
                "items_sha256": [sha256(",".join(x).encode()).hexdigest() for x in items],
                "contaminated": [h > 0 for h in hit],
            }

        return each

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return map_rows(found, schema, make)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` in which no benchmark window occurs.

    Each row is judged by its own text, whatever its doc_id; null and empty texts stay. Repeated rows stay or go
    together, all columns pass through whatever their names, an empty benchmark drops nothing, and an empty table stays
    empty. No row moves: each block of the benchmark is one more filter, after the first with what is left written.
    """
    spark = docs.sparkSession
    scratch, out = Scratch(spark, "decontaminate"), docs
    for k, shared in enumerate(_shared(spark, benchmark.where("item_id IS NOT NULL"), window, block_bytes)):
        out = _without_hits(scratch.keep(out) if k else out, shared)
    return out


def _without_hits(docs: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value
        for batch in batches:
            texts = batch.column("text")
            clean = [not grams.scan(alnum_words(texts[i].as_py()))[0] for i in range(batch.num_rows)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text, n_removed) of every row: the text without the words that a window covers and what stands between.

    Nulls, empty texts, repeated rows and empty tables are treated as by `contamination`.
    """
    import re

    found = find(docs, benchmark.where("item_id IS NOT NULL"), window, block_bytes).where("size(starts) > 0")
    found = found.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "starts", "ends").dropDuplicates(["d", "v"])
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("version")).join(found, F.expr("doc_id <=> d AND version = v"), "left")

    def make():
        word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.A)
        lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

        def each(cols):
            texts, removed = [], []
            for text, starts, ends in zip(cols["text"], cols["starts"], cols["ends"], strict=True):
                spans = _covered(starts or [], ends or [])
                if spans:
                    at = [m.span() for m in word.finditer(text.translate(lower))]
                    parts, last = [], 0
                    for s, e in spans:
                        parts.append(text[last : at[s][0]])
                        last = at[e - 1][1]
                    text = "".join(parts) + text[last:]
                texts.append(text)
                removed.append(sum(e - s for s, e in spans))
            return {"doc_id": cols["doc_id"], "text": texts, "n_removed": removed}

        return each

    return map_rows(texts.select("doc_id", "text", "starts", "ends"), "doc_id long, text string, n_removed long", make)
