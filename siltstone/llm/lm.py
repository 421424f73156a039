"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

Training texts are tokenised once; each run of documents gives a row with a count for every distinct token and bigram
hash. Spark sums them, and a shard's rows become exact counts of tokens, and for bigrams a Bloom filter in which a
bigram of level q was entered q times, once per level up to its own. Scoring asks for level 1, 2, ... until a probe fails and takes the
smallest count of the last level as the bigram's count, interpolated with discounted token frequencies.
"""

from __future__ import annotations

from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import release, spaced_words
from siltstone.session import Scratch, ship

#: Documents whose crc32(doc_id as text) mod FOLDS is HELD_OUT are not learned from.
FOLDS, HELD_OUT = 7, 2
#: Smallest count of each level of the filter; they double up to more than any corpus holds.
LEVELS = np.array([1, 2, 3, 5, *(1 << k for k in range(3, 48))], np.int64)
#: Bits of the filter for each entry, and probes.
BITS, PROBES = 12, 5
#: Weight of the token model against a context's count, and what is taken from each count for unseen tokens.
BACKOFF, DISCOUNT = 8.0, 0.7
#: UTF-8 bytes of text whose counts go to one shard; a shard is built by one task.
SHARD_BYTES = 4_000_000
#: Tokens that are counted together, and rows in a batch of counts; they bound the memory of a counting task.
RUN_TOKENS, RUN_ROWS = 1_000_000, 65_536
#: Parts in which runs ask the shards, one after the other: what is shuffled at once is so much less.
TURNS = 2
#: Most bytes of model that may be broadcast, as every Python worker holds a copy; beyond, runs of
#: texts ask the shards for the same counts and levels.
BROADCAST_BYTES = 200_000_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_END = np.uint64(xxhash.xxh64_intdigest(b" "))


def held_out(doc_id) -> bool:
    """A row without a doc_id is held out: nothing says that it may be learned from."""
    return doc_id is None or crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def token_hashes(text: str | None) -> np.ndarray:
    words = spaced_words(text)
    digest = xxhash.xxh64_intdigest
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter((digest(w.lower()) for w in words), np.uint64, len(words))
    out[-1] = _END
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    return x ^ (x >> np.uint64(29))


def bigram_hashes(tokens: np.ndarray) -> np.ndarray:
    """Of each token with the one before it; the end token stands before the first."""
    before = np.concatenate([[_END], tokens[:-1]])
    return mixed(before * _B + tokens)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of the hash, so that shards in order are hashes in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _count(docs: DataFrame, shards: int, bigrams: bool) -> DataFrame:
    """(part, hash, n) of runs of training documents: part is twice the shard, and one more for bigrams."""
    names = ["part", "hash", "n"]

    def counted(kind, values):
        unique, counts = np.unique(values, return_counts=True)
        part = (shard_of(unique, shards) * 2 + kind).astype(np.int32)
        for at in range(0, len(unique), RUN_ROWS):
            where = slice(at, at + RUN_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(part[where]), pa.array(unique[where].view(np.int64)), pa.array(counts[where])], names)

    def flush(held):
        yield from counted(0, np.concatenate(held))
        if bigrams:
            yield from counted(1, np.concatenate([bigram_hashes(t) for t in held]))

    def run(batches):
        held, n = [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, doc_id in enumerate(ids):
                if held_out(doc_id):
                    continue
                held.append(token_hashes(texts[i].as_py()))
                n += len(held[-1])
                if n >= RUN_TOKENS:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)
        del held
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "part int, hash long, n long")


def _level(level: int) -> np.uint64:
    return np.uint64(level * int(_B) % 2**64)


def probe_places(hashes: np.ndarray, level: int, n_bits: int):
    """Bit positions of each probe of (hash, level)."""
    first = mixed(hashes + _level(level))
    second = mixed(first ^ _A) | np.uint64(1)
    for i in range(PROBES):
        yield (first + np.uint64(i) * second) % np.uint64(n_bits)


def build_filter(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    level = np.searchsorted(LEVELS, counts, side="right")
    n_bits = max(64, (int(level.sum()) * BITS + 63) // 64 * 64)
    bits = np.zeros(n_bits, np.uint8)
    for j in range(1, int(level.max(initial=0)) + 1):
        for place in probe_places(hashes[level >= j], j, n_bits):
            bits[place.astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _packed(batches):
    """A row for each part of the model, from the summed counts in the order of their parts."""

    def pack(part, hashes, counts):
        hashes, counts = np.concatenate(hashes).view(np.uint64), np.concatenate(counts)
        kind, shard = part % 2 + 1, part // 2
        order = np.argsort(hashes)
        body, extra = (hashes[order].tobytes(), counts[order].tobytes()) if kind == 1 else (build_filter(hashes, counts), b"")
        made = {"kind": [kind], "shard": [shard], "body": [body], "extra": [extra], "n": [len(hashes)], "total": [int(counts.sum())]}
        return pa.RecordBatch.from_pydict(made, _PARTS)

    now, hashes, counts = None, [], []
    for batch in batches:
        parts, h, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1], [True]])) if len(parts) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if now is not None and parts[a] != now:
                yield pack(now, hashes, counts)
                hashes, counts = [], []
            now = int(parts[a])
            hashes.append(h[a:b])
            counts.append(n[a:b])
    if now is not None:
        yield pack(now, hashes, counts)
    release()


_PARTS = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("body", pa.binary()), ("extra", pa.binary()), ("n", pa.int64()), ("total", pa.int64())])


class Model:
    """Exact token counts and the sharded filter, as a task reads them."""

    def __init__(self, keys, counts, bits, first_bit, n_bits):
        self.keys, self.counts, self.bits, self.first_bit, self.n_bits = keys, counts, bits, first_bit, n_bits
        self.shards = len(n_bits)
        self.total, self.types = int(counts.sum(dtype=np.int64)), len(keys)

    @staticmethod
    def of(parts, sizes: list[tuple[int, int, int, int]], shards: int) -> Model:
        """From rows (kind, shard, body, extra) that come one at a time, and their (kind, shard, n, bytes of body)."""
        types, lengths = np.zeros(shards, np.int64), np.zeros(shards, np.int64)
        for kind, shard, n, length in sizes:
            if kind == 1:
                types[shard] = n
            else:
                lengths[shard] = length
        key_at, byte_at = np.cumsum(types) - types, np.cumsum(lengths) - lengths
        keys, counts = np.zeros(types.sum(), np.uint64), np.zeros(types.sum(), np.int64)
        bits = np.zeros(lengths.sum(), np.uint8)
        for kind, shard, body, extra in parts:
            if kind == 1:
                where = slice(key_at[shard], key_at[shard] + types[shard])
                keys[where], counts[where] = np.frombuffer(body, np.uint64), np.frombuffer(extra, np.int64)
            else:
                bits[byte_at[shard] : byte_at[shard] + lengths[shard]] = np.frombuffer(body, np.uint8)
        if counts.max(initial=0) < 1 << 32:
            counts = counts.astype(np.uint32)
        return Model(keys, counts, bits, byte_at.astype(np.uint64) * np.uint64(8), (lengths * 8).astype(np.uint64))

    def token_counts(self, tokens: np.ndarray) -> np.ndarray:
        if not self.types:
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.keys, tokens), self.types - 1)
        return np.where(self.keys[at] == tokens, self.counts[at].astype(np.int64), 0)

    def bigram_counts(self, pairs: np.ndarray) -> np.ndarray:
        """The smallest count of the highest level whose probes all hit; 0 if the first level misses."""
        out = np.zeros(len(pairs), np.int64)
        shard = shard_of(pairs, self.shards)
        live = np.flatnonzero(self.n_bits[shard] > 0)
        for j in range(1, len(LEVELS) + 1):
            size, base = self.n_bits[shard[live]], self.first_bit[shard[live]]
            first = mixed(pairs[live] + _level(j))
            second = mixed(first ^ _A) | np.uint64(1)
            hit = np.ones(len(live), bool)
            for i in range(PROBES):
                place = base + (first + np.uint64(i) * second) % size
                hit &= (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            live = live[hit]
            if not len(live):
                break
            out[live] = LEVELS[j - 1]
        return out


def log_probabilities(c, c_before, c_pair, total: int, types: int):
    """(base, model) log10 probabilities of tokens with these counts; the model's are of the interpolated bigram.

    Tokens never seen share DISCOUNT times the number of types, as one class, like the class of unseen tokens in the
    base; the counts of seen ones are less by DISCOUNT. Without any training tokens everything is one unseen class.
    """
    base = np.log10((c + 1) / (total + types + 1))
    if not total:
        return base, np.zeros(len(c))
    token = np.where(c > 0, c - DISCOUNT, DISCOUNT * types) / total
    pair = np.where(c > 0, np.minimum(c_pair, np.minimum(c, c_before)), 0)
    return base, np.log10(np.minimum(1.0, (pair + BACKOFF * token) / (c_before + BACKOFF)))


def _scores(ids: list, lengths: np.ndarray, starts: np.ndarray, c, base, own, total: int) -> pa.RecordBatch:
    """The result's rows of texts that stand end to end, from their tokens' counts and log probabilities."""
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([held_out(d) for d in ids]),
            pa.array(lengths.astype(np.int64)),
            pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)),
            pa.array(np.full(len(ids), total, np.int64)),
            pa.array(np.add.reduceat(base, starts)),
            pa.array(np.add.reduceat(own, starts)),
        ],
        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def train(docs: DataFrame, scratch: Scratch, shard_bytes: int = SHARD_BYTES, bigrams: bool = True) -> tuple[DataFrame, int]:
    """The model's parts (kind, shard, body, extra, n, total), one row per shard, and the number of shards."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(4, -(-size // shard_bytes))
    # A part's rows meet in one task and need no other exchange to be summed, sorted and packed.
    summed = _count(docs, shards, bigrams).repartition("part").groupBy("part", "hash").agg(F.sum("n").alias("n"))
    packed = summed.sortWithinPartitions("part").mapInArrow(_packed, "kind int, shard int, body binary, extra binary, n long, total long")
    return scratch.keep(packed), shards


def score(docs: DataFrame, shard_bytes: int = SHARD_BYTES, broadcast_bytes: int = BROADCAST_BYTES, bigrams: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words, A-Z lower-cased, and one end. A null or empty text is the end alone. Documents without a
    doc_id are held out. Tokens are told apart by XXH64. Repeated rows are learned from as often as they stand and get
    equal scores. With nothing to learn from, train_tokens is 0 and score 0. Other columns are ignored. Without `bigrams`
    these are neither counted nor asked for, and there is no column score.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "lm")
    parts, shards = train(docs, scratch, shard_bytes, bigrams)
    size = parts.agg(F.sum(F.length("body") + F.length("extra"))).first()[0] or 0
    if size > broadcast_bytes:
        return _wanted(_score_by_shards(docs, parts, shards, scratch, bigrams), bigrams)
    # One shard at a time comes to the driver, into arrays of their final size.
    sizes = [tuple(r) for r in parts.select("kind", "shard", "n", F.length("body")).collect()]
    rows = ((r.kind, r.shard, r.body, r.extra) for r in parts.toLocalIterator())
    model = Model.of(rows, sizes, shards)
    shared = spark.sparkContext.broadcast((model.keys, model.counts, model.bits, model.first_bit, model.n_bits))
    del model

    def run(batches):
        release()
        model = Model(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(0).to_pylist()
                tokens = [token_hashes(t) for t in part.column(1).to_pylist()]
                n = np.array([len(t) for t in tokens])
                flat, pairs = np.concatenate(tokens), np.concatenate([bigram_hashes(t) for t in tokens])
                unique, where = np.unique(flat, return_inverse=True)
                c = model.token_counts(unique)[where]
                starts = np.cumsum(n) - n
                before = np.concatenate([[0], c[:-1]])
                before[starts] = model.token_counts(np.array([_END]))[0]
                pairs, back = np.unique(pairs, return_inverse=True)
                base, own = log_probabilities(c, before, model.bigram_counts(pairs)[back], model.total, model.types)
                yield _scores(ids, n, starts, c, base, own, model.total)

    return _wanted(docs.select("doc_id", "text").mapInArrow(run, _RESULT), bigrams)


def _wanted(scored: DataFrame, bigrams: bool) -> DataFrame:
    return scored if bigrams else scored.drop("score")


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _pairs_of(tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins, and the bigram hashes of texts that stand end to end."""
    starts = np.cumsum(lengths) - lengths
    before = np.concatenate([[_END], tokens[:-1]])
    before[starts] = _END
    return starts, mixed(before * _B + tokens)


def _runs(batches):
    """Texts end to end, about RUN_TOKENS tokens a row: their documents, lengths, distinct tokens and the places of these."""

    def flush(ids, held):
        lengths = np.array([len(t) for t in held], np.int64)
        unique, places = np.unique(np.concatenate(held), return_inverse=True)
        packed = pa.compress(places.astype(np.uint32).tobytes(), "zstd", asbytes=True)
        run = (TaskContext.get().partitionId() << 32) + made
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((run, ids, lengths.tobytes(), unique.tobytes(), packed), _RUN, strict=True)], _RUN_NAMES)

    ids, held, n, made = [], [], 0, 0
    for batch in batches:
        texts = batch.column(1)
        for i, doc_id in enumerate(batch.column(0).to_pylist()):
            ids.append(doc_id)
            held.append(token_hashes(texts[i].as_py()))
            n += len(held[-1])
            if n >= RUN_TOKENS:
                yield flush(ids, held)
                ids, held, n, made = [], [], 0, made + 1
    if held:
        yield flush(ids, held)
    del held
    release()


_RUN_NAMES = ["run", "ids", "lengths", "tokens", "places"]
_RUN = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]


def _unpacked(lengths: bytes, tokens: bytes, places: bytes):
    """Lengths, distinct tokens, the place of each token among them, where each text begins, and the bigrams."""
    lengths, unique = np.frombuffer(lengths, np.int64), np.frombuffer(tokens, np.uint64)
    where = np.frombuffer(pa.decompress(places, 4 * int(lengths.sum()), "zstd", asbytes=True), np.uint32)
    return lengths, unique, where, *_pairs_of(unique[where], lengths)


def _score_by_shards(docs: DataFrame, parts: DataFrame, shards: int, scratch: Scratch, bigrams: bool = True) -> DataFrame:
    """The same scores where the model is too large to broadcast: runs of texts ask each shard for what they hold of it.

    A run sends a shard its distinct hashes, and gets a byte for each bigram and a count for each token back in their
    order, so neither the model nor a row for each token ever meets in one place.
    """
    told = parts.where("kind = 1").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    total, types = told.total or 0, told.n or 0
    runs = scratch.keep(docs.select("doc_id", "text").mapInArrow(_runs, "run long, ids array<bigint>, lengths binary, tokens binary, places binary"))

    def ask_in(turn):
        def ask(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    run = batch.column(0)[i].as_py()
                    _, unique, _, _, pairs = _unpacked(*(batch.column(k)[i].as_py() for k in (2, 3, 4)))
                    for kind, hashes in ((0, unique), (1, np.unique(pairs))) if bigrams else ((0, unique),):
                        shard = shard_of(hashes, shards)
                        cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
                        some = [(x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if shard[x] % TURNS == turn]
                        part = [int(shard[x]) * 2 + kind for x, _ in some]
                        bodies = [hashes[x:y].tobytes() for x, y in some]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(part, pa.int32()), pa.array([run] * len(part), pa.int64()), pa.array(bodies, pa.binary()), pa.nulls(len(part), pa.binary())],
                            ["part", "run", "body", "extra"],
                        )
            release()

        return ask

    def answer(batches):
        now, held = None, None
        for batch in batches:
            part, run = (batch.column(k).to_numpy() for k in range(2))
            bodies, extras = batch.column(2), batch.column(3)
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else [0]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if part[x] != now:
                    now, held = int(part[x]), None
                if run[x] < 0:
                    held = (bodies[int(x)].as_py(), extras[int(x)].as_py())
                    x += 1
                if x == y:
                    continue
                sent = [np.frombuffer(bodies[k].as_py(), np.uint64) for k in range(int(x), int(y))]
                asked, back = np.unique(np.concatenate(sent), return_inverse=True)
                found = _found(now, held, asked)[back]
                ends = np.cumsum([len(h) for h in sent])
                made = [f.tobytes() for f in np.split(found, ends[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(run[x:y]), pa.array(np.full(y - x, now, np.int32)), pa.array(made, pa.binary())], ["run", "part", "body"])
        release()

    def _found(part: int, held, asked: np.ndarray) -> np.ndarray:
        """The counts of tokens, or the levels of bigrams, in a part of the model."""
        body, extra = held or (b"", b"")
        if part % 2:
            model = Model.of([(2, part // 2, body, b"")], [(2, part // 2, 0, len(body))], shards)
            return np.searchsorted(LEVELS, model.bigram_counts(asked), side="right").astype(np.uint8)
        keys, counts = np.frombuffer(body, np.uint64), np.frombuffer(extra, np.int64)
        return Model(keys, counts, np.zeros(0, np.uint8), np.zeros(1, np.uint64), np.zeros(1, np.uint64)).token_counts(asked)

    def answers_of(turn):
        part = (F.col("shard") * 2 + F.col("kind") - 1).cast("int").alias("part")
        model = parts.where(F.col("shard") % TURNS == turn).select(part, F.lit(-1).cast("long").alias("run"), "body", "extra")
        asked = runs.mapInArrow(ask_in(turn), "part int, run long, body binary, extra binary").unionByName(model)
        # A part of the model comes before what it is asked.
        asked = asked.repartition("part").sortWithinPartitions("part", "run")
        return scratch.keep(asked.mapInArrow(answer, "run long, part int, body binary"))

    answers = reduce(DataFrame.unionByName, [answers_of(turn) for turn in range(TURNS)])
    scratch.drop(parts)

    def scored(ids, packed, bodies):
        lengths, unique, where, starts, pairs = _unpacked(*packed)
        # The parts are in the order of their shards, and so are the hashes.
        known = np.concatenate([np.frombuffer(b, np.int64) for part, b in bodies if not part % 2])
        levels = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(b, np.uint8) for part, b in bodies if part % 2)])
        c = known[where]
        before = np.concatenate([[0], c[:-1]])
        before[starts] = known[np.searchsorted(unique, _END)]
        both = np.concatenate([[0], LEVELS])[levels[np.unique(pairs, return_inverse=True)[1]]] if bigrams else np.zeros(len(c), np.int64)
        base, own = log_probabilities(c, before, both, total, types)
        return _scores(ids, lengths, starts, c, base, own, total)

    def run(batches):
        now, row, bodies = None, None, []
        for batch in batches:
            runs, part = (batch.column(k).to_numpy() for k in range(2))
            for i in range(batch.num_rows):
                if runs[i] != now:
                    if now is not None:
                        yield scored(*row, bodies)
                    now, bodies = runs[i], []
                    row = (batch.column(3)[i].as_py(), [batch.column(k)[i].as_py() for k in (4, 5, 6)])
                else:
                    bodies.append((int(part[i]), batch.column(2)[i].as_py()))
        if now is not None:
            yield scored(*row, bodies)
        release()

    empty = [F.lit(None).cast(t).alias(n) for n, t in zip(_RUN_NAMES[1:], ("array<bigint>", "binary", "binary", "binary"), strict=True)]
    first = runs.select("run", F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("body"), *_RUN_NAMES[1:])
    whole = first.unionByName(answers.select("run", "part", "body", *empty)).repartition("run").sortWithinPartitions("run", "part")
    return whole.mapInArrow(run, _RESULT)
