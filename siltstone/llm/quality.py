"""Quality rules: fixed rules, and a calibrated logistic regression over hashed word and character n-grams.

Each text's word 1- and 2-grams and character 3- and 4-grams (UTF-8 bytes) are hashed to buckets; their shares of the
text are the features, so a text's score is a mean of bucket weights and needs no vector at scoring time.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.boosting import platt
from siltstone.llm.common import map_rows, release, spaced_words
from siltstone.session import Scratch

#: Buckets of each family of n-grams, and labelled rows to train on, at most: those with the smallest hash of doc_id.
BUCKETS, TRAIN_ROWS = 1024, 4000
#: A text is rejected below this calibrated probability of good quality.
THRESHOLD = 0.5
#: Symbols that are counted; fewest words; most words in repeated windows, of 100.
SYMBOLS, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 50, 50
WINDOW = 3

_STEP = np.uint32(2654435761)


def signals(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = spaced_words(text)
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(" \t\n\r\x0b\x0c")]
    repeated = 0
    if len(words) > WINDOW:
        ids: dict[bytes, int] = {}
        number = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        n = len(words) - WINDOW + 1
        # Windows are numbered pair by pair, so equal numbers are equal windows.
        key = number[:n]
        for i in range(1, WINDOW):
            key = np.unique(key * len(ids) + number[i : i + n], return_inverse=True)[1]
        again = np.flatnonzero(np.bincount(key)[key] > 1)
        if len(again):
            hit = np.zeros(len(words) + 1, np.int64)
            np.add.at(hit, again, 1)
            np.add.at(hit, again + WINDOW, -1)
            repeated = int((np.cumsum(hit) > 0).sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def buckets(text: str | None) -> list[np.ndarray]:
    """The bucket of every n-gram of a whole text, by family."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    one = np.fromiter(map(crc32, words), np.uint32, len(words))
    two = (one[:-1] * _STEP) ^ one[1:]
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    grams = []
    for width in (3, 4):
        h = np.zeros(max(0, len(a) - width + 1), np.uint32)
        for i in range(width):
            h = (h ^ a[i : i + len(h)]) * _STEP
        grams.append(h)
    size = np.uint32(BUCKETS)
    return [((h ^ (h >> np.uint32(15))) * _STEP >> np.uint32(7)) % size for h in (one, two, *grams)]


def shares(text: str | None) -> np.ndarray:
    """The feature vector: each bucket's share of its family."""
    parts = [np.bincount(b, minlength=BUCKETS) / max(1, len(b)) for b in buckets(text)]
    return np.concatenate(parts).astype(np.float32)


class Classifier:
    """Weights by family, a bias, and the calibration."""

    def __init__(self, weights: np.ndarray, bias: float, scale: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.scale, self.shift = weights.reshape(-1, BUCKETS), bias, scale, shift

    def raw(self, text: str | None) -> float:
        means = (float(w[b].mean()) if len(b) else 0.0 for w, b in zip(self.weights, buckets(text), strict=True))
        return self.bias + sum(means)

    def probability(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.raw(text) + self.shift, -40, 40))))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 150) -> Classifier:
    """Logistic regression by accelerated gradient steps; every fifth row calibrates it. Scales `x` in place.

    Without rows of both qualities there is nothing to tell apart, and every text is good. Where the rows to fit or to
    calibrate on would lack one of them, all rows do both.
    """
    y = np.asarray(y, np.float64)
    if len(set(y)) < 2:
        return Classifier(np.zeros(x.shape[1]), 20.0)
    held = np.arange(len(y)) % 5 == 4
    fitted = ~held
    if len(set(y[held])) < 2 or len(set(y[fitted])) < 2:
        held = fitted = np.ones(len(y), bool)
    n = x.shape[1]
    middle = x.mean(axis=0, dtype=np.float64)
    # Some rows at a time, as a copy in double precision would be twice as large as the matrix.
    spread = sum((np.square(x[at : at + 256] - middle).sum(axis=0) for at in range(0, len(x), 256)), np.zeros(n))
    scale = np.sqrt(spread / len(x)) + 1e-5
    # In place: the matrix is the largest thing that the driver holds.
    x -= middle.astype(np.float32)
    x /= (scale * np.sqrt(n)).astype(np.float32)
    most = np.float32(5 / np.sqrt(n))
    np.clip(x, -most, most, out=x)
    # Both classes weigh the same; the calibration brings the real share back. Rows that are held out weigh nothing.
    share = y[fitted].mean()
    balance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) * fitted / fitted.sum()
    w, b = np.zeros(n, np.float32), 0.0
    ahead_w, ahead_b = w, b
    rate = 4.0
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead_w + ahead_b, -40, 40)))
        g = ((p - y) * balance).astype(np.float32)
        next_w = ahead_w - np.float32(rate) * (x.T @ g + np.float32(ridge) * ahead_w)
        next_b = ahead_b - rate * float(g.sum())
        speed = k / (k + 3)
        ahead_w, ahead_b = next_w + np.float32(speed) * (next_w - w), next_b + speed * (next_b - b)
        w, b = next_w, next_b
    unit = w / (scale * np.sqrt(n))
    made = Classifier(unit, float(b - (unit * middle).sum()))
    made.scale, made.shift = platt((x[held] @ w + b).astype(np.float64), y[held])
    return made


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Classifier:
    """Fit on at most `rows` labelled documents; without labels of both qualities every text is good.

    Labels without a doc_id, with a quality other than 0 and 1 or of documents that are not there are left out; rows that
    repeat count once.
    """
    chosen = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", F.col("quality").alias("good"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "good").limit(rows)
    # At most `rows` rows of two numbers: small at any size of the input.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL")

    def make():
        def each(cols):
            found = [shares(t) for t in cols["text"]]
            at = [np.flatnonzero(v) for v in found]
            return {
                "doc_id": cols["doc_id"],
                "good": cols["good"],
                "places": [a.astype(np.int16).tobytes() for a in at],
                "values": [v[a].astype(np.float16).tobytes() for v, a in zip(found, at, strict=True)],
            }

        return each

    made = map_rows(texts, "doc_id long, good int, places binary, values binary", make, rows=64)
    made = made.withColumn("mark", F.xxhash64("places", "values")).dropDuplicates(["doc_id", "good", "mark"])
    made = Scratch(docs.sparkSession, "quality").keep(made)
    # First the order of the rows, then the rows themselves, a partition at a time, into the matrix.
    order = [F.xxhash64("doc_id"), "doc_id", "mark", "good"]
    chosen = made.orderBy(*order).limit(rows).select("doc_id", "mark", "good").collect()
    place = {tuple(r): k for k, r in enumerate(chosen)}
    x, y = np.zeros((len(place), 4 * BUCKETS), np.float32), np.zeros(len(place))
    for row in made.toLocalIterator():
        k = place.get((row["doc_id"], row["mark"], row["good"]))
        if k is not None:
            x[k, np.frombuffer(row["places"], np.int16)] = np.frombuffer(row["values"], np.float16)
            y[k] = row["good"]
    model = fit(x, y)
    del x
    release()
    return model


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    probability, kept.

    A null or empty text has no words and fails the base. A document fails it with fewer than 50 words or with more
    than half of its words in 3-word windows that stand twice or more; what fails it is not kept whatever its
    probability. Repeated rows give equal rows; other columns of either table are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def make():
        model = shared.value

        def each(cols):
            counted = [signals(t) for t in cols["text"]]
            failed = [n < LEAST_WORDS or 100 * r > MOST_REPEATED * n for n, _, _, _, r in counted]
            p = [0.0 if not n else model.probability(t) for t, (n, *_) in zip(cols["text"], counted, strict=True)]
            out = {name: [c[i] for c in counted] for i, name in enumerate(names)}
            kept = [not f and q >= threshold for f, q in zip(failed, p, strict=True)]
            return out | {"doc_id": cols["doc_id"], "base_failed": failed, "probability": p, "kept": kept}

        return each

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, probability double, kept boolean"
    return map_rows(docs.select("doc_id", "text"), schema, make)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with all their columns, whatever their names and types.

    Each row is judged by its own whole text, whatever its doc_id. Null and empty texts go; repeated rows stay or go
    together; an empty table stays empty, and without labels of both qualities the fixed rules alone decide.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column("text")
            kept = []
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                n, _, _, _, r = signals(text)
                good = n >= LEAST_WORDS and 100 * r <= MOST_REPEATED * n and model.probability(text) >= threshold
                kept.append(good)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
