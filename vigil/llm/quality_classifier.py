"""Quality scores by supervised subword embeddings.

A document's features are its words, the character n-grams of its words, its pairs of neighbouring words, and the
shapes of these pairs (length, first and last character's kind of both words, and whether they are the same word),
hashed to buckets. A document's vector is the sum of the averages of its words' and n-grams', its pairs' and its pair
shapes' learned vectors; a softmax layer gives class probabilities. Vectors and layer are trained together by stochastic gradient descent in numpy on a bounded sample
of labelled documents. As the layer is linear, a bucket has one number once trained, what it adds to the log-odds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Workspace, carried, kept_in_worker, nothing_kept, restored, text_batches, words_of

#: Labelled documents that the model is fitted on, at most.
TRAIN_DOCS = 4000
#: Buckets of words and their n-grams, of word pairs, and of pair shapes; each kind follows the one before.
BUCKETS, PAIRS, SHAPES = 1 << 15, 1 << 15, 1 << 12
STARTS, ALL = (0, BUCKETS, BUCKETS + PAIRS), BUCKETS + PAIRS + SHAPES
DIM, GRAMS = 12, (2, 3, 4)
EPOCHS, BATCH, RATE = 6, 32, 0.35
#: A document is predicted good from this score on.
LEAST = 0.3
#: A worker forgets its words beyond this many; it takes so many new ones at a time.
MOST_WORDS, WORDS_AT_ONCE = 200_000, 10_000


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: the crc32 of its id as text is divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _kinds() -> np.ndarray:
    """A number for each byte's kind: upper case, lower case, digit, mark, beyond ASCII."""
    byte = np.arange(256)
    return np.select([(byte >= 65) & (byte <= 90), (byte >= 97) & (byte <= 122), (byte >= 48) & (byte <= 57), byte < 128], [0, 1, 2, 3], 4).astype(np.uint64)


KIND = _kinds()


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all words' features, one word after the other, the number of each word's, and each word's hash
    and shape."""
    framed = [b"<" + w + b">" for w in words]
    sizes = np.fromiter(map(len, framed), np.int64, len(framed))
    raw = np.frombuffer(b"".join(framed), np.uint8).astype(np.uint64)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    inside = np.arange(len(raw)) - first[owner]
    mixed = (raw + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    # a word's own feature is a sum over its places, so that it needs no pass of its own
    place = (mixed ^ (mixed >> np.uint64(29))) * (np.uint64(2) * inside.astype(np.uint64) + np.uint64(0xBF58476D1CE4E5B9))
    whole = np.add.reduceat(place ^ (place >> np.uint64(31)), first) if len(words) else np.zeros(0, np.uint64)
    values, owners = [whole], [np.arange(len(words))]
    for n in GRAMS:
        at = np.flatnonzero(inside + n <= sizes[owner])
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ raw[at + k]) * np.uint64(0x100000001B3) + np.uint64(0xCBF29CE4)
        values.append(h)
        owners.append(owner[at])
    owners = np.concatenate(owners)
    buckets = (_mix(np.concatenate(values)) % np.uint64(BUCKETS)).astype(np.int32)
    by = np.argsort(owners, kind="stable")
    raw = raw.astype(np.uint8)
    shape = (np.minimum(sizes - 2, 8).astype(np.uint64) * np.uint64(5) + KIND[raw[first + 1]]) * np.uint64(5) + KIND[raw[first + sizes - 2]]
    return buckets[by], np.bincount(owners, minlength=len(words)), _mix(whole), shape


def pair_buckets(hashes: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words in their order, the bucket of each pair of neighbours and of its shape."""
    same = (hashes[1:] == hashes[:-1]).astype(np.uint64)
    pair = _mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    shape = _mix(((shapes[:-1] * np.uint64(1024) + shapes[1:]) * np.uint64(2) + same) * np.uint64(0xD6E8FEB86659FD93))
    return STARTS[1] + (pair % np.uint64(PAIRS)).astype(np.int32), STARTS[2] + (shape % np.uint64(SHAPES)).astype(np.int32)


def count_features(docs: DataFrame) -> DataFrame:
    """(quality, buckets, counts) of labelled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        for rows in text_batches(batches, "text"):
            found = [counted(text or b"") for text in rows.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({"quality": rows.column("quality"), "buckets": pa.array([b.tobytes() for b, _ in found], pa.binary()), "counts": pa.array([c.tobytes() for _, c in found], pa.binary())})

    return docs.select("text", "quality").mapInArrow(run, "quality int, buckets binary, counts binary")


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's features in order, and how often each occurs."""
    codes, words = pd.factorize(np.array(text.split() + [None], object)[:-1])
    found, sizes, hashes, shapes = word_features(list(words))
    summed = np.bincount(found, np.repeat(np.bincount(codes, minlength=len(words)), sizes), ALL)
    for buckets in pair_buckets(hashes[codes], shapes[codes]):
        summed += np.bincount(buckets, minlength=ALL)
    some = np.flatnonzero(summed)
    return some.astype(np.int32), summed[some].astype(np.float32)


def shares(buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each feature's share of its kind, so that each kind is averaged apart."""
    kind = np.searchsorted(STARTS, buckets, side="right") - 1
    return (counts / np.bincount(kind, counts, len(STARTS))[kind]).astype(np.float32)


def train(docs: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> tuple[np.ndarray, float]:
    """Each bucket's addition to the log-odds of class 1, and the log-odds of a document without features."""
    rng = np.random.default_rng(seed)
    labels = np.array([q for q, _, _ in docs], np.int64)
    prior = (labels.sum() + 1) / (len(labels) + 2)
    if not len(docs) or len(set(labels.tolist())) < 2:
        return np.zeros(ALL, np.float32), float(np.log(prior / (1 - prior)))
    found = [(b, shares(b, c)) for _, b, c in docs]
    vectors = rng.normal(0, 1 / DIM, (ALL, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.log(np.array([1 - prior, prior], np.float32))
    squares, layer_squares = np.full(ALL, 1e-6, np.float32), np.float32(1e-6)
    # classes weigh alike while vectors are learned; the score is set back to the classes' shares below
    weight = np.where(labels == 1, 0.5 / prior, 0.5 / (1 - prior)).astype(np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for some in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // BATCH)):
            b = np.concatenate([found[i][0] for i in some])
            s = np.concatenate([found[i][1] for i in some])
            sizes = np.array([len(found[i][0]) for i in some])
            if not len(b):
                continue
            filled = np.flatnonzero(sizes)
            mean = np.zeros((len(some), DIM), np.float32)
            mean[filled] = np.add.reduceat(vectors[b] * s[:, None], (np.cumsum(sizes) - sizes)[filled])
            scores = mean @ layer.T + bias
            chance = np.exp(scores - scores.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            wrong = (chance - np.eye(2, dtype=np.float32)[labels[some]]) * weight[some, None] / len(some)
            back = (wrong @ layer).repeat(sizes, 0) * s[:, None]
            touched, place = np.unique(b, return_inverse=True)
            step = np.stack([np.bincount(place, back[:, d], len(touched)) for d in range(DIM)], 1).astype(np.float32)
            slope = wrong.T @ mean
            squares[touched] += (step**2).mean(1)
            layer_squares += (slope**2).mean()
            vectors[touched] -= rate * step / np.sqrt(squares[touched])[:, None]
            layer -= rate * slope / np.sqrt(layer_squares)
    part = vectors @ (layer[1] - layer[0])
    # the offset that gives the training documents' mean score, under their true shares, the share of class 1
    odds = np.array([float(s @ part[b]) if len(b) else 0.0 for b, s in found])
    low, high = -50.0, 50.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (1 / (1 + np.exp(-np.clip(odds + middle, -50, 50)))).mean() < prior else (low, middle)
    return part.astype(np.float32), float(low)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Train on at most TRAIN_DOCS labelled ids, those of the smallest hash; held-out ids are never read.

    Labels other than 0 and 1 and null ids are left out; of an id's labels the smallest counts, of its texts that of
    the smallest hash.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    labelled = texts.join(F.broadcast(chosen), "doc_id")  # at most TRAIN_DOCS ids
    work = Workspace(docs.sparkSession)
    one = labelled.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = work.table(count_features(one), "features")
    found = [(r.quality, np.frombuffer(r.buckets, np.int32), np.frombuffer(r.counts, np.float32)) for r in rows.toLocalIterator()]
    work.close()
    found.sort(key=lambda x: (x[0], len(x[1]), zlib.crc32(x[1]), zlib.crc32(x[2])))
    model = train(found)
    del found
    nothing_kept()  # the driver needs its memory for other stages
    return model


class Words:
    """What a worker keeps of the words it has met: their features' sum and number, their hash and shape."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.sums, self.sizes = np.zeros(0), np.zeros(0, np.int64)
        self.hashes, self.shapes = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def numbers(self, names: list[bytes]) -> np.ndarray:
        if len(self.number) > MOST_WORDS:
            self._forget()
        new = [w for w in names if w not in self.number]
        for k in range(0, len(new), WORDS_AT_ONCE):
            some = new[k : k + WORDS_AT_ONCE]
            buckets, sizes, hashes, shapes = word_features(some)
            sums = np.add.reduceat(self.values[buckets], np.cumsum(sizes) - sizes)
            self.number.update(zip(some, range(len(self.number), len(self.number) + len(some)), strict=True))
            self.sums, self.sizes = np.append(self.sums, sums), np.append(self.sizes, sizes)
            self.hashes, self.shapes = np.append(self.hashes, hashes), np.append(self.shapes, shapes)
        return np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))

    def log_odds(self, texts: pa.Array) -> np.ndarray:
        """What the features of each text add to the log-odds of class 1."""
        codes, names, counts = words_of(texts)
        word = self.numbers(names)[codes]
        owner, n = np.repeat(np.arange(len(counts)), counts), len(counts)
        out = np.bincount(owner, self.sums[word], n) / np.maximum(1, np.bincount(owner, self.sizes[word], n))
        inside = owner[1:] == owner[:-1]
        pairs = np.maximum(1, np.bincount(owner[1:][inside], minlength=n))
        for buckets in pair_buckets(self.hashes[word], self.shapes[word]):
            out += np.bincount(owner[1:][inside], self.values[buckets[inside]], n) / pairs
        return out


def score(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text; a text without words scores as the model's offset."""
    part, offset = model
    tag = hash((part.tobytes(), offset))
    shared = docs.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept_in_worker(("quality", tag), lambda: Words(shared.value.astype(np.float64)))
        for rows in text_batches(batches, "text"):
            chance = 1 / (1 + np.exp(-np.clip(words.log_odds(rows.column("text")) + offset, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(chance)], [*kept, name])

    kept = [c for c in docs.columns if c != name]
    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """Per document: whether its id is held out, its score and the class that it predicts.

    Null and empty texts get the offset's score. Very long texts are scored whole, in batches of their own. A null id
    is not held out and never trained on. Repeated rows score alike. Empty documents or labels are no error: without
    both classes all score the share of class 1. Extra columns are ignored.
    """
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``least``, with their columns.

    Null and empty texts, very long texts, null ids and repeated rows are scored as in ``classify``; an empty table
    gives no rows. Columns are carried under numbers, so their names can't clash.
    """
    return restored(score(carried(docs, text=F.col("text")), fit(docs, labels)).where(F.col("score") >= least), docs)
