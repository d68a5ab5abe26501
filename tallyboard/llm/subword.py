r"""Quality classifier on learned subword embeddings.

A text's features are its words, whether each is the one before it again, and the 3- to 5-grams of
its bytes, hashed to a fixed number of buckets. Each bucket has a learned vector; a text is the mean over the kinds of feature of the mean of
their vectors, and a softmax layer over it gives the class. Both are learned together by stochastic gradient descent in
numpy, from a bounded sample of labelled documents.

Since the layer is linear in the mean, a bucket's vector and the layer fold into one number per
bucket, and scoring a text is the mean of those over its features: exact, and one table look-up each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.llm import ship
from tallyboard.llm.sample import bounded_sample
from tallyboard.llm.words import SPACED, Words, chunks, mix

LOG_BUCKETS = 16
_BUCKETS = 1 << LOG_BUCKETS
_SIZES = (3, 4, 5)
_KINDS = 2 + len(_SIZES)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - LOG_BUCKETS)).astype(np.int32)


def feature_buckets(data: np.ndarray, offsets: np.ndarray):
    """Pairs (bounds, buckets): buckets of all features of one kind, text i's from bounds[i] on."""
    words = Words(data, offsets, SPACED, lower=False)
    hashes = words.hashes() if len(words) else np.zeros(0, np.uint64)
    yield words.first, _bucket(hashes)
    # Word pairs have a bucket for a word said again and one for a new word, whatever the words are.
    pair = np.zeros(len(hashes), dtype=np.int32)
    pair[1:] = hashes[1:] == hashes[:-1]
    pair[words.first[:-1][np.diff(words.first) > 0]] = 0
    yield words.first, pair
    wide = data.astype(np.uint64)
    for size in _SIZES:
        n = len(wide) - size + 1
        h = np.full(max(n, 0), size, dtype=np.uint64)
        for j in range(size):
            h = h * np.uint64(0x100000001B3) + wide[j : j + len(h)]
        buckets = _bucket(mix(h))
        # The last size - 1 bytes of a text begin no n-gram of it.
        starts = np.minimum(offsets[:-1], len(buckets))
        ends = np.maximum(starts, np.minimum(offsets[1:] - size + 1, len(buckets)))
        keep = np.zeros(len(buckets) + 1, dtype=np.int8)
        np.add.at(keep, starts, 1)
        np.add.at(keep, ends, -1)
        inside = np.cumsum(keep[:-1], dtype=np.int8) > 0
        yield np.concatenate([[0], np.cumsum(ends - starts)]), buckets[inside]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i, by itself: neighbours don't enter."""
    out = np.zeros(len(bounds) - 1)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], dtype=np.float64)
    return out


def score_column(folded: np.ndarray, bias: float, column: pa.Array) -> np.ndarray:
    """Probability of class 1 of each text; `folded` is what one feature adds to its log odds."""
    out = []
    for _, _, data, offsets in chunks(column):
        total = np.zeros(len(offsets) - 1)
        for bounds, buckets in feature_buckets(data, offsets):
            total += _sums(folded[buckets], bounds) / np.maximum(np.diff(bounds), 1)
        out.append(1 / (1 + np.exp(-np.clip(total / _KINDS + bias, -500, 500))))
    return np.concatenate(out) if out else np.zeros(0)


def sparse_features(docs: DataFrame) -> DataFrame:
    """label, buckets, shares: each text's distinct buckets of each kind and their weights in the mean."""

    def count(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            kept, shares, lengths = [], [], []
            for _, _, data, offsets in chunks(batch.column(1)):
                kinds = list(feature_buckets(data, offsets))
                for i in range(len(offsets) - 1):
                    length = 0
                    for bounds, b in kinds:
                        mine = b[bounds[i] : bounds[i + 1]]
                        values, n = np.unique(mine, return_counts=True)
                        kept.append(values)
                        shares.append((n / max(1, len(mine)) / _KINDS).astype(np.float32))
                        length += len(values)
                    lengths.append(length)
            bounds = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(kept), pa.int32())),
                    pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(shares), pa.float32())),
                ],
                ["label", "buckets", "shares"],
            )

    return docs.mapInArrow(count, "label int, buckets array<int>, shares array<float>")


def fit(
    rows: list[tuple[int, np.ndarray, np.ndarray]], width: int = 8, epochs: int = 10, rate: float = 0.5, seed: int = 1
):
    """(folded, bias) from (label, buckets, shares) rows, by AdaGrad steps over small batches.

    Without rows of both classes every text scores next to 1 or 0, as those rows do, or 0.5 without rows.
    """
    labels = np.array([r[0] for r in rows], dtype=int)
    if len(set(labels.tolist())) < 2:
        return np.zeros(_BUCKETS, np.float32), (0.0 if not len(rows) else 20.0 * (2 * labels[0] - 1))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / width, 1 / width, (_BUCKETS, width)).astype(np.float32)
    layer = rng.uniform(-1 / width, 1 / width, (width, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen = np.full((_BUCKETS, 1), 1e-8, np.float32)
    seen_layer = np.full(layer.shape, 1e-8, np.float32)
    seen_bias = np.full(2, 1e-8, np.float32)
    size = 64
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for begun in range(0, len(order), size):
            picked = [rows[i] for i in order[begun : begun + size]]
            buckets = np.concatenate([r[1] for r in picked])
            shares = np.concatenate([r[2] for r in picked])
            owner = np.repeat(np.arange(len(picked)), [len(r[1]) for r in picked])
            bounds = np.concatenate([[0], np.cumsum([len(r[1]) for r in picked])])
            mean = np.zeros((len(picked), width), np.float32)
            full = np.flatnonzero(np.diff(bounds) > 0)
            if len(full):
                mean[full] = np.add.reduceat(vectors[buckets] * shares[:, None], bounds[full], axis=0)
            logits = mean @ layer + bias
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            y = np.array([r[0] for r in picked])
            chance[np.arange(len(y)), y] -= 1
            error = (chance / len(picked)).astype(np.float32)
            back = error @ layer.T
            step_layer, step_bias = mean.T @ error, error.sum(axis=0)
            seen_layer += step_layer**2
            seen_bias += step_bias**2
            layer -= rate * step_layer / np.sqrt(seen_layer)
            bias -= rate * step_bias / np.sqrt(seen_bias)
            step = np.empty_like(vectors)
            for j in range(width):
                step[:, j] = np.bincount(buckets, back[owner, j] * shares, _BUCKETS)
            seen += (step**2).mean(axis=1, keepdims=True)
            vectors -= rate * step / np.sqrt(seen)
    # A bucket that no row has still holds its random start; it says nothing about a text.
    known = np.zeros(_BUCKETS, dtype=bool)
    for _, buckets, _ in rows:
        known[buckets] = True
    folded = np.where(known, vectors @ (layer[:, 1] - layer[:, 0]), 0).astype(np.float32)
    return folded, float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, sample: int = 2000):
    """Model from at most `sample` labelled rows, those with the smallest hash of doc_id.

    Only rows with crc32(doc_id as text) mod 3 other than 1 are learned from. Rows without a label or
    text don't count; of a doc_id's labels one is taken, the largest.
    """
    ship(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("_label"))
    known = known.where(~held_out(F.col("doc_id")))
    known = bounded_sample(known, F.xxhash64("doc_id"), sample)
    known = known.withColumnRenamed("doc_id", "_doc")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    taught = texts.join(F.broadcast(known), texts["doc_id"] == known["_doc"]).select("_label", "text", "_doc")
    # Several rows may share a doc_id, so the bound is set once more.
    taught = taught.orderBy(F.xxhash64("_doc", "text"), "_label").limit(sample)
    found = sparse_features(taught.select("_label", "text")).toArrow()
    rows = [
        (label, np.asarray(b.values), np.asarray(s.values))
        for label, b, s in zip(found["label"].to_pylist(), found["buckets"], found["shares"])
    ]
    return fit(rows)


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; one row out for each row in.

    Null text is empty; an empty text scores what the class bias gives. Only the text enters a score.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        folded, bias = sent.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(score_column(folded, bias, batch.column(2)))], ["doc_id", "held_out", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = 2000) -> DataFrame:
    """The rows of `docs` that the classifier predicts as class 1, with all their columns."""
    model = train(docs, labels, sample)
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    names = docs.columns
    place = names.index("text")

    def keep(batches):
        folded, bias = sent.value
        for batch in batches:
            yield batch.filter(pa.array(score_column(folded, bias, batch.column(place)) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
