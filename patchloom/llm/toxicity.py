"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, word pairs, and pairs with one or two words left
out between them, lower-cased, split at ASCII characters other than letters and digits, and
hashed to 2^20 places. Each coordinate has a learning rate of its own, which falls with the
squared gradients it has seen, and an L1 term keeps coordinates without lasting evidence at
exactly zero. So the model is a short list of places and weights, which goes to the workers
as it is; texts are scored there in Arrow batches.

Texts that are null, empty or without a word have no features and get the score of the
intercept. Without a labelled row of either kind nothing is learned and all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import store
from patchloom.llm.words import Block, blocks, mix

BITS = 20
#: (words in between, factor that tells the kinds of pairs apart)
SKIPS = ((0, 0x9E3779B97F4A7C15), (1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9))
#: At most so many labelled documents are learned from, those with the lowest hash of their id.
SAMPLE = 16_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 5.0, 0.01
TOXIC_FROM = 0.5
#: Texts are looked at in blocks of about so many bytes.
BLOCK = 1 << 18
_CODES = np.arange(256)
_WORD = ((_CODES >= 48) & (_CODES < 58)) | ((_CODES >= 97) & (_CODES < 123)) | (_CODES >= 128)


def _words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the text that it stands in."""
    inside = _WORD[block.data]
    cut = np.zeros(len(inside) + 1, bool)
    cut[block.offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    hashes = block.span_hash(block.prefix(False), starts, ends)
    return hashes, np.searchsorted(block.offsets, starts, side="right") - 1


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places of each text in order, and the text of each."""
    hashes, text = _words(block)
    found, texts = [hashes], [text]
    for between, factor in SKIPS:
        last = between + 1
        if len(hashes) > last:
            same = np.flatnonzero(text[:-last] == text[last:])
            found.append(mix(hashes[same] * np.uint64(factor) + hashes[same + last]))
            texts.append(text[same])
    places = np.concatenate(found) >> np.uint64(64 - BITS)
    keys = np.unique(np.concatenate(texts).astype(np.uint64) << np.uint64(BITS) | places)
    return (keys & np.uint64((1 << BITS) - 1)).astype(np.int64), (keys >> np.uint64(BITS)).astype(np.int64)


@dataclass
class Ftrl:
    """The learner: per coordinate the shifted gradient sum ``z`` and squared sum ``n``.

    The last coordinate is the intercept, which has no L1 term."""

    size: int
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self):
        self.z, self.n = np.zeros(self.size + 1), np.zeros(self.size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, limit = self.z[at], np.where(at == self.size, 0.0, L1)
        kept = np.sign(z) * np.maximum(np.abs(z) - limit, 0.0)
        return -kept / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def learn(self, places: np.ndarray, label: float) -> None:
        at = np.append(places, self.size)
        weights = self.weights(at)
        gradient = _sigmoid(weights.sum()) - label
        squares = self.n[at] + gradient * gradient
        self.z[at] += gradient - (np.sqrt(squares) - np.sqrt(self.n[at])) / ALPHA * weights
        self.n[at] = squares


def _sigmoid(score):
    return 1 / (1 + np.exp(-np.clip(score, -500, 500)))


@dataclass
class Model:
    """Weights that are not zero, by place; at most 2^20 of them."""

    places: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, block: Block, dense: np.ndarray) -> np.ndarray:
        # A text's weights are added one after the other, whatever else is in the block.
        places, text = features(block)
        return _sigmoid(self.intercept + np.bincount(text, dense[places], block.rows))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning; null where the id is."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, block in blocks(batch.column(2), BLOCK):
            places, text = features(block)
            bounds = np.searchsorted(text, np.arange(block.rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(places, pa.int32()))
            rows = slice(first, first + block.rows)
            yield pa.record_batch([batch.column(0)[rows], batch.column(1)[rows], lists], ["doc_id", "label", "places"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        bounds = batch.column(1).offsets.to_numpy()
        places = batch.column(1).values.to_numpy()
        rows += [(y, places[a:b].copy()) for y, a, b in zip(batch.column(0).to_pylist(), bounds[:-1], bounds[1:])]
    if not rows:
        return
    learner = Ftrl(1 << BITS)
    for _ in range(EPOCHS):
        for label, places in rows:
            learner.learn(places, label)
    every = np.arange(learner.size + 1)
    weights = learner.weights(every)
    at = np.flatnonzero(weights[:-1])
    places = np.append(at, learner.size)
    yield pa.record_batch({"place": pa.array(places, pa.int32()), "weight": pa.array(weights[places], pa.float64())})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Model of ``labels.toxic`` (0 or 1) from documents that are not held out; None if there are none.

    ``docs`` has doc_id and text. Rows with a null id or label are left out; an id that is
    labelled several times takes its largest label. The features of at most ``sample``
    documents are found in parallel and stored; the learner, which takes one example after
    the other, reads them in one task in the order of a hash of their ids.
    """
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    known = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(sample)
    # Bounded by ``sample`` rows of two numbers.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    rows = store(texts.mapInArrow(_examples, "doc_id long, label double, places array<int>"))
    order = [F.xxhash64(F.lit(19), "doc_id"), F.col("doc_id"), F.col("places")]
    one_by_one = rows.repartition(1).sortWithinPartitions(*order).select("label", "places")
    found = one_by_one.mapInArrow(_train, "place int, weight double").toPandas()
    if not len(found):
        return None
    places, weights = found["place"].to_numpy(), found["weight"].to_numpy()
    inner = places < 1 << BITS
    return Model(places[inner], weights[inner], float(weights[~inner][0]))


def _scores(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS)
        if model:
            dense[model.places] = model.weights
        for batch in batches:
            for first, block in blocks(batch.column(2), BLOCK):
                score = model.score(block, dense) if model else np.zeros(block.rows)
                rows = slice(first, first + block.rows)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0)[rows],
                        "held_out": batch.column(1)[rows],
                        "score": pa.array(score, pa.float64()),
                        "predicted": pa.array(score >= TOXIC_FROM).cast(pa.int32()),
                    }
                )

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score from 0 to 1, predicted 0 or 1.

    Only these two columns are read; repeated rows are scored each. A null id stays null,
    and so does its held_out.
    """
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(doc_id, held_out(F.col("doc_id")).alias("held_out"), F.lower("text").alias("text"))
    return rows.mapInArrow(_scores(model), "doc_id long, held_out boolean, score double, predicted int")
