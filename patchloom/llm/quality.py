"""Quality rules: counts per text, and a calibrated logistic regression over hashed n-grams.

Features are words, word pairs and runs of 3 and 5 bytes, hashed to 2^15 places; each of
the four groups adds up to one per text, so long texts weigh as much as short ones. The
regression is trained on labelled documents and its score turned into a probability on
others of them (Platt's method). Texts are scored in Arrow batches with fixed thresholds;
a text's score does not depend on the batch it comes in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import store
from patchloom.llm.words import SPACE, Block, blocks, mix, windows

BITS = 15
#: At most so many labelled documents are used, those with the lowest hash of their id;
#: three quarters train the regression, the rest calibrates it.
SAMPLE = 3_000
#: A document is kept if the probability of good quality is at least this.
KEEP_FROM = 0.5
#: L2 penalty and most steps of the fit.
PENALTY, STEPS = 1e-4, 25
LEAST_WORDS = 50
#: Texts are looked at in blocks of about so many bytes.
BLOCK = 1 << 18
#: Fixed value: the characters counted as symbols.
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
GROUPS = 4


def _features(block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each feature group: its number, places, and the bounds of each text's places."""
    shift = np.uint64(64 - BITS)
    starts, ends, bounds = block.words()
    hashes = block.span_hash(block.prefix(True), starts, ends)
    for group, size in ((0, 1), (1, 2)):
        runs, at = (hashes, bounds) if size == 1 else windows(hashes, bounds, size)
        yield group, (mix(runs + np.uint64(group)) >> shift).astype(np.int32), at
    small = block.data.astype(np.uint64)
    small[(small >= 65) & (small <= 90)] += np.uint64(32)
    for group, size in ((2, 3), (3, 5)):
        # Every run of bytes inside one text, as a number; shorter texts have none.
        lengths = np.maximum(np.diff(block.offsets) - size + 1, 0)
        at = np.concatenate([[0], np.cumsum(lengths)])
        first = np.repeat(block.offsets[:-1] - at[:-1], lengths) + np.arange(at[-1])
        runs = np.zeros(len(first), np.uint64)
        for k in range(size):
            runs = runs << np.uint64(8) | small[first + k]
        yield group, (mix(runs + np.uint64(group << 40)) >> shift).astype(np.int32), at


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, block in blocks(batch.column(2), BLOCK):
            places = [[] for _ in range(block.rows)]
            values = [[] for _ in range(block.rows)]
            for group, found, at in _features(block):
                for i in range(block.rows):
                    own, times = np.unique(found[at[i] : at[i + 1]], return_counts=True)
                    places[i].append(own + (group << BITS))
                    values[i].append((times / max(1, at[i + 1] - at[i])).astype(np.float32))
            rows = slice(first, first + block.rows)
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0)[rows],
                    "label": batch.column(1)[rows],
                    "places": pa.array([np.concatenate(p) for p in places], pa.list_(pa.int32())),
                    "values": pa.array([np.concatenate(v) for v in values], pa.list_(pa.float32())),
                }
            )


class Rows:
    """Sparse rows of a training set, one after the other in flat arrays."""

    def __init__(self, rows: list[tuple[float, np.ndarray, np.ndarray]]):
        self.labels = np.array([y for y, _, _ in rows])
        self.places = np.concatenate([p for _, p, _ in rows])
        self.values = np.concatenate([v for _, _, v in rows])
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(p) for _, p, _ in rows])

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.places] * self.values, len(self.labels)) + weights[-1]

    def loss(self, weights: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
        """Mean log loss with an L2 penalty on all but the intercept, and its gradient."""
        scores, sign = self.scores(weights), 2 * self.labels - 1
        off = -sign / (1 + np.exp(np.clip(sign * scores, -500, 500))) / len(scores)
        gradient = np.append(np.bincount(self.places, off[self.row] * self.values, len(weights) - 1), off.sum())
        inner = np.append(weights[:-1], 0.0)
        value = np.logaddexp(0, -sign * scores).mean() + penalty / 2 * (inner @ inner)
        return value, gradient + penalty * inner


def regression(rows: Rows, size: int, penalty: float = PENALTY, steps: int = STEPS, kept: int = 8) -> np.ndarray:
    """Weights and, last, the intercept that minimise :meth:`Rows.loss`: limited-memory BFGS."""
    weights = np.zeros(size + 1)
    share = np.clip(rows.labels.mean(), 1e-6, 1 - 1e-6)
    weights[-1] = np.log(share / (1 - share))
    value, gradient = rows.loss(weights, penalty)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, alphas = gradient.copy(), []
        for moved, changed in reversed(pairs):
            alphas.append((moved @ direction) / (changed @ moved))
            direction -= alphas[-1] * changed
        if pairs:
            moved, changed = pairs[-1]
            direction *= (moved @ changed) / (changed @ changed)
        for (moved, changed), alpha in zip(pairs, reversed(alphas)):
            direction += (alpha - (changed @ direction) / (changed @ moved)) * moved
        slope, step = gradient @ direction, 1.0 if pairs else 1 / max(1e-12, np.abs(gradient).sum())
        while True:
            to = weights - step * direction
            new_value, new_gradient = rows.loss(to, penalty)
            if new_value <= value - 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        moved, changed = to - weights, new_gradient - gradient
        if moved @ changed > 1e-16:
            pairs = [*pairs[1 - kept :], (moved, changed)]
        done = abs(value - new_value) <= 1e-7 * max(1.0, abs(value))
        weights, value, gradient = to, new_value, new_gradient
        if done:
            break
    return weights


def calibration(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make ``slope * score + offset`` the log odds of a label (Platt)."""
    rows = Rows([(y, np.zeros(1, np.int32), np.array([s])) for y, s in zip(labels, scores)])
    slope, offset = regression(rows, 1, penalty=0.0, steps=100)
    return float(slope), float(offset)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights by place; after them the intercept, slope and offset. None without both labels."""
    parts: dict[bool, list] = {True: [], False: []}
    for batch in batches:
        bounds = batch.column(2).offsets.to_numpy()
        places, values = (batch.column(k).values.to_numpy() for k in (2, 3))
        flags, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, (held, label) in enumerate(zip(flags, labels)):
            own = slice(bounds[i], bounds[i + 1])
            parts[held].append((label, places[own].copy(), values[own].copy()))
    if len({label for label, _, _ in parts[False]}) < 2:
        return
    size = GROUPS << BITS
    weights = regression(Rows(parts[False]), size)
    slope, offset = 1.0, 0.0
    if len({label for label, _, _ in parts[True]}) == 2:
        held = Rows(parts[True])
        slope, offset = calibration(held.scores(weights), held.labels)
    at = np.flatnonzero(weights[:-1])
    places = np.concatenate([at, size + np.arange(3)])
    found = np.concatenate([weights[at], [weights[-1], slope, offset]])
    yield pa.record_batch({"place": pa.array(places, pa.int32()), "weight": pa.array(found, pa.float64())})


@dataclass
class Model:
    """Weights by group and place; probability = 1 / (1 + exp(-(slope · score + offset)))."""

    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    offset: float = 0.0

    def score(self, block: Block) -> np.ndarray:
        total = np.full(block.rows, self.intercept)
        for group, found, at in _features(block):
            text = np.repeat(np.arange(block.rows), np.diff(at))
            sums = np.bincount(text, self.weights[group][found], block.rows)
            total += sums / np.maximum(np.diff(at), 1)
        return total

    def probability(self, block: Block) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.score(block) + self.offset)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Model of ``labels.quality`` (0 or 1); None if the labels are not of both kinds.

    ``docs`` has doc_id and text. Rows with a null id, text or label are left out; an id
    that is labelled several times takes its smallest label.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(sample)
    # Bounded by ``sample`` rows of two numbers.
    texts = docs.where("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    rows = store(texts.mapInArrow(_vectors, "doc_id long, label double, places array<int>, values array<float>"))
    held = (F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(4)) == 0).alias("held")
    order = [F.xxhash64(F.lit(11), "doc_id"), F.col("doc_id"), F.col("places")]
    # At most ``sample`` sparse rows: one task fits them.
    one = rows.repartition(1).sortWithinPartitions(*order).select(held, "label", "places", "values")
    found = one.mapInArrow(_train, "place int, weight double").toPandas()
    if not len(found):
        return None
    size = GROUPS << BITS
    dense = np.zeros(size + 3)
    dense[found["place"].to_numpy()] = found["weight"].to_numpy()
    intercept, slope, offset = dense[size:].tolist()
    return Model(dense[:size].reshape(GROUPS, 1 << BITS).astype(np.float32), intercept, slope, offset)


def _counts(text: pa.Array, row: int) -> int:
    """Lines with a word that are equal to an earlier line."""
    seen, again = set(), 0
    for line in (text[row].as_py() or "").split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            again += line in seen
            seen.add(line)
    return again


def _repeated_words(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text, words in runs of three words that the text has more than once."""
    lengths = np.diff(bounds)
    text = np.repeat(np.arange(len(lengths)), lengths)
    if len(hashes) < 3:
        return np.zeros(len(lengths), np.int64)
    runs = np.zeros(len(hashes) - 2, np.uint64)
    for k in range(3):
        runs = mix(runs * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + len(runs)])
    whole = np.flatnonzero(text[:-2] == text[2:])
    keys = mix(runs[whole] + text[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    again = whole[times[which] > 1]
    marked = np.zeros(len(hashes), bool)
    for k in range(3):
        marked[again + k] = True
    return np.bincount(text[marked], minlength=len(lengths))


def _rules(model: Model | None, keep_from: float, least_words: int, text_col: str, returned: list[str], only_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col)
            for first, block in blocks(texts, BLOCK):
                starts, ends, bounds = block.words()
                n_words = np.diff(bounds)
                points = ~SPACE[block.data] & ((block.data & 0xC0) != 0x80)

                def per_text(flags: np.ndarray, block: Block = block) -> np.ndarray:
                    sums = np.concatenate([[0], np.cumsum(flags)])
                    return np.diff(sums[block.offsets])

                repeated = _repeated_words(block.span_hash(block.prefix(False), starts, ends), bounds)
                failed = (n_words < least_words) | (100 * repeated > 50 * n_words)
                good = model.probability(block) if model else np.ones(block.rows)
                part = batch.slice(first, block.rows)
                columns = {n: part.column(n) for n in returned}
                judged = pa.record_batch(
                    columns
                    | {
                        "n_words": pa.array(n_words, pa.int64()),
                        "word_chars": pa.array(per_text(points), pa.int64()),
                        "n_symbols": pa.array(per_text(SYMBOLS[block.data]), pa.int64()),
                        "n_dup_lines": pa.array([_counts(texts, first + i) for i in range(block.rows)], pa.int64()),
                        "n_repeat_words": pa.array(repeated, pa.int64()),
                        "base_failed": pa.array(failed),
                        "good": pa.array(good, pa.float64()),
                        "kept": pa.array(~failed & (good >= keep_from)),
                    }
                )
                yield judged.filter(judged.column("kept")) if only_kept else judged

    return run


ADDED = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, good double, kept boolean"
)


def judge(
    docs: DataFrame, model: Model | None, text_col: str = "text",
    keep_from: float = KEEP_FROM, least_words: int = LEAST_WORDS, with_text: bool = True,
    only_kept: bool = False,
) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, the probability ``good`` and ``kept``.

    A null text has no words and fails. Without a model only the counts decide. Columns
    that have the name of an added one are replaced; no row is moved. ``with_text=False``
    leaves the text column out of the result, so that texts are not sent back;
    ``only_kept=True`` sends back the rows that are kept.
    """
    added = {part.split()[0] for part in ADDED.split(", ")}
    kept = [f for f in docs.schema if f.name not in added and (with_text or f.name != text_col)]
    rows = docs.select(*(F.col(f"`{f.name}`") for f in docs.schema if f.name not in added or f.name == text_col))
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    run = _rules(model, keep_from, least_words, text_col, [f.name for f in kept], only_kept)
    return rows.mapInArrow(run, ", ".join([*types, ADDED]))
