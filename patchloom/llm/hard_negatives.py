"""Hard-negative mining: the best rows of other labels under each positive's score.

All upper limits of an anchor, its positives' scores, split the scores below them into
disjoint slots. Each task keeps the best ``count`` rows per anchor and slot, the tables of
all tasks are merged the same way, and since slots are disjoint and ordered, a window's
rows are the first of the slots from its own limit downwards, cut at its lower limit: one
pass over the rows answers all overlapping windows.

Every row is compared with every anchor, in blocks: rows and anchors are packed into arrays
of bounded size, each pair of blocks is a matrix product. No more than the best rows of a
pair leave a task. Scores are exact integers at any magnitude.

Rows without an id, label or vector, or with a null or non-finite component, take no part,
nor does a row for anchors of another width. Of anchor rows that share an id the least (by
label, then vector) is the anchor; other rows that share an id count once for each score.
Rows of the anchor's own id are never its positives or negatives. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.common import store

SCALE = 256
#: Rows in a block; fewer if that many are over so many components.
ROWS, ROW_COMPONENTS = 4_096, 1 << 18
#: An anchor counts as its components and 64 more; blocks have about so many.
ANCHOR_SIZE = 1 << 16
#: Blocks of anchors that are broadcast at a time, of about half a megabyte each.
AT_ONCE = 64
#: Best rows that a task holds back to merge, over all its anchors and slots.
HELD = 1 << 20
_LOW = -(1 << 62)
_ROWS = "width int, ids binary, labels binary, vectors binary"


def participants(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, as long, long, array<double>."""
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
    ).where("vec_id is not null and label is not null and vector is not null")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(~bad)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) as 32-bit integers, or as exact Python integers if they do not fit."""
    if np.all(np.abs(vectors) < 2**22):
        return np.floor(vectors * SCALE).astype(np.int32)
    exact = [int(np.floor(x * SCALE)) if abs(x) < 2**44 else int(x) * SCALE for x in vectors.flat]
    return np.array(exact, object).reshape(vectors.shape)


def _bytes(vectors: np.ndarray) -> bytes:
    """Scaled where that takes 32 bits, else as given; :func:`_unpack` tells by the length."""
    scaled = _scaled(vectors)
    return (vectors if scaled.dtype == object else scaled).tobytes()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows of one width, sorted by id, without rows that are the same in all columns."""

    def flush(width: int, parts: list) -> pa.RecordBatch:
        ids, labels, vectors = (np.concatenate(p) for p in zip(*parts))
        order = np.argsort(ids, kind="stable")
        ids, labels, vectors = ids[order], labels[order], vectors[order]
        if np.any(ids[1:] == ids[:-1]):
            seen: dict = {}
            for i in range(len(ids)):
                seen.setdefault((ids[i], labels[i], vectors[i].tobytes()), i)
            kept = np.fromiter(seen.values(), np.int64)
            ids, labels, vectors = ids[kept], labels[kept], vectors[kept]
        values = [width, ids.tobytes(), labels.tobytes(), _bytes(vectors)]
        types = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array([v], t) for v, t in zip(values, types)], ["width", "ids", "labels", "vectors"])

    held: dict[int, list] = {}
    sizes: dict[int, int] = {}
    for batch in batches:
        ids, labels = (batch.column(i).to_numpy() for i in (0, 1))
        lists = batch.column(2)
        bounds = lists.offsets.to_numpy()
        widths, values = np.diff(bounds), lists.values.to_numpy(zero_copy_only=False)
        for width in np.unique(widths).tolist():
            most = min(ROWS, max(1, ROW_COMPONENTS // max(1, width)))
            chosen = np.flatnonzero(widths == width)
            for first in range(0, len(chosen), most):
                part = chosen[first : first + most]
                vectors = values[bounds[part][:, None] + np.arange(width)].reshape(len(part), width)
                if sizes.get(width, 0) + len(part) > most:
                    yield flush(width, held.pop(width))
                    sizes[width] = 0
                held.setdefault(width, []).append((ids[part], labels[part], vectors))
                sizes[width] = sizes.get(width, 0) + len(part)
    for width, parts in held.items():
        yield flush(width, parts)


def _unpack(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
    labels = np.frombuffer(row[f"{prefix}labels"], np.int64)
    data, shape = row[f"{prefix}vectors"], (len(ids), row["width"])
    if len(data) == 4 * shape[0] * shape[1]:
        return ids, labels, np.frombuffer(data, np.int32).reshape(shape)
    return ids, labels, _scaled(np.frombuffer(data, np.float64).reshape(shape))


def _products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products, anchors by rows, exact: in doubles if no sum can round."""
    if rows.dtype != object and anchors.dtype != object:
        top = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (rows, anchors)]
        most = top[0] * top[1] * max(1, rows.shape[1])
        kind = np.float32 if most < 2**24 else np.float64
        if most < 2**53:
            return (anchors.astype(kind) @ rows.T.astype(kind)).astype(np.int64)
    whole = lambda x: np.array([int(v) for v in x.flat], object).reshape(x.shape)
    products = whole(anchors).dot(whole(rows).T)
    if any(not _LOW < v < -_LOW for v in products.flat):
        raise ValueError("a score does not fit a long: scale the vectors down")
    return products.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Per line the ``count`` best (score, id), higher scores first, ties by smaller id.

    ``ids`` ascend; scores of ``_LOW`` are no candidates."""
    again = np.zeros(scores.shape, bool)
    step = 1  # rows that share an id are neighbours: an equal score counts once
    while step < len(ids) and np.any(same := ids[step:] == ids[:-step]):
        again[:, step:] |= same & (scores[:, step:] == scores[:, :-step])
        step += 1
    scores = np.where(again, _LOW, scores)
    if scores.shape[1] > 4 * count:
        # What is above the count-th best score stays, and of the ties the first.
        edge = np.partition(scores, scores.shape[1] - count, axis=1)[:, -count]
        above = scores > edge[:, None]
        ties = scores == edge[:, None]
        rank = np.cumsum(ties, axis=1, dtype=np.int32)
        taken = above | (ties & (rank <= count - above.sum(axis=1)[:, None]))
        at = np.nonzero(taken)[1].reshape(len(scores), count)
        scores = np.take_along_axis(scores, at, 1)
    else:
        at = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    order = np.argsort(-scores, axis=1, kind="stable")[:, :count]
    return np.take_along_axis(scores, order, 1), ids[np.take_along_axis(at, order, 1)]


class _Held:
    """A task's best rows by anchor and slot, merged as they come."""

    def __init__(self, count: int):
        self.count, self.parts, self.size = count, [], 0

    def add(self, anchors: np.ndarray, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        line, _ = real = np.nonzero(scores > _LOW)
        self.parts.append((anchors[line], np.full(len(line), slot, np.int64), scores[real], ids[real]))
        self.size += len(line)
        if self.size > 2 * HELD:
            self.merge()

    def merge(self) -> None:
        anchor, slot, score, row = (np.concatenate(p) for p in zip(*self.parts))
        order = np.lexsort((row, -score, slot, anchor))
        anchor, slot, score, row = (x[order] for x in (anchor, slot, score, row))
        group = (anchor[1:] != anchor[:-1]) | (slot[1:] != slot[:-1])
        new = np.concatenate([[True], group | (score[1:] != score[:-1]) | (row[1:] != row[:-1])])[: len(anchor)]
        anchor, slot, score, row = (x[new] for x in (anchor, slot, score, row))
        starts = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (slot[1:] != slot[:-1])])[: len(anchor)]
        first = np.flatnonzero(starts)
        rank = np.arange(len(anchor)) - np.repeat(first, np.diff(np.append(first, len(anchor))))
        kept = rank < self.count
        self.parts = [tuple(x[kept] for x in (anchor, slot, score, row))]
        self.size = int(kept.sum())

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.merge()
            yield pa.record_batch([pa.array(x) for x in self.parts[0]], names=["anchor_id", "slot", "score", "row_id"])
        self.parts, self.size = [], 0


_FOUND = "anchor_id long, slot long, score long, row_id long"


def _positives(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(count)
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, vectors = _unpack(row)
                anchors, own, targets = _unpack(row, "a_")
                scores = _products(vectors, targets)
                right = (labels == own[:, None]) & (ids != anchors[:, None])
                held.add(anchors, 0, *_best(np.where(right, scores, _LOW), ids, count))
            if held.size > HELD:
                yield from held.flush()
        yield from held.flush()

    return run


def _negatives(count: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(count)
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, vectors = _unpack(row)
                anchors, own, targets = _unpack(row, "a_")
                # Upper limits of each anchor, descending; padded with the last one.
                limits = np.frombuffer(row["a_limits"], np.int64).reshape(len(anchors), -1)
                least = _lower(limits[:, -1], num, den)
                scores = _products(vectors, targets)
                right = (labels != own[:, None]) & (ids != anchors[:, None]) & (scores >= least[:, None])
                for slot in range(limits.shape[1]):
                    inside = right & (scores <= limits[:, slot, None])
                    if slot + 1 < limits.shape[1]:
                        inside &= scores > limits[:, slot + 1, None]
                    some = np.flatnonzero(inside.any(axis=1))
                    if len(some):
                        masked = np.where(inside[some], scores[some], _LOW)
                        held.add(anchors[some], slot, *_best(masked, ids, count))
            if held.size > HELD:
                yield from held.flush()
        yield from held.flush()

    return run


def _lower(limit, num: int, den: int):
    """The least integer n with den · n >= num · limit, for limits of 0 and more."""
    return limit // den * num + -(-(limit % den) * num // den)


def _blocks_of(anchors: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """Anchors (anchor_id, label, vector, ..) packed into numbered blocks, and their number."""
    size = anchors.select(F.sum(F.size("vector").cast("long") + 64)).first()[0] or 0
    number = max(1, -(-size // ANCHOR_SIZE))
    block = F.pmod(F.xxhash64("anchor_id"), F.lit(number)).cast("int")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = row["own"]
                out = {
                    "width": row["width"],
                    "block": row["block"],
                    "a_ids": np.array([x["anchor_id"] for x in own], np.int64).tobytes(),
                    "a_labels": np.array([x["label"] for x in own], np.int64).tobytes(),
                    "a_vectors": _bytes(np.array([x["vector"] for x in own], np.float64)),
                }
                if "limits" in columns:
                    most = max(len(x["limits"]) for x in own)
                    padded = [x["limits"] + x["limits"][-1:] * (most - len(x["limits"])) for x in own]
                    out["a_limits"] = np.array(padded, np.int64).tobytes()
                yield pa.record_batch(
                    [pa.array([v], pa.int32() if isinstance(v, int) else pa.binary()) for v in out.values()], names=list(out)
                )

    grouped = anchors.groupBy(F.size("vector").alias("width"), block.alias("block"))
    lists = grouped.agg(F.collect_list(F.struct(*columns)).alias("own"))
    schema = "width int, block int, a_ids binary, a_labels binary, a_vectors binary"
    return store(lists.mapInArrow(pack, schema + (", a_limits binary" if "limits" in columns else ""))), number


def _against(packed: DataFrame, blocks: tuple[DataFrame, int], search) -> DataFrame:
    """``search`` run on each block of rows with each block of anchors of its width.

    The anchors are broadcast in parts of at most ``AT_ONCE`` blocks."""
    table, number = blocks
    parts = []
    for first in range(0, number, AT_ONCE):
        some = table.where(F.col("block").between(first, first + AT_ONCE - 1)).drop("block")
        parts.append(packed.join(F.broadcast(some), "width").mapInArrow(search, _FOUND))
    return reduce(DataFrame.unionByName, parts)


def _first(found: DataFrame, count: int) -> DataFrame:
    """The best ``count`` of each anchor and slot; combined before the shuffle by rank."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "row_id")
    return found.withColumn("_rank", F.dense_rank().over(order)).where(F.col("_rank") <= count).drop("_rank").distinct()


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Hard negatives of each anchor and positive.

    ``rows`` and ``anchors`` have (vec_id, label, vector) as :func:`participants` gives
    them; ``anchors`` are some of the rows. An anchor's positives are its best
    ``positives`` other rows of its label by integer inner product, ties by smaller id.
    Its negatives for each are the best ``negatives`` rows of other labels with
    ``num/den`` of the positive's score at least, and at most that score.
    """
    least = F.min(F.struct("label", "vector")).alias("least")
    anchors = anchors.groupBy(F.col("vec_id").alias("anchor_id")).agg(least).select("anchor_id", "least.*")
    anchors = store(anchors)
    packed = store(rows.select("vec_id", "label", "vector").mapInArrow(_pack, _ROWS))
    found = _against(packed, _blocks_of(anchors, ["anchor_id", "label", "vector"]), _positives(positives))
    found = store(_first(found, positives))
    # A window below zero is empty: its lower limit is above the upper one.
    limits = found.where("score >= 0").groupBy("anchor_id")
    limits = limits.agg(F.sort_array(F.collect_set("score"), asc=False).alias("limits"))
    targets = _blocks_of(anchors.join(limits, "anchor_id"), ["anchor_id", "label", "vector", "limits"])
    hard = _first(_against(packed, targets, _negatives(negatives, num, den)), negatives)

    # At most one slot per positive, and ``negatives`` rows in each: bounded lists.
    entry = F.struct(F.col("slot"), (-F.col("score")).alias("below"), F.col("row_id"))
    slots = hard.groupBy("anchor_id").agg(F.sort_array(F.collect_list(entry)).alias("slots"))
    windows = found.where("score >= 0").withColumnsRenamed({"score": "positive_score", "row_id": "positive_id"})
    windows = windows.join(limits, "anchor_id").join(slots, "anchor_id")
    own = (F.array_position("limits", F.col("positive_score")) - 1).cast("long")
    suffix = F.slice(F.filter("slots", lambda x: x["slot"] >= F.col("own")), 1, negatives)
    floor = F.expr(f"positive_score div {den} * {num} + (positive_score % {den} * {num} + {den - 1}) div {den}")
    inside = F.filter("suffix", lambda x: -x["below"] >= F.col("floor"))
    windows = windows.withColumn("own", own).withColumn("suffix", suffix).withColumn("floor", floor)
    ranked = windows.select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("at", "hit"))
    return ranked.select(
        "anchor_id",
        "positive_id",
        (F.col("at") + 1).alias("rank"),
        F.col("hit.row_id").alias("negative_id"),
        "positive_score",
        (-F.col("hit.below")).alias("negative_score"),
    )
