"""Packing of token sequences by patterns of lengths, fitted with non-negative least squares.

Only the histogram of lengths, at most ``limit`` rows, is looked at in one place. Lengths
are rounded to a few classes; patterns are the ways to fill a sequence with at most
``MOST`` documents of these classes. Non-negative least squares say how often each pattern
is used so that the classes are used up; the numbers are rounded down. A pattern lays all its
documents, each the longest of its class that has room. Documents that no pattern took are
residual: they are packed by exact length, longest first, each into the fullest sequence
with room, those that patterns began included. The
plan names lengths, not documents: a document takes the place that belongs to its rank
among those of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.bpe import bpe
from patchloom.llm.common import positions, store

LIMIT = 4096
END_ID = 1
CLASSES = 64
MOST = 3
#: Rows of one length that are ranked in one task.
RANKED_TOGETHER = 1_000


def patterns(classes: int = CLASSES, most: int = MOST) -> list[tuple[int, ...]]:
    """Falling tuples of at most ``most`` classes that sum to ``classes``."""

    def fill(room: int, largest: int, places: int) -> Iterator[tuple[int, ...]]:
        if room == 0:
            yield ()
        elif places:
            for c in range(min(room, largest), 0, -1):
                for rest in fill(room - c, c, places - 1):
                    yield (c, *rest)

    return list(fill(classes, classes, most))


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least ``|ax - b|``, by active sets (Lawson and Hanson)."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    for _ in range(3 * a.shape[0]):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        enter = int(np.argmax(gradient))
        if gradient[enter] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        active[enter] = True
        while True:
            some = np.flatnonzero(active)
            y = np.linalg.lstsq(a[:, some], b, rcond=None)[0]
            if (y > 0).all():
                x[:] = 0
                x[some] = y
                break
            low = y <= 0
            step = np.min(x[some][low] / (x[some][low] - y[low] + 1e-300))
            x[some] += step * (y - x[some])
            active[some[x[some] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def plan(counts: np.ndarray, limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """How often each tuple of lengths is laid as one sequence. ``counts[n]`` is the number
    of pieces of length n, 1 to ``limit``."""
    left = counts.astype(np.int64).copy()
    classes = min(CLASSES, limit)
    width = limit / classes
    of = np.round(np.arange(limit + 1) / width).astype(int)
    wanted = np.bincount(of, weights=left, minlength=classes + 1)[1:]
    ways = patterns(classes)
    a = np.zeros((classes, len(ways)))
    for j, way in enumerate(ways):
        for c in way:
            a[c - 1, j] += 1
    times = np.floor(nnls(a, wanted) + 1e-9).astype(np.int64) if wanted.any() else np.zeros(0, int)
    opened: dict[int, list[list]] = {}
    frees: list[int] = []

    def put(lengths: tuple[int, ...], repeats: int) -> None:
        free = limit - sum(lengths)
        if free not in opened:
            opened[free] = []
            insort(frees, free)
        opened[free].append([lengths, repeats])

    of_class = [np.flatnonzero(of == c)[::-1].tolist() for c in range(classes + 1)]
    for j in np.argsort(-times):
        todo, way = int(times[j]), ways[j]
        while todo > 0:
            chosen: list[int] = []
            for c in way:
                room = limit - sum(chosen)
                n = next((n for n in of_class[c] if n and n <= room and left[n] > chosen.count(n)), 0)
                if not n:
                    break
                chosen.append(n)
            if len(chosen) < len(way):
                break
            repeats = min([todo, *(int(left[n]) // chosen.count(n) for n in chosen)])
            for n in chosen:
                left[n] -= repeats
            put(tuple(chosen), repeats)
            todo -= repeats
    for n in range(limit, 0, -1):
        todo = int(left[n])
        while todo:
            at = bisect_left(frees, n)
            if at == len(frees):
                many = limit // n
                if todo >= many:
                    put((n,) * many, todo // many)
                    todo %= many
                else:
                    put((n,) * todo, 1)
                    todo = 0
                continue
            free = frees[at]
            group = opened[free][-1]
            used = min(group[1], todo)
            group[1] -= used
            if not group[1]:
                opened[free].pop()
                if not opened[free]:
                    del opened[free]
                    frees.pop(at)
            put((*group[0], n), used)
            todo -= used
    return [(lengths, repeats) for groups in opened.values() for lengths, repeats in groups]


def places(sequences: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end, sequence of the first, offset) for all ranks of a length."""
    out, taken, base = [], {}, 0
    for lengths, repeats in sequences:
        offset = 0
        for n in lengths:
            first = taken.get(n, 0)
            taken[n] = first + repeats
            out.append((n, first, first + repeats, base, offset))
            offset += n
        base += repeats
    return out


def _cut(path: str, limit: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe(path)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(encoder.encode(batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, first in enumerate(range(0, len(ids), limit)):
                    part = ids[first : first + limit]
                    rows.append(row)
                    piece.append(k)
                    start.append(first)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0).take(pa.array(rows, pa.int64())),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
            )

    return run


def pieces(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    limit: int = LIMIT, end_id: int = END_ID,
) -> DataFrame:
    """Lengths and checksums of the token pieces of each document.

    A text's ids are followed by ``end_id``; what is over ``limit`` is cut. A null or
    empty text is one piece of one token.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(_cut(path, limit, end_id), schema)


def pack(rows: DataFrame, order: list[str], length: str = "length", limit: int = LIMIT) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a length of 1 to ``limit``.

    ``rows`` must be cheap to read again. Equal rows are interchangeable; an empty table
    gives an empty one. Only the counts per length reach the driver.
    """
    spark = rows.sparkSession
    counts = np.zeros(limit + 1, np.int64)
    for row in rows.groupBy(length).count().toLocalIterator():
        counts[row[0]] = row[1]
    schema = "_length long, _first long, _end long, _sequence long, offset long"
    table = F.broadcast(spark.createDataFrame(places(plan(counts, limit)), schema))
    parts = F.get(F.lit([int(c) // RANKED_TOGETHER + 1 for c in counts]), F.col(length).cast("int"))
    bucket = F.pmod(F.xxhash64(*order), parts)
    ranked = positions(rows, [length], bucket, order, "_rank").drop("_rank_total")
    at = (F.col(length) == F.col("_length")) & (F.col("_rank") >= F.col("_first"))
    placed = ranked.join(table, at & (F.col("_rank") < F.col("_end")))
    sequence = F.col("_sequence") + F.col("_rank") - F.col("_first")
    return placed.select(*rows.columns, sequence.alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, **names: str) -> DataFrame:
    """Pieces of ``docs`` with the sequence and offset each is packed at.

    Null ids are kept; repeated rows are packed one by one; other columns are ignored.
    """
    cut = store(pieces(docs, path, **names))
    return pack(cut, ["doc_id", "piece", "start", "ids_crc32"])
