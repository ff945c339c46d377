"""Token sequences in training order, in binary shards of fixed stride.

Every sequence has a number from 0 to N - 1. A keyed Feistel network on the least even
number of bits that holds N permutes these numbers; results of N or more are sent through
again until they are below N (cycle walking), which keeps it a permutation of 0 to N - 1.
That is the sequence's global slot: shard and byte offset follow from it by division, and
a reader can go on at any slot.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.bpe import bpe
from patchloom.llm.common import store
from patchloom.llm.words import mix

STRIDE = 512
SHARD_RECORDS = 1 << 14
END_ID = 1
ROUNDS = 4
KEY = 42


def feistel(numbers: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """Permute numbers of 0 to ``total`` - 1."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        return (left << np.uint64(half)) | right

    out = once(numbers.astype(np.uint64))
    while len(over := np.flatnonzero(out >= np.uint64(total))):
        out[over] = once(out[over])
    return out.astype(np.int64)


def _sequences(path: str, stride: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe(path)
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, piece, size, records = [], [], [], []
            for row, ids in enumerate(encoder.encode(batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(end_id))
                if ids.max() > 0xFFFF:
                    raise ValueError(f"id {ids.max()} does not fit 16 bits")
                ids = ids.astype("<u2")
                for k, first in enumerate(range(0, len(ids), stride)):
                    part = ids[first : first + stride]
                    rows.append(row)
                    piece.append(k)
                    size.append(len(part))
                    records.append(part.tobytes())
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0).take(pa.array(rows, pa.int64())),
                    "piece": pa.array(piece, pa.int32()),
                    "n_tokens": pa.array(size, pa.int32()),
                    "ids": pa.array(records, pa.binary()),
                    "task": pa.array(np.full(len(rows), task), pa.int32()),
                    "number": pa.array(np.arange(number, number + len(rows)), pa.int64()),
                }
            )
            number += len(rows)

    return run


def _slots(total: int, key: int, stride: int):
    width = stride * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = feistel(batch.column("number").to_numpy(), total, key)
            ids = [x.ljust(width, b"\0") for x in batch.column("ids").to_pylist()]
            names = ["doc_id", "piece", "n_tokens"]
            columns = [pa.array(slots), *(batch.column(c) for c in names), pa.array(ids, pa.binary())]
            yield pa.record_batch(columns, ["slot", *names, "record"])

    return run


def training_order(
    docs: DataFrame, path: str, stride: int = STRIDE, shard_records: int = SHARD_RECORDS,
    key: int = KEY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Records of ``stride`` 16-bit ids, sorted by slot, one partition for each shard.

    A text's ids and ``end_id`` are cut into sequences; the last one is padded with zeros,
    ``n_tokens`` says how much counts. Null and empty texts are one sequence of one
    token, repeated rows are sequences of their own, an empty table gives no record.
    Sequences are numbered by the task that wrote them and their place in it, so nothing
    is sorted to number them; they are written once, so the numbers stay.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, n_tokens int, ids binary, task int, number long"
    written = store(rows.mapInArrow(_sequences(path, stride, end_id), schema))
    # One row per task: bounded by the number of input splits.
    counts = sorted(tuple(r) for r in written.groupBy("task").count().collect())
    before, total = [], 0
    for task, count in counts:
        before.append((task, total))
        total += count
    offsets = docs.sparkSession.createDataFrame(before, "task int, before long")
    numbered = written.join(F.broadcast(offsets), "task")
    numbered = numbered.withColumn("number", F.col("number") + F.col("before"))
    numbered = numbered.select("doc_id", "piece", "n_tokens", "ids", "number")
    out = "slot long, doc_id long, piece int, n_tokens int, record binary"
    placed = numbered.mapInArrow(_slots(total, key, stride), out)
    shard = F.expr(f"cast(slot div {shard_records} as int)")
    placed = placed.withColumn("shard", shard)
    shards = max(1, -(-total // shard_records))
    ordered = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    offset = F.expr(f"(slot % {shard_records}) * {2 * stride}L")
    return ordered.select("slot", "shard", offset.alias("byte_offset"), "doc_id", "piece", "n_tokens", "record")


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_shards(records: DataFrame, path: str) -> None:
    """Write ``shard-00000.bin`` and so on under ``path``, a URI that all executors reach.

    A shard is written under a name of its own and moved into place when it is whole, so
    a task that runs again, or twice, leaves the same file.
    """

    def write(rows: Iterator) -> None:
        store_, root = _file_system(path)
        store_.create_dir(root, recursive=True)
        stream, name, shard = None, None, None

        def finish() -> None:
            if stream is not None:
                stream.close()
                store_.move(name, f"{root}/shard-{shard:05d}.bin")

        for row in rows:
            if row.shard != shard:
                finish()
                shard, name = row.shard, f"{root}/.{uuid4().hex}"
                stream = store_.open_output_stream(name)
            stream.write(bytes(row.record))
        finish()

    records.select("shard", "record").foreachPartition(write)


def read_records(
    path: str, start: int, stop: int, stride: int = STRIDE, shard_records: int = SHARD_RECORDS
) -> Iterator[np.ndarray]:
    """Ids of the slots from ``start`` on, padding included, read one after another."""
    store_, root = _file_system(path)
    slot = start
    while slot < stop:
        shard, first = divmod(slot, shard_records)
        with store_.open_input_file(f"{root}/shard-{shard:05d}.bin") as file:
            file.seek(first * stride * 2)
            while slot < min(stop, (shard + 1) * shard_records):
                yield np.frombuffer(file.read(stride * 2), "<u2")
                slot += 1
