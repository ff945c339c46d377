"""Records of JSON array and bundle files, each file read by as many tasks as it has splits.

Spark's JSON reader gives a file that holds one document to one task. Here files are read
as text cut after each ``}``, which splits them like any line-based file. Where records
start follows from the quotes and brackets before a split:

1. Each split says how it changes the state of the document, for both answers to "does it
   begin inside a string?": the number of quotes, and the sum and the least value of the
   bracket depth.
2. Running sums over a file's splits (a few numbers each) give the state each begins in.
3. Each split is cut into whole records, and the pieces of a record at its ends.

Only the pieces move between tasks, to be put together; parsing is left to ``from_json``.
The states are broadcast: one row for each split, so about a millionth of the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_QUOTE, _ESCAPE, _OPEN, _CLOSE = 34, 92, (91, 123), (93, 125)
#: What may stand between records.
_BETWEEN = re.compile(rb"[\s,\[\]{}]*\Z")


def _brackets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Positions of brackets, their steps (1 or -1), whether an even number of quotes comes
    before each, and the number of quotes. Escaped quotes do not count."""
    quotes = np.flatnonzero(data == _QUOTE)
    escapes = data == _ESCAPE
    if len(quotes) and escapes.any():
        last_other = np.maximum.accumulate(np.where(escapes, -1, np.arange(len(data))))
        before = quotes - 1
        length = np.where(quotes > 0, before - last_other[before], 0)
        quotes = quotes[length % 2 == 0]
    opens = np.isin(data, _OPEN)
    at = np.flatnonzero(opens | np.isin(data, _CLOSE))
    even = np.searchsorted(quotes, at) % 2 == 0
    return at, np.where(opens[at], 1, -1), even, len(quotes)


def _joined(batch: pa.RecordBatch, first: int, last: int) -> np.ndarray:
    """The fragments of some rows as bytes, each with the bracket that it was cut after."""
    texts = batch.column(2).slice(first, last - first).cast(pa.large_string())
    end, nothing = (pa.scalar(x, pa.large_string()) for x in ("}", ""))
    whole = pc.binary_join_element_wise(texts, end, nothing)
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator]]:
    """((file, split), its parts as (batch, first row, row after the last)) in order."""

    def parts():
        for batch in batches:
            if not len(batch):
                continue
            files, splits = batch.column(0), batch.column(1).to_numpy()
            new_file = pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(new_file | (splits[1:] != splits[:-1])) + 1).tolist(), len(batch)]
            for first, last in zip(starts, starts[1:]):
                yield (files[first].as_py(), int(splits[first])), (batch, first, last)

    for key, group in groupby(parts(), key=lambda part: part[0]):
        yield key, (part for _, part in group)


_CHANGE = "file string, split long, file_size long, bytes long, quotes long, sum0 long, sum1 long, least0 long, least1 long, head string"


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, split), parts in _by_split(batches):
        size, quotes, head = 0, 0, ""
        sums, least = [0, 0], [0, 0]
        for batch, first, last in parts:
            file_size = batch.column(3)[first].as_py()
            data = _joined(batch, first, last)
            size += len(data)
            at, steps, even, more = _brackets(data)
            if not head and split == 0 and len(at):
                head = chr(data[at[0]])
            for inside in (0, 1):  # whether the split begins inside a string
                outside = steps[even == ((quotes + inside) % 2 == 0)]
                if len(outside):
                    depth = sums[inside] + np.cumsum(outside)
                    sums[inside], least[inside] = int(depth[-1]), min(least[inside], int(depth.min()))
            quotes += more
        values = [file, split, file_size, size, quotes, sums[0], sums[1], least[0], least[1], head]
        types = [pa.string(), *[pa.int64()] * 8, pa.string()]
        names = [f.split(" ")[0] for f in _CHANGE.split(", ")]
        yield pa.record_batch([pa.array([v], t) for v, t in zip(values, types)], names)


def _states(changes: DataFrame, under: int) -> DataFrame:
    """Per split: whether it begins inside a string, its depth there, its file's base depth, and
    the split in which the record began that is open at its start, if one is.

    Records are ``under`` levels below the base. Fails for files that end within a document.
    """
    whole = Window.partitionBy("file")
    before = whole.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    placed = changes.withColumn("inside", inside.cast("int"))
    placed = placed.withColumns(
        {
            "step": F.when(F.col("inside") == 0, F.col("sum0")).otherwise(F.col("sum1")),
            "least": F.when(F.col("inside") == 0, F.col("least0")).otherwise(F.col("least1")),
            "base": F.when(F.max("head").over(whole) == "[", 1).otherwise(0),
        }
    )
    # The last fragment got a bracket too, which is not in the file unless it ends with one.
    ends = F.sum("step").over(whole) + (F.sum("bytes").over(whole) - F.col("file_size"))
    good = (ends == 0) & (F.sum("quotes").over(whole) % 2 == 0)
    depth = F.coalesce(F.sum("step").over(before), F.lit(0))
    message = F.concat(F.lit("MALFORMED JSON document: "), F.col("file"))
    placed = placed.withColumn("depth", F.when(good, depth).otherwise(F.raise_error(message).cast("long")))
    outside = F.when(F.col("depth") + F.col("least") <= F.col("base") + under, F.col("split"))
    owner = F.last(outside, ignorenulls=True).over(before)
    return placed.select("file", "split", "inside", "depth", "base", owner.alias("owner"))


def _crossings(key: str, elements: bool):
    """Per split: whether the last member that begins in it, at the level of the document's
    own, is the one looked for; none begins: null."""
    pattern = _member(key, elements)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, split), parts in _by_split(batches):
            found, state = None, None
            for batch, first, last in parts:
                state = state or _State(batch, first)
                data = _joined(batch, first, last)
                at, depth, steps = state.advance(data)
                begins = at[(steps > 0) & (depth == state.base + 2)]
                if len(begins):
                    found = _is_member(data, int(begins[-1]), pattern)
            yield pa.record_batch([pa.array([file]), pa.array([split]), pa.array([found], pa.bool_())], ["file", "split", "wanted"])

    return run


def _member(key: str, elements: bool) -> re.Pattern:
    return re.compile(rb'"' + re.escape(key.encode()) + rb'"\s*:\s*' + (rb"\[" if elements else rb"\{") + rb"\Z")


def _is_member(data: np.ndarray, at: int, pattern: re.Pattern) -> bool:
    return bool(pattern.search(data[max(0, at - 1024) : at + 1].tobytes()))


class _State:
    """Where a split is: inside a string or not, and how deep."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.inside, self.depth, self.base, wanted = (batch.column(3 + k)[row].as_py() for k in range(4))
        self.wanted = bool(wanted)

    def advance(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Brackets outside strings: position, depth after it, step."""
        at, steps, even, quotes = _brackets(data)
        outside = even == (self.inside % 2 == 0)
        at, steps = at[outside], steps[outside]
        depth = self.depth + np.cumsum(steps)
        self.depth = int(depth[-1]) if len(depth) else self.depth
        self.inside = (self.inside + quotes) % 2
        return at, depth, steps


_PIECE = "file string, split long, at long, begins boolean, ends boolean, text string"


def _records(key: str | None, elements: bool):
    """Whole records of each split, and the pieces at its ends."""
    pattern = _member(key, elements) if key else None
    under = 0 if key is None else 2 if elements else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, split), parts in _by_split(batches):
            state, held, begins, count = None, [], False, 0
            for batch, first, last in parts:
                if state is None:
                    state = _State(batch, first)
                    level = state.base + under
                    # A record that is open here began in an earlier split.
                    open_ = state.depth > level and (key is None or state.wanted)
                    wanted = state.wanted
                data = _joined(batch, first, last)
                at, depth, steps = state.advance(data)
                out, start, between = [], 0 if open_ else None, 0
                for pos, deep, step in _events(at, depth, steps, level, state.base):
                    if key is not None and elements and step > 0 and deep == state.base + 2:
                        wanted = _is_member(data, pos, pattern)
                    elif step > 0 and deep == level + 1:
                        if key is None:
                            _check_between(data[between:pos], file)
                            if data[pos] != 123:
                                raise ValueError(f"MALFORMED record in {file}: not an object")
                        if key is None or (wanted if elements else _is_member(data, pos, pattern)):
                            open_, start, begins = True, pos, True
                    elif step < 0 and deep == level:
                        if open_:
                            held.append(data[start : pos + 1].tobytes())
                            out.append((count, begins, True, b"".join(held)))
                            count, held, open_, start = count + 1, [], False, None
                        between = pos + 1
                if open_:
                    held.append(data[start:].tobytes())
                elif key is None:
                    _check_between(data[between:], file)
                if out:
                    yield _pieces(file, split, out)
            if held:
                yield _pieces(file, split, [(count, begins, False, b"".join(held))])

    return run


def _events(at: np.ndarray, depth: np.ndarray, steps: np.ndarray, level: int, base: int):
    """Brackets at which a record, or a member of the document, begins or ends."""
    edge = np.where(steps > 0, depth == level + 1, depth == level)
    edge |= (steps > 0) & (depth == base + 2) & (level > base)
    return zip(at[edge].tolist(), depth[edge].tolist(), steps[edge].tolist())


def _check_between(data: np.ndarray, file: str) -> None:
    if not _BETWEEN.match(data.tobytes()):
        raise ValueError(f"MALFORMED text between the records of {file}")


def _pieces(file: str, split: int, rows: list[tuple]) -> pa.RecordBatch:
    at, begins, ends, texts = zip(*rows)
    columns = [
        pa.array([file] * len(rows), pa.string()),
        pa.array([split] * len(rows), pa.int64()),
        pa.array(at, pa.int64()),
        pa.array(begins, pa.bool_()),
        pa.array(ends, pa.bool_()),
        pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()),
    ]
    return pa.record_batch(columns, [f.split(" ")[0] for f in _PIECE.split(", ")])


def record_texts(spark: SparkSession, path: str, key: str | None = None, elements: bool = False) -> DataFrame:
    """(text, pos) of the records in JSON files; ``pos`` orders a file's records.

    Without ``key`` the records are the objects in a file's array, or its one object. With
    it they come out of the member of that name of each such object: the member itself, or
    with ``elements`` the objects in its array. A file that does not end where its document
    ends, or that has something else between its records, fails the read.
    """
    under = 0 if key is None else 2 if elements else 1
    lines = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        "value",
        F.col("_metadata.file_size").alias("file_size"),
    )
    states = _states(lines.mapInArrow(_changes, _CHANGE), under)
    if key is None:
        states = states.withColumn("wanted", F.lit(True))
    else:
        placed = _with_states(lines, states.withColumn("wanted", F.lit(False)))
        found = placed.mapInArrow(_crossings(key, elements), "file string, split long, wanted boolean")
        before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        last = F.coalesce(F.last("wanted", ignorenulls=True).over(before), F.lit(False))
        states = states.join(found.select("file", "split", last.alias("wanted")), ["file", "split"])
    pieces = _with_states(lines, states).mapInArrow(_records(key, elements), _PIECE)
    whole = pieces.where("begins AND ends").select("text", F.struct("file", F.col("split").alias("block"), F.col("at").alias("row")).alias("pos"))
    cut = pieces.where("NOT (begins AND ends)").join(F.broadcast(states.select("file", "split", "owner")), ["file", "split"])
    started = F.when(F.col("begins"), F.col("split")).otherwise(F.col("owner"))
    joined = cut.groupBy("file", started.alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "text"))), lambda x: x["text"]), "").alias("text"),
        F.min_by("at", "split").alias("row"),
    )
    return whole.unionByName(joined.select("text", F.struct("file", "block", "row").alias("pos")))


def _with_states(lines: DataFrame, states: DataFrame) -> DataFrame:
    """Lines in their order, each with the state that its split begins in."""
    states = F.broadcast(states.select("file", "split", "inside", "depth", "base", "wanted"))
    joined = lines.join(states, ["file", "split"])
    return joined.select("file", "split", "value", "inside", "depth", "base", "wanted")


def read_records(
    spark: SparkSession, path: str, schema: StructType, key: str | None = None, elements: bool = False
) -> DataFrame:
    """The records of :func:`record_texts` with the columns of ``schema``, and ``pos``."""
    parsed = F.from_json("text", schema, {"mode": "FAILFAST"})
    texts = record_texts(spark, path, key, elements)
    return texts.select(parsed.alias("record"), "pos").select("record.*", "pos")
