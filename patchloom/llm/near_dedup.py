"""Near-duplicate vectors by an inverted multi-index.

Vectors are cut in halves (of odd widths the second is longer), each with a codebook of its own; the pairs of codewords are the
cells of a product grid. A vector is stored in the cell of its nearest codewords. A search
goes through the cells in order of their distance, by the multi-sequence algorithm over the
two sorted codebook distances, until the distance exceeds that of the vector's own cell by
more than ``excess``. How far that must be is measured: vectors of the fitting sample are
moved to just the similarity asked for, in random directions, and ``excess`` is where the
target share of these is met from at least one side. Nearer pairs are met more often. What
is met is verified in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import store
from patchloom.llm.components import components

THRESHOLD = 0.9
TARGET_RECALL = 0.998
#: Codebooks are fitted on at most so many vectors, those with the lowest hash.
SAMPLE = 20_000
#: Vectors per cell that the size of the codebooks aims at.
PER_CELL = 32
CODEWORDS = (4, 2048)
#: Vectors of one cell, and searches, that are compared in one task.
CELL_BLOCK, SEARCH_BLOCK = 1024, 2048
FOUND = "kind int, a long, b long"


@dataclass
class Index:
    one: np.ndarray
    two: np.ndarray
    excess: float

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to all codewords of either half, the same in any batch."""
        half = self.one.shape[1]
        return (
            np.stack([((x[:, :half] - c) ** 2).sum(1) for c in self.one], 1),
            np.stack([((x[:, half:] - c) ** 2).sum(1) for c in self.two], 1),
        )

    def reach(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        return d1.min(1) + d2.min(1) + self.excess

    def visits(self, d1: np.ndarray, d2: np.ndarray, reach: float) -> Iterator[tuple[int, int]]:
        """Cells in order of distance, up to ``reach``: the multi-sequence algorithm."""
        first, second = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        a, b = d1[first].tolist(), d2[second].tolist()
        queue, done = [(a[0] + b[0], 0, 0)], {(0, 0)}
        while queue:
            distance, i, j = heapq.heappop(queue)
            if distance > reach:
                return
            yield int(first[i]), int(second[j])
            for step in ((i + 1, j), (i, j + 1)):
                if step[0] < len(a) and step[1] < len(b) and step not in done:
                    done.add(step)
                    heapq.heappush(queue, (a[step[0]] + b[step[1]], *step))


def _codebook(x: np.ndarray, size: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    words = x[rng.choice(len(x), min(size, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((words**2).sum(1)[None] - 2 * x @ words.T).argmin(1)
        for k in range(len(words)):
            if (near == k).any():
                words[k] = x[near == k].mean(0)
    return words


def fit(x: np.ndarray, total: int, threshold: float, recall: float) -> Index:
    """Index of unit vectors ``x``, a sample of ``total``."""
    rng = np.random.default_rng(0)
    size = 1 << max(0, round(np.log2(max(total / PER_CELL, 1)) / 2))
    size = min(max(size, CODEWORDS[0]), CODEWORDS[1], max(1, len(x) // 4))
    half = x.shape[1] // 2
    index = Index(_codebook(x[:, :half], size, rng), _codebook(x[:, half:], size, rng), 0.0)
    probe = x[:2000]
    away = rng.normal(size=probe.shape)
    away -= (away * probe).sum(1)[:, None] * probe
    away /= np.maximum(np.linalg.norm(away, axis=1), 1e-12)[:, None]
    moved = threshold * probe + np.sqrt(max(0.0, 1 - threshold**2)) * away
    d, e = index.distances(probe), index.distances(moved)
    n = np.arange(len(probe))
    there = d[0][n, e[0].argmin(1)] + d[1][n, e[1].argmin(1)] - d[0].min(1) - d[1].min(1)
    back = e[0][n, d[0].argmin(1)] + e[1][n, d[1].argmin(1)] - e[0].min(1) - e[1].min(1)
    index.excess = float(np.quantile(np.minimum(there, back), recall)) + 1e-9
    return index


def _unit(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    x = x.reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _assign(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            d1, d2 = index.distances(_unit(batch.column("x")))
            cells = {"i": pa.array(d1.argmin(1), pa.int32()), "j": pa.array(d2.argmin(1), pa.int32())}
            columns = {c: batch.column(c) for c in ("node", "weight", "x")}
            yield pa.record_batch(columns | cells)

    return run


def _search(index: Index):
    """For each vector, the cells to visit, by first codeword."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            d1, d2 = index.distances(_unit(batch.column("x")))
            reach = index.reach(d1, d2)
            rows, firsts, seconds = [], [], []
            for row in range(len(batch)):
                for i, j in index.visits(d1[row], d2[row], float(reach[row])):
                    rows.append(row)
                    firsts.append(i)
                    seconds.append(j)
            yield pa.record_batch(
                {
                    "node": batch.column("node").take(pa.array(rows, pa.int64())),
                    "ci": pa.array(firsts, pa.int32()),
                    "cj": pa.array(seconds, pa.int32()),
                }
            )

    return run


def _least_labels(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Smallest number reachable from each of ``size`` numbers over the links a - b."""
    label = np.arange(size)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(index: Index, threshold: float):
    """Links between the searches and the stored vectors of one block of a cell."""

    def run(stored: pa.Table, searches: pa.Table) -> pa.Table:
        empty = pa.table({"kind": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not len(stored) or not len(searches):
            return empty
        x, y = _unit(searches.column("x")), _unit(stored.column("s_x"))
        own, other = searches.column("node").to_numpy(), stored.column("s_node").to_numpy()
        w, v = searches.column("weight").to_numpy(), stored.column("s_weight").to_numpy()
        q, s = np.nonzero(x @ y.T >= threshold - 1e-9)
        exact = (x[q] * y[s]).sum(1) >= threshold
        q, s = q[exact & (own[q] != other[s])], s[exact & (own[q] != other[s])]
        if not len(q):
            return empty
        # The other vector's search meets this pair too if it visits this one's cell: then
        # each side counts for itself, else this one counts for both.
        d1, d2 = index.distances(y)
        used = np.unique(s)
        c1, c2 = searches.column("i").to_numpy()[q], searches.column("j").to_numpy()[q]
        back = np.empty(len(s), bool)
        reach = index.reach(d1[used], d2[used])
        back = d1[s, c1] + d2[s, c2] <= reach[np.searchsorted(used, s)]
        counted = np.concatenate([own[q], other[s[~back]]])
        weights = np.concatenate([v[s], w[q[~back]]])
        return _found(counted, weights, own[q], other[s])

    return run


def _found(counted: np.ndarray, weights: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Sums of ``weights`` by node (kind 0), and nodes with the least one linked to them (kind 1)."""
    nodes, at = np.unique(counted, return_inverse=True)
    sums = np.bincount(at, weights=weights).astype(np.int64)
    both, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = both[_least_labels(at[: len(a)], at[len(a) :], len(both))]
    moved = label != both
    return pa.table(
        {
            "kind": pa.array(np.concatenate([np.zeros(len(nodes)), np.ones(moved.sum())]), pa.int32()),
            "a": pa.array(np.concatenate([nodes, both[moved]])),
            "b": pa.array(np.concatenate([sums, label[moved]])),
        }
    )


def _every(threshold: float):
    """Links among all vectors of one width, for at most ``CELL_BLOCK`` of them."""

    def run(stored: pa.Table) -> pa.Table:
        x, node = _unit(stored.column("x")), stored.column("node").to_numpy()
        q, s = np.nonzero(x @ x.T >= threshold - 1e-9)
        linked = ((x[q] * x[s]).sum(1) >= threshold) & (node[q] != node[s])
        q, s = q[linked], s[linked]
        if not len(q):
            return pa.table({"kind": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        return _found(node[q], stored.column("weight").to_numpy()[s], node[q], node[s])

    return run


def _links(unique: DataFrame, total: int, threshold: float, recall: float) -> DataFrame:
    """(kind, a, b) of :func:`_found` for ``unique`` vectors of one width, by an index of their own."""
    sample = unique.orderBy(F.xxhash64("x"), "node").limit(SAMPLE).select("x").toArrow()
    index = fit(_unit(sample.column(0)), total, threshold, recall)
    assigned = store(unique.mapInArrow(_assign(index), "node long, weight long, x array<double>, i int, j int"))
    counts = assigned.groupBy("i", "j").agg(F.count(F.lit(1)).alias("in_cell"))
    visits = assigned.mapInArrow(_search(index), "node long, ci int, cj int")
    # Searches that visit a cell, and the vectors in it, bounded by splitting both.
    cells = counts.select(F.col("i").alias("ci"), F.col("j").alias("cj"), F.expr(f"cast(ceil(in_cell / {CELL_BLOCK}) as int)").alias("blocks"))
    visits = visits.join(cells, ["ci", "cj"])
    visits = store(visits)
    asked = visits.groupBy("ci", "cj").agg(F.count(F.lit(1)).alias("asked"))
    shape = cells.join(asked, ["ci", "cj"])
    shape = shape.select("ci", "cj", "blocks", F.expr(f"cast(ceil(asked / {SEARCH_BLOCK}) as int)").alias("sets"))
    shape = store(shape)
    wide = assigned.select("node", "weight", "x", "i", "j")
    block = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("blocks")).cast("int")
    held = wide.join(shape, (F.col("i") == F.col("ci")) & (F.col("j") == F.col("cj")))
    held = held.withColumn("block", block).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("sets") - 1)))
    asking = visits.drop("blocks").join(shape, ["ci", "cj"])
    asking = asking.withColumn("turn", F.pmod(F.xxhash64(F.lit(2), "node"), F.col("sets")).cast("int"))
    asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asking = asking.select("node", "ci", "cj", "turn", "block").join(wide, "node")
    key = ["ci", "cj", "turn", "block"]
    held = held.select("node", "weight", "x", *key)
    # Both sides come from one table: other names keep them apart.
    held = held.toDF("s_node", "s_weight", "s_x", *(f"s_{c}" for c in key))
    asking = asking.select("node", "weight", "x", "i", "j", *key)
    compared = held.groupBy(*(f"s_{c}" for c in key)).cogroup(asking.groupBy(*key))
    return store(compared.applyInArrow(_compare(index, threshold), FOUND))


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every vector.

    A vector that is null, empty or zero, or holds a null or a value that is not finite,
    is linked with nothing. Vectors are compared with those of their own width, even or odd.
    Equal vectors are searched once and linked with each other. Rows that share an id are
    one vector with several values; a null id has no links. ``kept``: the id is the smallest
    of its component.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fine = F.col("vec_id").isNotNull() & (F.size("x") > 0) & finite & F.exists("x", lambda v: v != 0)
    # The largest part first: squares of huge or tiny parts stay in range. As an argument it
    # is found once for each vector, inside the lambda it would be for each part.
    top = F.array_repeat(F.array_max(F.transform("x", F.abs)), F.size("x"))
    good = rows.where(F.coalesce(fine, F.lit(False)))
    good = good.withColumn("x", F.zip_with("x", top, lambda v, t: v / t + F.lit(0.0)))
    unique = good.groupBy("x").agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("weight"))
    unique = store(unique.select("node", "weight", "x"))
    width = F.size("x").alias("n")
    sizes = sorted(((r["count"], r["n"]) for r in unique.groupBy(width).count().collect()), reverse=True)
    # The most common width has an index, and so has each with many vectors; others are compared whole.
    indexed = [(total, n) for k, (total, n) in enumerate(sizes) if not k or total > CELL_BLOCK]
    parts = [_links(unique.where(F.size("x") == n), total, threshold, recall) for total, n in indexed]
    if len(sizes) > len(indexed):
        rare = unique.where(~F.size("x").isin([n for _, n in indexed]))
        parts.append(store(rare.groupBy(width).applyInArrow(_every(threshold), FOUND)))
    if parts:
        found = reduce(DataFrame.unionByName, parts)
        links = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
        named = components(found.where("kind = 1").select("a", "b"))
    else:
        links = spark.createDataFrame([], "node long, links long")
        named = spark.createDataFrame([], "node long, component long")
    members = good.join(unique.select("x", "node", "weight"), "x").select("vec_id", "node", "weight").distinct()
    members = members.join(links, "node", "left").join(named, "node", "left")
    own = F.coalesce("links", F.lit(0)) + F.col("weight") - 1
    members = members.groupBy("vec_id").agg(
        F.max(own).alias("n_links"), F.min(F.coalesce("component", "node")).alias("component_id")
    )
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id")).join(members, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
