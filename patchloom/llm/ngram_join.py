"""Set-similarity join of documents on word shingles, by token-combination prefixes.

All shingles get one global order: rarest first. If two sets are similar, few tokens of
either are missing from the other, so in any beginning of a set with more tokens than
may be missing some token is shared. Rare tokens of that prefix are indexed alone. A
frequent token would bring together too many documents, so such tokens are split into
sub-classes and every combination of k tokens of a sub-class is indexed instead; each
sub-class may then hide k - 1 shared tokens, for which the prefix is extended. A token
that only one set holds counts towards the prefix but is never indexed, so a document
that is mostly its own gets no index entry at all.

Larger sets take their prefix from a share of the tokens. Documents that share an entry are
then looked at in full: tokens that no other of them holds are counted, and two documents
whose own tokens alone keep them apart are no candidates, nor are those whose parity sketches
differ in more places than similar sets can. What is left is verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.common import store
from patchloom.llm.components import components
from patchloom.llm.words import mix, shingle_sets

#: Up to so many documents a token is rare (indexed alone), then indexed in pairs, then
#: in triples.
PAIRS_FROM, TRIPLES_FROM = 8, 256
#: Sets smaller than this use single tokens only.
SINGLES_BELOW = 32
#: Sets from this size on take their prefix from a hashed share of the tokens.
SHARE_FROM = 64
#: A token in more than one of so many documents goes last, without being counted again:
#: at most this many times the mean set size, so the list is bounded.
HOT_SHARE = 128
HUB_ROUNDS = 1
#: Bits of a set's parity sketch, in whole words of 64.
PARITY_WORDS = 16
_SCHEME_BITS = 63


class Threshold:
    """Jaccard similarity of at least ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def missing(self, n: int) -> int:
        """Most tokens of a set of ``n`` that a similar set can lack."""
        return n - -(-self.num * n // self.den)

    def schemes(self, n: int) -> list[int]:
        """Size classes in which a set of ``n`` is indexed; similar sets share one."""
        return sorted({n.bit_length(), (-(-self.num * n // self.den)).bit_length()})

    def parts(self, scheme: int) -> int:
        """Number of sub-classes of each frequent class in a size class."""
        return max(1, (self.missing((1 << scheme) - 1) + 1) // 4)

    def share(self, scheme: int) -> int:
        """Tokens under this value are ordered by frequency, others after them by value."""
        if (1 << scheme) <= SHARE_FROM:
            return 1 << 64
        return min(1 << 64, (1 << 64) * 5 * (self.den - self.num) // (2 * self.den))

    def needed(self, n: int, scheme: int) -> int:
        """Tokens that are enough for a prefix, whatever their classes turn out to be."""
        hidden = 0 if (1 << scheme) <= SINGLES_BELOW else 3 * self.parts(scheme)
        return min(n, self.missing(n) + 1 + hidden)


def scheme_tokens(tokens: np.ndarray, scheme: int) -> np.ndarray:
    """Sorted values of a set's tokens in a size class, which is kept in their last bits."""
    mixed = mix(tokens + np.uint64(scheme * 0x632BE59BD9B4E019 % (1 << 64)))
    return np.sort((mixed & ~np.uint64(_SCHEME_BITS)) | np.uint64(scheme))


def fingerprints(tokens: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        one = mix(tokens).sum(dtype=np.uint64)
        two = mix(tokens ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def signatures(tokens: list, meta: list, t: Threshold) -> np.ndarray:
    """Index entries of one set, given its shared tokens as (documents, value).

    ``meta`` holds, per size class: the class, the set's size, how many tokens are in
    the first and the second part of the order, and the hot ones with their count.
    """
    out = []
    at = 0
    by_scheme: dict[int, list] = {}
    for df, value in tokens:
        by_scheme.setdefault(value & _SCHEME_BITS, []).append((df, value & ((1 << 64) - 1)))
    while at < len(meta):
        scheme, n, first, second, hot_count = meta[at : at + 5]
        hot = [(1 << 62, h & ((1 << 64) - 1)) for h in meta[at + 5 : at + 5 + hot_count]]
        at += 5 + hot_count
        limit, parts = t.share(scheme), t.parts(scheme)
        counted = by_scheme.get(scheme, [])
        early = sorted(x for x in counted if x[1] < limit)
        late = sorted(x for x in counted if x[1] >= limit)
        left = t.missing(n) + 1 - (first - len(early))
        small = (1 << scheme) <= SINGLES_BELOW
        groups: dict[tuple[int, int], list[int]] = {}
        for df, value in early + sorted(h for h in hot if h[1] < limit):
            if left <= 0:
                break
            k = 1 if small or df <= PAIRS_FROM else 2 if df <= TRIPLES_FROM else 3
            if k == 1:
                out.append(value)
                left -= 1
            else:
                group = groups.setdefault((k, (value >> 6) % parts), [])
                group.append(value)
                left -= len(group) >= k
        left -= second - len(late)
        for _, value in late + sorted(h for h in hot if h[1] >= limit):
            if left <= 0:
                break
            out.append(value)
            left -= 1
        for (k, _), group in groups.items():
            for some in combinations(sorted(group), k):
                code = k
                for value in some:
                    code = (code * 0x9E3779B97F4A7C15 + value) & ((1 << 64) - 1)
                    code ^= code >> 29
                out.append((code & ~_SCHEME_BITS) | scheme)
    return np.unique(np.array(out, dtype=np.uint64)).view(np.int64)


def parity(tokens: np.ndarray) -> np.ndarray:
    """Bit i tells if an odd number of the set's tokens hash to i.

    Where two sketches differ, at least one token is in one of the two sets only.
    """
    bits = 64 * PARITY_WORDS
    counts = np.bincount((mix(tokens) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, ones, twos, seen = [], [], [], []
            for _, tokens in shingle_sets(batch.column(1), size):
                one, two = fingerprints(tokens)
                ns.append(len(tokens))
                ones.append(one)
                twos.append(two)
                seen.append(tokens)
            if not ns:
                continue
            values, counts = np.unique(np.concatenate(seen), return_counts=True)
            often = counts >= max(8, len(ns) // 100)
            rest = [None] * (len(ns) - 1)
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0),
                    "n_shingles": pa.array(ns, pa.int64()),
                    "fp1": pa.array(ones, pa.int64()),
                    "fp2": pa.array(twos, pa.int64()),
                    "often": pa.array([values[often].view(np.int64), *rest], pa.list_(pa.int64())),
                    "times": pa.array([counts[often], *rest], pa.list_(pa.int64())),
                }
            )

    return run


def _emit_tokens(size: int, t: Threshold, hot: np.ndarray):
    """Rows (tok, node) for the tokens a prefix can reach, and one with ``meta`` per set."""
    empty = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks, nodes, counts, metas, done = [], [], [], [], set()
            for _, tokens in shingle_sets(batch.column(0), size):
                n = len(tokens)
                if not n or (key := fingerprints(tokens)) in done:
                    continue
                done.add(key)
                is_hot = np.isin(tokens, hot) if len(hot) else np.zeros(n, bool)
                meta, own = [], []
                for scheme in t.schemes(n):
                    values = scheme_tokens(tokens, scheme)
                    limit = t.share(scheme)
                    early = n if limit >> 64 else int(np.searchsorted(values, np.uint64(limit)))
                    take = values[: max(early, t.needed(n, scheme))]
                    common = scheme_tokens(tokens[is_hot], scheme)
                    common = common[np.isin(common, take)]
                    plain = take[~np.isin(take, common)] if len(common) else take
                    first = n if limit >> 64 else int(np.searchsorted(plain, np.uint64(limit)))
                    first = min(first, len(plain))
                    own.append(plain.view(np.int64))
                    meta += [scheme, n, first, len(plain) - first, len(common)]
                    meta += common.view(np.int64).tolist()
                own.append(np.array([int(mix(np.array([key[1]], np.int64).view(np.uint64))[0])],
                                    np.uint64).view(np.int64))
                own = np.concatenate(own)
                toks.append(own)
                nodes.append(key[0])
                counts.append(len(own))
                metas.append(meta)
                if sum(counts) > 400_000:
                    yield _token_batch(toks, nodes, counts, metas)
                    toks, nodes, counts, metas = [], [], [], []
            yield _token_batch(toks or [empty], nodes, counts, metas)

    return run


def _token_batch(toks, nodes, counts, metas) -> pa.RecordBatch:
    """A set's ``meta`` is on the last of its rows."""
    total = int(sum(counts))
    last = np.cumsum(np.array(counts, np.int64)) - 1
    lengths = np.zeros(total + 1, np.int64)
    lengths[last + 1] = [len(m) for m in metas]
    valid = np.zeros(total, bool)
    valid[last] = True
    flat = np.concatenate([np.array(m, np.int64) for m in metas] or [np.zeros(0, np.int64)])
    meta = pa.ListArray.from_arrays(
        pa.array(np.cumsum(lengths).astype(np.int32)), pa.array(flat), mask=pa.array(~valid)
    )
    return pa.record_batch(
        {
            "tok": pa.array(np.concatenate(toks)),
            "node": pa.array(np.repeat(np.array(nodes, np.int64), counts)),
            "meta": meta,
        }
    )


def _emit_signatures(t: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, nodes, held = [], [], 0
            for node, tokens, meta in zip(*(c.to_pylist() for c in batch.columns)):
                pairs = [(x["df"], x["tok"]) for x in tokens]
                found = signatures(pairs, meta, t)
                sigs.append(found)
                nodes.append(np.full(len(found), node, np.int64))
                held += len(found)
                if held > 400_000:
                    yield pa.record_batch([np.concatenate(sigs), np.concatenate(nodes)], ["sig", "node"])
                    sigs, nodes, held = [], [], 0
            if sigs:
                yield pa.record_batch([np.concatenate(sigs), np.concatenate(nodes)], ["sig", "node"])

    return run


def _emit_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            docs, sets, sketches = [], [], [np.zeros(0, np.int64)]
            for i, tokens in shingle_sets(batch.column(1), size):
                if len(tokens) and fingerprints(tokens)[0] == wanted[i]:
                    docs.append(ids[i])
                    sets.append(tokens.tobytes())
                    sketches.append(parity(tokens))
            at = pa.array(np.arange(len(docs) + 1) * PARITY_WORDS, pa.int32())
            columns = {
                "doc": pa.array(docs, pa.int64()),
                "tokens": pa.array(sets, pa.binary()),
                "parity": pa.ListArray.from_arrays(at, pa.array(np.concatenate(sketches))),
            }
            yield pa.record_batch(columns)

    return run


def _emit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), 1000):
            part = batch.slice(start, 1000)
            sets = [np.frombuffer(x, np.int64) for x in part.column("tokens").to_pylist()]
            docs = np.repeat(part.column("doc").to_numpy(), [len(x) for x in sets])
            yield pa.record_batch([np.concatenate(sets), docs], ["tok", "doc"])


def _verify(t: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(t.den * both >= t.num * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """Of candidate pairs (a, b): those that are similar, stored."""
    one = sets.select(F.col("doc").alias("a"), F.col("tokens").alias("x"))
    two = sets.select(F.col("doc").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return store(both.mapInArrow(_verify(t), "a long, b long"))


def _own_tokens(sets: DataFrame, t: Threshold) -> DataFrame:
    """(doc, n, own, parity) of the documents of ``sets`` that can have a link at all.

    ``own`` is the number of a document's tokens that no other document here holds.
    """
    rows = sets.select("doc", "tokens").mapInArrow(_emit_all, "tok long, doc long")
    holders = rows.groupBy("tok").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"))
    own = holders.where("doc = last").groupBy("doc").agg(F.count(F.lit(1)).alias("own"))
    sizes = sets.select("doc", "parity", (F.octet_length("tokens") / 8).cast("long").alias("n"))
    counted = sizes.join(own, "doc", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    return counted.where(F.col("own") * t.den <= F.col("n") * (t.den - t.num))


def _different_entries(entries: DataFrame, doc: str) -> DataFrame:
    """The entries (sig, ``doc``) of several documents; of those with the same documents, one.

    Near copies share most of their entries, which would all bring the same pairs together.
    """
    held = entries.groupBy("sig").agg(
        F.min(doc).alias("low"),
        F.max(doc).alias("high"),
        F.count(F.lit(1)).alias("times"),
        *(F.bit_xor(F.xxhash64(F.lit(seed), doc)).alias(f"xor{seed}") for seed in (1, 2)),
    )
    chosen = held.where("low <> high").groupBy("low", "high", "times", "xor1", "xor2").agg(F.min("sig").alias("sig"))
    return entries.join(chosen.select("sig"), "sig")


def _connect(shared: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """(node, component) of documents with a link, from index entries (sig, doc, n, own, parity).

    An entry's documents are first compared with the one that has the fewest tokens of
    its own, the hub. Documents that are then in one component need no comparison with
    each other; the others are compared in full, unless their sizes, own tokens or parity
    sketches alone show that too many tokens differ.
    """
    spark = shared.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    found = None
    sides = ("doc", "n", "own", "label", "parity")
    for turn in range(HUB_ROUNDS + 1):
        if found is None:
            open_ = shared.withColumn("label", F.col("doc"))
        else:
            labelled = shared.join(found.withColumnRenamed("node", "doc"), "doc", "left")
            open_ = labelled.withColumn("label", F.coalesce("component", "doc")).drop("component")
        hubs = open_.groupBy("sig").agg(
            F.min("label").alias("low"),
            F.max("label").alias("high"),
            F.min(F.struct("own", "doc", "label", "n", "parity")).alias("o"),
        )
        hubs = hubs.where("low <> high")
        if turn < HUB_ROUNDS:
            hubs = hubs.select("sig", *(F.col(f"o.{c}").alias(f"o_{c}") for c in sides))
            near = open_.join(hubs, "sig").where("label <> o_label")
        else:
            left = open_.join(hubs.select("sig"), "sig")
            right = left.select("sig", *(F.col(c).alias(f"o_{c}") for c in sides))
            near = left.join(right, "sig").where("doc < o_doc and label <> o_label")
        near = near.where(F.greatest("n", "o_n") * t.num <= F.least("n", "o_n") * t.den)
        # Tokens that must differ, against the most that may between similar sets.
        most = (F.col("n") + F.col("o_n")) * (t.den - t.num)
        near = near.where((F.col("own") + F.col("o_own")) * (t.den + t.num) <= most)
        words = (F.get("parity", F.lit(k)).bitwiseXOR(F.get("o_parity", F.lit(k))) for k in range(PARITY_WORDS))
        odd = reduce(add, (F.bit_count(word) for word in words))
        near = near.where(odd * (t.den + t.num) <= most)
        pairs = near.select(F.greatest("doc", "o_doc").alias("a"), F.least("doc", "o_doc").alias("b"))
        new = _links(pairs.distinct(), sets, t)
        if new.isEmpty():
            continue
        links = links.unionByName(new)
        found = components(links)
    return found if found is not None else spark.createDataFrame([], "node long, component long")


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    size: int = 5, num: int = 8, den: int = 10,
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of each row of ``docs``.

    Documents are linked when the sets of their ``size``-word shingles (A-Z lower-cased)
    have a Jaccard similarity of at least ``num / den``; a component's id is the smallest
    id in it. Null, empty and blank texts have no shingles and stay alone; a null id is
    linked with nothing and its component is null; rows that share an id are one
    document with several texts. Other columns are ignored.
    """
    t = Threshold(num, den)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_shingles long, fp1 long, fp2 long, often array<long>, times array<long>"
    described = store(docs.mapInArrow(_describe(size), schema))
    key = ["fp1", "fp2", "n_shingles"]

    often = described.select(F.explode(F.arrays_zip("often", "times")).alias("x"))
    total = described.count()
    hot = often.groupBy("x.often").agg(F.sum("x.times").alias("n"))
    hot = hot.where(F.col("n") >= max(64, total // HOT_SHARE)).select("often").toPandas()
    hot_tokens = np.sort(hot["often"].to_numpy(dtype=np.int64).view(np.uint64))

    reps = described.where("n_shingles > 0 and doc_id is not null")
    reps = reps.groupBy(*key).agg(F.min("doc_id").alias("doc"))

    rows = docs.where("doc_id is not null").select("text")
    rows = rows.mapInArrow(_emit_tokens(size, t, hot_tokens), "tok long, node long, meta array<long>")
    by_token = Window.partitionBy("tok").orderBy("node")
    whole = by_token.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns(
        {
            "df": F.count(F.lit(1)).over(whole),
            "low": F.first("node").over(whole),
            "high": F.last("node").over(whole),
            "previous": F.lag("node").over(by_token),
        }
    )
    fresh = F.col("previous").isNull() | (F.col("previous") != F.col("node"))
    rows = rows.where(F.col("meta").isNotNull() | ((F.col("low") != F.col("high")) & fresh))
    token = F.when(F.col("meta").isNull(), F.struct("df", "tok"))
    sets = rows.groupBy("node").agg(
        F.collect_list(token).alias("tokens"), F.first("meta", ignorenulls=True).alias("meta")
    )
    sigs = sets.mapInArrow(_emit_signatures(t), "sig long, node long")
    sigs = store(sigs)
    shared = _different_entries(sigs, "node")
    by_node = reps.select(F.col("fp1").alias("node"), "doc")
    shared = store(shared.join(by_node, "node").select("sig", "doc"))

    wanted = shared.select("doc").distinct()
    wanted = wanted.join(by_node, "doc").select(F.col("doc").alias("doc_id"), "node")
    texts = docs.join(wanted, "doc_id").select("doc_id", "text", "node")
    token_sets = store(texts.mapInArrow(_emit_sets(size), "doc long, tokens binary, parity array<long>").distinct())
    able = store(_own_tokens(token_sets, t))
    shared = store(_different_entries(store(shared.join(able, "doc")), "doc"))
    found = _connect(shared, token_sets, t)

    named = described.select("doc_id", *key).join(reps, key, "left")
    named = named.join(found.withColumnRenamed("node", "doc"), "doc", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    component = component.otherwise(F.coalesce("component", "doc"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    # Rows that share an id share its component.
    return named.select("doc_id", "n_shingles", component.alias("component_id"))
