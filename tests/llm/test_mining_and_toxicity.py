"""Hard negatives against all pairs; the toxicity model against a plain learner and held-out rows."""

import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from patchloom.llm import hard_negatives, oracle, queries, toxicity
from patchloom.llm.words import blocks

VECTORS = "vec_id long, embedding array<double>, label int, width int, slot int, score int, ids string"
DOCS = "doc_id long, text string, label int, places string, held_out int, score int"
SF_DIR = "/root/testdata/sf0.01"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, 3, "x") for i, label, v in rows], VECTORS)


def rows_of(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        width = rng.choice((4, 4, 4, 4, 3, 1))
        v = [rng.choice((0.5, 1.0, 0.25, -0.3, rng.uniform(-1, 1))) for _ in range(width)]
        out.append((i * 10 if i < 60 else 600 + i, rng.randrange(3), v))
    hot = [0.9, 0.8, 0.7, 0.6]  # a third of all rows, with tied scores
    out += [(10_000 + i, i % 4, hot) for i in range(n // 2)] + [(10_000, 0, hot), (10_003, 1, [0.1] * 4)]
    odd = [None, [], [None, 1.0, 1.0, 1.0], [math.nan] * 4, [math.inf] * 4, [0.0] * 4, [-1.0] * 4, [-0.001] * 4]
    out += [(20_000 + 100 * k, 1, v) for k, v in enumerate(odd)]
    out += [(None, 1, hot), (30_000, None, hot), (100, 0, [0.5] * 4)]
    rng.shuffle(out)
    return out


def brute(rows, positives=5, negatives=5):
    known = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        known.setdefault((i, label, tuple(v)), tuple(math.floor(256 * x) for x in v))
    out = set()
    anchors = {}
    for i, label, v in sorted(known):
        if i % 100 == 0:
            anchors.setdefault(i, (i, label, v))
    for key in anchors.values():
        a, own, _ = key
        at = known[key]
        scored = {
            (-sum(x * y for x, y in zip(at, w)), i, label == own)
            for (i, label, _), w in known.items()
            if i != a and len(w) == len(at)
        }
        for p, pid, same in sorted(s for s in scored if s[2])[:positives]:
            hits = sorted((s, i) for s, i, same in scored if not same and 80 * -p <= 100 * -s <= 100 * -p)
            out |= {(a, pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(hits[:negatives])}
    return out


@pytest.mark.parametrize("at_once", [64, 1])
def test_hard_negatives(spark, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(hard_negatives, "AT_ONCE", at_once)
    monkeypatch.setattr(hard_negatives, "ANCHOR_SIZE", 300)
    rows = rows_of(1, 300)
    vectors(spark, rows).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in queries.op11_hard_negatives(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)
    assert len(got) > 100


def test_hard_negatives_by_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_DIR}/embeddings.parquet'")
    got = sorted(tuple(r) for r in queries.op11_hard_negatives(spark, SF_DIR).collect())
    assert got == sorted(duck.sql(oracle.OP11).fetchall())


def test_hard_negatives_of_large_components(spark):
    rows = [(0, 1, [3e3, 1.0]), (1, 1, [5e9, -2.0]), (2, 2, [4.6e9, 0.0]), (3, 2, [1.0, 0.0])]
    found = hard_negatives.participants(vectors(spark, rows))
    got = {tuple(r) for r in hard_negatives.mine(found, found.where("vec_id = 0")).collect()}
    score = lambda a, b: sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))
    assert got == {(0, 1, 1, 2, score(rows[0][2], rows[1][2]), score(rows[0][2], rows[2][2]))}


def test_hard_negatives_of_nothing(spark):
    empty = hard_negatives.participants(vectors(spark, []))
    assert hard_negatives.mine(empty, empty).count() == 0


def test_best_takes_ties_by_id_and_an_id_once_per_score():
    rng = np.random.default_rng(4)
    for _ in range(50):
        ids = np.sort(rng.integers(0, 30, 40))
        scores = rng.integers(0, 4, (6, 40))
        scores[rng.random(scores.shape) < 0.3] = hard_negatives._LOW
        got_scores, got_ids = hard_negatives._best(scores, ids, 5)
        for line, s, i in zip(scores, got_scores, got_ids):
            want = sorted({(-x, y) for x, y in zip(line.tolist(), ids.tolist()) if x > hard_negatives._LOW})[:5]
            assert [(-x, y) for x, y in zip(s.tolist(), i.tolist()) if x > hard_negatives._LOW] == want


# ---- toxicity


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], DOCS)


def corpus(seed, n):
    """Documents in which a few words are toxic, and a word is only where another follows it."""
    rng = random.Random(seed)
    plain = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(("Vile", "foul,", "GRIM!")))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


ODD = [(-1, None), (-2, ""), (-3, " \n\t"), (-4, "!?"), (-5, "w1 " * 60_000), (None, "vile foul grim vile"), (3, "vile foul")]


def plain_model(docs, labels):
    """The same learner, one dictionary entry at a time."""

    def features(text):
        data = pa.array([(text or "").lower()])
        _, block = next(iter(blocks(data)))
        return toxicity.features(block)[0].tolist()

    known = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 5}
    chosen = [(known[i], features(t)) for i, t in docs if i in known]
    return chosen, features


def learn(examples):
    z, n = {}, {}
    size = 1 << toxicity.BITS

    def weight(at):
        limit = 0 if at == size else toxicity.L1
        kept = math.copysign(max(abs(z.get(at, 0)) - limit, 0), z.get(at, 0))
        return -kept / ((toxicity.BETA + math.sqrt(n.get(at, 0))) / toxicity.ALPHA + toxicity.L2)

    def score(places):
        return 1 / (1 + math.exp(-sum(weight(p) for p in [*places, size])))

    for _ in range(toxicity.EPOCHS):
        for label, places in examples:
            g = score(places) - label
            for p in [*places, size]:
                w, old = weight(p), n.get(p, 0)
                z[p] = z.get(p, 0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / toxicity.ALPHA * w
                n[p] = old + g * g
    return score


def test_learner_equals_a_plain_one():
    docs, labels = corpus(2, 150)
    examples, features = plain_model(docs, labels)
    learner = toxicity.Ftrl(1 << toxicity.BITS)
    for _ in range(toxicity.EPOCHS):
        for label, places in examples:
            learner.learn(np.array(places, np.int64), label)
    score = learn(examples)
    weights = learner.weights(np.arange(learner.size + 1))
    for _, text in docs:
        places = features(text)
        got = 1 / (1 + math.exp(-(weights[places].sum() + weights[-1])))
        assert got == pytest.approx(score(places), abs=1e-9)
    assert np.count_nonzero(weights) < 200


def test_features_are_words_pairs_and_skips():
    texts = ["Ab, cd ef-gh", "ab cd EF gh", "ab", "", "cd ab", "é ab é"]
    got = []
    for _, block in blocks(pa.array([t.lower() for t in texts])):
        places, text = toxicity.features(block)
        got = [set(places[text == i].tolist()) for i in range(len(texts))]
    assert got[0] == got[1]
    assert [len(x) for x in got] == [10, 10, 1, 0, 3, 5]
    assert got[2] < got[4]


def test_toxicity(spark, tmp_path):
    docs, labels = corpus(5, 900)
    documents(spark, docs + ODD).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    marks = labels + [(5, 1, None), (None, 1, 1), (7, 0, 2)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = queries.op13_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs) + len(ODD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [None]
    truth = {i: t for i, _, t in labels}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == t for p, t in held) >= 0.98 * len(held)
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[-1] == by_id[-2] == by_id[-3] == by_id[-4] < 0.5
    assert by_id[None] > 0.5


def test_a_score_does_not_depend_on_the_batch(spark):
    docs, labels = corpus(6, 200)
    table = documents(spark, docs)
    model = toxicity.fit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    one = {r["doc_id"]: r["score"] for r in toxicity.score(table.repartition(60), model).collect()}
    other = {r["doc_id"]: r["score"] for r in toxicity.score(table.coalesce(1), model).collect()}
    assert one == other


def test_labels_that_are_held_out_teach_nothing(spark):
    docs, labels = corpus(7, 300)
    table = documents(spark, docs)
    schema = "doc_id long, quality int, toxic int"
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    one, other = (toxicity.fit(table, spark.createDataFrame(x, schema)) for x in (labels, flipped))
    assert one.places.tolist() == other.places.tolist()
    assert one.weights.tolist() == other.weights.tolist()


def test_without_labels_or_documents(spark):
    schema = "doc_id long, quality int, toxic int"
    docs = documents(spark, corpus(8, 20)[0])
    assert toxicity.fit(docs, spark.createDataFrame([], schema)) is None
    rows = toxicity.score(docs, None).collect()
    assert {(r["score"], r["predicted"]) for r in rows} == {(0.0, 0)}
    assert toxicity.score(documents(spark, []), None).count() == 0
    assert toxicity.fit(documents(spark, []), spark.createDataFrame([(1, 1, 1)], schema)) is None


def test_words_keep_to_their_text():
    for _, block in blocks(pa.array(["vile", "vile", "a vile"])):
        places, text = toxicity.features(block)
        assert places[text == 0].tolist() == places[text == 1].tolist()
        assert set(places[text == 0].tolist()) < set(places[text == 2].tolist())
