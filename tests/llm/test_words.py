"""Words that simple hashes confuse, and scores that must not depend on a text's neighbours."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from patchloom.llm import ngram_join, quality
from patchloom.llm.bpe import bpe
from patchloom.llm.queries import VOCABULARY
from patchloom.llm.words import blocks, shingle_sets


def morse(n, a="a", b="b"):
    """The Thue-Morse word: it and its complement collide modulo 2^64 for every base."""
    out = a
    while len(out) < n:
        out += "".join(b if c == a else a for c in out)
    return out[:n]


WORDS = [morse(n, *ab) for n in (1024, 2048, 4096) for ab in ("ab", "ba")]


def test_ids_of_confusable_words():
    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    texts = [*WORDS, " ".join(WORDS)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in bpe(VOCABULARY).encode(texts)] == want
    assert want[0] != want[1]


@pytest.mark.parametrize("size", [3, 5])
def test_shingles_of_confusable_words(size):
    rest = " one two three four five six"
    sets = [set(s.tolist()) for _, s in shingle_sets(pa.array([w + rest for w in WORDS]), size)]
    assert all(not (a ^ b) == set() for i, a in enumerate(sets) for b in sets[:i])
    mixed = next(shingle_sets(pa.array([" ".join(w + rest for w in WORDS)]), size))[1]
    plain = " ".join(w + rest for w in WORDS).split()
    assert len(mixed) == len(set(zip(*(plain[k:] for k in range(size)))))


def test_confusable_documents_are_not_linked(spark):
    texts = [f"{w} a b" for w in WORDS]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ngram_join.similar_documents(docs, size=3, num=9, den=10).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i for i in range(len(texts))}


def test_repeated_words_of_confusable_words():
    for a, b in zip(WORDS[::2], WORDS[1::2]):
        for _, block in blocks(pa.array([f"{a} x y {b} x y", f"{a} x y {a} x y"])):
            starts, ends, bounds = block.words()
            found = quality._repeated_words(block.span_hash(block.prefix(False), starts, ends), bounds)
            assert found.tolist() == [0, 6]


def test_span_hashes_tell_random_spans_apart():
    rng = random.Random(2)
    text = "".join(rng.choice("abé ") for _ in range(20_000))
    _, block = next(blocks(pa.array([text])))
    starts, ends, _ = block.words()
    raw, seen = block.data.tobytes(), {}
    for a, b, h in zip(starts, ends, block.span_hash(block.prefix(False), starts, ends).tolist()):
        assert seen.setdefault(h, raw[a:b]) == raw[a:b]
    assert len(seen) == len(set(raw.split()))


def model(seed):
    rng = np.random.default_rng(seed)
    weights = rng.normal(size=(quality.GROUPS, 1 << quality.BITS)).astype(np.float32)
    return quality.Model(weights, 0.1, 1.3, -0.2)


def test_a_quality_score_does_not_depend_on_the_batch():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc dé\n") for _ in range(rng.randint(0, 3000))) for _ in range(40)] + ["", "x", "long " * 30_000]
    fitted = model(1)
    together = np.concatenate([fitted.probability(block) for _, block in blocks(pa.array(texts))])
    alone = [fitted.probability(next(blocks(pa.array([t])))[1])[0] for t in texts]
    assert together.tolist() == alone


def test_regression_finds_the_minimum():
    rng = np.random.default_rng(5)
    true = rng.normal(size=6)
    rows = []
    for _ in range(400):
        places = np.sort(rng.choice(6, rng.integers(0, 5), replace=False)).astype(np.int32)
        values = rng.normal(size=len(places))
        odds = values @ true[places] + 0.3
        rows.append((float(rng.random() < 1 / (1 + np.exp(-odds))), places, values))
    table = quality.Rows(rows)
    weights = quality.regression(table, 6, penalty=1e-3, steps=200)
    value, gradient = table.loss(weights, 1e-3)
    assert np.abs(gradient).max() < 1e-3
    for k in range(7):
        for step in (-1e-2, 1e-2):
            moved = weights.copy()
            moved[k] += step
            assert table.loss(moved, 1e-3)[0] > value


def test_calibration_recovers_a_slope():
    rng = np.random.default_rng(6)
    scores = rng.normal(size=4000)
    labels = (rng.random(4000) < 1 / (1 + np.exp(-(2.5 * scores - 1)))).astype(float)
    slope, offset = quality.calibration(scores, labels)
    assert slope == pytest.approx(2.5, abs=0.3)
    assert offset == pytest.approx(-1, abs=0.2)


def test_only_kept_rows_come_back(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(80)), "n"), (2, "short", "n"), (3, None, "n")], "doc_id long, text string, kept string")
    every = quality.judge(docs, None)
    some = quality.judge(docs, None, only_kept=True)
    assert some.columns == every.columns
    assert [r["doc_id"] for r in some.collect()] == [r["doc_id"] for r in every.where("kept").collect()] == [1]
