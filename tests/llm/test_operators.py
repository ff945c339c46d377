"""Each operator against a plain restatement, on awkward small tables."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.llm import (
    chat,
    line_dedup,
    near_dedup,
    ngram_join,
    oracle,
    packing,
    quality,
    queries,
    secret_scan,
    sharding,
    token_output,
)
from patchloom.llm.bpe import bpe
from patchloom.llm.components import components
from patchloom.llm.queries import VOCABULARY
from tokenizers import Tokenizer

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, h1 string, n_words string, _text string"


def table(spark, texts, source="a"):
    rows = [(i, t, source, "x", "y", "z") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "K", "the", "of"]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 400))] for _ in range(25)]
    out = [None, "", "   \n\t", "one", "One", "two words", "two  WORDS", "x" * 50_000, "a b " * 9_000]
    for b in base:
        for _ in range(rng.randint(1, 8)):
            copy = list(b)
            for _ in range(rng.randint(0, max(1, len(b) // 40))):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    out += out[-3:] + ["line\n" * 5, "l" * 45 + "\nshort\n " + "L" * 45 + " "] + ["m" * 45 + f"\n{i}" for i in range(6)]
    return list(enumerate(out))


def components_of(sets, linked):
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if linked(sets[a], sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


@pytest.mark.parametrize(("size", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_ngram_join(spark, texts, size, num, den):
    sets = {}
    for d, t in texts:
        w = (t or "").encode().lower().split()
        runs = [tuple(w)] if 0 < len(w) < size else list(zip(*(w[i:] for i in range(size))))
        sets[d] = frozenset(runs)
    want = components_of(sets, lambda x, y: x and y and den * len(x & y) >= num * len(x | y))
    got = ngram_join.similar_documents(table(spark, texts), size=size, num=num, den=den).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {d: (len(sets[d]), want[d]) for d in sets}
    assert len(set(want.values())) < len(want) - 10


def test_ngram_join_null_id_and_empty_table(spark):
    rows = [(None, "a b c d"), (3, "a b c d"), (3, "e f g h"), (4, "e f g h")]
    got = ngram_join.similar_documents(table(spark, rows), size=3, num=9, den=10).collect()
    assert sorted((r[0], r[2]) for r in got if r[0]) == [(3, 3), (3, 3), (4, 3)]
    assert [r[2] for r in got if r[0] is None] == [None]
    assert ngram_join.similar_documents(table(spark, [])).count() == 0


def test_entries_of_the_same_documents_are_kept_once(spark):
    held = {1: {7, 8}, 2: {7, 8}, 3: {7, 8, 9}, 4: {9}, 5: {7, 9}, 6: {7, 8, 9}}
    rows = [(sig, doc) for sig, docs in held.items() for doc in docs]
    entries = spark.createDataFrame(rows, "sig long, doc long")
    got = {tuple(r) for r in ngram_join._different_entries(entries, "doc").select("sig", "doc").collect()}
    assert got == {(s, d) for s in (1, 3, 5) for d in held[s]}
    assert ngram_join._different_entries(entries.limit(0), "doc").count() == 0


def test_parity_never_differs_in_more_places_than_sets():
    rng = np.random.default_rng(3)
    for size in (0, 1, 40, 3_000):
        one = np.unique(rng.integers(0, 1 << 62, size, dtype=np.uint64))
        for new in (0, 1, 30, 2_000):
            two = np.union1d(one[new // 2 :], rng.integers(0, 1 << 62, new, dtype=np.uint64))
            bits = np.unpackbits((ngram_join.parity(one) ^ ngram_join.parity(two)).view(np.uint8)).sum()
            assert bits <= len(np.setxor1d(one, two)) and (new or not bits)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80)], "a long, b long")
    got = {r[0]: r[1] for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {80: 80, 90: 80}


def spans_of(text):
    text = text or ""
    assign = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
    )
    out = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    base = sorted(out)

    def candidate(c, run):
        for p in re.split(c.allowed, run):
            if len(p) >= secret_scan.WINDOW and all(re.search(n, p) for n in c.needs):
                sums = [
                    sum(secret_scan.TERMS[n] for n in Counter(p[i : i + secret_scan.WINDOW]).values())
                    for i in range(len(p) - secret_scan.WINDOW + 1)
                ]
                if min(sums) <= c.most:
                    return True
        return False

    place = 3
    for c in secret_scan.CLASSES:
        out += [(m.start(), place, m.end(), c.kind) for m in re.finditer(c.pattern, text) if candidate(c, m[0])]
        place += 1
    wide = list(out)
    for c in secret_scan.ONE_CASE:
        for m in re.finditer(c.pattern, text):
            held = any(s <= m.start() and m.end() <= e for s, _, e, _ in wide)
            if not held and candidate(c, m[0]):
                out.append((m.start(), place, m.end(), c.kind))
        place += 1
    name = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
    return name(base), name(out)


def test_secrets(spark, texts):
    rng = random.Random(3)
    mixed = "".join(rng.choice(secret_scan.CLASSES[0].alphabet[:62]) for _ in range(400))
    more = [
        "ö secret=token:abcdefgh API_KEY = 'abc.def=' password=12345", "Token:'AKIAAKIA" + "A1" * 12,
        f"😀 {mixed[:40]} and {'ab12' * 8}", mixed * 40, "0123456789abcdef" * 30, "token==" * 40, None, "",
        "550e8400-e29b-41d4-a716-446655440000 EXAMPLE" + mixed[:20],
    ]
    rows = texts + [(1000 + i, t) for i, t in enumerate(more)] + [(1000, more[0])]
    got = secret_scan.find_secrets(table(spark, rows))
    listed = got.select(
        "doc_id", "text", secret_scan.listed(F.col("base")), secret_scan.listed(F.col("secrets")),
        secret_scan.redacted(F.col("text"), F.col("secrets")),
    ).collect()
    assert len(listed) == len(rows)
    for _, text, base, every, clean in listed:
        assert (base, every) == spans_of(text)
        if text:
            assert not re.search("AKIA[A-Z0-9]{16}", clean)
            assert (clean == text) == (every == "")
    assert any("entropy_base64" in r[3] for r in listed)


def test_secrets_beside_allowed_words_and_of_one_case(spark):
    rng = random.Random(11)

    def key(alphabet, n=40):
        return "".join(rng.choice(alphabet) for _ in range(n))

    base64, one_case = secret_scan.CLASSES[0].alphabet[:64], [c.alphabet for c in secret_scan.ONE_CASE]
    made = [(p, key(base64)) for p in ("credentials/", "production_", "my-sample-") for _ in range(50)]
    made += [("", key(base64, 800) + "abcdefghijklm" + key(base64, 800)) for _ in range(5)]
    made += [("", key(a)) for a in one_case for _ in range(50)]
    rows = [(i, f"see {p}{k}.") for i, (p, k) in enumerate(made)]
    plain = ["internationalization/administration_2024/01", "sampleexampledummysampleexample12", "x" * 60 + "1234"]
    rows += [(1000 + i, t) for i, t in enumerate(plain)]
    got = secret_scan.find_secrets(table(spark, rows)).select("doc_id", "text", "secrets", secret_scan.redacted(F.col("text"), F.col("secrets"))).collect()
    every = secret_scan.find_secrets(table(spark, rows)).select("text", secret_scan.listed(F.col("secrets"))).collect()
    assert all(spans == spans_of(text)[1] for text, spans in every)
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", rows + [(1, None), (1, "see AKIA" + "B2" * 12)])
    assert sorted(r[5] for r in duck.sql(oracle.OP2).fetchall()) == sorted([s for _, s in every] + ["", spans_of("see AKIA" + "B2" * 12)[1]])
    assert {k.split(":")[0] for _, s in every for k in s.split(",") if k} >= {"entropy_base64", "entropy_upper", "entropy_lower"}
    lost = [made[r[0]] for r in got if r[0] < 1000 and made[r[0]][1] in r[3]]
    assert len(lost) <= 0.03 * len(made), lost
    assert all(r[3] == r[1] for r in got if r[0] >= 1000)
    held = secret_scan.find_secrets(table(spark, [(1, f"token={key(one_case[1])} {'0a1b2c3d4e5f' * 3}")])).first()
    assert [s.kind for s in held.secrets if s.kind == "entropy_lower"] == []


def test_secrets_leave_other_columns_alone(spark):
    names = ["doc_id", "text", "_text", "_hex", "_found", "_entropy_upper", "_row", "a.b", "base"]
    df = spark.createDataFrame([(1, "x " + "0a" * 12, "t", "h", "f", "e", "r", "d", "old")], names)
    got = secret_scan.find_secrets(df).first().asDict()
    assert {n: got[n] for n in names[:-1]} == dict(zip(names[:-1], df.first()))
    assert got["n_hex"] == 1 and len(got["base"]) == 1


def test_patterns_are_laid_whole_and_reach_the_bound():
    rng = np.random.default_rng(9)
    for lengths in (rng.geometric(1 / 900, 4000), rng.integers(1, 4097, 3000), np.full(999, 1365), rng.choice([4096, 2048, 1024, 100], 2000)):
        counts = np.bincount(np.minimum(lengths, 4096), minlength=4097)
        sequences = packing.plan(counts)
        used = np.zeros(4097, int)
        for row, times in sequences:
            assert sum(row) <= 4096
            for n in row:
                used[n] += times
        assert (used == counts).all()
        bound = -(-int(counts @ np.arange(4097)) // 4096)
        if lengths[0] != 1365 and len(set(lengths.tolist())) > 10 and lengths.mean() < 1500:
            assert sum(t for _, t in sequences) == bound
        assert sum(t for _, t in sequences) <= 1.12 * bound


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        assert sorted(token_output.feistel(np.arange(n), n)) == list(range(n))


def test_token_shards_round_trip(spark, texts, tmp_path):
    docs = table(spark, texts)
    records = token_output.training_order(docs, VOCABULARY, stride=16, shard_records=50)
    rows = records.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(r.shard == r.slot // 50 and r.byte_offset == r.slot % 50 * 32 for r in rows)
    path = f"file://{tmp_path}/shards"
    token_output.write_shards(records, path)
    by_slot = {r.slot: bytes(r.record) for r in rows}
    for slot, ids in enumerate(token_output.read_records(path, 7, len(rows), 16, 50), 7):
        assert ids.tobytes() == by_slot[slot]
    library = Tokenizer.from_file(VOCABULARY)
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.piece):
        found[r.doc_id] += np.frombuffer(bytes(r.record), "<u2")[: r.n_tokens].tolist()
    for d, t in texts:
        assert found[d] == [*library.encode(t or "", add_special_tokens=False).ids, 1]
    assert token_output.training_order(table(spark, []), VOCABULARY).count() == 0


def test_token_ids_over_16_bits_are_an_error(spark):
    with pytest.raises(Exception, match="id 65536 does not fit 16 bits"):
        token_output.training_order(table(spark, [(1, "a b")]), VOCABULARY, end_id=1 << 16).count()


def test_shards(spark, texts):
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, "", "", "") for i, t in texts] + [(None, "q", "lone", "", "", "")] * 2
    got = sharding.stratified_shards(spark.createDataFrame(rows, SCHEMA), 8).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    want = {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts}
    assert all((r.size, r.text_crc32) == want[r.doc_id] for r in got if r.doc_id is not None)
    source = {d: s for d, _, s, *_ in rows}
    mix = Counter((r.shard, source[r.doc_id]) for r in got if r.doc_id is not None)
    for s in ("s0", "s1", "s2"):
        counts = [mix[k, s] for k in range(8)]
        assert max(counts) - min(counts) <= 2
    assert sharding.stratified_shards(table(spark, []), 8).count() == 0


def test_shards_equal_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    want = duck.sql(oracle.OP4_PLACES)
    got = queries.op4_sharding(spark, SF_DIR).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_chat(spark):
    calls = [
        ("c", "2", 2, "ask", '{"text":"b","after":["1","9"]}'), ("c", "1", 1, "ask", '{"text":"é","turn":true}'),
        ("c", "1", 5, "ask", "{}"), ("c", "x", 3, "ask", '{"after":["y"]}'), ("c", "y", 4, "ask", '{"after":["x"]}'),
        ("d", "2", 0, "none", "no json"), (None, "1", 0, "ask", None), ("c", None, 7, "ask", None),
    ]
    results = [("c", "1", 9, "one"), ("c", "8", 10, "lost"), (None, "1", 1, "n")]
    tools = {"ask": {"properties": {"text": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["text"]}}
    got = chat.link_calls(
        spark.createDataFrame(calls, "conv_id string, call_id string, seq long, name string, arguments string"),
        spark.createDataFrame(results, "conv_id string, call_id string, seq long, content string"),
        tools,
    ).collect()
    rows = {(r.conv_id, r.call_id, r.state): r for r in got}
    assert len(got) == 9
    first = rows["c", "1", "answered"]
    assert first.message == '{"arguments":{"text":"é","turn":true},"call_id":"1","name":"ask","result":"one"}'
    assert (first.level, first.position, first.problems) == (0, 0, "turn is not integer")
    assert rows["c", "2", "open"].level == 1 and rows["c", "2", "open"].position == 1
    assert rows["c", "x", "open"].level is None and rows["c", "x", "open"].problems == "missing text"
    assert rows["c", "8", "unasked"].problems == "" and rows["d", "2", "open"].problems == "arguments are not JSON"


def test_chat_keeps_repeated_calls_and_results(spark, tmp_path):
    rows = [("1", 0, "user", "a"), ("1", 0, "user", "b"), ("1", 0, "user", "b"), ("1", 1, "assistant", "x"), ("1", 1, "assistant", "y")]
    rows += [("1", 2, "user", "c"), ("2", 1, "assistant", "z"), ("2", 1, "assistant", "z")]
    spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op5_chat_formatting(spark, str(tmp_path)).collect()
    seen = Counter((r.conv_id, r.state, m.get("result"), (m.get("arguments") or {}).get("text")) for r in got for m in [json.loads(r.message)])
    assert seen == Counter(
        {
            ("1", "answered", "x", "a"): 1, ("1", "repeated_call", None, "b"): 2, ("1", "repeated_result", "y", None): 1,
            ("1", "open", None, "c"): 1, ("2", "unasked", "z", None): 1, ("2", "repeated_result", "z", None): 1,
        }
    )
    assert len({(r.conv_id, r.position) for r in got}) == len(got)
    assert all((r.level is None) == (r.state not in ("answered", "open")) for r in got)


def test_chat_query_answers(spark):
    got = queries.op5_chat_formatting(spark, SF_DIR).collect()
    turns = spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect()
    assert len({(r.conv_id, r.position) for r in got}) == len(got)
    asked = {(str(t.conv_id), t.turn): t for t in turns if t.role != "assistant"}
    assert sum(r.state != "unasked" for r in got) == len(asked)
    for r in got:
        if r.state == "answered":
            assert json.loads(r.message)["arguments"]["text"] == asked[r.conv_id, r.seq].text


def test_bpe_equals_the_library(texts):
    rng = random.Random(1)
    letters = "abcdelmrstv'’ \n\t.,12²½éÉßΣςİı中日한<|endoftext|>\xa0\x85_-😀"
    some = [t for _, t in texts if t] + ["", "x" * 9_000, "ab" * 3_000, "IT'S we'Ll ''s !'t"]
    some += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3_000)]
    library, own = Tokenizer.from_file(VOCABULARY), bpe(VOCABULARY)
    for _ in range(2):  # the second time from the cache
        for want, ids in zip(library.encode_batch(some, add_special_tokens=False), own.encode(some), strict=True):
            assert ids.tolist() == want.ids
            assert own.decode(ids).decode() == library.decode(want.ids, skip_special_tokens=False)
        own._forget() if _ else None


def test_bpe_query(spark):
    library = Tokenizer.from_file(VOCABULARY)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in queries.op6_bpe(spark, SF_DIR).collect():
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        text = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16))
    x[100:300] = x[:200] + rng.normal(size=(200, 16)) * 0.2
    x[300:340] = x[0]
    x[340:400] = x[1] + rng.normal(size=(60, 16)) * 0.25
    x = x.astype(np.float32).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = (unit @ unit.T) >= 0.9
    rows = [(i, v.tolist(), "n") for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0]]
    rows += [(1000 + i, v, "n") for i, v in enumerate(odd)] + [(None, x[0].tolist(), "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")
    got = {r.vec_id: r for r in near_dedup.near_duplicates(df).collect()}
    want = components_of({i: i for i in range(600)}, lambda a, b: linked[a, b])
    counts = linked.sum(1) - 1
    found = sum(got[i].n_links for i in range(600))
    assert 0.9 * counts.sum() <= found <= counts.sum()
    assert all(got[i].n_links <= counts[i] for i in range(600))
    assert sum(got[i].component_id == want[i] for i in range(600)) >= 590
    assert all(got[1000 + i][1:] == (0, 1000 + i, True) for i in range(len(odd)))
    assert near_dedup.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_near_vectors_of_odd_and_rare_widths(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 15))
    x[100:200] = x[:100] + rng.normal(size=(100, 15)) * 0.1
    few = rng.normal(size=(40, 8))
    few[20:] = few[:20] * 2 + rng.normal(size=(20, 8)) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v.tolist()) for i, v in enumerate(few)]
    rows += [(2000, [1.0, 2.0, 3.0]), (2001, [2.0, 4.0, 6.0]), (2002, [5.0]), (2003, [-3.0]), (2004, [7.0])]
    got = {r.vec_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for some, start, least in ((x, 0, 0.98), (few, 1000, 1)):
        unit = some / np.linalg.norm(some, axis=1)[:, None]
        counts = (unit @ unit.T >= 0.9).sum(1) - 1
        found = [got[start + i].n_links for i in range(len(some))]
        assert counts.sum() and least * counts.sum() <= sum(found) and all(f <= c for f, c in zip(found, counts))
    ends = [(got[i].n_links, got[i].component_id) for i in range(2000, 2005)]
    assert ends == [(1, 2000), (1, 2000), (1, 2002), (0, 2003), (1, 2002)]


@pytest.mark.parametrize("limit", [16, 4096])
def test_packing_plan(limit):
    rng = np.random.default_rng(limit)
    lengths = np.minimum(rng.lognormal(np.log(limit / 6), 1, 20_000).astype(int) + 1, limit)
    counts = np.bincount(lengths, minlength=limit + 1)
    plan = packing.plan(counts, limit)
    used = Counter()
    for some, times in plan:
        assert sum(some) <= limit and times > 0
        for n in some:
            used[n] += times
    assert used == Counter(lengths.tolist())
    assert sum(t for _, t in plan) <= 1.01 * lengths.sum() / limit + 1
    assert packing.plan(np.zeros(limit + 1, int), limit) == []


def test_packing(spark, texts):
    library = Tokenizer.from_file(VOCABULARY)
    got = packing.pack_documents(table(spark, [*texts, texts[3]]), VOCABULARY).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for d, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = [ids[i : i + 4096] for i in range(0, len(ids), 4096)]
        want = [(k, 4096 * k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(pieces)]
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[d])
        assert own == sorted(want * (2 if d == texts[3][0] else 1))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(table(spark, []), VOCABULARY).count() == 0


def test_lines(spark, texts):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if c.isascii() else c for c in k)

    holders = defaultdict(set)
    for d, t in texts:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(d)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    got = {r.doc_id: r for r in line_dedup.dedup_lines(table(spark, texts)).collect()}
    dropped = 0
    for d, t in texts:
        lines = (t or "").split("\n")
        stay = [x for x in lines if keeper.get(key(x), d) == d]
        dropped += len(lines) - len(stay)
        assert (got[d].n_lines, got[d].n_dropped) == (len(lines), len(lines) - len(stay))
        assert got[d].kept_text == "\n".join(stay)
    assert dropped
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0
    names = ["doc_id", "text", "_gone", "_lines", "_stays", "_row", "_id", "h1", "n_lines"]
    clash = spark.createDataFrame([(i, "long " * 10 + "\n%d" % i, "g", "l", "s", "r", "i", "h", "old") for i in range(5)], names)
    kept = line_dedup.dedup_lines(clash).collect()
    assert all(tuple(r[n] for n in names[2:-1]) == ("g", "l", "s", "r", "i", "h") for r in kept)
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in kept) == [(i, 2, int(i < 4)) for i in range(5)]
    before = {r[0] for r in spark.sql("SHOW DATABASES").collect()}
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        line_dedup.dedup_lines(clash.withColumn("text", F.expr("string(1 / (doc_id - 3))")))
    assert {r[0] for r in spark.sql("SHOW DATABASES").collect()} == before
    nulls = line_dedup.dedup_lines(table(spark, [(None, "n" * 50)] * 5)).collect()
    assert [r.n_lines for r in nulls] == [1] * 5


def test_quality_counts(spark, texts):
    def base(t):
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        runs = list(zip(words, words[1:], words[2:]))
        often = Counter(runs)
        again = {i + k for i, r in enumerate(runs) if often[r] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), failed)

    more = [(2000, "# a|b\n# a|b\n \n \n[x]"), (2001, "ä 中 " * 40), (2002, None)]
    for r in quality.judge(table(spark, [*texts, *more]), None).collect():
        want = base(dict([*texts, *more])[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.kept == (not want[-1])
    assert quality.judge(table(spark, []), None).count() == 0


def test_quality_model_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    known = labels.where("doc_id % 3 <> 0")
    model = quality.fit(docs, known, 1_500)
    rest = quality.judge(docs.join(labels.where("doc_id % 3 = 0"), "doc_id"), model).where("not base_failed")
    right = rest.where((F.col("good") >= 0.5) == (F.col("quality") == 1)).count()
    assert right >= 0.9 * rest.count()
    assert quality.fit(docs, known.where("quality = 1"), 100) is None


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    want = duck.sql(oracle.oracle_sql()[name])
    got = queries.QUERIES[name](spark, SF_DIR).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = p.quality_rules(spark, docs, SF_DIR)
    lines = p.repeated_lines(spark, kept, SF_DIR)
    single = p.near_copies(spark, lines, SF_DIR)
    clean = p.secrets(spark, single, SF_DIR)
    assert all(df.columns == docs.columns for df in (kept, lines, single, clean))
    texts = {r.doc_id: r.text for r in single.collect()}
    sets = {d: frozenset(zip(*(t.encode().lower().split()[i:] for i in range(5)))) for d, t in texts.items()}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            assert 10 * len(sets[a] & sets[b]) < 8 * len(sets[a] | sets[b]) or not sets[a]
    assert {r.doc_id for r in clean.collect()} == set(texts)
    assert {r.doc_id for r in p.run(spark, SF_DIR).collect()} == set(texts)


def test_near_copies_of_repeated_rows_and_null_ids(spark):
    import corpus_pipeline as p

    words = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(5)]
    near = words[0] + " more"
    rows = [(5, words[0], "en", "b"), (5, words[0], "en", "b"), (5, words[0], "en", "a"), (7, near, "en", "a"), (None, near, "en", "a")]
    rows += [(None, words[1], "en", "a"), (None, words[1], "de", "a"), (None, words[1] + " more", "en", "a"), (8, words[2], "en", "a")]
    rows += [(9, words[3], "en", "a"), (9, words[4], "en", "a"), (None, None, "en", "a"), (None, None, "en", "a"), (None, "", "en", "a")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r) for r in p.near_copies(spark, docs, SF_DIR).select("doc_id", "text", "source").collect()]
    alone = [r for r in got if r[0] is None and r[1]]
    assert len(alone) == 1 and alone[0][1] in (words[1], words[1] + " more")
    rest = [r for r in got if r not in alone]
    want = [(5, words[0], "a"), (8, words[2], "a"), (9, words[3], "a"), (9, words[4], "a"), (None, None, "a"), (None, "", "a")]
    assert sorted(map(repr, rest)) == sorted(map(repr, want))
