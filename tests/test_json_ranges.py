"""Array and bundle files, cut into splits of any size, against the standard parser."""

import json
import random

import pytest

from patchloom import schemas
from patchloom.sources import readers, writers
from patchloom.sources.json_ranges import read_records


@pytest.fixture
def split_bytes(spark):
    """Sets the size of file splits for a test."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def set_to(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield set_to
    for name in names:
        spark.conf.unset(name)


def records(seed, n):
    rng = random.Random(seed)
    parts = ["a", "}", "{", '"', "\\", "[", "]", ",", "é", "\n", '"results": [', "x" * 60]

    def text():
        return "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))

    return [
        {"instance_id": f"i{k}", "patch": None if k % 5 == 0 else text(), "model_patch": "m", "deep": [{"a": [text()]}, {}]}
        for k in range(n)
    ]


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("size", [700, 1 << 20])
def test_array_files_of_many_splits(spark, tmp_path, split_bytes, indent, size):
    given = records(1, 60)
    path = tmp_path / "a.json"
    path.write_text(json.dumps(given, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
    split_bytes(size)
    got = readers.read_prediction_array(spark, str(path)).collect()
    tasks = {r["pos"]["block"] for r in got}
    assert (len(tasks) > 10) == (size == 700)
    found = [(r["instance_id"], r["patch"]) for r in sorted(got, key=lambda r: r["pos"])]
    assert found == [(r["instance_id"], "m" if r["patch"] is None else r["patch"]) for r in given]


def test_a_record_longer_than_many_splits(spark, tmp_path, split_bytes):
    given = [{"instance_id": "a", "patch": "{}}" * 700}, {"instance_id": "b", "patch": '"}'}, {"instance_id": "c", "patch": "}" * 900}]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(given))
    split_bytes(300)
    got = sorted(readers.read_prediction_array(spark, str(path)).collect(), key=lambda r: r["pos"])
    assert [(r["instance_id"], r["patch"]) for r in got] == [(r["instance_id"], r["patch"]) for r in given]


@pytest.mark.parametrize("size", [600, 1 << 20])
def test_bundles_of_many_splits(spark, tmp_path, split_bytes, size):
    given = records(2, 40)
    results = [{"instance_id": r["instance_id"], "logs": r["patch"], "passed": True, "more": r["deep"]} for r in given]
    bundle = {
        "config": {"results": [{"instance_id": "no"}], "note": '"results": ['},
        "metrics": {"resolved": 3, "results": [{"instance_id": "no"}]},
        "results": results,
        "other": [{"instance_id": "no", "results": [{"instance_id": "no"}]}],
    }
    path = tmp_path / "b.json"
    path.write_text(json.dumps(bundle, indent=1))
    split_bytes(size)
    got = read_records(spark, str(path), schemas.RESULT, "results", True).collect()
    found = [(r["instance_id"], r["logs"]) for r in sorted(got, key=lambda r: r["pos"])]
    assert found == [(r["instance_id"], r["logs"]) for r in results]
    assert [r["resolved"] for r in readers.read_bundle_metrics(spark, str(path)).collect()] == [3]


def test_last_result_of_an_id_wins(spark, tmp_path):
    for name, passed in (("1.json", [True, False]), ("2.json", [False, True])):
        rows = [{"instance_id": "a", "passed": p} for p in passed] + [{"instance_id": name, "passed": True}]
        (tmp_path / name).write_text(json.dumps({"results": rows}))
    got = readers.read_results(spark, str(tmp_path), last_wins=True).collect()
    assert sorted((r["instance_id"], r["passed"], r["tests_passed"]) for r in got) == [
        ("1.json", True, 0), ("2.json", True, 0), ("a", True, 0),
    ]
    assert [r["resolved"] for r in readers.read_bundle_metrics(spark, str(tmp_path)).collect()] == [None, None]


@pytest.mark.parametrize("text", ['[{"patch": "x"}', '[{"patch": "x}]', '[{"patch": "x"}] oops', "[1, 2]", "[[{}]]", '[{"patch": {]}]'])
def test_damaged_files_fail(spark, tmp_path, text):
    path = tmp_path / "bad.json"
    path.write_text(text)
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_prediction_array(spark, str(path)).collect()


@pytest.mark.parametrize(("text", "count"), [("", 0), (" [ ] ", 0), ('{"patch": "x"}', 1), ('{"patch": "x"}\n', 1), ("[{}]", 1)])
def test_small_files(spark, tmp_path, text, count):
    path = tmp_path / "small.json"
    path.write_text(text)
    assert readers.read_prediction_array(spark, str(path)).count() == count


def test_written_documents_are_what_other_tools_read(spark, tmp_path):
    rows = [("a", 'x"}\n'), ("é", None), ("c", "")]
    df = spark.createDataFrame(rows, "instance_id string, patch string").coalesce(1)
    for write, name in ((writers.write_arrays, "arrays"), (writers.write_prediction_objects, "objects")):
        write(df, str(tmp_path / name))
        write(df.limit(0), str(tmp_path / f"no_{name}"))
    load = lambda name: [json.loads(f.read_text() or "[]") for f in (tmp_path / name).glob("part-*")]
    assert load("arrays") == [[{"instance_id": k, "patch": v} for k, v in rows]]
    assert load("objects") == [dict(rows)]
    assert all(not x for x in load("no_arrays") + load("no_objects"))


def test_written_bundle(spark, tmp_path):
    rows = [("a", True, 1, 0, 0, True, None, 2.0, "l"), ("b", False, 0, 1, 0, True, "x", 4.0, "")]
    df = spark.createDataFrame(rows, schemas.RESULT).repartition(2)
    writers.write_bundle(df, str(tmp_path / "run"), {"workers": 4})
    (file,) = (tmp_path / "run").glob("part-*")
    bundle = json.loads(file.read_text())
    assert bundle["config"] == {"workers": "4"}
    assert bundle["metrics"]["resolved"] == 1
    assert sorted(r["instance_id"] for r in bundle["results"]) == ["a", "b"]
    writers.write_bundle(df.limit(0), str(tmp_path / "none"))
    assert readers.read_results(spark, str(tmp_path / "none")).count() == 0
