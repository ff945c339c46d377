import json

import pytest
from conftest import rows

from patchloom import schemas
from patchloom.operators import metrics, predictions as pred
from patchloom.sources import readers, writers


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        path = tmp_path / name
        path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
        return str(path)

    return write


RECORD = {
    "problem_statement": "Sled drifts\nleft \"on ice\"", "repo": "acme/sled", "patch": "+steer(0)\n",
    "instance_id": "acme__sled-9", "base_commit": "77aa", "unknown": {"field": [1]},
}


def test_instances_from_json_and_parquet(spark, put, tmp_path):
    lines = put("i.json", json.dumps(RECORD) + "\n\n" + json.dumps({**RECORD, "instance_id": "acme__sled-8", "test_patch": "+assert"}))
    got = readers.read_instances(spark, lines, "json", dataset="lite")
    assert rows(got.select("instance_id", "test_patch", "dataset")) == [
        ("acme__sled-8", "+assert", "lite"), ("acme__sled-9", "", "lite"),
    ]
    assert readers.read_instances(spark, put("a.json", [RECORD]), "json", array=True).count() == 1
    stored = str(tmp_path / "i.parquet")
    got.select(*schemas.INSTANCE.names).write.parquet(stored)
    again = readers.read_eval_instances(spark, stored, max_instances=1)
    assert again.columns == schemas.EVAL_COLUMNS and rows(again.select("instance_id")) == [("acme__sled-8",)]
    with pytest.raises(ValueError):
        readers.read_instances(spark, stored, "csv")
    with pytest.raises(ValueError):
        readers.read_instances(spark, stored, dataset="huge")


def test_eval_instances_read_five_columns(spark, tmp_path):
    path = str(tmp_path / "i.parquet")
    spark.createDataFrame([("a",) * 9], schemas.INSTANCE).write.parquet(path)
    plan = readers.read_eval_instances(spark, path)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1]
    assert "base_commit" in schema and "problem_statement" not in schema


PAIRS = [("acme__sled-1", "+one"), ("acme__sled-2", "+} , {\n-[\"")]


def values(df):
    return rows(df.select("instance_id", "patch"))


def test_prediction_array(spark, put):
    path = put("p.json", [{"instance_id": k, "patch": v} for k, v in PAIRS])
    assert values(readers.read_prediction_array(spark, path)) == PAIRS


@pytest.mark.parametrize("indent", [None, 2, "\t"])
def test_prediction_object(spark, put, indent):
    path = put("p.json", json.dumps({**dict(PAIRS), "é": None, "e": ""}, indent=indent))
    want = sorted([*PAIRS, ("é", None), ("e", "")], key=repr)
    assert values(readers.read_prediction_object(spark, path)) == want


@pytest.mark.parametrize("content", ["{}", "{\n}\n", ""])
def test_empty_prediction_object(spark, put, content):
    assert readers.read_prediction_object(spark, put("p.json", content)).count() == 0


def test_prediction_object_repeats_and_damage(spark, put):
    path = put("p.json", '{"a": "1",\n "b": "2", "a": "3"}')
    assert values(pred.keep_last(readers.read_prediction_object(spark, path))) == [("a", "3"), ("b", "2")]
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_prediction_object(spark, put("bad.json", '{"a": oops}')).collect()


def test_prediction_lines_and_errors(spark, put):
    lines = [
        {"instance_id": "a", "model_patch": "p", "model_name_or_path": "m"},
        {"instance_id": "a", "model_patch": "", "error": "boom"},
        {"instance_id": "b", "model_patch": "q", "model_name_or_path": "m"},
    ]
    path = put("p.jsonl", "\n".join(map(json.dumps, lines)) + "\n")
    got = readers.read_prediction_lines(spark, path)
    assert rows(got.select("instance_id", "patch", "error")) == [
        ("a", "", "boom"), ("a", "p", None), ("b", "q", None),
    ]
    assert rows(pred.keep_last(got).select("instance_id", "patch")) == [("a", ""), ("b", "q")]
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_prediction_lines(spark, put("bad.jsonl", "{oops\n")).collect()


def test_last_of_many_lines_wins_across_blocks(spark, put):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = [json.dumps({"instance_id": f"i{n % 7}", "patch": str(n)}) for n in range(2000)]
        got = readers.read_prediction_lines(spark, put("p.jsonl", "\n".join(lines)))
        assert got.rdd.getNumPartitions() > 1
        assert values(pred.keep_last(got)) == sorted((f"i{n % 7}", str(n)) for n in range(1993, 2000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_results_and_metrics_out_of_a_bundle(spark, put):
    result = {"instance_id": "a", "passed": True, "execution_time": 1.5, "logs": "x"}
    path = put("r.json", {"config": {"x": 1}, "metrics": {"resolved": 1}, "results": [result]})
    got = readers.read_results(spark, path)
    assert [(f.name, f.dataType) for f in got.schema] == [
        (f.name, f.dataType) for f in schemas.RESULT
    ]
    assert rows(got.select("tests_passed", "patch_applied")) == [(0, True)]
    assert rows(got.select("instance_id", "passed", "execution_time", "error_message")) == [
        ("a", True, 1.5, None)
    ]
    assert readers.read_bundle_metrics(spark, path).first().resolved == 1
    assert readers.read_results(spark, put("none.json", {"metrics": {}})).count() == 0


def test_dataset_formats(spark, tmp_path):
    df = spark.createDataFrame([("p", "c", "r", "i"), ("é\n", "c", None, "j")], schemas.PREFERENCE_PAIR)
    for name, format in [("a.json", "json"), ("a.parquet", "parquet")]:
        path = str(tmp_path / name)
        assert writers.write_dataset(df.repartition(3), path, format) == 2
        assert rows(readers.read_preference_pairs(spark, path)) == rows(df)
    with pytest.raises(ValueError):
        writers.write_dataset(df, str(tmp_path / "b"), "csv")
    with pytest.raises(ValueError):
        readers.read_preference_pairs(spark, "pairs.csv")


def test_preference_pairs_with_and_without_id(spark, tmp_path, put):
    df = spark.createDataFrame([("p", "c", "r", "i", "s")], "prompt string, chosen string, rejected string, instance_id string, strategy string")
    lines, stored = str(tmp_path / "p.json"), str(tmp_path / "p.parquet")
    writers.write_preference_pairs(df, lines)
    writers.write_preference_pairs(df, stored, "dataset")
    assert rows(readers.read_preference_pairs(spark, lines)) == [("p", "c", "r", "i")]
    assert rows(readers.read_training_pairs(spark, stored)) == [("p", "c", "r")]
    assert readers.read_training_pairs(spark, lines).count() == 1
    array = put("array.json", json.dumps([{"prompt": "p", "chosen": "c", "rejected": "r"}], indent=2))
    assert readers.read_training_pairs(spark, array, array=True).count() == 1
    with pytest.raises(ValueError):
        writers.write_preference_pairs(df, str(tmp_path / "x"), "csv")
    with pytest.raises(ValueError, match="chosen, rejected"):
        readers.read_training_pairs(spark, put("bad.json", {"prompt": "p"}))
    df.drop("rejected").write.parquet(str(tmp_path / "q.parquet"))
    with pytest.raises(ValueError, match="rejected"):
        readers.read_training_pairs(spark, str(tmp_path / "q.parquet"))


def test_written_pairs_are_compressed_in_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "COMPRESSED_ROWS", 100, raising=False)
    patch = "concat_ws('\\n+', transform(sequence(0, 40), i -> sha2(concat(id, ' ', i), 256)))"
    texts = spark.range(0, 250, 1, 1).selectExpr("concat('i', id) AS instance_id", f"{patch} AS chosen")
    made = texts.selectExpr("concat('Given this issue:\\n', chosen) AS prompt", "chosen", "left(chosen, 1300) AS rejected", "instance_id")
    raw = made.selectExpr("sum(length(prompt) + length(chosen) + length(rejected))").first()[0]
    path = tmp_path / "p.json"
    assert writers.write_preference_pairs(made, str(path)) == 250
    files = [f for f in path.iterdir() if f.name.startswith("part-")]
    # The patches are noise: what is saved is that a pair holds them more than once, and four bits a digit.
    assert sum(f.stat().st_size for f in files) < raw * 0.35
    assert len(files) == 3
    assert rows(readers.read_preference_pairs(spark, str(path))) == rows(made)


def test_lines_for_other_tools_stay_plain(spark, tmp_path):
    predictions = spark.createDataFrame(PAIRS, "instance_id string, patch string")
    writers.write_predictions(predictions, str(tmp_path / "p"))
    writers.write_submission(pred.submission(predictions, predictions, "m"), str(tmp_path / "s"))
    writers.write_dataset(predictions, str(tmp_path / "d"), compression="none")
    for name in "psd":
        lines = [json.loads(x) for f in (tmp_path / name).glob("part-*.json") for x in f.read_text().splitlines()]
        assert sorted(line["instance_id"] for line in lines) == [k for k, _ in PAIRS]


def test_sft_examples(spark, tmp_path):
    df = spark.createDataFrame([("i", "p", "c", "pc")], schemas.SFT_EXAMPLE)
    for name, format in [("s.json", "json"), ("s", "parquet")]:
        writers.write_dataset(df, str(tmp_path / name), format)
        assert rows(readers.read_sft_examples(spark, str(tmp_path / name))) == [("i", "p", "c", "pc")]


def test_predictions_and_submission(spark, tmp_path):
    predictions = spark.createDataFrame(PAIRS, "instance_id string, patch string")
    assert writers.write_predictions(predictions, str(tmp_path / "p")) == 2
    assert writers.write_predictions(predictions.limit(0), str(tmp_path / "none")) == 0
    assert values(readers.read_prediction_lines(spark, str(tmp_path / "p"))) == PAIRS
    writers.write_submission(pred.submission(predictions, predictions, "m"), str(tmp_path / "s"))
    got = readers.read_prediction_lines(spark, str(tmp_path / "s"))
    assert rows(got.select("instance_id", "patch", "model")) == [(k, v, "m") for k, v in PAIRS]


def test_patch_files(spark, tmp_path, put):
    predictions = spark.createDataFrame(
        [("o__r-1", "--- a\n+++ b\n"), ("a/b c", "one line"), ("e", "")], "instance_id string, patch string"
    )
    writers.write_patch_files(predictions, str(tmp_path / "out"))
    got = readers.read_patch_partitions(spark, str(tmp_path / "out"))
    assert values(got) == values(predictions)
    folder = tmp_path / "diffs"
    folder.mkdir()
    (folder / "patch_o__r-1.diff").write_text("--- a\n+++ b\n")
    (folder / "a+b c%20é.diff").write_text("x")
    assert values(readers.read_patch_files(spark, str(folder))) == [
        ("a+b c%20é", "x"), ("o__r-1", "--- a\n+++ b\n"),
    ]


def test_report(spark, tmp_path):
    df = spark.createDataFrame(
        [("a", True, 1, 0, 0, True, None, 2.0, ""), ("b", False, 0, 1, 0, True, "x", 4.0, "")],
        schemas.RESULT,
    )
    out = str(tmp_path / "report")
    writers.write_report(df, out, "20240101_000000", {"max_workers": 4})
    stored = spark.read.schema(schemas.RESULT).parquet(f"{out}/results")
    assert rows(stored.drop("run_ts")) == rows(df)
    written = spark.read.json(f"{out}/metrics").first()
    assert (written.resolved, written.avg_execution_time, written.config.max_workers) == (1, 3.0, "4")
    assert rows(spark.read.json(f"{out}/per_repo").select("repo", "resolved")) == [("a", 1), ("b", 0)]
    assert spark.read.json(f"{out}/error_types").first().error_type == "other"
    writers.write_report(df, out, "20240102_000000")
    assert metrics.global_metrics(spark.read.parquet(f"{out}/results"), ["run_ts"]).count() == 2
    assert spark.read.json(f"{out}/metrics").count() == 2


def test_stored_tables_outlive_their_input(spark, tmp_path):
    given = tmp_path / "given"
    spark.range(5).write.parquet(str(given))
    stored = writers.store(spark.read.parquet(str(given)).selectExpr("id * 2 AS x"))
    for file in given.iterdir():
        file.unlink()
    assert rows(stored) == [(0,), (2,), (4,), (6,), (8,)]
