"""Stored layouts: what a lookup reads, and files named after their rows."""

import pytest
from conftest import rows

from patchloom import schemas
from patchloom.operators import instances as inst
from patchloom.sources import patch_files, readers, writers


def issues(spark, n):
    return spark.range(n).selectExpr(
        "concat('o__r-', lpad(id, 6, '0')) AS instance_id", "'o/r' AS repo", "md5(string(id)) AS base_commit",
        "repeat(md5(string(id)), 20) AS problem_statement", "repeat('x', int(id % 100)) AS patch",
        "'' AS test_patch", "'' AS hints_text", "'' AS created_at", "'' AS version",
    )


def scanned(df):
    """Rows that came out of the scan of a table."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.head().metrics().apply("numOutputRows").value()


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    path = str(tmp_path / "stored")
    assert writers.write_instances(issues(spark, 20_000), path, files=4, row_group_bytes=256 << 10) == 20_000
    stored = readers.read_stored_instances(spark, path)
    found = inst.by_id(stored, "o__r-012345")
    assert found.count() == 1
    assert scanned(inst.by_id(stored, "o__r-012345")) < 1_500
    # An id between others that is not there: bounds cannot tell, Bloom filters can.
    assert scanned(inst.by_id(stored, "o__r-012345x")) == 0
    flat = str(tmp_path / "flat")
    issues(spark, 20_000).repartition(4).write.parquet(flat)
    assert scanned(inst.by_id(spark.read.parquet(flat), "o__r-012345")) > 1_500


def test_the_length_filter_is_pushed_and_the_patch_not_read(spark, tmp_path):
    path = str(tmp_path / "stored")
    writers.write_instances(issues(spark, 300), path)
    kept = inst.within_patch_length(readers.read_stored_instances(spark, path), 40).select("instance_id")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(n_chars,40)" in plan
    assert "patch" not in plan.split("ReadSchema: ")[1].split("\n")[0].replace("test_patch", "")
    assert rows(kept) == rows(inst.within_patch_length(issues(spark, 300), 40).select("instance_id"))
    assert inst.sft_examples(readers.read_stored_instances(spark, path)).columns == schemas.SFT_EXAMPLE.names


IDS = ["o__r-1", "a/b", "a+b", "a%2Fb", "a b", "é", "x\ny", "..", "patch_z.diff", "100%"]


def test_patch_files_come_back_under_their_ids(spark, tmp_path):
    path = tmp_path / "out"
    data = [(i, f"--- {i}\n+++ b\n") for i in IDS] + [("empty", ""), ("null", None), (None, "lost")]
    df = spark.createDataFrame(data, "instance_id string, patch string").repartition(3)
    writers.write_patch_diffs(df, str(path))
    got = readers.read_patch_files(spark, str(path), encoded=True)
    assert rows(got) == sorted([(i, p) for i, p in data if i and p], key=repr)
    assert (path / "patch_empty.diff").read_bytes() == (path / "patch_null.diff").read_bytes() == b""
    assert (path / "patch_o__r-1.diff").read_text() == "--- o__r-1\n+++ b\n"
    assert not list((path / "_staging").iterdir())
    writers.write_patch_diffs(df.where("instance_id = 'a/b'").selectExpr("instance_id", "'new' AS patch"), str(path))
    again = dict(rows(readers.read_patch_files(spark, str(path), encoded=True)))
    assert again["a/b"] == "new" and len(again) == len(IDS)
    writers.write_patch_diffs(df.where("instance_id = 'a+b'"), str(path), "overwrite")
    assert [r[0] for r in rows(readers.read_patch_files(spark, str(path), encoded=True))] == ["a+b"]


def test_repeated_ids(spark, tmp_path):
    df = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "3", 1)], "instance_id string, patch string, pos int")
    writers.write_patch_diffs(df, str(tmp_path / "last"))
    assert rows(readers.read_patch_files(spark, str(tmp_path / "last"), encoded=True)) == [("a", "2"), ("b", "3")]
    for parts in (1, 3):
        with pytest.raises(Exception, match="several patches"):
            writers.write_patch_diffs(df.drop("pos").repartition(parts, "patch"), str(tmp_path / f"bad{parts}"))
        assert not list((tmp_path / f"bad{parts}").glob("*.diff"))


def test_only_the_accepted_attempt_of_a_task_counts(tmp_path):
    writer = patch_files.PatchFileWriter(str(tmp_path), "run", False)
    first = writer.write(iter([("a", "1"), ("b", "2")]))
    second = writer.write(iter([("a", "1"), ("b", "2")]))
    assert first.folder != second.folder
    assert not list(tmp_path.glob("*.diff"))
    writer.commit([second, None])
    assert {f.name: f.read_text() for f in tmp_path.glob("*.diff")} == {"patch_a.diff": "1", "patch_b.diff": "2"}
    assert not list((tmp_path / "_staging").iterdir())
    other = patch_files.PatchFileWriter(str(tmp_path), "other", False)
    other.write(iter([("c", "3")]))
    other.abort([None])
    assert len(list(tmp_path.glob("*.diff"))) == 2 and not list((tmp_path / "_staging").iterdir())
