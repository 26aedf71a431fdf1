"""Stores of JSON files: what is opened, what is skipped, and what publishing leaves alone."""

import json

import pytest
from pyspark.sql import functions as F

from melisma.sources import files


def run(path, **fields):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(fields))


def test_runs_of_users(spark, tmp_path):
    run(tmp_path / "u1" / "b.json", created_at="2024-01-02", trajectory_id="b", feedback_events=[{"reward_score": 0.8}])
    run(tmp_path / "u1" / "a.json", created_at="2024-01-02", trajectory_id="a", feedback_events=[])
    run(tmp_path / "u2" / "c.json", created_at="2024-01-01", trajectory_id="c")
    (tmp_path / "u1" / "broken.json").write_text("{")
    (tmp_path / "u2" / "list.json").write_text("[1]")
    rows, skipped = files.read_runs(spark, str(tmp_path))
    assert [r.trajectory_id for r in rows.collect()] == ["c", "a", "b"]
    assert sorted(r.file.rsplit("/", 1)[1] for r in skipped.collect()) == ["broken.json", "list.json"]
    mine, bad = files.read_runs(spark, str(tmp_path), ["u1", "nobody", "u1"], feedback_only=True)
    assert [r.trajectory_id for r in mine.collect()] == ["b"] and bad.count() == 1
    assert len(mine.inputFiles()) == 3 and all("/u1/" in f for f in mine.inputFiles())  # no other user's files are opened
    assert files.read_runs(spark, str(tmp_path), ["nobody"])[0].isEmpty()
    for bad_name in ("../u2", "", ".", "..", "u1/", "*"):
        with pytest.raises(ValueError):
            files.read_runs(spark, str(tmp_path), [bad_name])


def test_point_reads(spark, tmp_path):
    for name in ("s1", "s2"):
        run(tmp_path / f"{name}.json", song_id=name, title=name)
    run(tmp_path / "s3.json", song_id="s3", other=1)
    rows, rejected = files.read_store(spark, str(tmp_path), "song_id string, title string", ["s2", "s3", "s9"])
    assert [r.song_id for r in rows.collect()] == ["s2"] and rejected.count() == 1 and len(rows.inputFiles()) == 2
    assert files.read_store(spark, str(tmp_path), "song_id string, title string")[0].count() == 2
    assert files.read_store(spark, str(tmp_path), "song_id string", [])[0].isEmpty()


def test_upsert_keeps_other_buckets(spark, tmp_path):
    path = str(tmp_path / "table")
    files.publish(spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("title"), F.lit(1).alias("version")), path, "k")
    listed = lambda: {f for f in spark.read.parquet(path).inputFiles()}
    before = listed()
    files.upsert(spark, spark.createDataFrame([(7, "new"), (1000, None)], "k long, title string"), path, "k")
    rows = {r.k: (r.title, r.version) for r in spark.read.parquet(path).collect()}
    assert len(rows) == 201 and rows[7] == ("new", 2) and rows[8] == ("old", 1) and rows[1000] == (None, 1)
    touched = {f.rsplit("/", 2)[1] for f in before - listed()}
    assert 1 <= len(touched) <= 2 and len({f.rsplit("/", 2)[1] for f in before & listed()}) == len({f.rsplit("/", 2)[1] for f in before}) - len(touched)
    files.upsert(spark, spark.createDataFrame([], "k long, title string"), path, "k")
    assert spark.read.parquet(path).count() == 201


def test_manifest_counts_splits(spark, tmp_path):
    runs = spark.createDataFrame([("u1", "a", "train"), ("u1", "b", "train"), ("u2", "c", "test")], "user_id string, trajectory_id string, split string")
    files.publish_splits(runs, str(tmp_path / "out"), 7)
    got = json.loads(next((tmp_path / "out" / "manifest").glob("part-*")).read_text())
    assert got == {"split_runs": {"test": 1, "train": 2}, "split_users": {"test": 1, "train": 1}, "seed": 7}
    with pytest.raises(Exception, match="(?i)exist"):
        files.publish_splits(runs, str(tmp_path / "out"), 7)
