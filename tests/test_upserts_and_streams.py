"""Upserts by partition, also after a lost job, and late events as a stream over daily files."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from veridelta.sources import readers
from veridelta.streaming import jobs

KEYS, BY = ["k", "day"], ["day"]


def rows(spark, data):
    return spark.createDataFrame(data, "k int, day string, v string, n int")


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "_pending" not in d}


def read(spark, path):
    return {(r.k, r.day, r.v, r.n) for r in readers.read_evidence(spark, path, BY).collect()}


def test_upsert_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    first = [(i, f"0{i % 4}", "old", 1) for i in range(40)]
    readers.upsert_evidence(rows(spark, first), path, KEYS, "n", BY)
    assert read(spark, path) == set(first)
    before = files(path)
    new = [(1, "01", "new", 2), (1, "01", "older", 1), (99, "01", "added", 1), (50, "07", "fresh", 1), (5, "01", "same order", 1)]
    for _ in range(2):
        readers.upsert_evidence(rows(spark, new), path, KEYS, "n", BY)
        want = (set(first) - {(1, "01", "old", 1), (5, "01", "old", 1)}) | {new[0], new[2], new[3], new[4]}
        assert read(spark, path) == want
    kept = {f: t for f, t in before.items() if "day=01" not in f}
    assert kept and kept.items() <= files(path).items()
    assert not [f for f in before if "day=01" in f and f in files(path)]


def test_upsert_that_was_lost(spark, tmp_path, monkeypatch):
    """Before the merged rows are complete the old ones stay; afterwards the next reader or writer completes them."""
    path = str(tmp_path / "t")
    first, new = [(i, f"d{i % 2}", "old", 1) for i in range(6)], [(0, "d0", "new", 2)]
    readers.upsert_evidence(rows(spark, first), path, KEYS, "n", BY)
    plain = readers.complete_upsert
    calls = []

    def lost(*a):
        calls.append(a)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return plain(*a)

    monkeypatch.setattr(readers, "complete_upsert", lost)
    with pytest.raises(RuntimeError):
        readers.upsert_evidence(rows(spark, new), path, KEYS, "n", BY)
    monkeypatch.setattr(readers, "complete_upsert", plain)
    shutil.rmtree(f"{path}/day=d0")  # as if lost between removing the old files and naming the new ones
    assert read(spark, path) == (set(first) - {(0, "d0", "old", 1)}) | set(new)
    spark.createDataFrame([(9, "d0", "half", 9)], "k int, day string, v string, n int").write.mode("overwrite").parquet(f"{path}/_pending")  # merged rows without their count
    assert read(spark, path) == (set(first) - {(0, "d0", "old", 1)}) | set(new)


def test_upsert_adds_columns_and_refuses_moving_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    readers.upsert_evidence(rows(spark, [(1, "a", "x", 1), (2, "a", "y", 1)]), path, KEYS, "n", BY)
    readers.upsert_evidence(rows(spark, [(1, "a", "z", 2)]).withColumn("note", F.lit("!")), path, KEYS, "n", BY)
    assert {(r.k, r.v, r.note) for r in readers.read_evidence(spark, path, BY).collect()} == {(1, "z", "!"), (2, "y", None)}
    with pytest.raises(ValueError):
        readers.upsert_evidence(rows(spark, []), path, ["k"], "n", BY)
    readers.upsert_evidence(rows(spark, []), str(tmp_path / "none"), KEYS, "n", BY)
    assert readers.read_evidence(spark, str(tmp_path / "none"), BY).count() == 0


def test_late_stream_over_daily_files(spark, tmp_path):
    """Equal to the batch operator over all files, through a restart; keys of their own, null keys, ties, missing times."""
    data = [(i, (i * 7919) % 1009 + (i // 300) * 200 if i % 17 else None, "hot" if i % 3 else None if i % 2 else "rare", i // 2) for i in range(1800)]
    df = spark.createDataFrame(data, "rid long, m long, k string, a long").withColumn("ts", F.timestamp_seconds(F.col("m") * 60)).drop("m")
    days, state, out = str(tmp_path / "days"), str(tmp_path / "state"), str(tmp_path / "out")
    stream = lambda: jobs.late_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(days), "rid", "ts", "a", "k", 100)
    for day in range(4):
        df.where(F.floor(F.col("rid") / 450) == day).coalesce(1).write.mode("append").parquet(days)
        if day in (1, 3):  # the second run goes on from the state of the first
            assert jobs.run_to_table(stream(), out, state) == 0
    order = df.withColumn("a", F.struct("a", "rid"))
    want = {(r.k, r.rid, r.lag_minutes) for r in jobs.late_events(order, "ts", "a", "k", 100).collect()}
    got = [(r.key, r.rid, r.lag_minutes) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    days = str(tmp_path / "days")
    shape = "rid long, k string, a long, t long"
    for a, t in enumerate((200, 199, 10, 198)):  # days; the third comes after the watermark passed it
        spark.createDataFrame([(a, "x", a, t * 86400)], shape).withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(days)
    s = spark.readStream.schema("rid long, k string, a long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(days)
    dropped = jobs.run_to_table(jobs.late_stream(s, "rid", "ts", "a", "k", 60, keep_days=30), str(tmp_path / "out"), str(tmp_path / "state"))
    assert dropped == 1 and {r.rid for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 3}
