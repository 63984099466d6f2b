"""Streams over several files and batches, with restarts from their checkpoints, against their batch twins."""

import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from lodeworks.operators.corpus import snapshot_versions
from lodeworks.sources.kept import KeptTable
from lodeworks.streaming import state as S

LOG = "source long, sha string, seq long, us long, deletes boolean, key string"


def log_of(n, seed):
    rng = random.Random(seed)
    return [(rng.randrange(7), f"c{rng.randrange(4)}", i, i * 1_000_000, rng.random() < 0.1, rng.choice(["x", "y"])) for i in range(n)]


def parts_of(rows, cuts):
    edges = [0, *cuts, len(rows)]
    return [rows[a:b] for a, b in zip(edges, edges[1:])]


def feed(spark, folder, rows, at_once=1):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(folder))
    return S.read_stream(spark, str(folder), at_once)


def drained(spark, tmp_path, parts, shape, restart=False):
    """The stream's rows after all parts: one run over all files, or a run behind each with the same checkpoint."""
    source, out = tmp_path / "in", S._folder(spark)
    for part in parts:
        stream = feed(spark, source, part)
        if restart:
            got = S.drain(shape(stream), folder=out)
    return got if restart else S.drain(shape(stream), folder=out)


SPLITS = [((100,), False), ((20, 50, 51), False), ((40, 90), True)]


@pytest.mark.parametrize(("cuts", "restart"), SPLITS)
def test_snapshots(spark, tmp_path, cuts, restart):
    rows = log_of(150, 1)
    shape = lambda s: S.keyed(s.select("source", "sha", "seq", "us"), "source", S.Snapshots, "source long, sha string, version int, first_us long, last_us long, is_current boolean")
    got = S.latest(drained(spark, tmp_path, parts_of(rows, cuts), shape, restart), "source")
    seen = spark.createDataFrame(rows, LOG).select("source", "sha", "seq", F.timestamp_micros("us").alias("at"))
    want = snapshot_versions(seen).select("source", "sha", "version", F.unix_micros("first_observed"), F.unix_micros("last_observed"), "is_current")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize(("cuts", "restart"), SPLITS)
def test_preferences(spark, tmp_path, cuts, restart):
    rows = log_of(150, 2)
    shape = lambda s: S.keyed(s.select(F.col("source").alias("owner"), "key", "seq", "deletes"), "owner", S.Preferences, "owner long, key string, revision long")
    got = S.latest(drained(spark, tmp_path, parts_of(rows, cuts), shape, restart), "owner").filter("key IS NOT NULL")
    want = S.preference_log(spark.createDataFrame(rows, LOG).select(F.col("source").alias("owner"), "key", "seq", "deletes"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize(("cuts", "restart"), SPLITS)
def test_conversations(spark, tmp_path, cuts, restart):
    rows = log_of(150, 3)
    turns = lambda s: s.select(F.col("source").alias("conv_id"), F.col("seq").alias("turn"), F.col("key").alias("role"))
    shape = lambda s: S.keyed(turns(s), "conv_id", S.Conversations, "conv_id long, turn long, role string")
    got = S.latest(drained(spark, tmp_path, parts_of(rows, cuts), shape, restart), "conv_id")
    want = S.conversation_window(turns(spark.createDataFrame(rows, LOG)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("conv_id", "turn", "role").collect()))


def sessions(life, delay, stream):
    rows = stream.withColumn("at", F.timestamp_micros("us")).withWatermark("at", f"{delay // 1_000_000} seconds")
    seen = rows.select(F.col("source").alias("owner"), "at", "us", F.lit(life).alias("life_us"))
    return S.keyed(seen, "owner", S.Sessions, "owner long, seen_us long, active boolean", timers=True)


@pytest.mark.parametrize(("cuts", "restart"), SPLITS)
def test_sessions_with_late_rows(spark, tmp_path, cuts, restart):
    """Rows come up to 20 seconds late, which the watermark allows; owners leave and come back, so timers fire in between."""
    life, delay = 15_000_000, 20_000_000
    rng = random.Random(4)
    rows = [(rng.choice(range(1 + i // 30, 4 + i // 30)), "c", i, max(0, i - rng.choice([0, 0, 3, 19])) * 1_000_000 + 500, False, "x") for i in range(150)]
    got = S.latest(drained(spark, tmp_path, parts_of(rows, cuts), partial(sessions, life, delay), restart), "owner")
    want = S.active_sessions(spark.createDataFrame(rows, LOG).select(F.col("source").alias("owner"), "us"), life, delay)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.active for r in want.collect()} == {True, False}


def test_empty_folder_and_settings(spark, tmp_path):
    before = spark.conf.get(S._PROVIDER, None)
    stream = feed(spark, tmp_path / "in", [])
    shape = S.keyed(stream.select("source", "sha", "seq", "us"), "source", S.Snapshots, "source long, sha string, version int, first_us long, last_us long, is_current boolean")
    assert S.drain(shape).count() == 0 and spark.conf.get(S._PROVIDER, None) == before


def test_ingest_over_batches(spark, tmp_path):
    """Three files in three batches, a run repeated, one batch written again as after a crash: nothing is added twice."""
    kept = KeptTable(spark, str(tmp_path / "kept"), "sha string, seq long", "sha")
    parts = [[(1, s, i, 0, False, "x") for i, s in enumerate(names)] for names in (["a", "b", "a"], ["b", "c"], ["a", "d", "d"])]
    for part in parts:
        stream = feed(spark, tmp_path / "in", part).select("sha", "seq")
        S.run(stream, kept.sink(F.col("seq")), str(tmp_path / "run"), "append")
    assert [tuple(r) for r in kept.log().orderBy("append").collect()] == [("batch-0", 3, 2, 1), ("batch-1", 2, 1, 1), ("batch-2", 3, 1, 2)]
    kept.sink()(spark.createDataFrame([("z", 9)], "sha string, seq long"), 2)
    S.run(S.read_stream(spark, str(tmp_path / "in"), 1).select("sha", "seq"), kept.sink(), str(tmp_path / "other-run"), "append")
    assert sorted(r.sha for r in kept.rows().collect()) == ["a", "b", "c", "d"]
    state = [p for p in (tmp_path / "run" / "state").rglob("*") if p.is_file() and "/state/state/" in str(p)]
    assert not state  # the stream keeps none
