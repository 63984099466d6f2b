"""Tables on the way are counted and removed; small scans are spread without running anything."""

import os

from lodeworks.sources import scratch


def test_written_tables_go(spark):
    scratch.drop_written(spark)
    made = scratch.written(spark.range(10).toDF("x"), "test-table")
    place = made.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert made.count() == 10 and os.path.isdir(place)
    assert scratch.drop_written(spark) == 1 and not os.path.exists(place) and scratch.drop_written(spark) == 0


def test_sizes():
    assert [scratch._bytes(x) for x in ("134217728b", "128MB", "16m", "7", "1g", "64k")] == [134217728, 134217728, 16 << 20, 7, 1 << 30, 64 << 10]


def test_small_scans_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    status = spark.sparkContext.statusTracker()
    before = len(status.getJobIdsForGroup())
    rows = scratch.spread(spark.read.parquet(str(tmp_path / "t")))
    assert len(status.getJobIdsForGroup()) <= before + 1  # reading the schema, no more
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
