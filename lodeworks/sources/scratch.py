"""Tables that a job writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder already set; where neither is and all runs on one machine, a new one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}/{uuid.uuid4().hex}"


#: Folders of written() by application, so that drop_written() knows them.
_WRITTEN: dict[str, list[str]] = {}


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table written once: what several parts of a plan read is made once, and survives lost executors.

    The table lies in the shared folder until drop_written().
    """
    spark = rows.sparkSession
    path = new_folder(spark, name)
    rows.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(rows.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Removes the tables that written() has left in this application, once no result needs them any more; how many there were."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)


def numbered(rows: DataFrame, column: str, first: int = 0) -> DataFrame:
    """rows, as they lie in their partitions, with consecutive numbers from `first` on. Only row counts by partition reach the driver."""
    placed = rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    placed = written(placed, "numbered")
    sizes = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    starts, at = [], first
    for part in sorted(sizes):
        starts.append((part, at))
        at += sizes[part]
    offsets = rows.sparkSession.createDataFrame(starts, "_part int, _start long")
    joined = placed.join(F.broadcast(offsets), "_part")  # a row for each partition
    return joined.withColumn(column, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores where their plan reads less than a split for each, as one small file is; else as they are.

    The size is what Spark estimates of the plan: nothing runs to learn it.
    """
    spark = rows.sparkSession
    cores, split = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.files.maxPartitionBytes")
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if size < cores * _bytes(split) else rows


#: Bytes of a part of rows, as Spark estimates a plan's, that one task groups at once.
_PART = 1 << 25


def in_parts(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by their keys to as many tasks as their size asks for, however well they compress: what a task groups stays
    of one size. The size is what Spark estimates of the plan; where it knows none, they go to the usual number."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = -(-size // _PART) if size < 1 << 50 else least
    return rows.repartition(min(max(least, parts), 20_000), *keys)


def _bytes(size: str) -> int:
    """A size such as 128MB or 134217728b as a number."""
    number, unit = size.lower().rstrip("b"), 1
    if number[-1:] in "kmgt":
        number, unit = number[:-1], 1024 ** ("kmgt".index(number[-1]) + 1)
    return int(number) * unit
