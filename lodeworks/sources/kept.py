"""Tables that are appended to: each append is one unit by name, adds only new keys, and is seen as a whole or not at all."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPORT = "append string, total long, inserted long, skipped long"


def there(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds something at a path, in whatever store it is."""
    try:
        spark.read.schema("x int").parquet(path)
        return True
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


class KeptTable:
    """Rows of a schema below a folder, of which no two have the same key.

    An append writes its rows to rows/append=<name>, by the partition columns, and then one line with its counts to
    log/append=<name>; rows without a line aren't part of the table. So an append that breaks off leaves nothing that is
    seen, its repetition writes it anew, and an append whose line is there adds nothing. One writer at a time.

    Of the kept table an append reads the key and partition columns only; the incoming keys are what is sent to it while they
    are few, so a small batch doesn't shuffle a large table. Rows that are equal in key must be so in partition columns.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str | T.StructType, key: str, partition_by: Sequence[str] = ()):
        self.spark, self.folder, self.key, self.partition_by = spark, folder.rstrip("/"), key, list(partition_by)
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        if not there(spark, f"{self.folder}/log"):
            spark.createDataFrame([], REPORT).drop("append").write.mode("overwrite").parquet(f"{self.folder}/log/append=-")  # no line

    def log(self) -> DataFrame:
        """(append, total, inserted, skipped) of each append that is part of the table."""
        return self.spark.read.schema(REPORT).parquet(f"{self.folder}/log").select("append", "total", "inserted", "skipped")

    def _named(self) -> DataFrame:
        """All published rows with the append that brought them."""
        path = f"{self.folder}/rows"
        schema = T.StructType([*self.schema.fields, T.StructField("append", T.StringType())])
        if not there(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path).join(F.broadcast(self.log().select("append")), "append", "left_semi")  # a line for each append

    def rows(self) -> DataFrame:
        return self._named().drop("append").select(*self.schema.fieldNames())

    def of(self, name: str) -> DataFrame:
        """The rows that one append brought."""
        return self._named().filter(F.col("append") == name).select(*self.schema.fieldNames())

    def append(self, incoming: DataFrame, name: str, *order: Column) -> DataFrame:
        """Adds the rows of incoming whose key isn't there, of each key the first in the given order (none: any one); its line
        of the log: how many rows came, how many were added and how many weren't. Rows without a key aren't."""
        known = self.log().filter(F.col("append") == name)
        if known.isEmpty():
            place = f"{self.folder}/incoming/append={name}"
            incoming.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(place)
            came = self.spark.read.schema(self.schema).parquet(place)
            keys = [*self.partition_by, self.key]
            old = self._named().select(*keys).join(came.select(*keys).distinct(), keys, "left_semi")
            first = came.filter(F.col(self.key).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(self.key).orderBy(*(order or [F.lit(1)])))).filter("_n = 1").drop("_n")
            first.join(old.select(self.key), self.key, "left_anti").write.mode("overwrite").partitionBy(*self.partition_by).parquet(f"{self.folder}/rows/append={name}")
            added = self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows/append={name}")
            counts = came.agg(F.count(F.lit(1)).alias("total")).crossJoin(F.broadcast(added.agg(F.count(F.lit(1)).alias("inserted"))))  # one row each
            line = counts.withColumn("skipped", F.col("total") - F.col("inserted"))
            line.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/log/append={name}")
            self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(place)
        return self.log().filter(F.col("append") == name)

    def sink(self, *order: Column) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: a batch that runs again, after a restart too, adds nothing twice, and the stream keeps no state of
        what was seen: the table itself knows."""

        def write(rows: DataFrame, batch: int) -> None:
            self.append(rows, f"batch-{batch}", *order)

        return write
