"""What several training-data operators need: shared storage, components of a graph, holdouts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word contracts: blank, tab, line feed, vertical tab, form feed, return.
WHITE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (tests) a new one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")  # one machine
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that a job writes on its way, in a folder of the shared one; emptied once nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.id = spark, uuid.uuid4().hex
        self.folder = f"{shared_dir(spark)}/tables/{name}-{self.id}"
        self.written: dict[str, str | None] = {}

    def table(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        df.write.option("compression", compression).parquet(f"{self.folder}/{name}")
        self.written[name] = None
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def bucketed(self, df: DataFrame, name: str, column: str) -> DataFrame:
        """df in as many buckets by a column as there are shuffle partitions: joins on it leave this side where it is."""
        known = f"scratch_{self.id}_{len(self.written)}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.option("compression", "zstd").option("path", f"{self.folder}/{name}").format("parquet").bucketBy(n, column).saveAsTable(known)
        self.written[name] = known
        return self.spark.table(known)

    def drop(self, *names: str) -> None:
        for name in names:
            known = self.written.pop(name)
            if known is not None:
                self.spark.sql(f"DROP TABLE {known}")
            self.spark.range(0).write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def drop_all_but(self, *names: str) -> None:
        self.drop(*[n for n in self.written if n not in names])


def held_out(doc_id: Column, parts: int) -> Column:
    """True where crc32 of the id as text leaves no remainder; rows without an id are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(True))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with where each begins: rows come sorted by the first `keys` columns, all integers.

    The last group of a batch waits for the next batch, so no more than a batch and one group is held.
    """

    def borders(table: pa.Table) -> np.ndarray:
        columns = np.stack([table.column(i).to_numpy() for i in range(keys)])
        return np.flatnonzero(np.append(True, (columns[:, 1:] != columns[:, :-1]).any(axis=0)))

    rest: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        now = pa.Table.from_batches([batch])
        rest = now if rest is None else pa.concat_tables([rest, now])
        starts = borders(rest)
        if len(starts) > 1:
            yield rest.slice(0, int(starts[-1])).combine_chunks(), starts[:-1]
            rest = rest.slice(int(starts[-1]))
    if rest is not None:
        yield rest.combine_chunks(), np.zeros(1, np.int64)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b), both long: (node, component), the least node of each.

    Alternates the large-star and small-star steps until the edges stay the same. Every step is an aggregate
    with map-side combination and an equi-join that adaptive execution splits at hubs; only one row of sums
    reaches the driver. Nodes without edges aren't in the result. Self loops and nulls are left out.
    """
    shared_dir(edges.sparkSession)
    now = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct().checkpoint()
    before = None
    for _ in range(rounds):
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1000003), F.sum(F.xxhash64("b", "a") % 999983)).first()
        if after == before or after[0] == 0:
            break
        before = after
        now = _small_star(_large_star(now)).distinct().checkpoint()
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
