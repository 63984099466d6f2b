"""Keyed state as Structured Streaming, and the batch twin of each over the whole log."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import safe_turn
from ..sources.scratch import new_folder


def normalized_turns(turns: DataFrame) -> DataFrame:
    """turns (.., role, text) with roles and texts as they are kept: a turn without a role is an old one, and its user's; texts are
    redacted, trimmed and cut as safe_turn() does. Turns of another role, or without text, aren't kept."""
    rows = turns.withColumns({"role": F.coalesce("role", F.lit("user")), "text": safe_turn(F.col("text"))})
    return rows.filter(F.col("role").isin("user", "assistant") & (F.col("text") != ""))


def conversation_window(turns: DataFrame, most: int = 12) -> DataFrame:
    """The last turns (conv_id, turn, ..) of each conversation: the twin of stream_conversations."""
    ranked = turns.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    return ranked.filter(F.col("_n") <= most).drop("_n")


def allowed_writes(writes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The writes (owner, key, seq, deletes, consented) that may be kept: deletes, and what its owner consented to, of an allowed key."""
    if not keys:
        raise ValueError("no preference key is allowed")
    return writes.filter(F.col("deletes") | (F.coalesce("consented", F.lit(False)) & F.trim("key").isin(*keys))).withColumn("key", F.trim("key"))


def preference_log(writes: DataFrame) -> DataFrame:
    """Allowed writes (owner, key, seq, deletes) to (owner, key, revision): writes since the owner's last delete."""
    last = Window.partitionBy("owner")
    rows = writes.withColumn("gone", F.max(F.when(F.col("deletes"), F.col("seq"))).over(last))
    kept = rows.filter(~F.col("deletes") & (F.col("seq") > F.coalesce("gone", F.lit(-1))))
    return kept.groupBy("owner", "key").agg(F.count(F.lit(1)).alias("revision"))


class Snapshots(StatefulProcessor):
    """Contents of a source with version and times, and which one is current; arrivals in the order of seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.contents = handle.getMapState("contents", "sha string", "version int, first long, last long")
        self.current = handle.getValueState("current", "sha string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = {k[0]: list(v) for k, v in self.contents.iterator()}
        current = self.current.get()
        sha = current[0] if current else None
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            at = int(row.us)
            if row.sha in known:
                known[row.sha][2] = max(known[row.sha][2], at)
            else:
                known[row.sha] = [len(known) + 1, at, at]
            sha = row.sha
        for k, v in known.items():
            self.contents.updateValue((k,), tuple(v))
        self.current.update((sha,))
        out = [(key[0], k, v[0], v[1], v[2], k == sha) for k, v in known.items()]
        yield pd.DataFrame(out, columns=["source", "sha", "version", "first_us", "last_us", "is_current"])

    def close(self) -> None:
        pass


class Preferences(StatefulProcessor):
    """Revisions by key of an owner; a delete empties them, so the next write begins at 1."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.revisions = handle.getMapState("revisions", "key string", "revision long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = {k[0]: v[0] for k, v in self.revisions.iterator()}
        for k in known:
            self.revisions.removeKey((k,))
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            if row.deletes:
                known = {}
            else:
                known[row.key] = known.get(row.key, 0) + 1
        for k, v in known.items():
            self.revisions.updateValue((k,), (v,))
        out = [(key[0], k, v) for k, v in known.items()] or [(key[0], None, 0)]  # a row says that nothing is left
        yield pd.DataFrame(out, columns=["owner", "key", "revision"])

    def close(self) -> None:
        pass


class Conversations(StatefulProcessor):
    """The last turns of a thread, twelve at most."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn long, role string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kept = [tuple(t) for t in self.turns.get()]
        kept += [(int(r.turn), r.role) for r in pd.concat(list(rows)).itertuples()]
        kept = sorted(kept)[-12:]
        self.turns.put(kept)
        yield pd.DataFrame([(key[0], *t) for t in kept], columns=["conv_id", "turn", "role"])

    def close(self) -> None:
        pass


class Sessions(StatefulProcessor):
    """Sessions by owner, open until a time after they were last seen: an event-time timer ends them once the watermark is there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expires = handle.getValueState("expires", "seen_us long, expires_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.expires.get()
        before = known[0] if known else None
        inputs = pd.concat(list(rows))
        seen = max(int(inputs["us"].max()), before if before is not None else 0)
        ends = (seen + int(inputs["life_us"].iloc[0])) // 1000
        if known and known[1] != ends:
            self.handle.deleteTimer(known[1])
        if not known or known[1] != ends:
            self.handle.registerTimer(ends)
        self.expires.update((seen, ends))
        yield pd.DataFrame([(key[0], seen, True)], columns=["owner", "seen_us", "active"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        seen = self.expires.get()[0]
        self.expires.clear()
        yield pd.DataFrame([(key[0], seen, False)], columns=["owner", "seen_us", "active"])

    def close(self) -> None:
        pass


def active_sessions(seen: DataFrame, life_us: int, delay_us: int = 0) -> DataFrame:
    """The batch twin of Sessions over the whole log seen (owner, us): (owner, seen_us, active), as of the last time in it less
    the delay that the stream's watermark allows."""
    last = seen.groupBy("owner").agg(F.max("us").alias("seen_us"))
    now = seen.agg((F.max("us") - delay_us).alias("now"))
    return last.crossJoin(F.broadcast(now)).select("owner", "seen_us", (F.col("seen_us") + life_us > F.col("now")).alias("active"))  # one row


def _folder(spark: SparkSession) -> str:
    return new_folder(spark, "streams")


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """RocksDB as the state store of streams that start within, which processors with map and list state and timers need; the
    session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def run(stream: DataFrame, write: Callable[[DataFrame, int], None], folder: str, mode: str = "update") -> None:
    """Runs a stream over what is there now, batch by batch, from where the last run in this folder ended."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write)
    with rocksdb_state(stream.sparkSession):
        started = writer.start()  # takes the settings of now
    started.awaitTermination()


def drain(stream: DataFrame, mode: str = "update", folder: str | None = None) -> DataFrame:
    """Runs a stream over what is there now; its rows with the batch that wrote them, from files of the shared folder.

    A batch that runs again overwrites its own folder, so each is written once. With the folder of an earlier run the stream
    goes on from there, and the rows are those of all runs. A stream of which nothing came has no rows.
    """
    spark, folder = stream.sparkSession, folder or _folder(stream.sparkSession)
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{folder}/rows/batch=-1")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    run(stream, write, folder, mode)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def latest(drained: DataFrame, key: str) -> DataFrame:
    """Of each key the rows of the last batch that wrote it: the state as it is at the end."""
    last = drained.groupBy(key).agg(F.max("batch").alias("batch"))
    return drained.join(last, [key, "batch"], "left_semi").drop("batch")


def keyed(rows: DataFrame, key: str, processor: Callable[[], StatefulProcessor], schema: str, timers: bool = False) -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(processor(), outputStructType=schema, outputMode="update", timeMode="eventTime" if timers else "none")


def read_stream(spark: SparkSession, path: str, files_at_once: int = 4) -> DataFrame:
    """A table's files as a stream, some files after others."""
    files = spark.read.parquet(path)
    reader = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", files_at_once)
    if files.select("_metadata.file_name").filter(F.col("_metadata.file_name") == path.rpartition("/")[2]).isEmpty():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")  # the path is one file, and a stream reads folders: this one's file of that name
    return reader.option("pathGlobFilter", name).parquet(folder)
