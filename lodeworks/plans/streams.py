"""Streaming queries over the given tables; each equals the SQL of its batch twin."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..sources.kept import KeptTable
from ..sources.reports import read_report, write_report
from ..streaming import state as S
from .base import query, table
from .corpus import DUCK_CHUNKS, DUCK_EVENTS

_SNAP = f"""WITH {DUCK_EVENTS}, s AS (SELECT source, sha, min(seq) AS f, max(seq) AS l, arg_min(seen, seq) AS a, max(seen) AS z FROM obs GROUP BY source, sha)
SELECT source, sha, row_number() OVER (PARTITION BY source ORDER BY f)::INT AS version, epoch_us(a) AS first_us, epoch_us(z) AS last_us, l = max(l) OVER (PARTITION BY source) AS is_current FROM s"""
#: Owners consent but for every eighth write; `signup` isn't a key that may be kept.
_PREF = """WITH w AS (SELECT user_id AS owner, event_type AS key, event_id AS seq, event_type = 'error' AS deletes FROM events WHERE event_type = 'error' OR (event_id % 8 <> 0 AND event_type IN ('click', 'view', 'purchase'))), g AS (SELECT *, max(CASE WHEN deletes THEN seq END) OVER (PARTITION BY owner) AS gone FROM w)
SELECT owner, key, count(*) AS revision FROM g WHERE NOT deletes AND seq > coalesce(gone, -1) GROUP BY owner, key"""


_stream = S.read_stream


@query(_SNAP)
def stream_snapshots(spark, sf):
    events = _stream(spark, f"{sf}/events.parquet")
    rows = events.select(F.col("user_id").alias("source"), F.sha2("event_type", 256).alias("sha"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    state = S.keyed(rows, "source", S.Snapshots, "source long, sha string, version int, first_us long, last_us long, is_current boolean")
    return S.latest(S.drain(state), "source")


def _writes(events):
    writes = events.select(F.col("user_id").alias("owner"), F.col("event_type").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("deletes"), (F.col("event_id") % 8 != 0).alias("consented"))
    return S.allowed_writes(writes, ["click", "view", "purchase"])


@query(_PREF)
def preferences(spark, sf):
    return S.preference_log(_writes(table(spark, sf, "events")))


@query(_PREF)
def stream_preferences(spark, sf):
    state = S.keyed(_writes(_stream(spark, f"{sf}/events.parquet")).drop("consented"), "owner", S.Preferences, "owner long, key string, revision long")
    return S.latest(S.drain(state), "owner").filter("key is not null")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE trim(text) <> '') WHERE n <= 12")
def stream_conversations(spark, sf):
    turns = _stream(spark, f"{sf}/conversations.parquet").filter("trim(text) <> ''").select("conv_id", "turn", "role")
    return S.latest(S.drain(S.keyed(turns, "conv_id", S.Conversations, "conv_id long, turn long, role string")), "conv_id")


_SESSIONS = "WITH s AS (SELECT user_id AS owner, max(ts) AS seen FROM events GROUP BY 1) SELECT owner, epoch_us(seen) AS seen_us, seen + INTERVAL 6 HOUR > (SELECT max(ts) FROM events) AS active FROM s"
_LIFE_US = 6 * 3_600_000_000


@query(_SESSIONS)
def active_sessions(spark, sf):
    seen = table(spark, sf, "events").select(F.col("user_id").alias("owner"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return S.active_sessions(seen, _LIFE_US)


@query(_SESSIONS)
def stream_active_sessions(spark, sf):
    """A session's timer ends it six hours after its owner was last seen, as the watermark passes."""
    events = _stream(spark, f"{sf}/events.parquet").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "0 seconds")
    seen = events.select(F.col("user_id").alias("owner"), "at", F.unix_micros("at").alias("us"), F.lit(_LIFE_US).alias("life_us"))
    return S.latest(S.drain(S.keyed(seen, "owner", S.Sessions, "owner long, seen_us long, active boolean", timers=True)), "owner")


_KEPT = "id string, prefix string, source string, chunk_ordinal int, text string"


def _identified(docs):
    """The chunks of documents (source, text) with an id by content."""
    id_ = F.md5(F.concat_ws("|", "source", "chunk_ordinal", "text").cast("binary"))
    return C.structure_chunk(docs).withColumn("id", id_).withColumn("prefix", F.substring("id", 1, 1))


@query(f"WITH RECURSIVE {DUCK_CHUNKS} SELECT md5(concat(source, '|', chunk_ordinal, '|', text)) AS id, count(DISTINCT 1) AS copies FROM chunks GROUP BY 1")
def stream_ingest(spark, sf):
    """Documents as they come, chunked and appended to a kept table that refuses what it has: the stream itself keeps no state."""
    folder = S._folder(spark)
    kept = KeptTable(spark, f"{folder}/kept", _KEPT, "id", ["prefix"])
    S.run(_identified(_stream(spark, f"{sf}/documents.parquet").select("source", "text")), kept.sink(), folder, "append")
    return kept.rows().groupBy("id").agg(F.count(F.lit(1)).alias("copies"))


@query(f"""WITH RECURSIVE {DUCK_CHUNKS}, c AS (SELECT doc_id % 3 AS part, md5(concat(source, '|', chunk_ordinal, '|', text)) AS id FROM chunks),
f AS (SELECT id, min(CASE part WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END) AS part FROM c GROUP BY id), n AS (SELECT part, count(*) AS total FROM c GROUP BY part),
i AS (SELECT part, count(*) AS inserted FROM f GROUP BY part)
SELECT 'part-' || n.part AS append, total, coalesce(inserted, 0) AS inserted, total - coalesce(inserted, 0) AS skipped, (SELECT count(*) FROM f) AS kept FROM n LEFT JOIN i USING (part)
UNION ALL SELECT 'all', (SELECT count(*) FROM c), 0, (SELECT count(*) FROM c), (SELECT count(*) FROM f)""")
def sinks(spark, sf):
    """Chunks appended in three parts, each twice under its name, and then all again under another: counts of each append."""
    kept = KeptTable(spark, f"{S._folder(spark)}/kept", _KEPT, "id", ["prefix"])
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    for part in (0, 1, 2, 0, 1, 2):
        kept.append(_identified(docs.filter(F.col("doc_id") % 3 == part)), f"part-{part}", "chunk_ordinal")
    kept.append(_identified(docs), "all", "chunk_ordinal")
    size = kept.rows().agg(F.count(F.lit(1)).alias("kept"))
    return kept.log().crossJoin(F.broadcast(size))  # one row


@query("""SELECT 'corpus' AS part, doc_id::VARCHAR AS id, md5(trim('t' || (doc_id % 3) || chr(10) || text)) AS value FROM documents WHERE text <> ''
UNION ALL SELECT 'query', item_id::VARCHAR, md5(text) FROM benchmark UNION ALL SELECT 'qrel', item_id::VARCHAR, concat('d', item_id, ':', item_id % 3) FROM benchmark WHERE item_id % 3 > 0""", name="beir_scan")
def beir_scan(spark, sf):
    """Documents and passages exported as a BEIR folder, and all three parts read back."""
    from ..sources.files import beir_scan as scan

    folder = S._folder(spark) + "/beir"
    docs, items = table(spark, sf, "documents").filter("text <> ''"), table(spark, sf, "benchmark")
    docs.select(F.col("doc_id").cast("string").alias("_id"), F.concat(F.lit("t"), F.col("doc_id") % 3).alias("title"), "text").write.json(f"{folder}/corpus.jsonl")
    items.select(F.col("item_id").cast("string").alias("_id"), "text").write.json(f"{folder}/queries.jsonl")
    items.select(F.col("item_id").cast("string").alias("query-id"), F.concat(F.lit("d"), "item_id").alias("corpus-id"), (F.col("item_id") % 3).alias("score")).write.option("sep", "\t").option("header", True).csv(f"{folder}/qrels/test.tsv")
    corpus, queries, qrels = scan(spark, folder)
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    parts = [
        corpus.select(F.lit("corpus").alias("part"), "id", F.coalesce("problem", digest("text")).alias("value")),
        queries.select(F.lit("query").alias("part"), F.col("query").alias("id"), digest("text").alias("value")),
        qrels.select(F.lit("qrel").alias("part"), F.col("query").alias("id"), F.concat_ws(":", "id", F.col("grade").cast("string")).alias("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT doc_id AS case_id, quality = 1 AS passed, toxic::DOUBLE AS penalty, (SELECT round(avg(quality), 6) FROM labels) AS pass_rate, (SELECT count(*) FROM labels) AS cases, 'run-1' AS run_id FROM labels")
def report_sink(spark, sf):
    """A run's cases and metrics written once, and read back."""
    folder = S._folder(spark) + "/report"
    cases = table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("passed"), F.col("toxic").cast("double").alias("penalty"))
    metrics = cases.agg(F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"), F.count(F.lit(1)).alias("cases"))
    write_report(cases, metrics, folder, run_id="run-1", dataset_id="labels", finished_at=datetime(2026, 1, 1, tzinfo=timezone.utc))
    header, rows = read_report(spark, folder, "pass_rate double, cases long")
    return rows.crossJoin(F.broadcast(header.select("metrics.*", "run_id")))  # one row
