"""Queries of corpus preparation: chunks, ids, manifests, snapshots, joins and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import contracts
from ..operators import corpus as O
from ..operators.matching import AT_LETTERS, containing
from ..sources.scratch import new_folder
from .base import query, sql, table

W = T.WS
_FLAT = f"trim(regexp_replace(text, '{W}+', ' ', 'g'))"

DUCK_CHUNKS = f"""
flat AS (SELECT doc_id, source, {_FLAT} AS t, length({_FLAT}) AS n FROM documents),
RECURSIVE_CHUNKS(doc_id, source, t, n, start, stop, k, piece) AS (
  SELECT doc_id, source, t, n, 0::BIGINT, 0::BIGINT, -1::BIGINT, NULL::VARCHAR FROM flat
  UNION ALL
  SELECT doc_id, source, t, n, CASE WHEN nxt < e AND substring(t, nxt + 1, 1) = ' ' THEN nxt + 1 ELSE nxt END, e, k + 1, trim(substring(t, s + 1, e - s)) FROM (
    SELECT *, greatest(s + 1, e - 100) AS nxt FROM (
      SELECT *, CASE WHEN s + 800 >= n THEN n
        WHEN length(regexp_replace(tail, '[^。！？!?；;]*$', '')) > 0 THEN s + 400 + length(regexp_replace(tail, '[^。！？!?；;]*$', ''))
        WHEN length(regexp_replace(tail, '[^ ]*$', '')) > 0 THEN s + 400 + length(regexp_replace(tail, '[^ ]*$', '')) - 1 ELSE s + 800 END AS e FROM (
        SELECT doc_id, source, t, n, start AS s, k, substring(t, start + 401, 400) AS tail FROM RECURSIVE_CHUNKS WHERE stop < n)))),
chunks AS (SELECT doc_id, source, k AS chunk_ordinal, piece AS text FROM RECURSIVE_CHUNKS WHERE k >= 0)"""


def _chunks(spark, sf):
    return C.structure_chunk(table(spark, sf, "documents").select("doc_id", "source", "text"))


@query(f"WITH RECURSIVE {DUCK_CHUNKS} SELECT doc_id, chunk_ordinal::INT AS chunk_ordinal, length(text)::INT AS n_chars, md5(text) AS digest FROM chunks")
def structure_chunk(spark, sf):
    return _chunks(spark, sf).select("doc_id", "chunk_ordinal", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


_JSON = """'{"chunk_ordinal":' || chunk_ordinal || ',"chunker_version":"structure-v1;max_chars=800;overlap_chars=100","document_sha256":"' || sha256(full_text)
 || '","location":{"cell_reference":null,"heading_path":[],"page_number":null,"sheet_name":null,"slide_number":null,"table_number":null,"table_row_number":null},"source_fragment_ordinal":0,"source_reference":'
 || to_json(source) || ',"text":' || to_json(text) || '}'"""


@query(f"WITH RECURSIVE {DUCK_CHUNKS} SELECT doc_id, chunk_ordinal::INT AS chunk_ordinal, 'ev_' || sha256({_JSON}) AS evidence_id FROM (SELECT c.*, d.text AS full_text FROM chunks c JOIN documents d USING (doc_id))")
def evidence_id(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text", F.sha2("text", 256).alias("sha"))
    chunks = C.structure_chunk(docs)
    made = C.evidence_id(F.col("sha"), F.col("source"), F.lit(0), F.col("chunk_ordinal"), F.col("text"), C.version())
    return chunks.select("doc_id", "chunk_ordinal", made.alias("evidence_id"))


@query("""SELECT user_id, event_type, 'snap_' || sha256('{"content_sha256":"' || sha256(event_type) || '","source_reference":"' || user_id || '"}') AS snapshot_id FROM (SELECT DISTINCT user_id, event_type FROM events)""")
def snapshot_id(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type").distinct()
    sha = T.canonical_sha({"content_sha256": F.sha2("event_type", 256), "source_reference": F.col("user_id").cast("string")})
    return rows.select("user_id", "event_type", F.concat(F.lit("snap_"), sha).alias("snapshot_id"))


@query("""SELECT o_orderkey, sha256('{"order":' || o_orderkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS fingerprint FROM orders""")
def record_fingerprint(spark, sf):
    fields = {"order": F.col("o_orderkey"), "priority": F.col("o_orderpriority"), "status": F.col("o_orderstatus")}
    return table(spark, sf, "orders").select("o_orderkey", T.canonical_sha(fields).alias("fingerprint"))


_JSON_CHUNK = """'{"chunker_version":"structure-v1","document_sha256":"' || sha256(text) || '","evidence_id":"ev_' || sha256(doc_id || ':' || sha256(text)) || '"}'"""


@query(f"""WITH i AS (SELECT 'ev_' || sha256(doc_id || ':' || sha256(text)) AS id, {_JSON_CHUNK} AS item FROM documents) SELECT 'corpus_' || sha256('[' || string_agg(item, ',' ORDER BY id) || ']') AS fingerprint, count(*) AS members FROM i""")
def corpus_fingerprint(spark, sf):
    sha = F.sha2("text", 256)
    id_ = F.concat(F.lit("ev_"), F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), sha), 256))
    return C.corpus_fingerprint(table(spark, sf, "documents").select(id_.alias("evidence_id"), sha.alias("document_sha256"), F.lit("structure-v1").alias("chunker_version")))


@query("SELECT 'manifest_' || sha256('{\"entries\":[' || string_agg('{\"content_sha256\":\"' || sha256(o_orderpriority) || '\",\"source_id\":' || o_orderkey || '}', ',' ORDER BY o_orderkey) || ']}') AS identity, count(*) AS entries FROM orders")
def manifest_freeze(spark, sf):
    entry = F.to_json(F.struct(F.sha2("o_orderpriority", 256).alias("content_sha256"), F.col("o_orderkey").alias("source_id")))
    frozen = O.freeze_manifest(table(spark, sf, "orders").select(F.col("o_orderkey").alias("source_id"), entry.alias("entry")), new_folder(spark, "manifests"))
    return frozen.select("identity", "entries")


_BUCKETS = "SELECT b, sha256(string_agg(digest, ',' ORDER BY digest)) AS part, count(*) AS n FROM (SELECT *, substring(digest, 1, 4) AS b FROM (SELECT {digest} AS digest FROM {table})) GROUP BY b"


@query("WITH p AS (" + _BUCKETS.format(digest="sha256(concat(o_orderkey, '|', o_orderstatus))", table="orders") + ") SELECT sha256(string_agg(part, ',' ORDER BY b)) AS fingerprint, sum(n)::BIGINT AS members FROM p")
def manifest_identity(spark, sf):
    rows = table(spark, sf, "orders").select(F.sha2(F.concat_ws("|", "o_orderkey", "o_orderstatus"), 256).alias("digest"))
    return C.set_fingerprint(rows)


@query("""SELECT 'page-' || page_id || '.html' AS path, 'html' AS format, sha256(html) AS content_sha256, strlen(html)::BIGINT AS byte_size FROM pages
UNION ALL SELECT 'doc-' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.PDF' WHEN doc_id % 5 = 0 THEN '.docx' ELSE '.txt' END, CASE WHEN doc_id % 7 = 0 THEN 'pdf' WHEN doc_id % 5 = 0 THEN 'docx' ELSE NULL END, sha256(text), strlen(text)::BIGINT FROM documents""")
def artifact_inventory(spark, sf):
    from ..sources.files import document_format

    pages = table(spark, sf, "pages").select(F.concat(F.lit("page-"), "page_id", F.lit(".html")).alias("path"), F.col("html").alias("content"))
    end = F.when(F.col("doc_id") % 7 == 0, ".PDF").when(F.col("doc_id") % 5 == 0, ".docx").otherwise(".txt")
    docs = table(spark, sf, "documents").select(F.concat(F.lit("doc-"), "doc_id", end).alias("path"), F.col("text").alias("content"))
    rows = pages.unionByName(docs)
    return rows.select("path", document_format(F.col("path")).alias("format"), F.sha2("content", 256).alias("content_sha256"), F.octet_length("content").cast("long").alias("byte_size"))


@query("""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '../x/' || doc_id WHEN doc_id % 17 = 0 THEN 'gone/' || doc_id ELSE 'docs/' || doc_id END AS path,
  CASE WHEN doc_id % 11 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS sha FROM documents), f AS (SELECT 'docs/' || doc_id AS path, sha256(text) AS actual FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(m.path, '^/|(^|/)\\.\\.(/|$)') THEN 'outside-root' WHEN actual IS NULL THEN 'missing' WHEN actual <> sha THEN 'hash-mismatch' ELSE 'verified' END AS verdict FROM m LEFT JOIN f USING (path)""")
def manifest_verify(spark, sf):
    docs = table(spark, sf, "documents")
    path = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("../x/"), "doc_id")).when(F.col("doc_id") % 17 == 0, F.concat(F.lit("gone/"), "doc_id")).otherwise(F.concat(F.lit("docs/"), "doc_id"))
    sha = F.when(F.col("doc_id") % 11 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    entries = docs.select("doc_id", path.alias("path"), sha.alias("content_sha256"))
    files = docs.select(F.concat(F.lit("docs/"), "doc_id").alias("path"), F.sha2("text", 256).alias("actual"))
    return O.verify_manifest(entries, files).select("doc_id", "verdict")


@query("""WITH o AS (SELECT o_orderkey AS source_id, o_orderstatus AS kind, o_orderdate AS captured_at, sha256(o_orderpriority) AS content_sha256 FROM orders WHERE o_orderkey % 4 <> 3),
n AS (SELECT o_orderkey AS source_id, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS kind, o_orderdate + CASE WHEN o_orderkey % 5 = 0 THEN INTERVAL 0 DAY ELSE INTERVAL 1 DAY END AS captured_at,
  CASE WHEN o_orderkey % 2 = 0 THEN sha256(o_orderpriority || 'v2') ELSE sha256(o_orderpriority) END AS content_sha256 FROM orders WHERE o_orderkey % 3 = 0),
b AS (SELECT coalesce(o.source_id, n.source_id) AS source_id, CASE WHEN n.source_id IS NULL THEN 'kept' WHEN o.source_id IS NULL THEN 'created' WHEN o.kind <> n.kind THEN 'rejected-identity' WHEN n.captured_at <= o.captured_at THEN 'rejected-not-later' ELSE 'updated' END AS outcome,
  o.content_sha256 AS oc, n.content_sha256 AS nc FROM o FULL JOIN n ON o.source_id = n.source_id)
SELECT source_id, outcome, outcome = 'updated' AND oc <> nc AS content_changed, CASE WHEN outcome IN ('created', 'updated') THEN nc ELSE oc END AS content_sha256 FROM b""")
def manifest_upsert(spark, sf):
    orders = table(spark, sf, "orders")
    key, later = F.col("o_orderkey"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate")).otherwise(F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"))
    old = orders.filter("o_orderkey % 4 <> 3").select(key.alias("source_id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderdate").alias("captured_at"), F.sha2("o_orderpriority", 256).alias("content_sha256"))
    sha = F.when(key % 2 == 0, F.sha2(F.concat("o_orderpriority", F.lit("v2")), 256)).otherwise(F.sha2("o_orderpriority", 256))
    new = orders.filter("o_orderkey % 3 = 0").select(key.alias("source_id"), F.when(key % 9 == 0, "X").otherwise(F.col("o_orderstatus")).alias("kind"), later.alias("captured_at"), sha.alias("content_sha256"))
    return O.manifest_upsert(old, new, ["kind"]).select("source_id", "outcome", F.coalesce("content_changed", F.lit(False)).alias("content_changed"), "content_sha256")


@query("""WITH i AS (SELECT doc_id, CASE WHEN n_chars < 100 THEN 'no-extractable-content' WHEN doc_id % 97 = 96 THEN 'pdf-text-layer-missing' END AS failure FROM documents)
SELECT policy, status, coalesce(failure, '') AS failure, count(*) AS n FROM (
 SELECT 'continue' AS policy, failure, CASE WHEN failure IS NULL THEN 'succeeded' ELSE 'parsing_failed' END AS status FROM i
 UNION ALL SELECT 'stop', failure, CASE WHEN doc_id > (SELECT min(doc_id) FROM i WHERE failure IS NOT NULL) THEN 'not_attempted' WHEN failure IS NULL THEN 'succeeded' ELSE 'parsing_failed' END FROM i) GROUP BY ALL""")
def ingest_report(spark, sf):
    failure = F.when(F.col("n_chars") < 100, "no-extractable-content").when(F.col("doc_id") % 97 == 96, "pdf-text-layer-missing")
    items = table(spark, sf, "documents").select("doc_id", failure.alias("failure"))
    both = [O.ingest_report(items, "doc_id", p).withColumn("policy", F.lit(p)) for p in ("continue", "stop")]
    return both[0].unionByName(both[1]).groupBy("policy", "status", F.coalesce("failure", F.lit("")).alias("failure")).agg(F.count(F.lit(1)).alias("n"))


DUCK_EVENTS = "obs AS (SELECT user_id AS source, sha256(event_type) AS sha, event_id AS seq, ts AS seen FROM events)"


def _observations(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("source"), F.sha2("event_type", 256).alias("sha"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))


@query(f"""WITH {DUCK_EVENTS}, s AS (SELECT source, sha, min(seq) AS f, max(seq) AS l, arg_min(seen, seq) AS first_observed, max(seen) AS last_observed FROM obs GROUP BY source, sha)
SELECT source, sha, row_number() OVER (PARTITION BY source ORDER BY f)::INT AS version, epoch_us(first_observed) AS first_us, epoch_us(last_observed) AS last_us, l = max(l) OVER (PARTITION BY source) AS is_current FROM s""")
def snapshot_versions(spark, sf):
    rows = O.snapshot_versions(_observations(spark, sf))
    return rows.select("source", "sha", "version", F.unix_micros(F.col("first_observed").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last_observed").cast("timestamp")).alias("last_us"), "is_current")


@query(f"""WITH {DUCK_EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY source, sha ORDER BY seq) = 1 AS created, lag(sha) OVER (PARTITION BY source ORDER BY seq) AS before FROM obs)
SELECT source, seq, created, coalesce(before <> sha, false) AS content_changed FROM r""")
def snapshot_transitions(spark, sf):
    return O.snapshot_log(_observations(spark, sf)).select("source", "seq", "created", "content_changed")


@query(f"""WITH RECURSIVE {DUCK_CHUNKS}, cur AS (SELECT DISTINCT user_id FROM events WHERE event_id % 2 = 0)
SELECT doc_id, chunk_ordinal::INT AS chunk_ordinal, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE 'now' END AS chunker_version FROM chunks WHERE doc_id % 5 <> 0 AND doc_id IN (SELECT user_id FROM cur)""")
def current_chunks(spark, sf):
    """A document's snapshot is current if its user has an even event; each fifth document was cut by an older chunker."""
    made = F.when(F.col("doc_id") % 5 == 0, "old").otherwise("now")
    chunks = _chunks(spark, sf).withColumns({"evidence_id": F.concat_ws(":", "doc_id", "chunk_ordinal"), "chunker_version": made})
    links = chunks.select(F.concat(F.lit("snap_"), "doc_id").alias("snapshot_id"), "evidence_id")
    seen = table(spark, sf, "events").groupBy(F.concat(F.lit("snap_"), "user_id").alias("snapshot_id")).agg(F.bool_or(F.col("event_id") % 2 == 0).alias("is_current"))
    return O.current_chunks(chunks, links, seen, "now").select("doc_id", "chunk_ordinal", "chunker_version")


@query("""WITH e AS (SELECT DISTINCT md5(text) AS id FROM documents WHERE doc_id % 3 = 0), i AS (SELECT md5(text) AS id, doc_id FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id) AS n FROM i)
SELECT id, doc_id FROM f WHERE n = 1 AND id NOT IN (SELECT id FROM e)""")
def idempotent_append(spark, sf):
    docs = table(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("id"), "doc_id")
    return O.idempotent_append(docs.filter("doc_id % 3 = 0"), docs, "id", F.col("doc_id"))


@query("""WITH u AS (SELECT md5(text) AS id, doc_id, 0 AS part FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT md5(text), doc_id, 1 FROM documents WHERE doc_id % 2 = 0)
SELECT id, doc_id, part FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part, doc_id) AS n FROM u) WHERE n = 1""")
def dedupe_union(spark, sf):
    docs = table(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("id"), "doc_id")
    both = docs.filter("doc_id % 3 = 0").withColumn("part", F.lit(0)).unionByName(docs.filter("doc_id % 2 = 0").withColumn("part", F.lit(1)))
    return O.first_of(both, ["id"], F.col("part"), F.col("doc_id"))


@query("""WITH a AS (SELECT md5(text) AS id, doc_id AS snapshot FROM documents), b AS (SELECT md5(text) AS id, doc_id AS snapshot FROM documents WHERE doc_id % 2 = 0)
SELECT b.id, b.snapshot, min(a.snapshot) AS linked_to FROM b JOIN a ON a.id = b.id AND a.snapshot <> b.snapshot GROUP BY 1, 2""")
def link_conflicts(spark, sf):
    docs = table(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("id"), F.col("doc_id").alias("snapshot"))
    return O.link_conflicts(docs, docs.filter("snapshot % 2 = 0"))


@query("SELECT text_sha, count(*) AS documents, min(doc_id) AS first_id FROM (SELECT sha256(text) AS text_sha, doc_id FROM documents) GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    return O.exact_duplicates(table(spark, sf, "documents"), "doc_id")


@query("SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return O.duplicate_keys(table(spark, sf, "orders").select(F.col("o_custkey").alias("key")), "key")


@query("SELECT doc_id FROM labels EXCEPT SELECT vec_id FROM embeddings")
def corpus_minus(spark, sf):
    return O.missing_ids(table(spark, sf, "labels"), table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("""WITH j AS (SELECT l.doc_id, sha256(CASE WHEN l.doc_id % 41 = 7 THEN d.text || 'x' ELSE d.text END) AS sha FROM labels l JOIN documents d USING (doc_id)), c AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 50 <> 3)
SELECT j.doc_id, CASE WHEN c.doc_id IS NULL THEN 'outside-corpus' ELSE 'wrong-hash' END AS problem FROM j LEFT JOIN c ON c.doc_id = j.doc_id WHERE c.doc_id IS NULL OR c.sha <> j.sha""")
def qrels_outside_corpus(spark, sf):
    docs = table(spark, sf, "documents")
    then = F.sha2(F.when(F.col("doc_id") % 41 == 7, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256)  # judged on another text
    judged = table(spark, sf, "labels").select("doc_id").join(docs, "doc_id").select(F.col("doc_id").alias("id"), then.alias("document_sha256"))
    corpus = docs.filter("doc_id % 50 <> 3").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("document_sha256"))
    return O.judged_outside(judged, corpus).withColumnRenamed("id", "doc_id")


@query("""WITH e AS (SELECT DISTINCT source, lang FROM documents), a AS (SELECT DISTINCT source, lang FROM documents WHERE n_chars > 500)
SELECT source, count(e.lang) AS expected, count(a.lang) AS actual, count(e.lang) = count(a.lang) AND count(e.lang) = count(*) AS equal FROM e FULL JOIN a USING (source, lang) GROUP BY source""")
def id_set_equality(spark, sf):
    docs = table(spark, sf, "documents")
    return O.sets_equal(docs, docs.filter("n_chars > 500"), "source", "lang")


_PROFILED = "SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'html' ELSE 'pdf' END AS format, CASE WHEN doc_id % 4 = 0 THEN 'revoked' ELSE 'active' END AS status, CASE WHEN doc_id % 6 <> 1 THEN doc_id END AS published FROM documents"
_PROFILE_BY = ("lang", "source", "format", "status")


def _duck_profile(name: str, value: str) -> str:
    return f"""SELECT '{name}' AS dimension, v AS value, sum(n)::BIGINT AS documents, sum(bytes)::BIGINT AS bytes, count(*) AS contents, count(*) FILTER (WHERE n > 1) AS duplicate_groups,
  coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS duplicate_documents, sum(missing)::BIGINT AS missing_dates
  FROM (SELECT {value} AS v, sha256(text) AS sha, count(*) AS n, sum(strlen(text)) AS bytes, count(*) FILTER (WHERE published IS NULL) AS missing FROM d GROUP BY 1, 2) GROUP BY v"""


@query(f"WITH d AS ({_PROFILED}) " + " UNION ALL ".join(_duck_profile(c, c) for c in _PROFILE_BY) + " UNION ALL " + _duck_profile("all", "NULL::VARCHAR"))
def corpus_profile(spark, sf):
    return O.profile(sql(spark, sf, _PROFILED, "documents"), _PROFILE_BY, F.col("published"))


@query("SELECT doc_id, CASE WHEN d.source = 'src' || (doc_id % 20) AND sha256(text) = sha256(d2t) THEN 'matched' WHEN sha256(text) <> sha256(d2t) THEN 'hash-differs' ELSE 'source-differs' END AS verdict FROM (SELECT *, CASE WHEN doc_id % 19 = 0 THEN text || ' ' ELSE text END AS d2t FROM documents) d")
def manifest_document_join(spark, sf):
    docs = table(spark, sf, "documents")
    entries = docs.select("doc_id", F.concat(F.lit("src"), F.col("doc_id") % 20).alias("source"), F.sha2(F.when(F.col("doc_id") % 19 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("content_sha256"))
    return O.match_documents(entries, docs.select("doc_id", "source", F.sha2("text", 256).alias("content_sha256")), "doc_id")


#: Six entities of the given tables, as text that Spark and DuckDB read alike, with rows that break their rules.
_ENTITIES = {
    "domain": ("supplier", "SELECT concat('d', s_suppkey) AS id, CASE WHEN s_suppkey % 50 = 0 THEN 'pending' WHEN s_suppkey % 3 = 0 THEN 'revoked' ELSE 'active' END AS status, concat('f', s_suppkey - CASE WHEN s_suppkey % 40 = 1 THEN 1 ELSE 0 END) AS record_fingerprint FROM supplier"),
    "chunk": (
        "documents",
        "SELECT concat('ev', doc_id) AS evidence_id, doc_id % 13 - 1 AS source_fragment_ordinal, CASE WHEN doc_id % 31 <> 5 THEN doc_id % 4 END AS chunk_ordinal, CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 END AS page_number, CASE WHEN doc_id % 3 = 1 THEN doc_id % 8 END AS slide_number,"
        " CASE WHEN doc_id % 5 = 0 THEN 1 END AS table_number, CASE WHEN doc_id % 10 = 0 OR doc_id % 33 = 1 THEN 1 END AS table_row_number FROM documents",
    ),
    "snapshot": (
        "events",
        "SELECT concat('s', event_id) AS snapshot_id, concat('u', user_id) AS source_reference, concat('c', event_id % 6) AS content_sha256, event_id % 9 AS version_number, event_id - 5 AS byte_size, CASE WHEN event_id % 17 = 0 THEN 'txt' ELSE 'pdf' END AS document_format,"
        " event_id AS first_observed_at, event_id - CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END AS last_observed_at, event_id % 23 = 0 AS is_current FROM events",
    ),
    "link": ("documents", "SELECT concat('s', doc_id * 3) AS snapshot_id, concat('ev', doc_id - CASE WHEN doc_id % 8 = 1 THEN 1 WHEN doc_id % 8 = 2 THEN 10000000 ELSE 0 END) AS evidence_id FROM documents"),
    "record": (
        "orders",
        "SELECT concat('r', o_orderkey) AS record_id, concat('fp', o_orderkey - CASE WHEN o_orderkey % 71 = 0 THEN o_orderkey % 142 ELSE 0 END) AS record_fingerprint, concat('s', o_orderkey % 700) AS source_snapshot_id, o_orderkey % 29 = 0 AS is_current,"
        " CASE o_orderkey % 4 WHEN 0 THEN 'normalized' WHEN 1 THEN 'not_stated' WHEN 2 THEN 'manual_review_required' ELSE CASE WHEN o_orderkey % 12 = 3 THEN 'unclear' ELSE 'not_stated' END END AS deadline_status,"
        " CASE WHEN o_orderkey % 4 IN (0, 2) OR o_orderkey % 20 = 1 THEN 'raw' END AS deadline_raw, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 16 <> 0 THEN o_orderdate END AS deadline, CASE WHEN o_orderkey % 4 = 2 AND o_orderkey % 10 <> 4 THEN 'reason' END AS deadline_reason,"
        " CASE WHEN o_orderkey % 58 <> 0 THEN o_orderdate END AS activated_at, CASE WHEN o_orderkey % 87 <> 0 THEN 'run' END AS activation_reference FROM orders",
    ),
    "citation": ("lineitem", "SELECT concat('r', l_orderkey + CASE WHEN l_partkey % 97 = 0 THEN 1000000000 ELSE 0 END) AS record_id, concat('field', l_linenumber % 3) AS field_path, l_linenumber - CASE WHEN l_suppkey % 7 = 0 THEN 3 ELSE 0 END AS citation_ordinal, concat('ev', l_partkey % 1300) AS evidence_id FROM lineitem"),
}


def _duck_rule(entity: str, key: str, rule: str, broken: str) -> str:
    return f"SELECT '{entity}' AS entity, {key} AS key, '{rule}' AS rule FROM {entity} WHERE {broken}"


def _duck_twice(entity: str, key: str, rule: str, columns: str, where: str = "true") -> str:
    return f"SELECT '{entity}', {key}, '{rule}' FROM (SELECT *, count(*) OVER (PARTITION BY {columns}) AS n FROM {entity} WHERE {where}) WHERE n > 1"


_CITATION = "concat_ws('|', record_id, field_path, citation_ordinal)"
_DUCK_VIOLATIONS = "WITH " + ", ".join(f"{n} AS ({text})" for n, (_, text) in _ENTITIES.items()) + " " + " UNION ALL ".join(
    [
        _duck_rule("domain", "id", "status-known", "status NOT IN ('active', 'revoked')"),
        _duck_twice("domain", "id", "one-fingerprint", "record_fingerprint"),
        _duck_rule("chunk", "evidence_id", "source_fragment_ordinal-from-0", "source_fragment_ordinal < 0"),
        _duck_rule("chunk", "evidence_id", "chunk_ordinal-missing", "chunk_ordinal IS NULL"),
        _duck_rule("chunk", "evidence_id", "page_number-from-1", "page_number < 1"),
        _duck_rule("chunk", "evidence_id", "slide_number-from-1", "slide_number < 1"),
        _duck_rule("chunk", "evidence_id", "row-within-table", "table_row_number IS NOT NULL AND table_number IS NULL"),
        _duck_rule("snapshot", "snapshot_id", "format-known", "document_format = 'txt'"),
        _duck_rule("snapshot", "snapshot_id", "size-from-0", "byte_size < 0"),
        _duck_rule("snapshot", "snapshot_id", "version-from-1", "version_number < 1"),
        _duck_rule("snapshot", "snapshot_id", "observed-in-order", "last_observed_at < first_observed_at"),
        _duck_twice("snapshot", "snapshot_id", "one-version-of-content", "source_reference, content_sha256"),
        _duck_twice("snapshot", "snapshot_id", "one-content-of-version", "source_reference, version_number"),
        _duck_twice("snapshot", "snapshot_id", "one-current-of-source", "source_reference", "is_current"),
        _duck_twice("link", "concat_ws('|', snapshot_id, evidence_id)", "one-snapshot-of-evidence", "evidence_id"),
        _duck_rule("link", "concat_ws('|', snapshot_id, evidence_id)", "snapshot-there", "snapshot_id NOT IN (SELECT snapshot_id FROM snapshot)"),
        _duck_rule("link", "concat_ws('|', snapshot_id, evidence_id)", "evidence-there", "evidence_id NOT IN (SELECT evidence_id FROM chunk)"),
        _duck_rule("record", "record_id", "deadline-status-known", "deadline_status = 'unclear'"),
        _duck_rule("record", "record_id", "deadline-consistent", "(deadline_status = 'normalized' AND (deadline IS NULL OR deadline_reason IS NOT NULL)) OR (deadline_status = 'not_stated' AND (deadline_raw IS NOT NULL OR deadline IS NOT NULL OR deadline_reason IS NOT NULL)) OR (deadline_status = 'manual_review_required' AND (deadline_raw IS NULL OR deadline IS NOT NULL OR deadline_reason IS NULL))"),
        _duck_rule("record", "record_id", "current-was-activated", "is_current AND (activated_at IS NULL OR activation_reference IS NULL)"),
        _duck_twice("record", "record_id", "one-fingerprint", "record_fingerprint"),
        _duck_twice("record", "record_id", "one-current-of-snapshot", "source_snapshot_id", "is_current"),
        _duck_rule("record", "record_id", "snapshot-there", "source_snapshot_id NOT IN (SELECT snapshot_id FROM snapshot)"),
        _duck_rule("citation", _CITATION, "ordinal-from-1", "citation_ordinal < 1"),
        _duck_twice("citation", _CITATION, "one-key", "record_id, field_path, citation_ordinal"),
        _duck_rule("citation", _CITATION, "record-there", "record_id NOT IN (SELECT record_id FROM record)"),
        _duck_rule("citation", _CITATION, "evidence-there", "evidence_id NOT IN (SELECT evidence_id FROM chunk)"),
    ]
)


@query(_DUCK_VIOLATIONS)
def contract_violations(spark, sf):
    """Rules of rows, unique keys and references of six entities, made of the given tables."""
    return contracts.violations({name: sql(spark, sf, text, source) for name, (source, text) in _ENTITIES.items()})


@query(f"""SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(replace(lower(regexp_replace(d.text, '{W}', '', 'g')), 'ß', 'ss'), replace(lower(regexp_replace(b.text, '{W}', '', 'g')), 'ß', 'ss'))""")
def anchor_support(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.quote_key(F.col("text")).alias("text"))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), T.quote_key(F.col("text")).alias("text"))
    found = containing(docs, items, AT_LETTERS)  # keys have no white space
    return found.select(F.col("item").alias("item_id"), F.col("id").alias("doc_id"))


@query(f"SELECT doc_id, md5(replace(lower(regexp_replace(text, '{W}', '', 'g')), 'ß', 'ss')) AS key FROM documents")
def quote_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.quote_key(F.col("text")).cast("binary")).alias("key"))


_CLEAN = "trim(regexp_replace(x, '(?i)bearer\\s+[a-z0-9._-]+', '[redacted bearer token]', 'g'))"


@query(f"""WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN text || ' Bearer abc.def-1 end' ELSE text END AS x FROM conversations), k AS (SELECT conv_id, turn, {_CLEAN} AS t FROM c)
SELECT conv_id, turn, md5(CASE WHEN length(t) > 600 THEN rtrim(substring(t, 1, 599)) || '…' ELSE t END) AS digest, contains(t, '[redacted bearer token]') AS redacted, length(t) > 600 AS cut FROM k""")
def safe_turn(spark, sf):
    x = F.when(F.col("conv_id") % 5 == 0, F.concat("text", F.lit(" Bearer abc.def-1 end"))).otherwise(F.col("text"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", T.safe_turn(x).alias("t"), F.trim(F.regexp_replace(x, T.BEARER, "[redacted bearer token]")).alias("whole"))
    return rows.select("conv_id", "turn", F.md5(F.col("t").cast("binary")).alias("digest"), F.contains("whole", F.lit("[redacted bearer token]")).alias("redacted"), (F.length("whole") > 600).alias("cut"))


#: Turns of conversations, some of which are old ones without a role, hold a token, or are of a role that isn't kept.
_TURNS = "SELECT conv_id, turn, CASE WHEN turn % 7 = 0 THEN NULL WHEN turn % 11 = 5 THEN 'tool' ELSE role END AS role, CASE WHEN conv_id % 5 = 0 THEN concat(text, ' Bearer abc.def-1 end') ELSE text END AS text FROM conversations"
DUCK_TURNS = f"""tu AS ({_TURNS}), nt AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, {_CLEAN.replace('x,', 'text,')} AS t FROM tu),
kept AS (SELECT conv_id, turn, role, CASE WHEN length(t) > 600 THEN rtrim(substring(t, 1, 599)) || '…' ELSE t END AS text FROM nt WHERE role IN ('user', 'assistant') AND t <> '')"""


@query(f"WITH {DUCK_TURNS} SELECT conv_id, turn, role, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM kept) WHERE n <= 12")
def conversation_window(spark, sf):
    from ..streaming.state import conversation_window as window
    from ..streaming.state import normalized_turns

    rows = window(normalized_turns(sql(spark, sf, _TURNS, "conversations")), 12)
    return rows.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"""WITH r AS (SELECT source, unnest(list_filter([CASE WHEN trim(regexp_replace(text, '{W}+', ' ', 'g')) = '' THEN 'blank' END, CASE WHEN regexp_matches(text, '[\\x00-\\x08\\x0b-\\x1f]') THEN 'control-character' END, CASE WHEN regexp_matches(text, 'Bearer\\s+\\S+') THEN 'bearer' END,
 CASE WHEN regexp_matches(text, 'eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+') THEN 'jwt' END, CASE WHEN regexp_matches(text, 'sk-[A-Za-z0-9_-]{{16,}}') THEN 'secret-key' END], lambda r: r IS NOT NULL)) AS rule FROM documents)
SELECT source, rule, count(*) AS documents FROM r GROUP BY ALL""")
def credential_screen(spark, sf):
    rows = table(spark, sf, "documents").select("source", F.explode(T.credential_rules(F.col("text"))).alias("rule"))
    return rows.groupBy("source", "rule").agg(F.count(F.lit(1)).alias("documents"))
