"""Queries of parsing and ingestion: formats to their parsers, failures to another way, chunks to a kept table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import parsing as P
from ..sources.kept import KeptTable
from ..sources.scratch import new_folder
from .base import query, table
from .corpus import DUCK_CHUNKS
from .evaluation import _DUCK_FRAGMENTS

_DUCK_PATHS = f"""{_DUCK_FRAGMENTS}, paths(page, ordinal, path) AS (SELECT page, ordinal, CASE WHEN level > 0 THEN [text] ELSE []::VARCHAR[] END FROM o WHERE ordinal = 0
UNION ALL SELECT o.page, o.ordinal, CASE WHEN level > 0 THEN list_append(list_slice(path, 1, level - 1), text) ELSE path END FROM paths JOIN o ON o.page = paths.page AND o.ordinal = paths.ordinal + 1)"""
_BLOCKS = DUCK_CHUNKS.replace("FROM documents", "FROM blocks")
_JSON = """'{"chunk_ordinal":' || chunk_ordinal || ',"chunker_version":"structure-v1;max_chars=800;overlap_chars=100","document_sha256":"' || sha || '","location":{"cell_reference":null,"heading_path":' || to_json(path)
 || ',"page_number":' || coalesce(page_number::VARCHAR, 'null') || ',"sheet_name":null,"slide_number":null,"table_number":null,"table_row_number":null},"source_fragment_ordinal":' || ordinal || ',"source_reference":' || to_json(name) || ',"text":' || to_json(text) || '}'"""


def _web(spark, sf):
    """Pages as documents of the html format."""
    return table(spark, sf, "pages").select(F.concat(F.lit("page-"), "page_id").alias("source"), F.lit("html").alias("format"), F.sha2("html", 256).alias("content_sha256"), F.col("html").alias("content"))


@query(f"""WITH RECURSIVE {_DUCK_PATHS}, blocks AS (SELECT page * 100000 + ordinal AS doc_id, '' AS source, text FROM o), {_BLOCKS},
i AS (SELECT 'page-' || page AS name, ordinal, c.chunk_ordinal, c.text, path, NULL::INT AS page_number, sha256(html) AS sha FROM chunks c JOIN paths ON page * 100000 + ordinal = c.doc_id JOIN pages ON page_id = page)
SELECT name AS source, ordinal AS source_fragment_ordinal, chunk_ordinal::INT AS chunk_ordinal, 'ev_' || sha256({_JSON}) AS evidence_id FROM i""")
def located_evidence(spark, sf):
    """Pages to fragments under their headings, to chunks, to ids that hold the heading path."""
    chunks = P.identified_chunks(P.parse(_web(spark, sf), {"html": P.parse_html}))
    return chunks.select("source", "source_fragment_ordinal", "chunk_ordinal", "evidence_id")


def _papers(spark, sf):
    """Documents as paged ones: some with a text layer, some with recognized regions instead, some with neither, some of another
    format; what was recorded of them."""
    docs = table(spark, sf, "documents").filter("text IS NOT NULL").withColumn("source", F.concat(F.lit("doc-"), "doc_id"))
    kind = F.when(F.col("doc_id") % 11 == 3, "docx").otherwise("pdf")
    papers = docs.select("source", kind.alias("format"), F.sha2("text", 256).alias("content_sha256"), F.col("text").alias("content"))
    layers = docs.filter("doc_id % 3 = 0").select("source", F.posexplode(F.split("text", "\n")).alias("page_number", "text")).withColumn("page_number", F.col("page_number") + 1)
    words = docs.filter("doc_id % 3 = 1").select("source", F.posexplode(F.split("text", r"\s+")).alias("n", "text"))
    x0, y0 = (F.col("n") % 5) * 0.2, F.floor(F.col("n") % 40 / 5) * 0.12
    box = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x0 + 0.1, y0), (x0 + 0.1, y0 + 0.1), (x0, y0 + 0.1))])
    regions = words.select("source", F.floor(F.col("n") / 40).cast("int").alias("page_number"), "text", F.lit(0.9).alias("confidence"), box.alias("polygon"))
    return papers, layers, regions.withColumn("page_number", F.col("page_number") + 1)


_DUCK_PAPERS = rf"""{_DUCK_PATHS},
papers AS (SELECT doc_id, 'doc-' || doc_id AS name, sha256(text) AS sha, text, doc_id % 11 = 3 AS other FROM documents WHERE text IS NOT NULL),
layer AS (SELECT name, sha, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS page_number, unnest(string_split(text, chr(10))) AS text FROM papers WHERE doc_id % 3 = 0 AND NOT other),
word AS (SELECT name, sha, unnest(range(len(regexp_split_to_array(text, '\s+')))) AS n, unnest(regexp_split_to_array(text, '\s+')) AS text FROM papers WHERE doc_id % 3 = 1 AND NOT other),
region AS (SELECT name, sha, n // 40 + 1 AS page_number, string_agg(text, chr(10) ORDER BY n) AS text FROM word WHERE trim(text) <> '' GROUP BY ALL),
paged AS (SELECT name, sha, (row_number() OVER (PARTITION BY name ORDER BY page_number) - 1)::INT AS ordinal, page_number::INT AS page_number, text FROM (SELECT * FROM layer UNION ALL SELECT * FROM region) WHERE trim(text) <> ''),
frag AS (SELECT *, row_number() OVER () AS number FROM (
  SELECT 'page-' || page AS name, sha256(html) AS sha, ordinal, NULL::INT AS page_number, path, o.text FROM o JOIN paths USING (page, ordinal) JOIN pages ON page_id = page
  UNION ALL SELECT name, sha, ordinal, page_number, []::VARCHAR[], text FROM paged)),
everything AS (SELECT 'page-' || page_id AS name, 'no-extractable-content' AS failed FROM pages UNION ALL SELECT name, CASE WHEN other THEN 'parser-not-registered' ELSE 'no-extractable-content' END FROM papers)"""


def _parsed(spark, sf):
    papers, layers, regions = _papers(spark, sf)
    documents = _web(spark, sf).unionByName(papers)
    return P.parse(documents, {"html": P.parse_html, "pdf": P.text_layers(layers)}, {"pdf-text-layer-missing": P.recognized(regions)})


@query(f"""WITH RECURSIVE {_DUCK_PAPERS} SELECT name AS source, ordinal, page_number, array_to_string(path, ' > ') AS heading_path, md5(text) AS digest, NULL::VARCHAR AS failure FROM frag
UNION ALL SELECT name, NULL, NULL, NULL, NULL, failed FROM everything WHERE name NOT IN (SELECT name FROM frag)""")
def parsed_documents(spark, sf):
    """Pages and papers through their formats' parsers; papers without a text layer by their recognized regions."""
    rows = _parsed(spark, sf)
    path = F.when(F.col("failure").isNull(), F.array_join("location.heading_path", " > "))
    return rows.select("source", "ordinal", F.col("location.page_number").alias("page_number"), path.alias("heading_path"), F.md5(F.col("text").cast("binary")).alias("digest"), "failure")


@query(f"""WITH RECURSIVE {_DUCK_PAPERS}, blocks AS (SELECT number AS doc_id, '' AS source, text FROM frag), {_BLOCKS},
ids AS (SELECT name, 'ev_' || sha256({_JSON}) AS id FROM (SELECT name, sha, ordinal, page_number, path, c.chunk_ordinal, c.text FROM frag JOIN chunks c ON c.doc_id = number)),
old AS (SELECT DISTINCT id FROM ids WHERE name LIKE 'page-%'),
added AS (SELECT name, count(*) AS chunks, count(DISTINCT id) FILTER (WHERE id NOT IN (SELECT id FROM old)) AS inserted FROM ids GROUP BY name),
counted AS (SELECT name, count(*) AS fragments FROM frag GROUP BY name)
SELECT e.name AS source, CASE WHEN fragments IS NULL THEN 'parsing_failed' ELSE 'succeeded' END AS status, CASE WHEN fragments IS NULL THEN failed END AS failure, coalesce(fragments, 0) AS fragments,
  coalesce(chunks, 0) AS chunks, coalesce(inserted, 0) AS inserted, coalesce(chunks, 0) - coalesce(inserted, 0) AS skipped FROM everything e LEFT JOIN counted USING (name) LEFT JOIN added USING (name)""")
def ingest_documents(spark, sf):
    """A kept table that has the pages already takes pages and papers: what each document adds to it."""
    kept = KeptTable(spark, new_folder(spark, "corpus"), P.CHUNKS, "evidence_id", ["chunker_version"])
    P.ingest(P.parse(_web(spark, sf), {"html": P.parse_html}), kept, "pages")
    return P.ingest(_parsed(spark, sf), kept, "everything")
