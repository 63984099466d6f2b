"""Queries of retrieval and of its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators.chunking import corpus_fingerprint
from ..operators.embedding import TOKEN_HASH, embedded
from ..sources.scratch import new_folder, written
from .base import DUCK_BM25, DUCK_QRELS, chunks_of, duck_tokens, qrels_of, queries_of, query, sql, table


def _bm25(spark: SparkSession, sf: str, k: int | None) -> DataFrame:
    return R.bm25_search(queries_of(spark, sf), chunks_of(spark, sf), k)


@query(f"SELECT doc_id AS id, coalesce(list_aggregate({duck_tokens('text')}, 'string_agg', ' '), '') AS tokens, len({duck_tokens('text')})::INT AS n FROM documents")
def lexical_tokens(spark, sf):
    from ..functions.text import lexical_tokens as tokens

    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), tokens(F.col("text")).alias("t"))
    return rows.select("id", F.array_join("t", " ").alias("tokens"), F.size("t").alias("n"))


@query(f"WITH {DUCK_BM25} SELECT term, df::BIGINT AS df, n::BIGINT AS n, round(avgdl, 6) AS avgdl FROM dfs, tot")
def bm25_index(spark, sf):
    _, terms, totals = R.bm25_index(chunks_of(spark, sf))
    return terms.crossJoin(F.broadcast(totals)).select("term", "df", "n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {DUCK_BM25} SELECT query, id, round(score, 6) AS score, array_to_string(matched_terms, ' ') AS matched_terms, rank::INT AS rank FROM bmr WHERE rank <= 5")
def bm25_search(spark, sf):
    return _bm25(spark, sf, 5).select("query", "id", F.round("score", 6).alias("score"), F.array_join("matched_terms", " ").alias("matched_terms"), "rank")


@query(f"""WITH {DUCK_BM25}, sdf AS (SELECT source, term, count(*) AS df FROM post GROUP BY ALL),
stot AS (SELECT source, count(*) AS n, avg(length) AS avgdl FROM lens GROUP BY source),
sbm AS (SELECT query, post.source, post.id, round(sum(ln(1 + (stot.n - sdf.df + 0.5) / (sdf.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / stot.avgdl))), 9) AS score
  FROM post JOIN qt USING (term) JOIN sdf ON sdf.term = post.term AND sdf.source = post.source JOIN stot ON stot.source = post.source
  JOIN lens ON lens.id = post.id GROUP BY query, post.source, post.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY score DESC, id) AS rank FROM sbm WHERE score > 0)
SELECT query, source, id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 3""")
def bm25_source_local(spark, sf):
    return R.bm25_search(queries_of(spark, sf), chunks_of(spark, sf, "source"), 3, by="source").select("query", "source", "id", F.round("score", 6).alias("score"), "rank")


DUCK_DENSE = """
vecs AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
norms AS (SELECT id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM vecs),
den AS (SELECT q.id AS query, n.id, n.label, q.label AS qlabel, round(list_dot_product(n.v, q.v), 9) AS score
  FROM norms n, norms q WHERE q.id % 25 = 0 AND n.id <> q.id),
denr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM den)"""


def _vectors(spark, sf, *more):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), *more)


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.filter("id % 25 = 0").select(F.col("id").alias("query"), "vector")


@query(f"WITH {DUCK_DENSE} SELECT query, id, round(score, 6) AS score, rank::INT AS rank FROM denr WHERE rank <= 5")
def dense_search(spark, sf):
    vectors = _vectors(spark, sf)
    return R.dense_search(_asked(vectors), vectors, 5, but_itself=True).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {DUCK_DENSE} SELECT query, count(*) AS n, round(avg(score), 6) AS mean_score, round(max(score), 6) AS best FROM den GROUP BY query")
def dense_pairs(spark, sf):
    vectors = _vectors(spark, sf)
    return R.dense_summary(_asked(vectors), vectors).select("query", "n", F.round("mean", 6).alias("mean_score"), F.round("best", 6).alias("best"))


@query(f"""WITH {DUCK_DENSE}, r AS (SELECT den.query, d.source, den.id, den.score, row_number() OVER (PARTITION BY query, d.source ORDER BY score DESC, den.id) AS rank
FROM den JOIN documents d ON d.doc_id = den.id) SELECT query, source, id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 3""")
def dense_source_local(spark, sf):
    vectors = _vectors(spark, sf)
    placed = vectors.join(chunks_of(spark, sf, "source").select("id", "source"), "id")
    return R.dense_search(_asked(vectors), placed, 3, by="source", but_itself=True).select("query", "source", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {DUCK_DENSE}, t AS (SELECT query, id, score FROM den WHERE score > 0.05) SELECT query, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM t) WHERE rank <= 10")
def ranked_topk(spark, sf):
    vectors = _vectors(spark, sf)
    return R.dense_search(_asked(vectors), vectors, 10, least=0.05, but_itself=True).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, len(v)::INT AS dimension, round(sqrt(list_dot_product(v, v)), 5) AS norm,
  CASE WHEN len(v) <> 64 THEN 'wrong-dimension' WHEN sqrt(list_dot_product(v, v)) = 0 THEN 'zero' ELSE 'valid' END AS verdict FROM e""")
def vector_validate(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return R.vector_verdicts(vectors, 64).select("vec_id", "dimension", F.round("norm", 5).alias("norm"), "verdict")


def _indexed(spark, sf):
    """Documents that have a vector, as chunks, and their vectors."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("document_sha256"), F.lit("structure-v1").alias("chunker_version"))
    vectors = _vectors(spark, sf)
    return docs.join(vectors.select("id"), "id", "left_semi"), vectors


_DUCK_INDEX = """c AS (SELECT doc_id::VARCHAR AS id, doc_id, sha256(text) AS sha FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)),
f AS (SELECT 'corpus_' || sha256('[' || string_agg('{"chunker_version":"structure-v1","document_sha256":"' || sha || '","evidence_id":"' || id || '"}', ',' ORDER BY id) || ']') AS fingerprint FROM c)"""


@query(f"WITH {_DUCK_INDEX} SELECT fingerprint, 'given' AS embedder, 'structure-v1' AS chunker_version, 64 AS dimension, (SELECT count(*) FROM c) AS vectors FROM f")
def dense_index_build(spark, sf):
    chunks, vectors = _indexed(spark, sf)
    return R.dense_index(chunks, vectors, new_folder(spark, "index"), embedder="given", dimension=64).drop("digest", "path")


@query("""SELECT 'corpus-fingerprint' AS problem, 1::BIGINT AS found UNION ALL SELECT 'embedder', 1 UNION ALL
SELECT 'not-stored', count(*) FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings) AND doc_id % 10 = 0 UNION ALL SELECT 'unknown-ids', count(*) FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings) AND doc_id % 10 = 1""")
def dense_index_guard(spark, sf):
    """An index without each tenth chunk, asked to serve the chunks but for another tenth, with another embedder."""
    chunks, vectors = _indexed(spark, sf)
    header = R.dense_index(chunks.filter("id % 10 <> 0"), vectors, new_folder(spark, "index"), embedder="given", dimension=64)
    return R.dense_index_problems(header, chunks.filter("id % 10 <> 1"), embedder="other", dimension=64)


_TEXT = "text"


def _duck_vectors(name: str, key: str, tokens: str) -> str:
    """Signed token hashes of tokens (key, t), scaled: name(key, b, x)."""
    place = f"('0x' || substring(md5(t), 1, 8))::BIGINT % {TOKEN_HASH.dimension} AS b, 1 - 2 * (('0x' || substring(md5(t), 9, 1))::BIGINT % 2) AS s"
    return f"""{name}_s AS (SELECT {key}, b, sum(s) AS x FROM (SELECT {key}, {place} FROM {tokens}) GROUP BY {key}, b),
{name} AS (SELECT {key}, b, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS x FROM {name}_s QUALIFY sum(x * x) OVER (PARTITION BY {key}) > 0)"""


DUCK_HYBRID = f"""{DUCK_BM25}, {DUCK_QRELS.strip()},
{_duck_vectors("dvec", "id", "(SELECT id, unnest(tokens) AS t FROM tok)")},
{_duck_vectors("qvec", "query", f"(SELECT item_id AS query, unnest({duck_tokens('text')}) AS t FROM benchmark)")},
hsum AS (SELECT query, id, sum(q.x * d.x) AS score FROM qvec q JOIN dvec d USING (b) GROUP BY query, id),
hden AS (SELECT query, id, round(coalesce(score, 0), 9) AS score FROM (SELECT DISTINCT query FROM qvec) CROSS JOIN (SELECT DISTINCT id FROM dvec) LEFT JOIN hsum USING (query, id)),
hdenr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM hden),
hbmr AS (SELECT query, id, rank, score FROM bmr),
branch AS (SELECT query, id, rank, 'bm25' AS r FROM hbmr UNION ALL SELECT query, id, rank, 'dense' AS r FROM hdenr),
fus AS (SELECT query, id, round(sum(1.0 / (60 + rank)), 9) AS score, max(CASE WHEN r = 'bm25' THEN rank END)::INT AS bm25_rank, max(CASE WHEN r = 'dense' THEN rank END)::INT AS dense_rank
  FROM branch WHERE rank <= 20 GROUP BY query, id),
fusr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM fus)"""


def _embedded(spark, sf):
    """The queries' vectors and the chunks', by source, from their texts alone."""
    chunks = embedded(chunks_of(spark, sf, "source"), instruction=TOKEN_HASH.document_instruction)
    return embedded(queries_of(spark, sf), instruction=TOKEN_HASH.query_instruction), chunks


def _hybrid_branches(spark, sf, candidates=20):
    """The candidates of each query by BM25 and by cosine."""
    asked, chunks = _embedded(spark, sf)
    return _bm25(spark, sf, candidates), R.dense_search(asked, chunks, candidates)


@query(f"WITH {_duck_vectors('v', 'item_id', f'(SELECT item_id, unnest({duck_tokens(_TEXT)}) AS t FROM benchmark)')} SELECT item_id AS query, round(sqrt(sum(x * x)), 6) AS norm, count(*) AS used, sum(b * (x > 0)::INT)::BIGINT AS up, sum(b * (x < 0)::INT)::BIGINT AS down, '{TOKEN_HASH.identity}' AS embedder FROM v WHERE x <> 0 GROUP BY item_id")
def text_embedding(spark, sf):
    """Vectors of the benchmark's passages, by their length and by where they count up and down."""
    rows = embedded(queries_of(spark, sf)).filter("vector IS NOT NULL").select("query", F.posexplode("vector").alias("b", "x")).filter("x <> 0")
    side = lambda c: F.sum(F.when(c, F.col("b")).otherwise(0)).cast("long")
    return rows.groupBy("query").agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("norm"), F.count(F.lit(1)).alias("used"), side(F.col("x") > 0).alias("up"), side(F.col("x") < 0).alias("down"), F.lit(TOKEN_HASH.identity).alias("embedder"))


@query(f"WITH {DUCK_HYBRID} SELECT query, id, round(score, 6) AS score, bm25_rank, dense_rank, rank::INT AS rank FROM fusr")
def rrf_fuse(spark, sf):
    lexical, dense = _hybrid_branches(spark, sf)
    return R.rrf_fuse({"bm25": lexical, "dense": dense}).withColumn("score", F.round("score", 6))


def _versioned(spark, sf):
    """Chunks with what tells their corpus apart: the documents, whole."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.sha2("text", 256).alias("document_sha256"), F.lit("whole-v1").alias("chunker_version"))


_DUCK_CORPUS = """(SELECT 'corpus_' || sha256('[' || string_agg('{"chunker_version":"whole-v1","document_sha256":"' || sha256(text) || '","evidence_id":"' || doc_id || '"}', ',' ORDER BY doc_id::VARCHAR) || ']') FROM documents)"""


@query(f"WITH {DUCK_HYBRID} SELECT query, id, round(score, 6) AS score, bm25_rank, dense_rank, rank::INT AS rank, (SELECT count(*) FROM documents) AS corpus_size, 'whole-v1' AS chunker_version, {_DUCK_CORPUS} AS corpus_fingerprint, '{TOKEN_HASH.identity}' AS embedder FROM fusr WHERE rank <= 5")
def hybrid_search(spark, sf):
    lexical, dense = _hybrid_branches(spark, sf)
    chunks = _versioned(spark, sf)
    report = corpus_fingerprint(chunks.withColumn("evidence_id", F.col("id").cast("string"))).select(F.col("members").alias("corpus_size"), F.lit("whole-v1").alias("chunker_version"), F.col("fingerprint").alias("corpus_fingerprint"), F.lit(TOKEN_HASH.identity).alias("embedder"))
    return R.rrf_fuse({"bm25": lexical, "dense": dense}, k=5).withColumn("score", F.round("score", 6)).crossJoin(F.broadcast(report))  # one row


DUCK_SCOPE = f"""{DUCK_HYBRID},
scope AS (SELECT DISTINCT q.query, d2.doc_id AS id FROM qrels q JOIN documents d1 ON d1.doc_id = q.id JOIN documents d2 ON d2.source = d1.source),
sb AS (SELECT b.query, b.id, 'bm25' AS r, row_number() OVER (PARTITION BY b.query ORDER BY score DESC, b.id) AS rank FROM hbmr b JOIN scope USING (query, id)),
sd AS (SELECT b.query, b.id, 'dense' AS r, row_number() OVER (PARTITION BY b.query ORDER BY score DESC, b.id) AS rank FROM hdenr b JOIN scope USING (query, id)),
sfus AS (SELECT query, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM sb UNION ALL SELECT * FROM sd) WHERE rank <= 20 GROUP BY query, id),
sfusr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM sfus)"""


def _scopes(spark, sf, judged):
    """(query, source): the sources that a passage is from, which is where it may be sought."""
    return judged.join(chunks_of(spark, sf, "source").select("id", "source"), "id").select("query", "source").distinct()


def _allowed(rows, scopes):
    return rows.join(scopes.groupBy("query").agg(F.collect_set("source").alias("scopes")), "query")


def _scoped(spark, sf, scopes):
    """The fused ranking within each query's sources: scores are those over the whole corpus, ranks are within."""
    asked, chunks = _embedded(spark, sf)
    lexical = R.bm25_search(_allowed(queries_of(spark, sf), scopes), chunks_of(spark, sf, "source"), 20, place="source")
    return R.rrf_fuse({"bm25": lexical, "dense": R.dense_search(_allowed(asked, scopes), chunks, 20, scope="source")})


@query(f"WITH {DUCK_SCOPE} SELECT query, id, round(score, 6) AS score, rank::INT AS rank FROM sfusr WHERE rank <= 5")
def hybrid_scoped(spark, sf):
    scopes = written(_scopes(spark, sf, qrels_of(spark, sf)), "scopes")
    return _scoped(spark, sf, scopes).filter("rank <= 5").select("query", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {DUCK_SCOPE} SELECT b.query, b.id, rank::INT AS rank FROM (SELECT hbmr.query, hbmr.id, row_number() OVER (PARTITION BY hbmr.query ORDER BY score DESC, hbmr.id) AS rank FROM hbmr JOIN scope USING (query, id)) b WHERE rank <= 10")
def source_scope(spark, sf):
    scopes = written(_scopes(spark, sf, qrels_of(spark, sf)), "scopes")
    return R.bm25_search(_allowed(queries_of(spark, sf), scopes), chunks_of(spark, sf, "source"), 10, place="source").select("query", "id", "rank")


@query(f"WITH {DUCK_BM25} SELECT 'even' AS batch, query, id, round(score, 6) AS score, rank::INT AS rank FROM bmr WHERE rank <= 5 AND query % 2 = 0 UNION ALL SELECT 'odd', query, id, round(score, 6), rank::INT FROM bmr WHERE rank <= 5 AND query % 2 = 1")
def bm25_stored_search(spark, sf):
    """One stored index, guarded, that serves two batches of queries."""
    chunks, folder = _versioned(spark, sf), new_folder(spark, "bm25")
    header = R.bm25_store(chunks, folder)
    if problems := R.bm25_index_problems(header, chunks).collect():
        raise ValueError(f"the index can't serve these chunks: {problems}")
    batches = []
    for name, rest in (("even", 0), ("odd", 1)):
        ranked = R.bm25_stored_search(queries_of(spark, sf).filter(F.col("query") % 2 == rest), header, 5)
        batches.append(ranked.select(F.lit(name).alias("batch"), "query", "id", F.round("score", 6).alias("score"), "rank"))
    return batches[0].unionByName(batches[1])


def _duck_metrics(ranking: str, k: int, name: str = "m") -> str:
    return f"""{name}_h AS (SELECT qrels.query, qrels.id, grade, r.rank, row_number() OVER (PARTITION BY qrels.query ORDER BY grade DESC, qrels.id) AS ideal
  FROM qrels LEFT JOIN (SELECT query, id, rank FROM {ranking} WHERE rank <= {k}) r ON r.query = qrels.query AND r.id = qrels.id),
{name} AS (SELECT query, round(count(rank) / count(*), 9) AS recall, round(coalesce(1.0 / min(rank), 0.0), 9) AS rr, min(rank)::INT AS first_rank,
  round(sum(CASE WHEN rank IS NOT NULL THEN (pow(2, grade) - 1) / log2(rank + 1.0) ELSE 0.0 END) / sum(CASE WHEN ideal <= {k} THEN (pow(2, grade) - 1) / log2(ideal + 1.0) ELSE 0.0 END), 9) AS ndcg
  FROM {name}_h GROUP BY query)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {DUCK_BM25}, {DUCK_QRELS.strip()}, {_duck_metrics('bmr', 5)} SELECT query, round(recall, 6) AS recall, round(rr, 6) AS rr, first_rank, round(ndcg, 6) AS ndcg FROM m")
def retrieval_metrics(spark, sf):
    return _rounded(R.retrieval_metrics(_bm25(spark, sf, 5), qrels_of(spark, sf), 5))


@query(f"""WITH {DUCK_BM25}, {DUCK_QRELS.strip()}, {_duck_metrics('bmr', 5)}, ql AS (SELECT query, min(lang) AS lang FROM qrels JOIN documents d ON d.doc_id = qrels.id GROUP BY query)
SELECT lang, count(*) AS cases, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM m JOIN ql USING (query) GROUP BY GROUPING SETS ((lang), ())""")
def metrics_by_stratum(spark, sf):
    gold = qrels_of(spark, sf)
    scored = R.retrieval_metrics(_bm25(spark, sf, 5), gold, 5)
    strata = gold.join(chunks_of(spark, sf, "lang"), "id").groupBy("query").agg(F.min("lang").alias("stratum"))
    return R.metric_means(scored, strata).withColumnRenamed("stratum", "lang")


_CUTS = (1, 3, 5, 10)


@query(
    f"WITH {DUCK_BM25}, {DUCK_QRELS.strip()}, "
    + ", ".join(_duck_metrics("bmr", k, f"m{k}") for k in _CUTS)
    + " "
    + " UNION ALL ".join(f"SELECT {k} AS k, count(*) AS cases, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, count(*) FILTER (WHERE rr < 1 OR recall < 1 OR ndcg < 1) AS failed FROM m{k}" for k in _CUTS)
)
def cutoff_sweep(spark, sf):
    return R.cutoff_sweep(_bm25(spark, sf, max(_CUTS)), qrels_of(spark, sf), _CUTS)


@query(f"""WITH {DUCK_HYBRID}, grid AS (SELECT c, k FROM (VALUES (5), (10), (20)) a(c), (VALUES (10), (30), (60)) b(k)),
g AS (SELECT c, k, query, id, round(sum(1.0 / (k + rank)), 9) AS score FROM branch, grid WHERE rank <= c GROUP BY ALL),
gr AS (SELECT *, row_number() OVER (PARTITION BY c, k, query ORDER BY score DESC, id) AS rank FROM g)
SELECT c AS candidates, k AS constant, count(*) FILTER (WHERE q.id IS NOT NULL) AS hits, round(sum(CASE WHEN q.id IS NOT NULL THEN 1.0 / rank ELSE 0 END), 6) AS rr_sum
FROM gr LEFT JOIN qrels q ON q.query = gr.query AND q.id = gr.id WHERE rank <= 5 GROUP BY c, k""")
def rrf_grid(spark, sf):
    return R.rrf_grid(_hybrid_branches(spark, sf), qrels_of(spark, sf), (5, 10, 20), (10, 30, 60))


_REASONS = """list_filter([CASE WHEN first_rank IS NULL THEN 'no-relevant-evidence-retrieved' END, CASE WHEN first_rank > 1 THEN 'first-relevant-result-ranked-late' END,
CASE WHEN recall < 1 THEN 'incomplete-recall' END, CASE WHEN ndcg < 1 THEN 'suboptimal-relevance-order' END], lambda r: r IS NOT NULL)"""


@query(f"WITH {DUCK_BM25}, {DUCK_QRELS.strip()}, {_duck_metrics('bmr', 10)} SELECT query, array_to_string({_REASONS}, ',') AS reasons FROM m WHERE len({_REASONS}) > 0")
def failure_reasons(spark, sf):
    """What is wrong with each case at the largest cutoff."""
    measured = R.retrieval_metrics(_bm25(spark, sf, max(_CUTS)), qrels_of(spark, sf), max(_CUTS))
    return R.failure_reasons(measured).select("query", F.array_join("reasons", ",").alias("reasons"))


_DUCK_DIAGNOSIS = f"""{DUCK_BM25}, {DUCK_QRELS.strip()}, qtok AS (SELECT item_id AS query, list_distinct({duck_tokens('text')}) AS t FROM benchmark),
ov AS (SELECT q.query, q.id, q.grade, list_sort(list_filter(qtok.t, lambda x: list_contains(tok.tokens, x))) AS matched FROM qrels q JOIN tok ON tok.id = q.id JOIN qtok USING (query)),
dg AS (SELECT ov.query, ov.id, ov.grade, matched, bmr.rank::INT AS rank, CASE WHEN len(matched) = 0 THEN 'no-lexical-overlap' WHEN bmr.rank <= 5 THEN 'retrieved' ELSE 'ranked-below-cutoff' END AS status
  FROM ov LEFT JOIN bmr ON bmr.query = ov.query AND bmr.id = ov.id)"""


def _diagnosed(spark, sf):
    queries, chunks = queries_of(spark, sf), chunks_of(spark, sf)
    return R.lexical_diagnosis(qrels_of(spark, sf), queries, chunks, None, 5), queries


@query(f"WITH {_DUCK_DIAGNOSIS} SELECT query, id, grade, array_to_string(matched, ' ') AS matched_terms, rank, status FROM dg")
def lexical_diagnosis(spark, sf):
    return _diagnosed(spark, sf)[0].withColumn("matched_terms", F.array_join("matched_terms", " "))


@query(f"""WITH {_DUCK_DIAGNOSIS}, c AS (SELECT query, bool_and(status = 'no-lexical-overlap') AS whole, bool_or(status = 'no-lexical-overlap') AS part, bool_or(status = 'ranked-below-cutoff') AS below,
  min(rank) FILTER (WHERE status = 'retrieved') AS best FROM dg GROUP BY query),
f AS (SELECT query, list_filter(CASE WHEN len(t) = 0 THEN ['query-produced-no-tokens'] ELSE [CASE WHEN whole THEN 'no-gold-lexical-overlap' WHEN part THEN 'partial-gold-lexical-overlap' END,
  CASE WHEN below THEN 'gold-ranked-below-cutoff' END, CASE WHEN best > 1 THEN 'relevant-results-ranked-late' END] END, lambda x: x IS NOT NULL) AS fs FROM c JOIN qtok USING (query))
SELECT query, coalesce(fs[1], 'lexical-overlap-covered') AS classification, CASE WHEN len(fs) = 0 THEN 'lexical-overlap-covered' ELSE array_to_string(fs, ',') END AS factors FROM f""")
def case_diagnosis(spark, sf):
    diagnosed, queries = _diagnosed(spark, sf)
    return R.case_diagnosis(diagnosed, queries).withColumn("factors", F.array_join("factors", ","))


@query(f"""WITH {DUCK_SCOPE}, {_duck_metrics('sfusr', 5, 's')}, {_duck_metrics('fusr', 5, 'u')}
SELECT s.query, round(s.rr, 6) AS scoped_rr, round(u.rr, 6) AS unscoped_rr, round(s.rr - u.rr, 6) AS delta FROM s JOIN u USING (query)""")
def scoped_comparison(spark, sf):
    lexical, dense = _hybrid_branches(spark, sf)
    whole = R.rrf_fuse({"bm25": lexical, "dense": dense})
    judged = qrels_of(spark, sf)
    scopes = written(_scopes(spark, sf, judged), "scopes")
    scoped = written(_scoped(spark, sf, scopes), "scoped")
    return _rounded(R.compared_scopes(scoped, whole, judged, places=chunks_of(spark, sf, "source"), allowed=scopes))


@query(f"WITH {DUCK_BM25}, n AS (SELECT b.item_id AS query, count(bmr.id) AS found FROM benchmark b LEFT JOIN bmr ON bmr.query = b.item_id AND bmr.rank <= 5 AND bmr.score >= 25 GROUP BY 1) SELECT query, found, CASE WHEN found = 0 THEN 'insufficient_evidence' ELSE 'answerable' END AS status, found > 0 AS model_called FROM n")
def insufficient_evidence(spark, sf):
    return R.answerable(queries_of(spark, sf), _bm25(spark, sf, 5), 25)


@query(f"""WITH {DUCK_BM25}, n AS (SELECT query, count(*) FILTER (WHERE rank <= 3 AND score >= 40) AS first_found, count(*) FILTER (WHERE rank <= 6) AS widened FROM bmr GROUP BY query)
SELECT query, first_found, CASE WHEN first_found = 0 THEN 6 ELSE 3 END AS k, first_found = 0 AS retried, CASE WHEN first_found = 0 THEN widened ELSE first_found END AS evidence FROM n""")
def answer_widening(spark, sf):
    return R.widened(_bm25(spark, sf, 6), 40, 3)


_REPLANS = """SELECT conv_id, turn, role, CASE turn % 4 WHEN 0 THEN 'insufficient_evidence' WHEN 1 THEN 'no_matches' WHEN 2 THEN 'answered' ELSE 'tool_error' END AS result_code, conv_id % 3 AS replan_count, CASE WHEN role = 'user' THEN 'read' WHEN conv_id % 2 = 0 THEN 'write' ELSE 'read' END AS operation FROM conversations"""


@query(f"""WITH r AS ({_REPLANS}) SELECT conv_id, turn, result_code, replan_count, operation, CASE WHEN operation = 'read' AND replan_count = 0 AND turn % 4 < 2 THEN 'replan_once' ELSE 'stop' END AS decision,
CASE WHEN operation = 'write' THEN 'write-operation-never-replanned' WHEN replan_count > 0 THEN 'replan-limit-reached' WHEN turn % 4 < 2 THEN result_code ELSE 'non-recoverable-result' END AS reason FROM r""")
def replan_audit(spark, sf):
    """What each turn's outcome leads to, with its reason: the audit of widened and repeated questions."""
    return R.replanning(sql(spark, sf, _REPLANS, "conversations")).drop("role")


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
p AS (SELECT vec_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM u WHERE label IS NOT NULL),
l AS (SELECT label, min(vec_id) AS least FROM u WHERE label IS NOT NULL GROUP BY 1),
n AS (SELECT u.vec_id, min(l.least) AS neg FROM u JOIN l ON l.label <> u.label GROUP BY 1)
SELECT p.vec_id AS query, pos AS positive, neg AS negative, round(list_dot_product(q.v, x.v) - list_dot_product(q.v, y.v), 6) AS margin
FROM p JOIN n USING (vec_id) JOIN u q ON q.vec_id = p.vec_id JOIN u x ON x.vec_id = pos JOIN u y ON y.vec_id = neg""")
def embedding_margin(spark, sf):
    e = table(spark, sf, "embeddings").filter("label is not null").select("vec_id", "label", F.col("embedding").alias("vector"))
    return R.embedding_margins(e).select("query", "positive", "negative", F.round("margin", 6).alias("margin"))


@query(f"""WITH {DUCK_BM25} SELECT query, to_json(list({{'evidence_id': bmr.id, 'rank': rank, 'source_reference': d.source, 'text': d.text}} ORDER BY rank))::VARCHAR AS payload,
array_to_string(list(bmr.id ORDER BY rank), ',') AS allowed, count(*) AS evidence FROM bmr JOIN documents d ON d.doc_id = bmr.id WHERE rank <= 3 GROUP BY query""")
def evidence_pack(spark, sf):
    ranked = _bm25(spark, sf, 3).select("query", "id", "rank")
    packed = R.evidence_pack(ranked, chunks_of(spark, sf, F.col("source").alias("source_reference")))
    return packed.select("query", "payload", F.array_join(F.transform("allowed", lambda x: x.cast("string")), ",").alias("allowed"), "evidence")
