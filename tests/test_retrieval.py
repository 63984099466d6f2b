"""Embedding, exact cosine, stored BM25 index, fusion and diagnosis against plain versions."""

import hashlib
import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeworks.functions.text import lexical_tokens
from lodeworks.functions.tokens import text_parts, tokens_in
from lodeworks.operators import retrieval as R
from lodeworks.operators.embedding import TOKEN_HASH, EmbeddingSpec, embedded


def plain_vector(tokens, dimension):
    v = np.zeros(dimension)
    for t in tokens:
        h = hashlib.md5(t.encode()).hexdigest()
        v[int(h[:8], 16) % dimension] += -1 if int(h[8], 16) % 2 else 1
    return v / np.linalg.norm(v) if v.any() else None


def test_spec_identity_by_hand():
    spec = EmbeddingSpec("p", "m", "r", 3)
    fields = {"provider": "p", "model_name": "m", "model_revision": "r", "dimension": 3, "max_sequence_length": 512, "normalization": "l2", "query_instruction": "", "document_instruction": ""}
    assert spec.identity == "emb_" + hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert spec.identity != EmbeddingSpec("p", "m", "r", 4).identity
    for bad in (("", "m", "r", 3), ("p", "m", "r", 0), ("p", "m", "r", 3, 0), ("p", "m", "r", 3, 1, "max")):
        with pytest.raises(ValueError):
            EmbeddingSpec(*bad)


def test_vectors_from_text(spark):
    rows = [(1, "b b a", "x"), (2, None, "x"), (3, "", "y"), (4, "Word word WORD other", "y"), (5, "后端 开发", None), (6, "...", "z")]
    got = {r.id: r.vector for r in embedded(spark.createDataFrame(rows, "id int, text string, source string")).collect()}
    want = {1: ["b", "b", "a"], 4: ["word", "word", "word", "other"], 5: ["后端", "开发"]}
    for i, tokens in want.items():
        assert np.allclose(got[i], plain_vector(tokens, TOKEN_HASH.dimension), atol=1e-12)
    assert got[2] is None and got[3] is None and got[6] is None
    small = EmbeddingSpec("offline", "token-hash", "1", 8, max_sequence_length=2, normalization="none")
    first = embedded(spark.createDataFrame([(1, "b b a")], "id int, text string"), small, instruction="b ").first().vector
    assert np.abs(first).sum() == 2 and (np.abs(first) == 2).any()
    assert embedded(spark.createDataFrame([], "id int, text string")).count() == 0


def plain_search(queries, vectors, k, allow=lambda q, v: True, group=lambda v: None, least=-9.0):
    out = []
    for q, x in queries:
        scored = {}
        for i, y, place in vectors:
            if y is None or len(y) != len(x) or not np.isfinite(y).all() or not np.any(y) or not allow(q, (i, place)):
                continue
            s = round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 9)
            if s > least:
                scored.setdefault(group(place), []).append((-s, i))
        for g, found in scored.items():
            out += [(q, i, g, -s, rank) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def test_dense_search_equals_plain(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.integers(-3, 4, 5).astype(float).tolist(), "abc"[i % 3]) for i in range(300)]  # many ties
    vectors += [(900, None, "a"), (901, [0.0] * 5, "a"), (902, [1.0, 2.0], "b"), (903, [float("nan")] + [1.0] * 4, "c"), (904, [], "a")]
    frame = spark.createDataFrame(vectors, "id int, vector array<double>, place string").repartition(4)
    asked = [(i * 7, vectors[i * 7][1]) for i in range(20) if any(vectors[i * 7][1])]
    queries = spark.createDataFrame([(q, x, ["a", "c"] if q % 2 else ["b"]) for q, x in asked], "query int, vector array<double>, scopes array<string>")
    rows = lambda df, *by: sorted([(r.query, r.id, r[by[0]] if by else None, r.score, r.rank) for r in df.collect()], key=str)
    for sent in (1 << 25, 5 * 8 * 6):  # all queries at once, and in blocks
        monkeypatch.setattr(R, "_SENT", sent)
        assert rows(R.dense_search(queries, frame, 4)) == plain_search(asked, vectors, 4)
        assert rows(R.dense_search(queries, frame, 4, but_itself=True, least=0.2)) == plain_search(asked, vectors, 4, lambda q, v: q != v[0], least=0.2)
        assert rows(R.dense_search(queries, frame, 2, by="place"), "place") == plain_search(asked, vectors, 2, group=lambda p: p)
        scoped = plain_search(asked, vectors, 3, lambda q, v: v[1] in (["a", "c"] if q % 2 else ["b"]))
        assert rows(R.dense_search(queries, frame, 3, scope="place")) == scoped
    every = {q: [s for _, _, _, s, _ in plain_search([(q, x)], vectors, 999, lambda q, v: q != v[0])] for q, x in asked}
    for r in R.dense_summary(queries, frame).collect():
        assert r.n == len(every[r.query]) and math.isclose(r.mean, np.mean(every[r.query]), abs_tol=1e-9) and r.best == max(every[r.query])
    assert R.dense_search(queries.limit(0), frame, 3).count() == 0 == R.dense_search(queries, frame.limit(0), 3).count()


def test_only_first_rows_leave_a_task(spark):
    rng = np.random.default_rng(1)
    frame = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(4000)], "id int, vector array<double>").repartition(3)
    found = R.dense_search(frame.filter("id < 10").withColumnRenamed("id", "query"), frame, 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    assert found.count() == 50


def test_stored_index_reads_no_text(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 7} common text number{i}", f"{i:064d}", "v1") for i in range(60)], "id int, text string, document_sha256 string, chunker_version string")
    header = R.bm25_store(docs, str(tmp_path / "index"))
    assert R.bm25_index_problems(header, docs).count() == 0
    asked = spark.createDataFrame([(1, "word3 common"), (2, "number5"), (3, "unknown words"), (4, "")], "query int, text string")
    stored = R.bm25_stored_scores(asked, R.bm25_header(spark, str(tmp_path / "index")))
    key = lambda df: sorted((r.query, r.id, r.score, tuple(r.matched_terms)) for r in df.collect())
    assert key(stored) == key(R.bm25_scores(asked, docs)) and key(stored)
    assert all("/index/postings/" in f for f in stored.inputFiles())
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PartitionFilters: []" not in plan
    changed = {r.problem: r.found for r in R.bm25_index_problems(header, docs.filter("id > 0")).collect()}
    assert changed == {"corpus-fingerprint": 1, "chunks": 1}
    with pytest.raises(ValueError):
        R.bm25_store(docs.unionByName(docs.limit(1)), str(tmp_path / "other"))


def test_fusion_refuses_repeated_and_blank_ids(spark):
    good = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query string, id string, rank int")
    for bad in ([("q", "a", 1), ("q", "a", 2)], [("q", " ", 1)], [("q", None, 1)]):
        other = spark.createDataFrame(bad, "query string, id string, rank int")
        with pytest.raises(Exception, match="id twice|blank id"):
            R.rrf_fuse({"one": good, "two": other}).collect()
    assert R.rrf_fuse({"one": good, "two": good}).count() == 2


def test_scopes_are_checked(spark):
    ranking = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query string, id int, rank int")
    judged = spark.createDataFrame([("q", 2, 1)], "query string, id int, grade int")
    places = spark.createDataFrame([(1, "s"), (2, "t")], "id int, source string")
    both = spark.createDataFrame([("q", "s"), ("q", "t")], "query string, source string")
    assert R.compared_scopes(ranking, ranking, judged, places=places, allowed=both).first().delta == 0
    with pytest.raises(Exception, match="outside its scope"):
        R.compared_scopes(ranking, ranking, judged, places=places, allowed=both.filter("source = 's'")).collect()


def test_each_factor_of_a_diagnosis(spark):
    texts = {1: "red apple", 2: "green pear", 3: "red plum", 4: "red fig", 5: "blue", 6: "red red red"}
    chunks = spark.createDataFrame(list(texts.items()), "id int, text string")
    asked = [("none", "yellow"), ("part", "red"), ("late", "red"), ("below", "red"), ("empty", "..."), ("fine", "pear")]
    queries = spark.createDataFrame(asked, "query string, text string")
    judged = spark.createDataFrame([("none", 5, 1), ("part", 6, 1), ("part", 5, 1), ("late", 3, 1), ("below", 4, 1), ("below", 6, 2), ("empty", 1, 1), ("fine", 2, 1)], "query string, id int, grade int")
    order = {"red": [6, 1, 3, 4]}
    scored = spark.createDataFrame([(q, i, 9.0 - n) for q, t in asked for n, i in enumerate(order.get(t, [2] if t == "pear" else []))], "query string, id int, score double")
    diagnosed = R.lexical_diagnosis(judged, queries, chunks, scored, 3)
    by = {(r.query, r.id): (r.matched_terms, r.rank, r.status) for r in diagnosed.collect()}
    assert by["part", 6] == (["red"], 1, "retrieved") and by["part", 5] == ([], None, "no-lexical-overlap") and by["below", 4] == (["red"], 4, "ranked-below-cutoff")
    got = {r.query: (r.classification, r.factors) for r in R.case_diagnosis(diagnosed, queries).collect()}
    assert got == {
        "none": ("no-gold-lexical-overlap", ["no-gold-lexical-overlap"]),
        "part": ("partial-gold-lexical-overlap", ["partial-gold-lexical-overlap"]),
        "late": ("relevant-results-ranked-late", ["relevant-results-ranked-late"]),
        "below": ("gold-ranked-below-cutoff", ["gold-ranked-below-cutoff"]),
        "empty": ("query-produced-no-tokens", ["query-produced-no-tokens"]),
        "fine": ("lexical-overlap-covered", ["lexical-overlap-covered"]),
    }


def test_each_failure_reason(spark):
    rows = [("perfect", 1.0, 1.0, 1, 1.0), ("none", 0.0, 0.0, None, 0.0), ("late", 1.0, 0.5, 2, 0.6), ("some", 0.5, 1.0, 1, 0.8), ("order", 1.0, 1.0, 1, 0.9)]
    got = {r.query: r.reasons for r in R.failure_reasons(spark.createDataFrame(rows, "query string, recall double, rr double, first_rank int, ndcg double")).collect()}
    assert got == {
        "none": ["no-relevant-evidence-retrieved", "incomplete-recall", "suboptimal-relevance-order"],
        "late": ["first-relevant-result-ranked-late", "suboptimal-relevance-order"],
        "some": ["incomplete-recall", "suboptimal-relevance-order"],
        "order": ["suboptimal-relevance-order"],
    }


def test_margins_need_no_row_of_all_labels(spark):
    rows = [(i, "abcd"[i % 4], [float(i), 1.0]) for i in range(1, 13)]
    got = R.embedding_margins(spark.createDataFrame(rows, "vec_id int, label string, vector array<double>")).collect()
    assert {(r.query, r.positive, r.negative) for r in got} == {(i, i + 4, 2 if i % 4 == 1 else 1) for i in range(1, 9)}


def _texts(spark, n=600, seed=3):
    """Chunks with copies, common words and places, one without a place, one without text, and queries."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(40)], k=rng.randint(1, 30))), "abc"[i % 3]) for i in range(n)]
    rows += [(n + i, rows[7][1], "abc"[i % 3]) for i in range(50)] + [(n + 60, rows[7][1], None), (n + 61, None, "a")]
    chunks = spark.createDataFrame(rows, "id int, text string, source string").repartition(3)
    asked = [(q, " ".join(rng.choices(words, k=4))) for q in range(12)] + [(20, "nothing here"), (21, "")]
    return chunks, spark.createDataFrame(asked, "query int, text string")


@pytest.mark.parametrize("small", [False, True])
def test_bm25_by_tasks_equals_all_scores(spark, monkeypatch, small):
    """The first rows of each query, of each place and within places are those of all scores; also in blocks of queries."""
    if small:
        monkeypatch.setattr(R, "_SENT", 1 << 12)
        monkeypatch.setattr(R, "_MATCHES", 50)
    chunks, asked = _texts(spark)
    key = lambda df, *more: sorted((r.query, *[r[c] for c in more], r.rank, r.id, round(r.score, 7), tuple(r.matched_terms)) for r in df.collect())
    scored = R.bm25_scores(asked, chunks.drop("source"))
    assert key(R.bm25_search(asked, chunks, 7)) == key(R.topk(scored, 7))
    local = R.topk(R.bm25_scores(asked, chunks, ["source"]), 4, ["query", "source"])
    assert key(R.bm25_search(asked, chunks, 4, by="source"), "source") == key(local, "source")
    allowed = spark.createDataFrame([(q, s) for q in range(12) for s in "abc"[: q % 3 + 1]], "query int, source string")
    scoped = R.bm25_search(asked.join(allowed.groupBy("query").agg(F.collect_set("source").alias("scopes")), "query"), chunks, 6, place="source")
    assert key(scoped) == key(R.rescope(scored, chunks, allowed, 6))
    some = spark.createDataFrame([(q, i) for q in range(12) for i in (3, 7, 77, 601, 640, 661)], "query int, id int")
    rank = lambda df: {(r.query, r.id): r["rank"] for r in df.collect()}
    assert rank(R.bm25_ranks(asked, chunks, some)) == rank(R.rank_among(scored, some))


def test_bm25_search_shuffles_no_scores(spark, tmp_path):
    chunks, asked = _texts(spark)
    stages = R.bm25_search(asked, chunks, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in stages and "Join" not in stages and "Aggregate" not in stages
    whole = chunks.filter("text is not null").select("id", "text", F.sha2("text", 256).alias("document_sha256"), F.lit("v1").alias("chunker_version"))
    header = R.bm25_store(whole, str(tmp_path / "index"))
    key = lambda df: sorted((r.query, r["rank"], r.id, r.score, tuple(r.matched_terms)) for r in df.collect())
    assert key(R.bm25_stored_search(asked, header, 5)) == key(R.bm25_search(asked, whole, 5))


def test_tokens_in_tasks_are_the_column_s(spark):
    """Texts cut on Arrow's buffers have the tokens of lexical_tokens(), in order, also in slices of a batch."""
    rng = random.Random(5)
    signs = ["a", "B", "z9", "+", "#", ".", "_", "-", " ", "\n", "\t", "\x00", "\x1c", "é", "ß", "İ", "K", "“", "。", "中", "文", "字", "䷀", "㐀", "鿿", "\U00020000", "한", "C++", "c#.", "...x..", "e.g."]
    texts = ["", None, "...", "+-#", "A.", "中", "Word."] + ["".join(rng.choices(signs[: rng.choice((12, len(signs)))], k=rng.randint(1, 40))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {r.id: r.t for r in rows.select("id", lexical_tokens(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    batch, got = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), {}
    for part in text_parts(batch, 0, 50, 200):
        row, code, words = tokens_in(part.column(0))
        names, n = words.to_pylist(), len(got)
        assert len(names) == len(set(names)) and len(part) <= 50
        got |= {n + i: [names[c] for c in code[row == i].tolist()] for i in range(len(part))}
    assert got == want


def test_texts_go_to_tasks_uncut(spark):
    """Neither BM25 nor the vectors make a row's list of tokens in the JVM (F8 to F10, F15, F17 to F21)."""
    chunks, asked = _texts(spark)
    assert "regexp_extract_all" not in embedded(chunks)._jdf.queryExecution().optimizedPlan().toString()
    plans = []
    R_written, R.written = R.written, lambda rows, name: plans.append((name, rows._jdf.queryExecution().optimizedPlan().toString())) or R_written(rows, name)
    try:
        R.bm25_search(asked, chunks, 5)
    finally:
        R.written = R_written
    assert [("regexp_extract_all" in plan) for name, plan in plans if name == "counted"] == [False]
