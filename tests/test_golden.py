"""Known small cases of the operators."""

import hashlib
import math
import random
from datetime import datetime, timezone

import duckdb
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lodeworks.functions import text as T
from lodeworks.operators import chunking, corpus, evaluation, matching, retrieval, trust
from lodeworks.operators import facts as facts_ops
from lodeworks.plans.registry import ORACLES, QUERIES
from lodeworks.sources import files, reports
from lodeworks.streaming import state
from tests.compare import differ


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "x string").select(expr(F.col("x"))).first()[0]


def test_bm25_order_and_terms(spark):
    docs = spark.createDataFrame([(1, "Python Python RAG Agent internship"), (2, "Python Java backend internship"), (3, "Java Spring backend internship")], "id long, text string")
    asked = spark.createDataFrame([(0, "Python RAG")], "query long, text string")
    got = retrieval.bm25_search(asked, docs, 2).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 2] and got[0].matched_terms == ["python", "rag"]
    tied = retrieval.bm25_search(spark.createDataFrame([(0, "backend")], "query long, text string"), docs, 5).orderBy("rank").collect()
    assert [r.id for r in tied] == [2, 3] and tied[0].score == tied[1].score


def test_tokens(spark):
    assert one(spark, T.lexical_tokens, "C++ 后端开发 x 职 Straße .NET-4. a_b") == ["c++", "后端", "端开", "开发", "x", "职", "stra", "e", "net-4", "a_b"]


def test_metrics(spark):
    judged = spark.createDataFrame([("q", "a", 3), ("q", "b", 1)], "query string, id string, grade int")
    ranking = spark.createDataFrame([("q", "x", 1), ("q", "b", 2)], "query string, id string, rank int")
    m = retrieval.retrieval_metrics(ranking, judged, 2).first()
    assert (m.recall, m.rr, m.first_rank) == (0.5, 0.5, 2) and 0 < m.ndcg < 1
    best = (7 / math.log2(2)) + 1 / math.log2(3)
    assert math.isclose(m.ndcg, (1 / math.log2(3)) / best, abs_tol=1e-9)


def test_rrf(spark):
    a = spark.createDataFrame([("q", "shared", 1), ("q", "lexical", 2)], "query string, id string, rank int")
    b = spark.createDataFrame([("q", "semantic", 1), ("q", "shared", 2)], "query string, id string, rank int")
    for rankings in ({"bm25": a, "dense": b}, {"dense": b, "bm25": a}):
        first = retrieval.rrf_fuse(rankings).orderBy("rank").first()
        assert (first.id, first.bm25_rank, first.dense_rank) == ("shared", 1, 2)


def plain_chunks(text, most, overlap):
    flat, out, start = " ".join(text.split()), [], 0
    if len(flat) <= most:
        return [flat]
    while start < len(flat):
        end = hard = min(start + most, len(flat))
        if hard < len(flat):
            places = range(hard - 1, start + max(1, most // 2) - 1, -1)
            end = next((i + 1 for i in places if flat[i] in chunking.ENDINGS), next((i for i in places if flat[i] == " "), hard))
        out += [flat[start:end].strip()] if flat[start:end].strip() else []
        if end >= len(flat):
            break
        start = max(start + 1, end - overlap)
        start += start < end and flat[start] == " "
    return out


def test_chunks(spark):
    pieces = one(spark, lambda c: chunking.chunk_texts(c, 10, 3), "abcdefghijklmnopqrst")
    assert all(len(p) <= 10 for p in pieces) and pieces[1][:3] == pieces[0][-3:]
    for text in ("", "one two three. four five! six seven eight nine", "a" * 35, "word " * 30, "句子。" * 20, "x　 y\n\nz " * 9):
        for most, overlap in ((10, 3), (20, 9), (7, 0)):
            assert one(spark, lambda c, m=most, o=overlap: chunking.chunk_texts(c, m, o), text) == plain_chunks(text, most, overlap), (text, most, overlap)


def test_values(spark):
    assert one(spark, T.recruitment_type, " 日常实习 ") == "internship" and one(spark, T.recruitment_type, "apprentice") is None
    for text, want in (("2026年2月3日", ("2026-02-03", "normalized", None)), ("2026-2-30", (None, "manual_review_required", "invalid-calendar-date")), ("soon", (None, "manual_review_required", "unsupported-date-expression")), (None, (None, "not_stated", None))):
        got = one(spark, T.deadline, text)
        assert (str(got.deadline) if got.deadline else None, got.status, got.reason) == want
    assert one(spark, T.location_key, "上海 市") == "上海" and one(spark, T.location_key, "市") == "市"
    assert len(one(spark, T.safe_turn, "x" * 700)) == 600 and "Bearer" not in one(spark, T.safe_turn, "a Bearer abc.d b")
    assert one(spark, T.credential_rules, "key sk-abcdefghijklmnop123") == ["secret-key"] and one(spark, T.credential_rules, None) == ["blank"]
    assert one(spark, T.host, "https://user@Jobs.Example.com.:8080/x") == "jobs.example.com"


def test_code_token(spark):
    rows = spark.createDataFrame([("J1 engineer",), ("J12 engineer",), ("xJ1",), ("role (j1)",)], "title string")
    assert [r.title for r in rows.filter(facts_ops.has_code(F.col("title"), "J1")).collect()] == ["J1 engineer", "role (j1)"]


def test_citations(spark):
    evidence = spark.createDataFrame([("e1", "The quick brown fox")], "evidence_id string, text string")
    rows = [(0, "e1", "quick  Brown"), (1, "e1", "fox"), (2, "e2", "fox")]
    cited = spark.createDataFrame([("a", 1, *r) for r in rows], "answer string, claim int, ordinal int, evidence_id string, quote string")
    got = {r.ordinal: r.issue for r in facts_ops.citation_issues(cited, evidence, ["answer", "claim"]).collect()}
    assert got == {0: None, 1: "duplicate", 2: "outside-evidence"}


def test_recognition_rates(spark):
    pairs = spark.createDataFrame([("AI Agent", "Al Agent"), ("one two three four", "one two three four")], "expected string, actual string")
    a, b = evaluation.ocr_error_rates(pairs).orderBy("chars").collect()  # rows come in any order
    assert (a.char_edits, a.word_edits, a.exact, b.exact) == (1, 1, False, True)
    m = evaluation.ocr_error_rates(pairs).agg(F.avg("cer").alias("macro"), (F.sum("char_edits") / F.sum("chars")).alias("micro")).first()
    assert m.micro < m.macro
    wide = evaluation.ocr_error_rates(spark.createDataFrame([("ＡＢ　c", "AB c")], "expected string, actual string")).first()
    assert wide.exact and wide.char_edits == 0


def test_conversation_window(spark):
    turns = spark.createDataFrame([(1, i, "user") for i in range(13)], "conv_id long, turn long, role string")
    assert sorted(r.turn for r in state.conversation_window(turns).collect()) == list(range(1, 13))


def test_heading_stack_is_one_of_places(spark):
    blocks = spark.createDataFrame([(1, 0, 1, "A"), (1, 1, 3, "C"), (1, 2, 2, "B"), (1, 3, 0, "text")], "page long, ordinal int, level int, text string")
    got = {r.ordinal: r.heading_path for r in evaluation.heading_paths(blocks).collect()}
    assert got == {0: ["A"], 1: ["A", "C"], 2: ["A", "B"], 3: ["A", "B"]}


def test_set_fingerprint_ignores_order(spark):
    rows = [(f"d{i}",) for i in range(50)]
    a, b = (chunking.set_fingerprint(spark.createDataFrame(r, "digest string")).first() for r in (rows, rows[::-1]))
    assert a == b and a.members == 50


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert evaluation.edit_distance(a, b) == plain_edits(a, b)
    words = [f"w{i}" for i in range(50_000)]  # more kinds of words than any one alphabet has letters
    assert evaluation.edit_distance(words, words[:20_000] + ["x"] + words[20_001:]) == 1


def test_html_fragments_as_parsers_read(spark):
    html = """<p title='a>b'>it&#8217;s caf&eacute; &mdash; a<h1>One<br>two</h1>loose<script>if (a < b) { x("<p>no</p>") }</script><h3>Deep</h3><ul><li>x<li>y</ul><h2>Back</h2><p>end"""
    rows = [(1, html), (2, None), (3, "no blocks"), (4, "<p>seen</p><script><p>no</p>"), (5, "<style>p { }</style><!-- <p>no</p> --><p> </p><H6>A  b</H6>")]
    got = evaluation.html_fragments(spark.createDataFrame(rows, "page long, html string")).orderBy("page", "ordinal").collect()
    want = [("p", "it\u2019s caf\u00e9 \u2014 a", []), ("h1", "One two", ["One two"]), ("h3", "Deep", ["One two", "Deep"]), ("li", "x", ["One two", "Deep"]), ("li", "y", ["One two", "Deep"]), ("h2", "Back", ["One two", "Back"]), ("p", "end", ["One two", "Back"])]
    assert [(r.tag, r.text, r.heading_path) for r in got if r.page == 1] == want
    assert [(r.page, r.text) for r in got if r.page > 1] == [(4, "seen"), (5, "A b")]
    blocks = spark.createDataFrame([(r.page, r.ordinal, r.level, r.text) for r in got], "page long, ordinal int, level int, text string")
    assert {(r.page, r.ordinal): r.heading_path for r in evaluation.heading_paths(blocks).collect()} == {(r.page, r.ordinal): r.heading_path for r in got}


@pytest.mark.parametrize("name", ["html_fragments", "heading_path", "located_evidence", "parsed_documents"])
def test_references_without_semicolon_equal_sql(spark, tmp_path, name):
    pages = [(1, "<h1>a &amp; b&&amp</h1><p>x &quot</p><li>&am &lt;i&gt &copy 2 &middot c&amp;lt; &amp;amp</li>"), (2, "<p>&amp")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, "one &amp two")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert differ(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name]) is None


def test_containing_equals_all_pairs(spark):
    rng = random.Random(5)
    words = "ab cd ef gh ij kl mn".split()
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(200, None), (201, ""), (7, "ab cd ef")]
    items = [(i, x[3 : 3 + rng.randint(1, 40)]) for i, (_, x) in enumerate(texts[:60]) if x and len(x) > 50] + [(900, None), (901, ""), (902, "gh  ij")]
    want = sorted((i, t) for i, x in items for t, y in texts if x and y and x in y)
    given = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(items, "item long, text string")
    for cut in (matching.AT_BLANKS, matching.AT_LETTERS, "[ac]"):
        assert sorted(tuple(r) for r in matching.containing(*given, cut).collect()) == want
    assert want


@pytest.mark.parametrize("sent", [matching._SENT, 0])
def test_texts_searched_for_items_are_not_shuffled(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(matching, "_SENT", sent)
    rng = random.Random(6)
    texts = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(300))) for i in range(100)]
    items = [(i, x[20:200]) for i, x in texts[:10]]
    spark.createDataFrame(texts, "id long, text string").write.parquet(f"{tmp_path}/texts")
    spark.createDataFrame(items, "item long, text string").write.parquet(f"{tmp_path}/items")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")  # less than the texts, more than the items
    try:
        found = matching.containing(spark.read.parquet(f"{tmp_path}/texts"), spark.read.parquet(f"{tmp_path}/items"))
        assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in found.collect()) == [(i, i) for i in range(10)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("sent", [None, 0])
def test_items_that_tasks_get_or_join(spark, monkeypatch, sent):
    """Both ways of looking items up find the same, also for rows without an id; few items are looked up without a row for each piece of a text."""
    if sent is not None:
        monkeypatch.setattr(matching, "_SENT", sent)
    texts = [(1, "a b\u00e9 c d e f g"), (2, " b\u00e9 c  d e f"), (None, "x a b\u00e9 c d e f g y"), (1, "c d e f g h"), (4, None), (5, ""), (6, "\u4e00\u4e8c a b\u00e9 c d e f")]
    items = [(1, "a b\u00e9 c d e f"), (1, "c d e"), (2, "d e f g h"), (None, "b\u00e9 c d"), (3, "e f"), (4, "q r s t u v"), (5, None), (6, ""), (7, "c  d e"), (8, "c  d e")]
    key = lambda p: tuple((x is None, x) for x in p)
    want = sorted(((i, t) for i, x in items for t, y in texts if x and y and x in y), key=key)
    found = matching.containing(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(items, "item long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=key) == want
    assert sent == 0 or "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_rank_among_counts_what_stands_before(spark):
    scored = spark.createDataFrame([(q, i, float((i * 7) % 5)) for q in (1, 2) for i in range(20)], "query long, id long, score double")
    ranks = {(r.query, r.id): r.rank for r in retrieval.topk(scored, None).collect()}
    some = spark.createDataFrame([(1, 3), (1, 10), (2, 19), (2, 99)], "query long, id long")
    assert {(r.query, r.id): r.rank for r in retrieval.rank_among(scored, some).collect()} == {k: ranks[k] for k in ((1, 3), (1, 10), (2, 19))}


def test_calls_and_preflight(spark):
    rows = [
        ("a", "call_tool", "call_tool", "f", "f", {"k": " 1"}, {"k": "1"}, False),
        ("b", "call_tool", "call_tool", "f", "g", {"k": "1"}, {"k": "1"}, False),
        ("c", "call_tool", "call_tool", "g", "g", {"k": " 1"}, {"k": "1"}, False),
        ("d", "refuse", "refuse", None, None, None, None, False),
        ("e", "refuse", "refuse", None, None, None, None, True),
        ("e", "call_tool", "call_tool", "h", "h", {"k": "x"}, {"k": "x"}, False),
        ("f", "call_tool", "call_tool", "f", "f", {"k": "x"}, {"k": "x"}, False),
    ]
    kinds = "case_id string, expected_decision string, actual_decision string, expected_tool string, actual_tool string, expected_arguments map<string,string>, actual_arguments map<string,string>, failed boolean"
    calls = spark.createDataFrame(rows, kinds).withColumns({"latency": F.lit(1.0), "tokens": F.lit(None).cast("long")})
    number = {"f": lambda m: F.when(F.trim(m["k"]).rlike("^[0-9]+$"), F.transform_values(m, lambda k, v: F.trim(v)))}
    got = evaluation.tool_call_metrics(calls, normalizers=number).first()
    assert (got.cases, got.failed_calls, got.usage_unavailable, got.tokens) == (7, 1, 7, 0)
    assert [round(x * n) for x, n in ((got.decision_accuracy, 7), (got.tool_accuracy, 5), (got.arguments_accuracy, 5), (got.case_accuracy, 7))] == [6, 4, 2, 3]
    none = evaluation.tool_call_metrics(calls.filter("expected_decision = 'refuse'")).first()
    assert none.tool_accuracy is None and none.arguments_accuracy is None
    tools = spark.createDataFrame([("f",), ("g",)], "tool string")
    assert tuple(evaluation.tool_case_preflight(calls, tools, number).first()) == (7, 5, 2, 1, 1, 1)


def test_registry_and_matches(spark):
    log = [("Acme", "jobs.acme.com.", 1, 1, "active"), ("Acme", "acme.com", 2, 1, "active"), ("Acme", "acme.com", 3, 2, "revoked"), ("Other", "acme.com", 4, 1, "active")]
    registry = trust.registry_current(spark.createDataFrame(log, "company string, domain string, id long, version int, status string"))
    pages = [(1, "https://x.Jobs.acme.com/a", " acme"), (2, "https://acme.com", "Acme"), (3, "https://notjobs.acme.com", "Acme"), (4, None, "Acme"), (5, "http://www.acme.com", "Other")]
    frame = spark.createDataFrame(pages, "page_id long, url string, company string")
    assert {r.page_id: r.matched for r in trust.domain_matches(frame, registry).collect()} == {1: "jobs.acme.com.", 5: "acme.com"}
    told = trust.source_assessment(frame.withColumn("official", F.lit(True)), trust.domain_matches(frame, registry))
    assert {r.page_id: r.reasons for r in told.collect()}[5] == ["not-https", "freshness-unverified"]


def test_latency_takes_the_nearest_rank(spark):
    calls = spark.createDataFrame([(float(v), v == 3, datetime(2026, 1, 1, 0, 0, v)) for v in range(1, 11)] + [(None, True, None)], "value double, failed boolean, started timestamp")
    got = evaluation.latency_summary(calls).first()
    assert (got.p50, got.p95, got.p99, got.least, got.most, got.succeeded, got.failed, got.mean) == (5.0, 10.0, 10.0, 1.0, 10.0, 9, 2, 5.5)
    assert math.isclose(got.throughput, 11 / 9, abs_tol=1e-6)


def test_index_is_guarded(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"h{i}", "v1") for i in range(20)], "id long, document_sha256 string, chunker_version string")
    vectors = spark.createDataFrame([(i, [1.0, float(i), 0.5]) for i in range(25)], "id long, vector array<double>")
    header = retrieval.dense_index(chunks, vectors, str(tmp_path / "i"), embedder="e", dimension=3)
    kinds = {"embedder": "e", "dimension": 3}
    assert retrieval.dense_index_problems(header, chunks, **kinds).count() == 0
    other = retrieval.dense_index_problems(header, chunks.filter("id > 0"), embedder="f", dimension=4).collect()
    assert {r.problem: r.found for r in other} == {"corpus-fingerprint": 1, "embedder": 1, "dimension": 1, "unknown-ids": 1}
    for bad in (chunks.union(chunks.limit(1)), chunks.withColumn("chunker_version", F.col("id").cast("string")), chunks.withColumn("id", F.col("id") + 10)):
        with pytest.raises(ValueError):
            retrieval.dense_index(bad, vectors, str(tmp_path / "bad"), **kinds)


def test_csv_rows_of_every_file(spark, tmp_path):
    head = ",".join(files.REGISTRY_COLUMNS)
    for name, lines in (("a.csv", 3), ("b.csv", 5)):
        body = "".join(f'c{i},d{i}.com,"see\nthis",2024-01-0{i},me,{"active" if i != 2 else "odd"}\n' for i in range(1, lines))
        (tmp_path / name).write_text(("\ufeff" if name == "a.csv" else "") + head + "\n" + body, encoding="utf-8")
    got = files.domain_registry_scan(spark, str(tmp_path)).collect()
    assert sorted((r.file[-5:], r.row, r.company) for r in got) == [("a.csv", 2, "c1"), ("a.csv", 3, "c2")] + [("b.csv", i + 1, f"c{i}") for i in range(1, 5)]
    assert all(r.evidence_reference == "see\nthis" and r.problems == (["status-unknown"] if r.company == "c2" else []) for r in got)
    (tmp_path / "c.csv").write_text("company,domain\n")
    with pytest.raises(ValueError, match="header"):
        files.domain_registry_scan(spark, str(tmp_path))


def test_reports_are_written_once(spark, tmp_path):
    cases, metrics = spark.createDataFrame([(1, True)], "case_id long, passed boolean"), spark.createDataFrame([(0.5,)], "rate double")
    given = {"run_id": "r", "dataset_id": "d", "finished_at": datetime(2026, 1, 1, tzinfo=timezone.utc)}
    reports.write_report(cases, metrics, str(tmp_path / "r"), **given)
    header, rows = reports.read_report(spark, str(tmp_path / "r"), "rate double")
    assert (header.first().metrics.rate, header.first().finished_at, rows.count()) == (0.5, "2026-01-01T00:00:00+00:00", 1)
    with pytest.raises(AnalysisException):
        reports.write_report(cases, metrics, str(tmp_path / "r"), **given)
    for wrong in ({"run_id": " "}, {"finished_at": datetime(2026, 1, 1)}):
        with pytest.raises(ValueError):
            reports.write_report(cases, metrics, str(tmp_path / "x"), **(given | wrong))


def test_resampling_draws_groups_with_replacement(spark):
    groups = spark.createDataFrame([(f"g{i}", float(i), 1.0) for i in range(7)], "key string, diff double, n double")
    got = {r.sample: (r.diff, r.n) for r in evaluation.resampled(groups, 50, "s").collect()}
    assert len(got) == 50 and all(n == 7.0 for _, n in got.values()) and len({d for d, _ in got.values()}) > 10
    want = sum(int(hashlib.md5(f"s|0|{i}".encode()).hexdigest()[:8], 16) % 7 for i in range(7))
    assert got[0][0] == want
    assert evaluation.resampled(groups.limit(0), 5, "s").count() == 0


def test_search_batch_and_codes(spark):
    records = spark.createDataFrame([(1, "ACME", "campus", "2026-01-01"), (2, "Acme", None, None), (3, "Other", "campus", "2026-05-01")], "id long, company string, kind string, d string").withColumn("deadline", F.to_date("d"))
    cases = [("company", "acme", None, None), ("kind", None, "campus", None), ("after", None, None, "2026-02-01"), ("all", None, None, None), ("both", "ACME", "campus", "2026-01-01"), ("none", "x", None, None)]
    got = facts_ops.job_search_batch(records, spark.createDataFrame(cases, "case_id string, company string, kind string, after string"))
    found = {}
    for r in got.collect():
        found.setdefault(r.case_id, set()).add(r.id)
    assert found == {"company": {1, 2}, "kind": {1, 3}, "after": {3}, "all": {1, 2, 3}, "both": {1}}
    with pytest.raises(ValueError):
        facts_ops.has_code(F.col("title"), "J1.*")


def test_link_conflicts_name_another_snapshot(spark):
    known = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "id string, snapshot long")
    new = spark.createDataFrame([("a", 1), ("a", 9), ("b", 3), ("c", 5), ("d", 6)], "id string, snapshot long")
    assert sorted(tuple(r) for r in corpus.link_conflicts(known, new).collect()) == [("a", 1, 2), ("a", 9, 1), ("c", 5, 4)]


def test_changed_items_need_no_table():
    """Long texts with changed items only take time by their length."""
    import time

    rng = random.Random(2)
    text = "".join(rng.choice("abdeo ") for _ in range(400_000))
    start = time.time()
    assert evaluation.edit_distance(text, text.translate(str.maketrans("eo", "c0"))) == text.count("e") + text.count("o")
    assert time.time() - start < 5


def test_long_page_is_read_line_by_line(spark):
    """A page of many lines takes time by its regions, and pages that go on over batches stay whole."""
    from lodeworks.operators import decoding

    rows = spark.range(60_000).selectExpr("id % 2 AS page", "CAST(id div 2 AS DOUBLE) AS top", "CAST(id div 2 AS DOUBLE) + 0.9 AS bottom", "0.0D AS left", "CAST(id AS STRING) AS text")
    got = {r.page: r.text for r in decoding.reading_order(rows, "page").collect()}
    assert got == {p: "\n".join(str(i) for i in range(p, 60_000, 2)) for p in (0, 1)}
