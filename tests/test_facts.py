"""Constraints, support, profiles, task checks, replanning and headers: a case for each rule."""

import json

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import corpus, decoding, facts
from lodeworks.operators import retrieval as R
from lodeworks.sources import files
from lodeworks.streaming.state import normalized_turns


def test_constraints_by_their_own_rules(spark):
    cases = [
        ("recruitment_type", "实习", "Intern", True), ("recruitment_type", "apprentice", "apprentice", False), ("recruitment_type", "campus", None, False),
        ("location", "北京市", "北 京", True), ("location", "Bern", "bern", False), ("location", "市", "", True),
        ("job_title", "Data Engineer", "data ENGINEER", True), ("job_title", "Engineer", "Data Engineer", False), ("job_title", "J12", "Backend (j12)", True), ("job_title", "J12x", "Backend J12x", False),
        ("company", "Acme", "acme", False), ("company", "Acme", "Acme", True), ("company", "Acme", " Acme", False), ("limit", "10", None, True), ("limit", "20", None, False), ("limit", "20", "20", True),
    ]
    wanted = spark.createDataFrame([(i, k, v) for i, (k, v, _, _) in enumerate(cases)], "id int, k string, v string")
    given = spark.createDataFrame([(i, k, a) for i, (k, _, a, _) in enumerate(cases) if a is not None], "id int, k string, v string")
    got = {r.id: r.retained for r in facts.constraints_retained(wanted, given).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}


def test_ungrounded_records_are_not_judged(spark):
    judged = spark.createDataFrame([("a", "supported"), ("b", "unsupported"), ("c", "uncertain"), ("d", "supported")], "record string, label string")
    grounding = spark.createDataFrame([("a", True), ("d", True), ("d", False), ("e", False)], "record string, valid boolean")
    got = {r.record: (r.supported, r.status) for r in facts.record_support(judged, grounding).collect()}
    assert got == {"a": (1, "accepted"), "b": (0, "semantic_validation_failed"), "c": (0, "manual_review_required"), "d": (0, "grounding_failed"), "e": (0, "grounding_failed")}
    assert facts.record_support(judged).count() == 4


def test_claims_without_evidence_are_not_judged(spark):
    claims = spark.createDataFrame([("a", 1, 2), ("a", 2, 0), ("b", 1, 1), ("c", 1, 1)], "answer string, claim int, evidence int")
    judged = spark.createDataFrame([("a", 1, "supported"), ("a", 2, "supported"), ("b", 1, "supported")], "answer string, claim int, label string")
    got = {r.answer: tuple(r)[1:] for r in facts.answer_support(claims, judged).collect()}
    assert got == {"a": (2, 1, 0.5, True), "b": (1, 0, 1.0, False), "c": (1, 0, 0.0, True)}


def test_more_cases_than_a_block(spark):
    records = spark.createDataFrame([(i, f"Company {i % 5}", ["internship", "campus"][i % 2], None) for i in range(40)], "id int, company string, kind string, deadline date")
    cases = spark.createDataFrame([(i, f"company {i % 5}" if i % 3 else None, "campus" if i % 2 else None, None) for i in range(30)], "case_id int, company string, kind string, after string")
    rows = lambda most: sorted(tuple(r) for r in facts.job_search_batch(records, cases, most).collect())
    assert rows(10_000) == rows(7) and len(rows(7)) > 100


def test_profile_counts_copies_and_dates(spark):
    docs = spark.createDataFrame([("en", "same", "2020"), ("en", "same", None), ("de", "same", "2020"), ("de", "é", None), (None, "x", None)], "lang string, text string, day string")
    got = {(r.dimension, r.value): tuple(r)[2:] for r in corpus.profile(docs, ["lang"], F.col("day")).collect()}
    assert got == {("all", None): (5, 15, 3, 1, 3, 3), ("lang", "en"): (2, 8, 1, 1, 2, 1), ("lang", "de"): (2, 6, 2, 0, 0, 1), ("lang", None): (1, 1, 1, 0, 0, 1)}


def test_each_check_of_a_task(spark):
    good = {"expected_ids": ["a", "b"], "ids": ["b", "a"], "expected_status": "answered", "status": "answered", "grounding_valid": True, "target_evidence": ["e"], "cited": ["e", "f"], "required_terms": ["t"], "quoted": "a t b", "sources": ["s"], "scope": ["s", "r"]}
    bad = {"ids_match": {"ids": ["a", "b", "b"]}, "status_right": {"status": "refused"}, "grounded": {"grounding_valid": None}, "evidence_cited": {"cited": ["f"]}, "terms_quoted": {"quoted": None}, "in_scope": {"scope": None}}
    schema = "name string, expected_ids array<string>, ids array<string>, expected_status string, status string, grounding_valid boolean, target_evidence array<string>, cited array<string>, required_terms array<string>, quoted string, sources array<string>, scope array<string>"
    rows = [("good", *good.values()), *[(name, *(good | change).values()) for name, change in bad.items()]]
    for r in decoding.task_checks(spark.createDataFrame(rows, schema)).collect():
        assert {c for c in bad if not r[c]} == ({r.name} if r.name in bad else set())


def test_replanning_stops_and_says_why(spark):
    rows = [("no_matches", 0, "read"), ("insufficient_evidence", 0, "read"), ("insufficient_evidence", 1, "read"), ("no_matches", 0, "write"), ("answered", 0, "read")]
    frame = spark.createDataFrame(rows, "result_code string, replan_count int, operation string")
    got = [(r.decision, r.reason) for r in R.replanning(frame).collect()]
    assert got == [("replan_once", "no_matches"), ("replan_once", "insufficient_evidence"), ("stop", "replan-limit-reached"), ("stop", "write-operation-never-replanned"), ("stop", "non-recoverable-result")]
    for bad in (("x", -1, "read"), ("x", 0, "other"), ("x", None, "read")):
        with pytest.raises(Exception, match="replan count"):
            R.replanning(spark.createDataFrame([bad], frame.schema)).collect()


def test_gold_sets_say_what_is_wrong(spark, tmp_path):
    header = {"dataset_id": "d", "annotation_status": "reviewed", "annotated_by": "me", "source_reference": "s", "document_sha256": "a" * 64, "chunker_version": "c", "tokenizer_version": "t"}
    judgment = {"evidence_id": "e1", "relevance_grade": 2, "evidence_text": "x"}
    case = {"case_id": "1", "query": "q", "judgments": [judgment]}
    sets = [
        (header | {"cases": [case]}, [None]), (header | {"chunker_version": " ", "cases": [case]}, ["chunker-version-blank"]), (header | {"annotation_status": "done", "cases": [case]}, ["status-unknown"]),
        (header | {"document_sha256": "a", "cases": [case]}, ["document-digest-invalid"]), (header | {"cases": []}, ["no-cases"]),
        (header | {"cases": [case | {"query": ""}, case | {"judgments": []}, case | {"judgments": [judgment | {"relevance_grade": 0}, judgment | {"relevance_grade": 1.5}, judgment | {"evidence_id": None}, judgment]}]}, ["case-blank", "no-judgments", "grade-invalid", "grade-invalid", "evidence-blank", None]),
    ]
    for i, (content, want) in enumerate(sets):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(content))
        assert [r.problem for r in files.qrels_scan(spark, str(path)).collect()] == want
    (tmp_path / "bad.json").write_text("{no json")
    assert [r.problem for r in files.qrels_scan(spark, str(tmp_path / "bad.json")).collect()] == ["set-unreadable"]


def test_turns_as_they_are_kept(spark):
    rows = [(1, 1, None, " old text "), (1, 2, "assistant", "Bearer abc.def said"), (1, 3, "tool", "x"), (1, 4, "user", "  "), (1, 5, "user", "y" * 700), (1, 6, "user", None)]
    got = {r.turn: (r.role, r.text) for r in normalized_turns(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert got.keys() == {1, 2, 5} and got[1] == ("user", "old text") and got[2] == ("assistant", "[redacted bearer token] said") and len(got[5][1]) == 600


def test_current_chunks_in_order(spark):
    chunks = spark.createDataFrame([("e2", "s", "v1", 1), ("e1", "s", "v1", 0), ("e3", "t", "v1", 0), ("e4", "s", "v0", 0), ("e5", "s", "v1", 2)], "evidence_id string, source string, chunker_version string, chunk_ordinal int")
    links = spark.createDataFrame([("a", "e1"), ("a", "e2"), ("a", "e4"), ("b", "e5"), ("c", "e3")], "snapshot_id string, evidence_id string")
    seen = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "snapshot_id string, is_current boolean")
    assert [r.evidence_id for r in corpus.current_chunks(chunks, links, seen, "v1").collect()] == ["e1", "e2", "e3"]
    assert [r.evidence_id for r in corpus.current_chunks(chunks, links, seen, "v1", "t").collect()] == ["e3"]


def test_filters_of_an_id_meet_in_parts_of_their_size(spark):
    """No join by filter, and no fewer parts than the size asks for; null ids, lists and missing limits as a join has them."""
    wanted = spark.createDataFrame([(1, "limit", "10"), (2, "limit", "20"), (3, "location", "x"), (3, "location", "y"), (4, "kind", "a"), (None, "kind", "a"), (5, "kind", None), (6, "limit", "10")], "id int, k string, v string")
    given = spark.createDataFrame([(3, "location", "y"), (3, "location", "x"), (None, "kind", "a"), (5, "kind", None), (6, "limit", None), (7, "kind", "a")], "id int, k string, v string")
    kept = facts.constraints_retained(wanted, given)
    assert {r.id: r.retained for r in kept.collect()} == {1: True, 2: False, 3: True, 4: False, None: False, 5: False, 6: True}
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "RepartitionByExpression [id" in plan
