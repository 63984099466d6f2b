"""Routing by format, fallbacks, ids with places, reading order and contracts, on small documents."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import contracts, decoding
from lodeworks.operators import parsing as P
from lodeworks.sources.kept import KeptTable
from lodeworks.sources.files import artifact_inventory

DOCS = "source string, format string, content_sha256 string, content string"
REGIONS = "source string, page_number int, text string, confidence double, polygon array<struct<x: double, y: double>>"


def region(source, page, text, left, top, confidence=0.9, height=0.1):
    return (source, page, text, confidence, [(left, top), (left + 0.1, top), (left + 0.1, top + height), (left, top + height)])


def parsed(spark):
    html = "<h1>Head</h1><p>one</p><h3>Deep</h3><li>two"
    rows = [("w", "html", "1" * 64, html), ("e", "html", "2" * 64, "<div>none</div>"), ("t", "pdf", "3" * 64, None), ("s", "pdf", "4" * 64, None), ("n", "pdf", "5" * 64, None), ("d", "docx", "6" * 64, "x"), ("u", None, "7" * 64, "x")]
    layers = spark.createDataFrame([("t", 1, "first page"), ("t", 2, "  "), ("t", 3, "third")], "source string, page_number int, text string")
    regions = spark.createDataFrame([region("s", 2, "b", 0.5, 0.1), region("s", 2, "a", 0.1, 0.12), region("s", 2, "c", 0.1, 0.5), region("n", 1, "faint", 0.1, 0.1, 0.2), region("t", 1, "not asked", 0.1, 0.1)], REGIONS)
    return P.parse(spark.createDataFrame(rows, DOCS), {"html": P.parse_html, "pdf": P.text_layers(layers)}, {"pdf-text-layer-missing": P.recognized(regions)})


def test_each_format_and_fallback(spark):
    got = sorted((r.source, r.ordinal if r.ordinal is not None else -1, r.text, r.location and (r.location.page_number, r.location.heading_path), r.failure) for r in parsed(spark).collect())

    assert [g for g in got if g[4] is None] == [
        ("s", 0, "a\nb\nc", (2, []), None),
        ("t", 0, "first page", (1, []), None),
        ("t", 1, "third", (3, []), None),
        ("w", 0, "Head", (None, ["Head"]), None),
        ("w", 1, "one", (None, ["Head"]), None),
        ("w", 2, "Deep", (None, ["Head", "Deep"]), None),
        ("w", 3, "two", (None, ["Head", "Deep"]), None),
    ]
    assert {g[0]: g[4] for g in got if g[4]} == {"e": "no-extractable-content", "n": "no-extractable-content", "d": "parser-not-registered", "u": "parser-not-registered"}



def test_ids_hold_the_place(spark):
    for r in P.identified_chunks(parsed(spark)).collect():
        fields = {
            "chunk_ordinal": r.chunk_ordinal, "chunker_version": r.chunker_version, "document_sha256": r.content_sha256, "source_fragment_ordinal": r.source_fragment_ordinal, "source_reference": r.source, "text": r.text,
            "location": r.location.asDict(),
        }
        text = json.dumps(fields, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        assert r.evidence_id == "ev_" + hashlib.sha256(text.encode()).hexdigest()


def test_ingest_counts(spark, tmp_path):
    kept = KeptTable(spark, str(tmp_path / "kept"), P.CHUNKS, "evidence_id", ["chunker_version"])
    rows = parsed(spark)
    first = {r.source: tuple(r)[1:] for r in P.ingest(rows.filter("source IN ('w', 'e')"), kept, "one").collect()}
    assert first == {"w": ("succeeded", None, 4, 4, 4, 0), "e": ("parsing_failed", "no-extractable-content", 0, 0, 0, 0)}
    second = {r.source: tuple(r)[1:] for r in P.ingest(rows, kept, "two").collect()}
    assert second["w"] == ("succeeded", None, 4, 4, 0, 4) and second["t"] == ("succeeded", None, 2, 2, 2, 0) and second["s"][4] == 1
    assert kept.rows().count() == 7


def plain_order(regions):
    """Lines as sets of regions: each region, from the top, asks all lines for their share of it."""
    lines = []
    for r in sorted(regions):
        shares = []
        for line in lines:
            top, bottom = min(x[0] for x in line), max(x[2] for x in line)
            shares.append(max(0.0, (min(bottom, r[2]) - max(top, r[0])) / min(bottom - top, r[2] - r[0])))
        if shares and max(shares) >= 0.5:
            lines[shares.index(max(shares))].append(r)
        else:
            lines.append([r])
    ordered = sorted(lines, key=lambda line: min(x[0] for x in line))
    return "\n".join(r[3] for line in ordered for r in sorted(line, key=lambda x: x[1]))


def test_regions_join_the_line_they_share_most_with():
    assert decoding._lines([(0.0, 0.5, 0.10, "A"), (0.06, 0.3, 0.16, "B"), (0.065, 0.1, 0.11, "C")]) == "A\nC\nB"
    rng = random.Random(7)
    for _ in range(300):
        regions = [(t := rng.random(), rng.random(), t + rng.choice([0.02, 0.05, 0.1]), str(i)) for i in range(rng.randrange(12))]
        assert decoding._lines(regions) == plain_order(regions)


def test_contracts_name_each_broken_rule(spark):
    snapshots = spark.createDataFrame(
        [("s1", "u1", "c1", 1, 5, "pdf", 1, 2, True), ("s2", "u1", "c2", 1, 5, "pdf", 2, 1, True), ("s3", "u2", "c1", 0, -1, "txt", 1, 1, False), ("s3", None, "c1", 1, 0, "html", 1, 1, None)],
        "snapshot_id string, source_reference string, content_sha256 string, version_number int, byte_size long, document_format string, first_observed_at int, last_observed_at int, is_current boolean",
    )
    links = spark.createDataFrame([("s1", "e1"), ("s9", "e1"), ("s2", "e2"), (None, "e3")], "snapshot_id string, evidence_id string")
    got = sorted(tuple(r) for r in contracts.violations({"snapshot": snapshots, "link": links}).collect())
    assert got == sorted([
        ("snapshot", "s1", "one-content-of-version"), ("snapshot", "s2", "one-content-of-version"), ("snapshot", "s1", "one-current-of-source"), ("snapshot", "s2", "one-current-of-source"),
        ("snapshot", "s2", "observed-in-order"), ("snapshot", "s3", "version-from-1"), ("snapshot", "s3", "size-from-0"), ("snapshot", "s3", "format-known"), ("snapshot", "s3", "source_reference-missing"),
        ("snapshot", "s3", "one-key"), ("snapshot", "s3", "one-key"),
        ("link", "s1|e1", "one-snapshot-of-evidence"), ("link", "s9|e1", "one-snapshot-of-evidence"), ("link", "s9|e1", "snapshot-there"), ("link", "e3", "snapshot_id-missing"),
    ])
    with pytest.raises(ValueError):
        contracts.violations({"other": links})


def test_deadlines_are_consistent(spark):
    rows = [("normalized", "raw", 1, None, True), ("normalized", None, None, None, False), ("not_stated", None, None, None, True), ("not_stated", "raw", None, None, False), ("manual_review_required", "raw", None, "why", True), ("manual_review_required", "raw", 1, "why", False), (None, None, None, None, True)]
    frame = spark.createDataFrame([(f"r{i}", f"f{i}", "s", *r[:4], False, None, None, r[4]) for i, r in enumerate(rows)], "record_id string, record_fingerprint string, source_snapshot_id string, deadline_status string, deadline_raw string, deadline int, deadline_reason string, is_current boolean, activated_at int, activation_reference string, fine boolean")
    broken = {r.key for r in contracts.violations({"record": frame}).collect()}
    assert broken == {r.record_id for r in frame.filter(~F.col("fine")).collect()}


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.HTML").write_bytes(b"<p>x</p>")
    (tmp_path / "b.bin").write_bytes(b"1")
    got = {r.path.rpartition("/")[2]: (r.format, r.content_sha256, r.byte_size) for r in artifact_inventory(spark, str(tmp_path)).collect()}
    assert got == {"a.HTML": ("html", hashlib.sha256(b"<p>x</p>").hexdigest(), 8), "b.bin": (None, hashlib.sha256(b"1").hexdigest(), 1)}


def test_catalog_of_reports_by_line(spark, tmp_path):
    """Reports may stand one to a line, so that their number makes no files; what isn't a report is left out (F23)."""
    from lodeworks.sources.files import evaluation_catalog

    folder = tmp_path / "experiments"
    folder.mkdir()
    reports = [{"dataset_id": f"d{i}", "dataset_version": "v", "annotation_status": "final", "cases": i, "metrics": {"mrr": i / 4, "note": "n/a"}} for i in range(3)]
    (folder / "some.json").write_text("\n".join([json.dumps(reports[0]), "not json", json.dumps(reports[1])]) + "\n")
    (folder / "more.json").write_text(json.dumps(reports[2]) + "\n")
    got = evaluation_catalog(spark, str(folder), lines=True).collect()
    assert sorted((r.dataset_id, r.family, r.version, r.status, r.cases, tuple(r.metrics.items())) for r in got) == [(f"d{i}", "experiment", "v", "final", i, (("mrr", i / 4),)) for i in range(3)]


def test_catalog_query_writes_no_file_for_each_report(spark, monkeypatch, tmp_path):
    import os

    from lodeworks.plans import scans

    monkeypatch.setattr(scans, "_folder", lambda spark: str(tmp_path))
    spark.range(2000).selectExpr("id AS event_id", "id % 500 AS user_id", "double(id) AS value").write.parquet(str(tmp_path / "events.parquet"))
    assert scans.evaluation_catalog(spark, str(tmp_path)).count() == 500
    assert sum(n.endswith(".json") for _, _, names in os.walk(tmp_path / "experiments") for n in names) < 100
