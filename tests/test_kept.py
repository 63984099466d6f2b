"""Appends, frozen manifests and digests: whole or not at all, once, and the same however the rows are dealt."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodeworks.operators.chunking import corpus_fingerprint, ordered_digest
from lodeworks.operators.corpus import FrozenConflict, freeze_manifest
from lodeworks.sources.kept import KeptTable

SCHEMA = "id string, part string, n int"


def frame(spark, ids, n=0):
    return spark.createDataFrame([(i, i[:1] if i else None, n) for i in ids], SCHEMA)


def counts(kept, name):
    return tuple(kept.log().filter(F.col("append") == name).select("total", "inserted", "skipped").first())


def test_appends_add_new_keys_once(spark, tmp_path):
    kept = KeptTable(spark, str(tmp_path / "t"), SCHEMA, "id", ["part"])
    assert kept.rows().count() == 0 and kept.log().count() == 0
    kept.append(frame(spark, ["a1", "a2", "b1", "a1"]), "one")
    assert counts(kept, "one") == (4, 3, 1)
    kept.append(frame(spark, ["a1", "x9"]), "one")  # the name is taken: nothing is written
    assert counts(kept, "one") == (4, 3, 1) and kept.rows().count() == 3
    kept.append(frame(spark, ["b1", "b2", None], 7), "two")
    assert counts(kept, "two") == (3, 1, 2)
    again = KeptTable(spark, str(tmp_path / "t"), SCHEMA, "id", ["part"])
    assert sorted((r.id, r.n) for r in again.rows().collect()) == [("a1", 0), ("a2", 0), ("b1", 0), ("b2", 7)]
    assert again.append(frame(spark, []), "none").first()[1:] == (0, 0, 0)


def test_first_of_a_key_by_order(spark, tmp_path):
    kept = KeptTable(spark, str(tmp_path / "t"), SCHEMA, "id")
    rows = spark.createDataFrame([("k", "p", 3), ("k", "p", 1), ("k", "p", 2)], SCHEMA)
    kept.append(rows, "one", F.col("n"))
    assert [r.n for r in kept.rows().collect()] == [1]


def test_broken_append_is_not_seen_and_written_anew(spark, tmp_path):
    kept = KeptTable(spark, str(tmp_path / "t"), SCHEMA, "id", ["part"])
    kept.append(frame(spark, ["a1"]), "one")
    frame(spark, ["a1", "a2", "a3"], 9).write.partitionBy("part").parquet(str(tmp_path / "t" / "rows" / "append=two"))  # no line in the log
    assert kept.rows().count() == 1
    kept.append(frame(spark, ["a2"], 5), "two")
    assert sorted((r.id, r.n) for r in kept.rows().collect()) == [("a1", 0), ("a2", 5)]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_digest_is_that_of_the_sorted_text(spark):
    rows = [(i * 7919 % 5003, f"item {i} é") for i in range(5003)]
    want = hashlib.sha256(("<" + ";".join(t for _, t in sorted(rows)) + ">").encode()).hexdigest()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, shuffled in ((1, "8"), (7, "16"), (64, "3"), (64, "200")):
            spark.conf.set("spark.sql.shuffle.partitions", shuffled)
            frame = spark.createDataFrame(rows, "k int, t string").repartition(parts)
            got = ordered_digest(frame, "t", "k", before="<", between=";", after=">")
            assert tuple(got.first()) == (want, 5003)
            assert parts == 1 or "rangepartitioning" in plan(got)
        few = spark.createDataFrame([(1, "b"), (1, "a"), (0, "c")], "k int, t string").repartition(16)
        assert ordered_digest(few, "t", "k").first().digest == hashlib.sha256(b"c,a,b").hexdigest()
        assert tuple(ordered_digest(few.limit(0), "t", "k", before="[", after="]").first()) == (hashlib.sha256(b"[]").hexdigest(), 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_large_items_travel_in_several_rows(spark):
    rows = [(i, chr(97 + i % 26) * 300_000) for i in range(40)]
    want = hashlib.sha256(",".join(t for _, t in rows).encode()).hexdigest()
    assert tuple(ordered_digest(spark.createDataFrame(rows, "k int, t string").coalesce(1), "t", "k").first()) == (want, 40)


def test_corpus_fingerprint_by_hand(spark):
    rows = [("ev_b", "2" * 64, "v1"), ("ev_a", "1" * 64, "v1")]
    items = [{"chunker_version": v, "document_sha256": d, "evidence_id": e} for e, d, v in sorted(rows)]
    want = hashlib.sha256(json.dumps(items, separators=(",", ":")).encode()).hexdigest()
    got = corpus_fingerprint(spark.createDataFrame(rows, "evidence_id string, document_sha256 string, chunker_version string")).first()
    assert (got.fingerprint, got.members) == (f"corpus_{want}", 2)


def test_frozen_manifest(spark, tmp_path):
    entries = spark.createDataFrame([("s2", '{"a":2}'), ("s1", '{"a":1}')], "source_id string, entry string")
    identity = "manifest_" + hashlib.sha256(b'{"entries":[{"a":1},{"a":2}]}').hexdigest()
    place = tmp_path / f"identity={identity}"
    entries.limit(1).write.parquet(str(place / "entries"))  # half written: no marker
    first = freeze_manifest(entries, str(tmp_path)).first()
    assert tuple(first) == (identity, 2, str(place), True)
    assert tuple(freeze_manifest(entries.repartition(3), str(tmp_path)).first()) == (identity, 2, str(place), False)
    entries.limit(1).write.mode("overwrite").parquet(str(place / "entries"))
    with pytest.raises(FrozenConflict):
        freeze_manifest(entries, str(tmp_path))
    with pytest.raises(ValueError):
        freeze_manifest(entries.limit(0), str(tmp_path))


def test_digest_task_sorts_no_blobs(spark, monkeypatch):
    """The one task that hashes holds the places of its blobs: the only sort is that of the ranges (F25)."""
    from lodeworks.operators import chunking

    monkeypatch.setattr(chunking, "_BLOB", 64)
    items = [f"item-{i:05d}" for i in range(3000)]
    got = ordered_digest(spark.createDataFrame([(t,) for t in items[::-1]], "t string").repartition(5), "t", "t")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Sort [") == 1
    assert tuple(got.first()) == (hashlib.sha256(",".join(items).encode()).hexdigest(), 3000)
