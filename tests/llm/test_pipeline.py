"""The pipeline's stages, each on its own input, and the whole run."""

import base64
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import tiktoken

import corpus_pipeline
from lodeworks.llm import decontaminate, mixing, token_shards
from tests.llm.test_decontaminate import near
from tests.llm.test_langid import plain_model
from tests.llm.test_simhash import plain_components, plain_fingerprint


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    extra = [(10_001, "123 !!", None, "s", 6), (10_002, None, None, "s", None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    kept = corpus_pipeline.identify_language(spark, docs, sf_dir)
    assert kept.columns == docs.columns and kept.filter("doc_id > 10000").count() == 0 and kept.count() > 180
    unique = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    texts = [r.text for r in unique.collect()]
    assert len(texts) == len(set(texts)) and unique.columns == docs.columns
    clean = corpus_pipeline.drop_contaminated(spark, docs, sf_dir)
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()
    assert not any(i in decontaminate.normal(r.text or "") for r in clean.collect() for i in items)
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert mixed.columns == docs.columns and mixed.count() > 0


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and len(rows) > 100
    assert all(r.offset % token_shards.stride() == 0 for r in rows)


def test_run_equals_plain_stages(spark, sf_dir, tmp_path):
    """The words of each document in the shards are those that plain versions of the stages before them leave and take."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    predict = plain_model([(r.text, r.lang) for r in docs if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5])
    known = [r for r in docs if predict(r.text)[0] != "und" and predict(r.text)[1] >= 0.5]
    prints = {r.doc_id: plain_fingerprint(r.text) for r in known}
    least = plain_components(list(prints.items()))
    unique = [r for r in known if least[r.doc_id, prints[r.doc_id]] == r.doc_id]
    flat = {r.doc_id: decontaminate.normal(r.text) for r in unique}
    # an item within its budget leaves one of budget + 1 pieces whole; where none is there, nothing need be compared
    cut = {t: [t[i * len(t) // (len(t) // 10 + 1) : (i + 1) * len(t) // (len(t) // 10 + 1)] for i in range(len(t) // 10 + 1)] for t in items}
    has = lambda t, x: t in x or (any(p in x for p in cut[t]) and near(t, x, len(t) // 10))
    clean = [r for r in unique if not any(has(t, flat[r.doc_id]) for t in items)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(clean, spark.read.parquet(f"{sf_dir}/documents.parquet").schema).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    taken = {r[0]: r[1] for r in con.execute(f"select doc_id, taken_tokens from ({mixing.oracle_sql()})").fetchall() if r[1]}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_shards.VOCABULARY, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=token_shards.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.tokens), "<u2").tolist()
        for doc, lo, hi in zip(r.doc_ids, r.starts, [*r.starts[1:], len(ids)], strict=True):
            tokens[doc].append([x for x in ids[lo:hi] if x != token_shards.END])
    assert tokens.keys() == taken.keys()
    texts = {r.doc_id: r.text for r in docs}
    for doc, n in taken.items():
        size = len(coder.encode_ordinary(texts[doc]))
        words = len(texts[doc].split())
        ids = sum(map(len, tokens[doc]))
        assert n // words * size <= ids <= -(-n // words) * size, doc
        if n % words == 0:
            assert ids == n // words * size


def test_odd_tables(spark, sf_dir, tmp_path):
    """Null ids, texts and names, repeated rows, other columns, and an empty table go through all stages."""
    rows = [(None, "the words of a text without an id", None, None, 3, "x"), (1, None, "en", "s", None, "x"), (2, "", "en", "s", 0, "x")]
    rows += [(i, f"the clean text number {i} has words of its own {'abcdefgh'[i % 8] * 5} and more {i * i}", "en", "s", 40, "x") for i in range(10, 60)]
    rows += [(60, "the same old row", "en", "t", 16, "x")] * 2 + [(61, "word " * 30_000, "en", "t", 150_000, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot string")
    for name, some in (("odd", frame), ("empty", frame.limit(0))):
        some.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert sorted(r.slot for r in got) == list(range(len(got))) and (len(got) > 0) == (name == "odd")
        assert not {1, 2} & {d for r in got for d in r.doc_ids}
