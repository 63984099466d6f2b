"""Token shards: exact round trip of every text, slots as a permutation, resumable reads."""

import base64
from collections import defaultdict

import numpy as np
import pytest

from lodeworks.llm import token_shards
from lodeworks.llm.queries import QUERIES


@pytest.fixture(scope="module")
def decode():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_shards.VOCABULARY, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=token_shards.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return coder


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000, 4097, 50_000):
        got = token_shards.permuted(np.arange(n), n, 9)
        assert sorted(got.tolist()) == list(range(n))
    a, b = (token_shards.permuted(np.arange(5000), 5000, k) for k in (1, 2))
    assert (a != b).mean() > 0.99 and abs(np.corrcoef(np.arange(5000), a)[0, 1]) < 0.05


def test_split_words_give_the_same_ids(decode):
    tokenizer = token_shards.Tokenizer(token_shards.VOCABULARY, keep=5)
    texts = ["a b  c", " lead", "trail ", "x\n y", "don't 's 1 2,3 -- the the", "über é z   q", "", " ", "  ", "a\x1cb \x1c c", "tab\t end \t", "it 's we 'll", "日本 語 x"]
    for text in texts:
        assert tokenizer.ids(text) == np.array(decode.encode_ordinary(text), "<u2").tobytes(), repr(text)


def pieces(rows):
    """{document: its tokens}, put together from the sequences that hold it; each sequence's parts must fill it."""
    by = defaultdict(list)
    for r in rows:
        ends = [*r.starts[1:], len(np.frombuffer(bytes(r.tokens), "<u2"))]
        assert r.starts[0] == 0 and len(r.doc_ids) == len(r.starts) == len(r.places)
        for doc, lo, hi, place in zip(r.doc_ids, r.starts, ends, r.places, strict=True):
            by[doc].append((place, np.frombuffer(bytes(r.tokens), "<u2")[lo:hi].tolist()))
    return by


def whole(parts):
    parts = sorted(parts)
    tokens = []
    for place, some in parts:
        assert place == len(tokens)
        tokens += some
    return tokens


def test_query_round_trip(spark, sf_dir, decode):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op1_token_shards"](spark, sf_dir).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    for r in rows:
        assert (r.shard, r.offset) == (r.slot // token_shards.SHARD_RECORDS, r.slot % token_shards.SHARD_RECORDS * token_shards.stride())
        assert 2 * r.n_tokens == len(r.tokens)
    assert sum(r.n_tokens < token_shards.SEQUENCE for r in rows) <= 8  # the last of each task
    parts = pieces(rows)
    assert parts.keys() == texts.keys()
    for doc, text in texts.items():
        ids = whole(parts[doc])
        assert ids[-1] == token_shards.END and decode.decode(ids[:-1]) == text


def test_shards_are_read_from_any_slot(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kinds = {"length": 64, "shard_records": 100}
    want = {r.slot: r for r in token_shards.write(docs, folder=str(tmp_path), **kinds).collect()}
    assert sorted(want) == list(range(len(want))) and all(r.shard == r.slot // 100 for r in want.values())
    assert len(list(tmp_path.iterdir())) == 2 * -(-len(want) // 100)
    for start, stop in ((0, len(want)), (250, 333), (99, 101), (5, 5), (len(want) - 3, len(want) + 1000), (len(want) + 500, len(want) + 600)):
        got = list(token_shards.read_shards(str(tmp_path), start, stop, **kinds))
        assert [r.slot for r in got] == list(range(start, max(start, min(stop, len(want)))))
        for r in got:
            w = want[r.slot]
            assert (r.doc_ids, r.starts, r.places, r.tokens.astype("<u2").tobytes()) == (w.doc_ids, w.starts, w.places, bytes(w.tokens))


def test_odd_rows(spark, decode):
    rows = [(1, None, 0), (2, "", 0), (None, "no id", 0), (-1, "an id", 0), (3, "word " * 50_000, 0), (4, "same", 0), (4, "same", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    got = token_shards.write(docs).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    parts = pieces(got)
    assert whole(parts[1]) == whole(parts[2]) == [token_shards.END]
    assert decode.decode(whole(parts[None])[:-1]) == "no id" and decode.decode(whole(parts[-1])[:-1]) == "an id"
    assert len(parts[4]) == 2 and {decode.decode(t[:-1]) for _, t in parts[4]} == {"same"}
    assert decode.decode(whole(parts[3])[:-1]) == "word " * 50_000
    assert token_shards.write(docs.limit(0)).count() == 0


def test_many_blocks_and_shards_of_a_task(spark, sf_dir, monkeypatch):
    """The same rows however much a task sorts at once, and where a partition holds several shards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.slot: tuple(r) for r in token_shards.write(docs, length=64, shard_records=50).collect()}
    monkeypatch.setattr(token_shards, "_PARTITIONS", 3)
    monkeypatch.setattr(token_shards, "DEAL_BYTES", 1)
    assert {r.slot: tuple(r) for r in token_shards.write(docs, length=64, shard_records=50).collect()} == want


def test_query_and_pipeline_write_shards(spark, sf_dir, tmp_path, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(token_shards, "shared_dir", lambda spark: str(tmp_path))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, run in enumerate((lambda: QUERIES["op1_token_shards"](spark, sf_dir), lambda: corpus_pipeline.write_tokens(spark, docs, sf_dir)), 1):
        rows = run().collect()
        folders = sorted(tmp_path.glob("shards-*"), key=lambda p: p.stat().st_mtime)
        assert len(folders) == i
        got = list(token_shards.read_shards(str(folders[-1]), 0, len(rows)))
        assert {r.slot: r.tokens.tobytes() for r in got} == {r.slot: bytes(r.tokens) for r in rows} and len(got) == len(rows)


def test_changed_shards_fail(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    written = token_shards.write(docs, folder=str(tmp_path))
    path = tmp_path / "shard-00000000.bin"
    data = bytearray(path.read_bytes())
    data[-1] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="crc32"):
        written.collect()
