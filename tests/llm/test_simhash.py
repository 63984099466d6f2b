"""SimHash near-duplicates against brute force over all pairs of fingerprints."""

import random

import numpy as np
import xxhash

from lodeworks.llm import simhash
from lodeworks.llm.queries import QUERIES


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """[(id, fp)] -> {id: smallest id reachable over fingerprints at 4 or fewer bits}"""
    values = sorted({f for _, f in rows})
    parent = {f: f for f in values}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    arr = np.array(values, np.uint64)
    for i, f in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 4):
            parent[find(f)] = find(values[i + 1 + j])
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return {(d, f): least.get(find(f)) for d, f in rows}


def test_spark_hash_is_the_same(spark):
    row = spark.sql("select xxhash64('of the and to') h").first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest("of the and to".encode(), 42)


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op9_simhash_dedup"](spark, sf_dir).collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    want = plain_components(list(prints.items()))
    assert len(got) == len(docs)
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == want[(r.doc_id, prints[r.doc_id])]


def test_links_find_every_close_pair(spark):
    random.seed(5)
    values = set()
    for _ in range(300):
        f = random.getrandbits(64)
        values.add(f)
        for _ in range(3):
            g = f
            for b in random.sample(range(64), random.randint(1, 5)):
                g ^= 1 << b
            values.add(g)
    center = random.getrandbits(64)  # a dense ball: many in one group
    values |= {center ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)}
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in sorted(values)]
    frame = spark.createDataFrame(signed, "fp long")
    from lodeworks.llm.shared import components

    want = plain_components([(i, v % 2**64) for i, (v,) in enumerate(signed)])
    number = {v: i for i, (v,) in enumerate(signed)}
    for largest in (20_000, 100):  # whole groups, and groups dealt into parts
        got = {r.node: r.component for r in components(simhash.links(frame, largest)).collect()}
        groups = {}
        for v, i in number.items():
            groups.setdefault(want[(i, v % 2**64)], set()).add(got.get(v, v))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_odd_rows(spark):
    rows = [(3, None, "x"), (1, "", "x"), (2, "  \t\n", "x"), (5, "One two", "y"), (4, "one TWO", None), (5, "One two", "y"), (None, "one two", "z"), (7, "éa ü " * 30000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for d in (1, 2, 3) for r in by[d]} == {1}
    assert all(r.fingerprint == "0" * 16 for d in (1, 2, 3) for r in by[d])
    assert {r.component_id for d in (4, 5, None) for r in by[d]} == {4} and len(by[5]) == 2
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_representatives(spark):
    rows = [(3, None, "x"), (1, "", "x"), (5, "One two", "y"), (4, "one TWO", None), (4, "one TWO", None), (6, "other words here", "y"), (None, "one two", "z"), (None, "nothing like it at all", "z"), (None, "and again not like it", "z"), (7, "a", "1"), (7, "b", "1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.keep_representatives(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(1, ""), (4, "one TWO"), (6, "other words here"), (0, "nothing like it at all"), (0, "and again not like it"), (7, "a"), (7, "b")])
    assert simhash.keep_representatives(docs.limit(0)).count() == 0
