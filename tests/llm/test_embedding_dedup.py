"""Vector near-duplicates against brute force over all pairs."""

import numpy as np
import pytest

from lodeworks.llm import embedding_dedup
from lodeworks.llm.queries import QUERIES


def plain(rows, cosine=0.98):
    """[(id, vector, label)] -> {id: (links, component)}"""
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    parent = {i: i for i, _, _ in rows}
    links = dict.fromkeys(parent, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, v, a) in enumerate(ok):
        for j, w, b in ok[k + 1 :]:
            if a == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= cosine:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (links[i], find(i)) for i in parent}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = plain(rows)
    got = QUERIES["op6_embedding_dedup"](spark, sf).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("largest", [2048, 7])
def test_dense_group_is_counted_exactly(spark, monkeypatch, largest):
    rng = np.random.default_rng(3)
    center = rng.normal(size=16)
    rows = [(i, (center + rng.normal(size=16) * 0.1).tolist(), 1) for i in range(120)]
    rows += [(200 + i, rows[i][1], 1) for i in range(10)]  # exact copies
    rows += [(300 + i, rng.normal(size=16).tolist(), i % 2) for i in range(100)]
    real = embedding_dedup._degrees
    monkeypatch.setattr(embedding_dedup, "_degrees", lambda n, c, cosine, kind: real(n, c, cosine, kind, largest))
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), window=8).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (8, [1.0, 2.0], None), (9, [1.0, 2.0], None)]
    rows += [(10, [1.0, 2.0], 1), (11, [1e200, 2e200], 1), (12, [1e-200, 2e-200], 1), (13, [1.0, 2.0, 0.0], 1), (14, [1.0, 2.0], 2)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, unit string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame).collect()}
    assert got == {r[0]: (0, r[0]) for r in rows} | {i: (2, 10) for i in (10, 11, 12)}
    twice = embedding_dedup.near_duplicates(frame.unionByName(frame.filter("vec_id = 10"))).filter("vec_id = 10").collect()
    assert [(r.n_links, r.component_id) for r in twice] == [(3, 10)] * 2
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_more_passes_for_more_vectors():
    counts = [embedding_dedup.passes_for(n, 32, 0.98) for n in (10, 1000, 10**5, 10**8)]
    assert counts == sorted(counts) and counts[0] < counts[-1] < 60


def test_clustered_label_equals_brute_force(spark):
    """12,000 vectors of one label around one direction (mean cosine 0.9), 300 of them near a copy at 0.981."""
    rng = np.random.default_rng(5)
    center = rng.normal(size=64)
    x = 3 * center / np.linalg.norm(center) + rng.normal(size=(12_000, 64)) / 8
    x /= np.linalg.norm(x, axis=1)[:, None]
    d = rng.normal(size=(300, 64))
    d -= (d * x[:300]).sum(1)[:, None] * x[:300]
    d /= np.linalg.norm(d, axis=1)[:, None]
    x[300:600] = 0.981 * x[:300] + np.sqrt(1 - 0.981**2) * d
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(frame).collect()}
    links = np.concatenate([(x[i : i + 1000] @ x.T >= 0.98).sum(1) - 1 for i in range(0, len(x), 1000)])
    want = {i: int(n) for i, n in enumerate(links)}
    wrong = [i for i in want if got[i] != want[i]]
    assert sum(n > 0 for n in want.values()) >= 600 and len(wrong) <= 6, (len(wrong), links.sum())
