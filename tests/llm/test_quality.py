"""Quality scores: held-out ranking, calibration pieces against plain ones, odd rows."""

import zlib

import numpy as np

from lodeworks.llm import quality
from lodeworks.llm.queries import QUERIES


def test_query_ranks_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op10_quality_score"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    good = np.array([s for s, q, _ in held if q == 1])
    bad = np.array([s for s, q, _ in held if q == 0])
    auc = ((good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean())
    assert auc > 0.95
    assert np.mean([q == p for _, q, p in held]) > 0.95


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = rng.integers(1, 12)
        w, y = rng.integers(1, 9, n).astype(float), rng.random(n)
        got = quality.isotonic(w, y)
        want = [max(min((w[i : j + 1] @ y[i : j + 1]) / w[i : j + 1].sum() for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        assert np.allclose(got, want)


def test_odd_rows(spark):
    rows = [(i, "THE!! AND!! OF!! " * 5 if i % 3 == 0 else f"a clean line of words number {i} and so on.\nanother one", "x") for i in range(90)]
    rows += [(200, None, "x"), (201, "", "x"), (None, "some words", "x"), (202, "w " * 200000, "x"), (202, "w", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1, "t") for i in range(90)] + [(None, 1, "t"), (5, None, "t"), (7, 1, "t")], "doc_id long, quality int, text string")
    got = quality.assess(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[200].score == by[201].score and by[None].held_out
    assert by[0].predicted == 0 and by[1].predicted == 1
    assert {r.score for r in quality.assess(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.assess(docs.limit(0), labels).count() == 0


def test_fit_equals_plain_least_squares(spark):
    """All of the fit over a small table, row by row in plain arrays: standardized statistics, waves, ridge, steps, scores."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()]
    waves, gamma, penalty, bins = 16, 0.05, 1e-3, 64
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    quality.shared_dir(spark)
    model = quality.fit(docs, marks, waves=waves, gamma=gamma, penalty=penalty, bins=bins)
    texts = dict(rows)
    own = [(quality.statistics((texts[d] or "").encode()), q) for d, q in labels if d in texts and zlib.crc32(str(d).encode()) % 5]
    x, y = np.array([a for a, _ in own]), np.array([float(q) for _, q in own])
    sd = x.std(axis=0)
    rng = np.random.default_rng(20240607)
    weights, shift = rng.normal(0, np.sqrt(2 * gamma), (x.shape[1], waves)), rng.uniform(0, 2 * np.pi, waves)

    def features(stats):
        z = np.clip((stats - x.mean(axis=0)) / np.where(sd > 1e-9, sd, 1), -6, 6)
        return np.column_stack([np.sqrt(2 / waves) * np.cos(z @ weights + shift), np.ones(len(z))])

    f = features(x)
    padded = np.vstack([f, np.sqrt(penalty * len(y)) * np.eye(waves + 1)])
    ridge = np.linalg.lstsq(padded, np.append(y - y.mean(), np.zeros(waves + 1)), rcond=None)[0]
    assert np.allclose(model.ridge, ridge, atol=1e-7)
    raw = f @ ridge
    of = np.clip(np.floor(raw / (4 / bins)), -bins // 2, bins // 2)
    kinds = np.unique(of)
    n, mean_y, mean_raw = (np.array([g(of == k) for k in kinds]) for g in (np.sum, lambda m: y[m].mean(), lambda m: raw[m].mean()))
    steps = [max(min((n[i : j + 1] @ mean_y[i : j + 1]) / n[i : j + 1].sum() for j in range(k, len(n))) for i in range(k + 1)) for k in range(len(n))]
    everything = np.array([quality.statistics((t or "").encode()) for _, t in rows])
    want = np.clip(np.interp(features(everything) @ ridge, mean_raw, steps), 0, 1)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert np.allclose([got[d] for d, _ in rows], want, atol=1e-6)
