"""Periodic runs against brute force over all periods, transforms against their definition, odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lodeworks.llm import periodic_runs
from lodeworks.llm.queries import QUERIES
from lodeworks.llm.words import slices


def plain_runs(words):
    """[(start, length, period)]: every period, every stretch of equal words at its distance, smallest periods only."""
    _, codes = np.unique(np.array(words, object), return_inverse=True) if words else (0, np.zeros(0, int))
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[0], codes[:-q] == codes[q:], [0]]).astype(int)
        begins, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for i, j in zip(begins.tolist(), ends.tolist()):
            length = j - i + q
            if length >= max(6, 4 * q) and not any((codes[i : i + length - d] == codes[i + d : i + length]).all() for d in range(1, q)):
                out.append((i, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {w for start, length, q in runs for w in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("ring", [periodic_runs._RING, periodic_runs._LARGE])
@pytest.mark.parametrize("n", [2, 16, 64, 128, 2048])
def test_transform_is_exact(ring, n):
    rng = np.random.default_rng(n)
    a, b = (rng.integers(-(ring.p // 2), ring.p // 2, (2, n)) for _ in "ab")
    if n <= 128:
        want = np.array([[sum(int(x[j]) * int(y[(k - j) % n]) for j in range(n)) % ring.p for k in range(n)] for x, y in zip(a, b)])
        both = ring.mod(ring.forward(a.astype(float), n) * ring.forward(b.astype(float), n))
        got = ring.inverse(both).astype(np.int64) * pow(n, -1, ring.p) % ring.p
        assert (got == want).all()
        assert (ring.inverse(both, behind=True).astype(np.int64) * pow(n, -1, ring.p) % ring.p == want[:, n // 2 :]).all()
    back = ring.inverse(ring.forward(a.astype(float), n)).astype(np.int64)
    assert ((back - a * n) % ring.p == 0).all()


def test_runs_equal_brute_force():
    random.seed(3)
    for _ in range(200):
        docs = []
        for _ in range(random.randint(1, 6)):
            kinds, n = random.choice([1, 2, 3, 9]), random.choice([0, 1, 5, 6, 21, 64, 250])
            words = [str(random.randrange(kinds)) for _ in range(n)]
            for _ in range(random.randint(0, 3) if n > 4 else 0):
                a = random.randrange(n)
                p, e = random.randint(1, max(1, (n - a) // 3)), random.randint(a, n)
                for i in range(a, e):
                    words[i] = words[a + (i - a) % p]
            docs.append(words)
        codes, counts = np.array([int(w) for d in docs for w in d], np.int64), np.array([len(d) for d in docs])
        got = [[] for _ in docs]
        for text, *run in zip(*(x.tolist() for x in periodic_runs.runs_of(codes, counts))):
            got[text].append(tuple(run))
        assert got == [plain_runs(d) for d in docs]


def test_hard_words_stay_near_linear():
    """A long text of one word, and blocks of two words in turn, each nest many repetitions: no seed is followed twice."""
    n = 60_000
    assert [x.tolist() for x in periodic_runs.runs_of(np.zeros(n, np.int64), np.array([n]))] == [[0], [0], [n], [1]]
    codes = np.tile(np.repeat([0, 1], [700, 300]), 60)
    text, start, length, period = periodic_runs.runs_of(codes, np.array([n]))
    assert (0, n, 1000) in set(zip(start.tolist(), length.tolist(), period.tolist())) and len(text) == 121


def test_query_equals_brute_force(spark, sf_dir):
    """Every document of the smallest tables, whole."""
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    with_runs = 0
    for d in docs:
        words, h = split(d.text), zlib.crc32(str(d.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, r = plain_runs(words), got[d.doc_id]
        with_runs += bool(runs)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest()
    assert with_runs >= 10


def test_odd_rows(spark):
    long = "x y " * 30_000 + "end"
    texts = [None, "", " \t\n ", "a", "a a a a a", "a a a a a a", "   ", "é ü é ü é ü é ü\n", long, "a a a a a a", "one\x0btwo\x0cone two one\rtwo one two"]
    rows = [(i, t, "r", 1) for i, t in enumerate(texts)] + [(None, "b b b b b b c", "r", 1), (5, "a a a a a a", "r", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    found = sorted(periodic_runs.find(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.collapsed))
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    for i, t in enumerate(texts):
        words = split(t)
        runs = plain_runs(words) if len(words) < 1000 else [(0, 60_000, 2)]
        assert [tuple(r) for r in by[i].runs] == runs and by[i].n_words == len(words)
        assert by[i].collapsed == plain_collapsed(words, runs)
    assert by[None].collapsed == "b c" and by[8].collapsed == "x y end"
    out = periodic_runs.digests(periodic_runs.find(periodic_runs.with_repetitions(docs))).collect()
    assert len(out) == len(rows) and all(r.runs_sha256 and r.collapsed_sha256 for r in out)
    empty = periodic_runs.digests(periodic_runs.find(periodic_runs.with_repetitions(docs.limit(0))))
    assert empty.count() == 0


def test_slices_hold_whole_words():
    import pyarrow as pa

    texts = ["ab cd", None, "", "cd", " x", "ab  ", "e"]
    for most in (1, 6, 1 << 20):
        got = []
        for w in slices(pa.array([t and t.encode() for t in texts], pa.binary()), most):
            names = [w.kinds[c].as_py().decode() for c in w.codes.tolist()]
            got += [names[a:b] for a, b in zip(w.starts, w.starts[1:])]
            assert w.lengths.tolist() == [len(n) for n in names]
        assert got == [split(t) for t in texts]
