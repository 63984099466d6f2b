"""The backoff automaton: base scores and counts exactly, probabilities that sum to one, odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodeworks.llm import lm
from lodeworks.llm.queries import QUERIES


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [" "]


def out(doc):
    return zlib.crc32(str(doc).encode()) % 10 == 0


def test_query_base_scores_and_gain(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counts = Counter(t for d, x in docs.items() if not out(d) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    got = QUERIES["op2_lm_score"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        own = tokens(docs[r.doc_id])
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(counts[t] > 0 for t in own), n, out(r.doc_id))
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and r.score <= 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.9


def brute(train, texts):
    """Plain backoff over dictionaries, with the same discounts and thresholds, for a vocabulary that is frequent throughout."""
    seqs = [tokens(t) for t in train]
    uni = Counter(t for s in seqs for t in s)
    total, kinds = sum(uni.values()), len(uni)
    n1, n2 = (sum(c == i for c in uni.values()) for i in (1, 2))
    d1 = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    p1 = lambda w: (uni[w] - d1) / total if w in uni else d1 * kinds / total
    bi = Counter(p for s in seqs for p in zip(["<s>", *s], s) if all(x == "<s>" or uni[x] >= 2 for x in p))
    bi = {p: c for p, c in bi.items() if c >= 2 and (p[0] != "<s>" or len(seqs) >= 2)}
    tri = Counter((a, b, c) for s in seqs for a, b, c in zip(["<s>", *s], s, s[1:]) if (a, b) in bi and (b, c) in bi)
    tri = {p: c for p, c in tri.items() if c >= 2}
    of = {"<s>": len(seqs)} | uni

    def p2(a, w):
        own = {y: (c - 0.75) / of[x] for (x, y), c in bi.items() if x == a}
        if w in own:
            return own[w]
        return (1 - sum(own.values())) / (1 - sum(p1(y) for y in own)) * p1(w)

    def p3(a, b, w):
        own = {z: (c - 0.75) / bi[(a, b)] for (x, y, z), c in tri.items() if (x, y) == (a, b)}
        if w in own:
            return own[w]
        return (1 - sum(own.values())) / (1 - sum(p2(b, z) for z in own)) * p2(b, w)

    scores = []
    for text in texts:
        total_log, a, b = 0.0, None, "<s>"
        for w in tokens(text):
            total_log += math.log10(p3(a, b, w) if a is not None else p2(b, w))
            a, b = b, w
        scores.append(total_log)
    return scores, uni


def test_scores_equal_plain_backoff(spark):
    rng = np.random.default_rng(4)
    words = ["a", "b", "c", "d", "e", "rare1", "rare2"]
    texts = [" ".join(rng.choice(words, size=rng.integers(1, 9), p=[0.3, 0.25, 0.2, 0.15, 0.09, 0.005, 0.005])) for _ in range(300)] + ["zz a b", "once"]
    rows = list(enumerate(texts))
    train = [t for i, t in rows if not out(i)]
    want, _ = brute(train, texts)
    for chunk, bucket in ((lm.CHUNK, lm.BUCKET), (37, 100), (2, 1 << 20)):  # texts in many chunks, and cut in pieces
        got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk, bucket=bucket).collect()}
        for i, w in enumerate(want):
            assert math.isclose(got[i], w, rel_tol=1e-9, abs_tol=1e-9), (chunk, texts[i], got[i], w)


def test_odd_rows(spark):
    rows = [(i, "the same old words again", 1) for i in range(30)] + [(100, None, 1), (101, " \n", 1), (None, "the words", 1), (102, "w " * 100_000, 1), (102, "x", 1)]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, n int, chunk string").withColumn("row", F.lit(1))
    got = lm.score(frame).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[100].n_tokens == by[101].n_tokens == 1 and by[100].score == by[101].score and by[None].held_out
    assert all(r.train_tokens == by[0].train_tokens for r in got)
    none = lm.score(frame.filter("doc_id is null")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in none] == [(3, 0, 0, 0.0, 0.0)]
    assert lm.score(frame.limit(0)).count() == 0


def test_ngrams_seen_twice_count_however_large_the_corpus(spark):
    """Over 400,000 training tokens a pair or triple seen twice is under a share of 1e-5, and is kept all the same."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 50, 60)) for _ in range(8000)]
    for i in range(300):
        texts[2 * i] += f" r{i} s{i} t{i}"
        texts[2 * i + 1001] += f" r{i} s{i} t{i}"
    rows = list(enumerate(texts))
    train = [t for i, t in rows if not out(i)]
    some = [*range(0, 600, 60), 7999]
    want, uni = brute_of_tables(train, [texts[i] for i in some])
    assert sum(uni.values()) > 400_000
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk, bucket in ((lm.CHUNK, lm.BUCKET), (5000, 1 << 14)):  # however it is dealt, the scores are the same
        got = {r.doc_id: r.score for r in lm.score(frame, chunk=chunk, bucket=bucket).collect()}
        for i, w in zip(some, want, strict=True):
            assert math.isclose(got[i], w, rel_tol=1e-9, abs_tol=1e-9), (chunk, i, got[i], w)


def brute_of_tables(train, texts):
    """The backoff of brute(), with the sums of each history taken once."""
    seqs = [tokens(t) for t in train]
    uni = Counter(t for s in seqs for t in s)
    total, kinds = sum(uni.values()), len(uni)
    n1, n2 = (sum(c == i for c in uni.values()) for i in (1, 2))
    d1 = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    p1 = lambda w: (uni[w] - d1) / total if w in uni else d1 * kinds / total
    bi = {p: c for p, c in Counter(p for s in seqs for p in zip(["<s>", *s], s)).items() if c >= 2}
    tri = {p: c for p, c in Counter(p for s in seqs for p in zip(["<s>", *s], s, s[1:])).items() if c >= 2}
    of = {"<s>": len(seqs)} | uni
    left2, below2, left3, below3 = (Counter() for _ in range(4))
    for (a, b), c in bi.items():
        left2[a] += (c - 0.75) / of[a]
        below2[a] += p1(b)

    def p2(a, w):
        return (bi[a, w] - 0.75) / of[a] if (a, w) in bi else (1 - left2[a]) / (1 - below2[a]) * p1(w)

    for (a, b, c), n in tri.items():
        left3[a, b] += (n - 0.75) / bi[a, b]
        below3[a, b] += p2(b, c)

    def p3(a, b, w):
        return (tri[a, b, w] - 0.75) / bi[a, b] if (a, b, w) in tri else (1 - left3[a, b]) / (1 - below3[a, b]) * p2(b, w)

    scores = []
    for text in texts:
        own = tokens(text)
        scores.append(math.log10(p2("<s>", own[0])) + sum(math.log10(p3(a, b, w)) for a, b, w in zip(["<s>", *own], own, own[1:])))
    return scores, uni


def test_automaton_by_hand():
    """Three words; a pair state that fails to its last word's, and that to the empty history, each at its cost."""
    a, b, c = 0, 1, 2
    # Arc 0: a -> b leads to the pair state 4, and arc 1 from there over c to the state of c.
    arcs = np.array([1 + a, 4]), np.array([-0.5, -0.25]), np.array([4, 1 + c])
    model = lm.Automaton(4, *arcs, np.array([-1.0, -2.0, -3.0]), np.array([1 + a, 1 + b, 1 + c]), np.array([0, 0, 0, 0, 1 + b]), np.array([0.0, -0.1, -0.2, -0.3, -0.7]))
    state, word = np.array([0, 1 + a, 4, 4, 1 + c]), np.array([b, b, c, a, c])
    weight, to = model.step(state, word, np.array([-1, -1, 1, -1, 1]), np.array([0, 0, -1, -1, -1]))  # some arcs begin elsewhere
    assert np.allclose(weight, [-2.0, -0.5, -0.25, -0.7 - 0.2 - 1.0, -0.3 - 3.0]) and to.tolist() == [1 + b, 4, 1 + c, 1 + a, 1 + c]
    words = np.array([a, b, c, a] * 700)
    of_pair, of_word = np.where(words == c, 1, -1), np.where(words == b, 0, -1)
    whole = model.walk(words, of_pair, of_word, np.array([0]), np.ones(len(words), bool), 1)
    state, total = np.zeros(1, np.int64), 0.0
    for i in range(len(words)):
        step, state = model.step(state, words[i : i + 1], of_pair[i : i + 1], of_word[i : i + 1])
        total += step[0]
    assert math.isclose(whole[0], total, rel_tol=1e-12) and len(words) > 5 * lm.LANE


def test_query_scores_equal_plain_backoff_over_the_real_vocabulary(spark, sf_dir):
    """All documents of the smallest tables, whole, against the backoff over dictionaries."""
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    want, _ = brute_of_tables([t for d, t in docs if not out(d)], [t for _, t in docs])
    got = {r.doc_id: r.score for r in QUERIES["op2_lm_score"](spark, sf_dir).collect()}
    for (d, _), w in zip(docs, want, strict=True):
        assert math.isclose(got[d], w, rel_tol=1e-9, abs_tol=1e-9), d


def test_distinct_keys():
    rng = np.random.default_rng(6)
    for top, n in ((5, 40), (10**9, 3000), (2**62, 3000), (1, 1), (1, 0)):
        keys = rng.integers(0, top, n)
        for got, want in zip(lm._distinct(keys), np.unique(keys, return_inverse=True), strict=True):
            assert (got == want).all()
