"""Counts and posteriors of quality rules against plain ones, agreement with labels that the operator never sees, odd rows."""

import re
from collections import Counter

import numpy as np

from lodeworks.llm import quality_rules
from lodeworks.llm.queries import QUERIES


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines, seen, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    short = sum(len(w) <= 3 and any(c.isalpha() for c in w) for w in words)
    capitals, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    top = max(Counter(words).values(), default=0)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), len(lines), text.count("!"), capitals, letters, short, top)


def plain_votes(c):
    x = dict(zip(quality_rules.COUNTS, c))
    n = x["n_words"]

    def vote(asked, number, fine, poor):
        if not asked:
            return 0
        return 1 if fine(number()) else -1 if poor(number()) else 0

    return [
        vote(n >= 20, lambda: x["n_symbols"] / n, lambda v: v < 0.02, lambda v: v > 0.1),
        vote(n >= 20 and x["n_letters"] >= 40, lambda: x["n_capitals"] / x["n_letters"], lambda v: v < 0.1, lambda v: v > 0.3),
        vote(n >= 20, lambda: x["n_marks"] / n, lambda v: v < 0.05, lambda v: v > 0.3),
        vote(n >= 20, lambda: x["n_repeat_words"] / n, lambda v: v < 0.15, lambda v: v > 0.3),
        vote(x["n_lines"] >= 4, lambda: x["n_dup_lines"] / x["n_lines"], lambda v: v < 0.25, lambda v: v > 0.4),
        vote(n >= 20, lambda: x["word_chars"] / n, lambda v: 3.5 <= v <= 9, lambda v: not 3 <= v <= 10),
        vote(n >= 20 and 2 * x["n_letters"] > x["word_chars"], lambda: x["n_short_words"] / n, lambda v: v > 0.1, lambda v: v < 0.05),
        vote(n >= 20, lambda: x["n_top_word"] / n, lambda v: v < 0.12, lambda v: v > 0.2),
    ]


def plain_posteriors(votes):
    """EM text by text, with products of probabilities instead of sums of logarithms."""
    rules = range(len(votes[0]))
    share, good, bad = 0.1, [0.95 for _ in rules], [0.5 for _ in rules]
    for _ in range(500):
        p = []
        for row in votes:
            fine, poor = 1 - share, share
            for v, a, b in zip(row, good, bad):
                fine *= {1: a, -1: 1 - a, 0: 1}[v]
                poor *= {1: 1 - b, -1: b, 0: 1}[v]
            p.append(fine / (fine + poor))
        share = (sum(1 - q for q in p) + 0.4) / (len(p) + 4)
        good = [(sum(q for q, r in zip(p, votes) if r[j] > 0) + 3.8) / (sum(q for q, r in zip(p, votes) if r[j]) + 4) for j in rules]
        bad = [max((sum(1 - q for q, r in zip(p, votes) if r[j] < 0) + 2) / (sum(1 - q for q, r in zip(p, votes) if r[j]) + 4), 1 - good[j]) for j in rules]
    return p


def test_query_equals_plain_rules(spark, sf_dir):
    """Every document of the smallest tables, whole: counts, votes and posteriors."""
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = sorted(QUERIES["op12_quality_rules"](spark, sf_dir).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [d for d, _ in docs]
    counts = [plain_counts(t) for _, t in docs]
    assert [tuple(r[1:6]) for r in got] == [c[:5] for c in counts]
    fine = plain_posteriors([plain_votes(c) for c in counts])
    assert np.allclose([r.p_fine for r in got], fine, atol=1e-6)
    failed = [c[0] < 50 or 100 * c[4] > 50 * c[0] for c in counts]
    assert [r.base_failed for r in got] == failed
    assert [r.kept for r in got] == [not f and p >= 0.5 for f, p in zip(failed, fine)]


def test_verdicts_agree_with_labels(spark):
    """Texts that pass the base rules, at sf0.1: the labels are never given to the operator."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = [(r.kept, labels[r.doc_id]) for r in QUERIES["op12_quality_rules"](spark, sf).collect() if not r.base_failed and r.doc_id in labels]
    assert np.mean([k for k, q in seen if q == 1]) > 0.995
    assert np.mean([not k for k, q in seen if q == 0]) > 0.95


def test_accuracies_are_found_again():
    """Votes drawn from known accuracies: EM comes back to them."""
    rng = np.random.default_rng(5)
    n, on_fine, on_poor = 200_000, np.array([0.99, 0.95, 0.9, 0.97, 0.99]), np.array([0.8, 0.6, 0.7, 0.3, 0.5])
    poor = rng.random(n) < 0.15
    right = rng.random((n, 5)) < np.where(poor[:, None], on_poor, on_fine)
    votes = np.where(right, 1, -1) * np.where(poor[:, None], -1, 1) * (rng.random((n, 5)) < 0.8)
    kinds, weights = np.unique(votes, axis=0, return_counts=True)
    found = quality_rules.fit(kinds, weights.astype(float))
    assert abs(found.poor - 0.15) < 0.01
    assert np.abs(found.on_fine - on_fine).max() < 0.01 and np.abs(found.on_poor - on_poor).max() < 0.03


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    plain = "the river of old stones ran down to a green field where some people had built their first houses long ago in peace".split()
    clean = [" ".join(rng.permutation(plain)[:9].tolist()) + ".\n" for _ in range(12)]
    texts = [None, "", "\n\n  \n", "".join(clean), "w " * 60_000, "é" * 10, "a b c a b c a b", "x\ny\nx\n x\nx", "<b>|&", " ".join(f"{w}!!" for w in "".join(clean).upper().split())]
    rows = [(i, t, 7, True) for i, t in enumerate(texts)] + [(None, "".join(clean), 7, True), (3, "".join(clean), 7, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, votes boolean")
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        assert tuple(by[i][1:6]) == plain_counts(t)[:5]
    assert by[0].base_failed and by[1].base_failed and by[4].base_failed and not by[0].kept
    assert by[3].kept and by[None].kept and not by[9].kept and not by[9].base_failed
    assert quality_rules.judge(docs.limit(0)).count() == 0
    only_fine = quality_rules.judge(docs.filter("doc_id = 3")).collect()
    assert len(only_fine) == 2 and all(r.kept for r in only_fine)
