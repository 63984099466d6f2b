"""Edit matching against a plain dynamic program over every document and item."""

import random
import time

import numpy as np

from lodeworks.llm import decontaminate
from lodeworks.llm.queries import QUERIES


def plain(pattern, text):
    """Sellers' algorithm: the least edit distance of pattern to any part of text, and the first end of it."""
    column, best = list(range(len(pattern) + 1)), (len(pattern), 0)
    for at, c in enumerate(text):
        diagonal, column[0] = column[0], 0
        for i, p in enumerate(pattern):
            diagonal, column[i + 1] = column[i + 1], min(diagonal + (p != c), column[i] + 1, column[i + 1] + 1)
        best = min(best, (column[-1], at + 1))
    return best


def edited(rng, text, n):
    for _ in range(n):
        if not text:
            break
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("xyz q") + text[i:], text[:i] + "q" + text[i + 1 :]])
    return text


def test_every_match_is_found():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 14)))) for i in range(25)]
    matcher = decontaminate.Matcher(items, 0.1)
    hits = 0
    for _ in range(120):
        item, text = rng.choice(items)
        around = [" ".join(word() for _ in range(rng.randint(0, 20))) for _ in range(2)]
        doc = f"{around[0]} {edited(rng, text, rng.randint(0, 6))} {around[1]}"
        got = {item: (d, length) for item, d, length, _ in matcher.find(doc)}
        flat = decontaminate.normal(doc)
        for i, t in items:
            t = decontaminate.normal(t)
            d, _ = plain(t, flat)
            assert (i in got) == (d <= int(0.1 * len(t)))
            if i in got:
                assert got[i] == (d, len(t))
                hits += 1
    assert hits > 50


def test_pieces_are_budget_plus_one():
    for n, k in ((95, 9), (30, 0), (50, 49), (3, 8)):
        leaves = decontaminate.pieces("x" * n, k)
        spans = sorted((x.lo, x.hi) for x in leaves)
        assert len(leaves) == min(k, n - 1) + 1 and spans[0][0] == 0 and spans[-1][1] == n
        assert all(a[1] == b[0] and a[1] > a[0] for a, b in zip(spans, spans[1:]))


def test_query_finds_the_planted_passages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in QUERIES["op4_decontaminate"](spark, sf_dir).collect()}
    exact = {(d.doc_id, i.item_id) for d in docs for i in items if decontaminate.normal(i.text) in decontaminate.normal(d.text)}
    assert exact and exact <= got
    slow = {(d.doc_id, i.item_id) for d in docs[:40] for i in items[:12] if plain(decontaminate.normal(i.text), decontaminate.normal(d.text)[:4000])[0] <= len(decontaminate.normal(i.text)) // 10}
    assert slow <= got


def test_odd_rows_and_slices(spark):
    passage = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(1, None, "x"), (2, "", "x"), (3, f"Intro. THE QUICK  brown\nfox jumps ovr the lazy dog again and again!", "x"), (None, passage, "x"), (4, "z " * 100000 + passage, "x"), (4, passage, "x"), (5, "clean words only", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, passage, 1), (11, passage, 1), (12, "", 1), (13, None, 1), (None, "clean words only", 1)], "item_id long, text string, doc_id int")
    for most in (4 << 20, 100):  # in one slice, and in several
        got = decontaminate.overlaps(docs, items, most_bytes=most).collect()
        named = sorted((r.doc_id or 0, r.item_id, r.distance) for r in got if r.item_id is not None)
        assert named == sorted([(d, i, e) for d, e in ((3, 1), (0, 0), (4, 0), (4, 0)) for i in (10, 11)])
        assert [(r.doc_id, r.distance) for r in got if r.item_id is None] == [(5, 0)]
        kept = decontaminate.clean(docs, items, most_bytes=most)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
        assert sorted(r.doc_id for r in decontaminate.clean(docs, items.filter("item_id is not null"), most_bytes=most).collect()) == [1, 2, 5]
    assert decontaminate.overlaps(docs, items.limit(0)).count() == 0 == decontaminate.overlaps(docs.limit(0), items).count()


def test_query_equals_all_pairs(spark, sf_dir):
    """All documents and items of the smallest tables, whole texts. An occurrence within the budget holds one of budget + 1
    pieces as it is; only texts that hold one need the table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = [(i.item_id, decontaminate.normal(i.text)) for i in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op4_decontaminate"](spark, sf_dir).collect()}
    want = set()
    for item, t in items:
        budget = len(t) // 10
        cuts = [len(t) * k // (budget + 1) for k in range(budget + 2)]
        pieces = [t[a:b] for a, b in zip(cuts, cuts[1:])]
        for d in docs:
            x = decontaminate.normal(d.text or "")
            if any(piece in x for piece in pieces) and (t in x or near(t, x, budget)):
                want.add((d.doc_id, item))
    assert want == got and want


def near(pattern, text, budget):
    """plain(), column by column over arrays."""
    steps = np.arange(len(pattern) + 1)
    codes, column = np.array([ord(c) for c in pattern]), steps.copy()
    for c in text:
        put = np.append(0, np.minimum(column[:-1] + (codes != ord(c)), column[1:] + 1))
        column = np.minimum.accumulate(put - steps) + steps
        if column[-1] <= budget:
            return True
    return False


def test_many_near_copies_in_one_text_take_linear_time():
    passage = "the quick brown fox jumps over the lazy dog again and again"
    matcher = decontaminate.Matcher([(1, passage)])
    start = time.time()
    assert matcher.find((passage.replace("quick", "quack") + " . ") * 8000)[0][:2] == (1, 1)
    assert time.time() - start < 20
