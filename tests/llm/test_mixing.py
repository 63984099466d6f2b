"""Budgets down the tree against a plain recursion, exact prefixes, and the query against its SQL."""

import hashlib
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import mixing
from lodeworks.llm.queries import ORACLES, QUERIES


def deal(budget, children):
    """{name: (weight, cap)} -> {name: given}, round after round among those below their cap"""
    given, open_ = {}, {k for k, (w, _) in children.items() if w > 0}
    given.update({k: 0.0 for k in children if k not in open_})
    while open_:
        weight = sum(children[k][0] for k in open_)
        full = {k for k in open_ if children[k][1] <= budget * children[k][0] / weight}
        if not full:
            return given | {k: budget * children[k][0] / weight for k in open_}
        for k in full:
            given[k] = float(children[k][1])
            budget -= children[k][1]
        open_ -= full
    return given


def test_budgets_equal_plain_recursion(spark):
    leaves = [("a", "en", f"s{i}", 100 * i + 7) for i in range(5)] + [("a", "de", "s0", 30), ("a", "xx", "s1", 9), ("b", "en", "s0", 10_000), ("b", "fr", "s9", 0), ("c", "en", "s0", 50)]
    for share in (0.1, 0.5, 0.9, 2.0, 5.0):
        recipe = mixing.Recipe(domains={"a": 5, "b": 1, "c": 0}, langs={"en": 2.0, "xx": 0.5}, sources={"s1": 3.0}, share=share)
        got = {r[:3]: r.target for r in mixing.budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, leaf_tokens long"), recipe).collect()}
        tree = defaultdict(lambda: defaultdict(dict))
        for d, lang, s, n in leaves:
            tree[d][lang][s] = (recipe.sources.get(s, 1), 2 * n)
        cap = lambda x: sum(cap(v) for v in x.values()) if isinstance(x, dict) else x[1]
        caps = {d: cap(t) if recipe.domains.get(d, 1) else 0 for d, t in tree.items()}
        top = deal(min(share * sum(x[3] for x in leaves) // 1, sum(caps.values())), {d: (recipe.domains.get(d, 1), caps[d]) for d in tree})
        for d, by_lang in tree.items():
            mid = deal(top[d], {k: (recipe.langs.get(k, 1), cap(t)) for k, t in by_lang.items()})
            for k, t in by_lang.items():
                for s, g in deal(mid[k], t).items():
                    assert abs(got[(d, k, s)] - g) <= 1, (share, d, k, s)


@pytest.fixture(scope="module")
def query(spark):
    sf = "/root/testdata/sf0.01"
    return sf, QUERIES["op8_source_mixing"](spark, sf).collect()


def test_query_equals_sql(query):
    sf, got = query
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(ORACLES["op8_source_mixing"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_prefixes_meet_their_targets(spark, query):
    _, rows = query
    leaves = defaultdict(list)
    for r in rows:
        leaves[(r.domain, r.lang, r.source)].append(r)
    taken = sum(r.taken_tokens for r in rows)
    want = int(0.8 * sum(r.tokens for r in rows))
    assert want - len(leaves) <= taken <= want
    for own in leaves.values():
        epoch = own[0].epochs_full
        order = sorted(own, key=lambda r: hashlib.md5(f"mix-1|{epoch}|{r.doc_id}".encode()).hexdigest())
        parts = [r.partial_tokens for r in order]
        cut = sum(p == r.tokens for p, r in zip(parts, order, strict=True) if r.tokens)
        full = [r for r in order if r.tokens]
        assert [r.partial_tokens for r in full[cut + 1 :]] == [0] * len(full[cut + 1 :])


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", "s"), (None, "a b c", "en", "s"), (3, "w " * 100_000, "en", "t"), (4, "same row", "de", "s"), (4, "same row", "de", "s"), (5, "\t a\x0bb\n", "de", "s")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, bucket int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or 0, r.tokens) for r in got) == sorted([(1, 0), (2, 0), (0, 3), (3, 100_000), (4, 2), (4, 2), (5, 2)])
    whole = mixing.select_documents(docs, mixing.Recipe(share=2.0))
    assert whole.columns == docs.columns and whole.filter("doc_id = 5").count() == 2
    assert mixing.mix(docs.limit(0)).count() == 0 == mixing.select_documents(docs.limit(0)).count()
    custom = mixing.mix(docs, mixing.Recipe(domains={"x": 1.0}), domain=F.lit("x")).collect()
    assert {r.domain for r in custom} == {"x"}


def test_documents_meet_the_targets_to_the_word(spark, sf_dir):
    """What select_documents() returns, counted plainly, is what mix() says is taken of each document; cut texts are prefixes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: (r.text or "") for r in docs.collect()}
    want = {r.doc_id: r.taken_tokens for r in mixing.mix(docs).collect() if r.taken_tokens}
    got, cut = defaultdict(int), 0
    for r in mixing.select_documents(docs).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        got[r.doc_id] += len(words)
        if r.text != texts[r.doc_id]:
            cut += 1
            assert r.text == " ".join(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])[: len(words)]) and r.n_chars == len(r.text)
    assert got == want and cut > 5
