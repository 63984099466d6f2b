"""Word-first language identification: held-out accuracy, fallback to n-grams, odd rows."""

import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from lodeworks.llm import langid
from lodeworks.llm.queries import QUERIES


def test_query_predicts_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op7_language_id"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held)
    assert right >= 0.95 * len(held)


def test_fallback_goes_from_long_to_short():
    model = langid.tabulate(["a", "b"], [("sonne", {"a": 5}), ("lune", {"b": 5})])
    scorer = langid.Scorer(model)
    row = scorer.unseen("sonnen")  # has known 4-grams: "^son", "sonn", "onne"
    grams = [model.grams[g] for g in ("^son", "sonn", "onne")]
    assert abs(row - model.table[grams].mean(axis=0)).max() < 1e-12
    row = scorer.unseen("xxlu")  # the longest known one is the 2-gram "lu"
    assert abs(row - model.table[[model.grams["lu"]]].mean(axis=0)).max() < 1e-12
    assert scorer.predict("sonne lune lune")[0] == "b"
    assert scorer.predict("SONNE!")[0] == "a" and math.isclose(sum(langid.Scorer(model).unseen("qqq")), 0)


def test_odd_rows(spark):
    rows = [(i, "der die das und nicht wort" if i % 2 else "the and of that word not", "de" if i % 2 else "en", "x") for i in range(60)]
    rows += [(100, None, "de", "x"), (101, "", None, "x"), (102, "12 34 !?", "en", "x"), (None, "the and of", "en", "x"), (103, "das " * 60000, None, "x"), (103, "das " * 3, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all((by[d].lang_pred, by[d].score) == ("und", 0.0) for d in (100, 101, 102))
    assert by[103].lang_pred == "de" and by[None].lang_pred == "en" and by[None].held_out
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    none = langid.identify(docs.limit(0))
    assert none.count() == 0
    unlabelled = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def plain_model(rows, least=2):
    """predict(text) of a plain word-first model over dictionaries, learned from (text, lang)."""
    langs = sorted({lang for _, lang in rows})
    words = Counter((w, lang) for text, lang in rows for w in re.findall(r"[^\W\d_]+", text.lower()))
    total = Counter()
    for (w, _), n in words.items():
        total[w] += n
    known = {w for w, n in total.items() if n >= least}
    grams = {n: Counter() for n in (4, 3, 2, 1)}
    for (w, lang), c in words.items():
        if w in known:
            for n in grams:
                for g in plain_grams(w, n):
                    grams[n][g, lang] += c

    totals = {}

    def logs(counts, keys, key):
        kinds = len(keys)
        if id(counts) not in totals:
            totals[id(counts)] = {lang: sum(counts[k, lang] for k in keys) for lang in langs}
        sums = totals[id(counts)]
        return {lang: math.log((counts[key, lang] + 0.1) / (sums[lang] + 0.1 * (kinds + 1))) for lang in langs}

    kinds = {n: {g for g, _ in grams[n]} for n in grams}
    seen = {}

    def of_word(w):
        if w not in seen:
            seen[w] = dict.fromkeys(langs, 0.0)
            if w in known:
                seen[w] = logs(words, known, w)
            else:
                for n in grams:
                    found = [logs(grams[n], kinds[n], g) for g in plain_grams(w, n) if g in kinds[n]]
                    if found:
                        seen[w] = {lang: sum(f[lang] for f in found) / len(found) for lang in langs}
                        break
        return seen[w]

    def predict(text):
        if not text or not langs or not any(c.isalpha() for c in text):
            return "und", 0.0
        sums = dict.fromkeys(langs, 0.0)
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            for lang, x in of_word(w).items():
                sums[lang] += x
        best = max(langs, key=lambda lang: (sums[lang], [-ord(c) for c in lang]))
        return best, 1 / sum(math.exp(sums[lang] - sums[best]) for lang in langs)

    return predict


def plain_grams(word, n):
    word = f"^{word}$"
    return list(word[1:-1]) if n == 1 else [word[i : i + n] for i in range(max(1, len(word) - n + 1))]


def test_scores_equal_a_plain_model(spark):
    """Every score of a small table, with words that are known, partly known and not at all, against dictionaries."""
    docs = [(r.doc_id, r.text[:200] if r.text else r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(9001, "zzqx wvvk", None), (9002, "the qqthe", "en"), (9003, "12 !", "en"), (9004, None, "en")]
    learned = [(t, lang) for d, t, lang in docs if t is not None and lang is not None and zlib.crc32(str(d).encode()) % 5]
    predict = plain_model(learned)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    for d, text, _ in docs:
        lang, score = predict(text)
        assert got[d][0] == lang and math.isclose(got[d][1], score, rel_tol=1e-6, abs_tol=1e-9), (d, got[d], lang, score)
