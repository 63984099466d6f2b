"""License notices against a plain search of all windows."""

from lodeworks.llm import licenses
from lodeworks.llm.queries import QUERIES


def grams(words):
    return [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]


def plain(text):
    """{(license, template): containment}: the best share of the template's shingles in windows of twice its size."""
    own = grams(licenses.words_of(text or ""))
    found = {}
    for name, texts in licenses.TEMPLATES.items():
        for i, t in enumerate(texts):
            want = set(grams(licenses.words_of(t)))
            places = [k for k, g in enumerate(own) if g in want]
            best = max((len({own[k] for k in places if a <= k < a + 2 * len(want)}) / len(want) for a in places), default=0)
            if best >= licenses.CONTAINED:
                found[(name, i)] = best
    return found


def test_query_finds_every_notice(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {(r.doc_id, r.license, r.template): r.containment for r in QUERIES["op5_license_scan"](spark, sf).collect()}
    want = {(d, *k): c for d, x in docs.items() for k, c in plain(x).items()}
    assert want and got == want


def test_long_and_edited_notices(spark):
    mit = licenses.TEMPLATES["mit"][2]
    edited = mit.replace("free of charge", "at no charge").replace("associated", "related")
    filler = "some other words that say nothing of the kind " * 40
    rows = [(1, filler + mit.upper().replace(" ", "\n * ") + ". " + filler), (2, filler + mit[: len(mit) // 2] + filler), (3, f"{filler}{edited}. {filler}{mit}")]
    rows += [(4, "license " * 50), (5, " ".join(t for ts in licenses.TEMPLATES.values() for t in ts))]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, {})[(r.license, r.template)] = r.containment
    assert got[1] == {("mit", 2): 1.0} and got[3][("mit", 2)] == 1.0
    assert 2 not in got and 4 not in got
    assert set(got[5]) == {(name, i) for name, ts in licenses.TEMPLATES.items() for i in range(len(ts))}


def test_band_settings():
    least = 0.8 / (1.1 * 1.25 + 1 - 0.8)
    assert 1 - (1 - least**licenses.ROWS) ** licenses.BANDS > 0.999
    for n in range(1, 500):
        length = licenses.grid(n)
        width, kept = licenses.width_of(length), -(-8 * n // 10)
        assert n <= length <= max(n + 1, int(1.1 * n)) and kept / (width + n - kept) > 0.5


def test_anchors_lose_no_text():
    """Any text with 0.8 of a template's shingles has an anchor: of every template, those without one are too few."""
    words = set(licenses.anchors(licenses.TEMPLATES))
    for texts in licenses.TEMPLATES.values():
        for t in texts:
            shingles = licenses._shingles(t)
            assert sum(words.isdisjoint(s) for s in shingles) < licenses.CONTAINED * len(shingles)


def test_segments_of_long_texts(spark, monkeypatch):
    """Notices at any place of long texts, over the borders of segments too."""
    monkeypatch.setattr(licenses, "SEGMENT", 64)
    mit = licenses.words_of(licenses.TEMPLATES["mit"][4])
    rows = [(i, " ".join(["filler"] * (40 + 7 * i) + mit + ["words"] * 90)) for i in range(12)]
    got = {r.doc_id: (r.containment, r.at) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).filter("license = 'mit' and template = 4").collect()}
    assert got == {i: (1.0, 40 + 7 * i) for i in range(12)}


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "x Released under the MIT License. y", 1), (3, "w " * 200_000 + "Licensed under CC BY-NC 4.0.", 1), (3, "w " * 200_000 + "Licensed under CC BY-NC 4.0.", 1), (4, "MIT License", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, window int")
    got = {(r.doc_id, r.license, r.template, r.containment, r.at) for r in licenses.scan(docs).collect()}
    assert got == {(None, "mit", 0, 1.0, 1), (3, "cc-by-nc-4.0", 0, 1.0, 200_000)}
    assert licenses.scan(docs.limit(0)).count() == 0 and licenses.scan(docs, {}).count() == 0
