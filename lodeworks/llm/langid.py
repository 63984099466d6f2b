"""Language identification, words first: log frequencies of known words, shorter and shorter n-grams for the rest."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out

#: A word is a run of letters (word characters but digits and the underscore), lower-cased.
_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the n-grams that an unseen word falls back to, longest first; words are marked with ^ and $.
GRAMS = (4, 3, 2, 1)
_FLUSH = 200_000
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Log frequencies: words and n-grams to rows of a matrix with a column for each language."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray


def marked(word: str, n: int) -> list[str]:
    word = f"^{word}$"
    return [word[i : i + n] for i in range(max(1, len(word) - n + 1))] if n > 1 else list(word[1:-1])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of bounded parts of a partition."""
    counts: Counter[tuple[str, str]] = Counter()

    def out() -> pa.RecordBatch:
        keys = list(counts)
        parts = [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([counts[k] for k in keys], pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(parts, ["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.update((lang, w) for w in _WORD.findall(text.lower()))
            if len(counts) > _FLUSH:
                yield out()
    if counts:
        yield out()


def fit(docs: DataFrame, sample_rows: int = 2000, least: int = 2, parts: int = 5) -> Model:
    """Learns from rows that aren't held out and have a text and a lang.

    At most about sample_rows rows of each language are read, those with the least hash of their id: this documented
    bound keeps the model small enough to send to each task (the words that occur `least` times or more in so many
    texts). Counting runs on Spark; the driver gets the counts of the sample only.
    """
    rows = docs.filter("lang is not null and text is not null").filter(~held_out(F.col("doc_id"), parts))
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(totals)
    if not langs:
        return Model([], {}, {}, np.zeros((0, 0)))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample_rows / totals[lang]))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1_000_003)) / 1_000_003.0
    sample = rows.select("lang", "text", draw.alias("draw")).filter(F.col("draw") < share[F.col("lang")])
    counted = sample.select("lang", "text").mapInArrow(_count, "lang string, word string, n long")
    by_lang = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, lang in enumerate(langs)]
    known = counted.groupBy("word").agg(F.sum("n").alias("total"), *by_lang).filter(F.col("total") >= least).toArrow()  # of the sample
    return _table(langs, known["word"].to_pylist(), np.stack([known[f"n{i}"].to_numpy() for i in range(len(langs))], axis=1).astype(float))


def tabulate(langs: list[str], counted: Iterable[tuple[str, dict[str, int]]]) -> Model:
    """The model of words with their counts by language."""
    words = dict(counted)
    return _table(langs, list(words), np.array([[by.get(lang, 0) for lang in langs] for by in words.values()], float).reshape(-1, len(langs)))


def _table(langs: list[str], words: list[str], counts: np.ndarray) -> Model:
    """Smoothed log frequencies of the words, and of the n-grams of each length in them."""
    smooth = lambda rows: np.log((rows + 0.1) / (rows.sum(axis=0) + 0.1 * (len(rows) + 1)))
    blocks, index, start = [smooth(counts)], {}, len(words)
    for n in GRAMS:
        own: dict[str, int] = {}
        grams = np.fromiter((own.setdefault(g, len(own)) for word in words for g in marked(word, n)), np.int64)
        of = np.repeat(np.arange(len(words)), [max(1, len(w) + 3 - n) if n > 1 else len(w) for w in words])
        rows = np.stack([np.bincount(grams, counts[of, i], len(own)) for i in range(len(langs))], axis=1)
        index |= {g: start + i for g, i in own.items()}
        start += len(own)
        blocks.append(smooth(rows))
    return Model(langs, {w: i for i, w in enumerate(words)}, index, np.concatenate(blocks))


class Scorer:
    """Predicts one text at a time; remembers a bounded number of unseen words."""

    def __init__(self, model: Model, keep: int = 200_000):
        self.model, self.keep, self.seen = model, keep, {}

    def unseen(self, word: str) -> np.ndarray:
        """The mean log frequencies of its known n-grams of the greatest length that has any."""
        found = self.seen.get(word)
        if found is None:
            found = np.zeros(len(self.model.langs))
            for n in GRAMS:
                rows = [i for g in marked(word, n) if (i := self.model.grams.get(g)) is not None]
                if rows:
                    found = self.model.table[rows].mean(axis=0)
                    break
            if len(self.seen) >= self.keep:
                self.seen.clear()
            if len(word) <= 64:
                self.seen[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.langs or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0
        words = _WORD.findall(text.lower())
        get = self.model.words.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        logs = self.model.table[ids[ids >= 0]].sum(axis=0)
        for i in np.flatnonzero(ids < 0).tolist():
            logs = logs + self.unseen(words[i])
        best = int(np.argmax(logs))
        return self.model.langs[best], float(1 / np.exp(logs - logs[best]).sum())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the columns lang_pred and score in front of its own; only text is looked at."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # bounded by fit()'s sample
    names = ["lang_pred", "score", *docs.columns]
    at = docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            found = [scorer.predict(t) for t in batch.column(at).to_pylist()]
            new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*new, *batch.columns], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(each, f"lang_pred string, score double, {kinds}")


def identify(docs: DataFrame, parts: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs (doc_id, text, lang); other columns are ignored.

    lang_pred is a learned language, or `und` with score 0 if the text is null, has no letter or nothing was learned;
    score is the posterior of the prediction, in (0, 1]. Of languages that tie, the first by name wins. Rows without
    an id are scored, never learned from, and count as held out; repeated rows are scored each.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    scored = predict(rows.select("doc_id", "text"), fit(rows, parts=parts))
    return scored.select("doc_id", held_out(F.col("doc_id"), parts).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, parts: int = 5) -> DataFrame:
    """The rows of docs whose language is found with a score of `least` or more; all columns stay as they are."""
    model = fit(docs.select("doc_id", "text", "lang"), parts=parts)
    found = predict(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
