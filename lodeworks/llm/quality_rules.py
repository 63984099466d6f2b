"""Quality rules as weak supervision: rules vote or abstain, EM estimates how often each is right, posteriors decide."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, shared_dir
from .words import Words, slices

#: What is counted of each text, in the order of the columns.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_capitals", "n_letters", "n_short_words", "n_top_word")
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_CAPITALS = np.isin(np.arange(256), np.arange(65, 91))
_LETTERS = _CAPITALS | np.isin(np.arange(256), np.arange(97, 123))
_MARKS = np.arange(256) == ord("!")


@dataclass(frozen=True)
class Rule:
    """Votes 1 (fine) or -1 (poor) by a number; abstains (0) between the two, or where `asked` doesn't hold or is null."""

    name: str
    number: str
    fine: str
    poor: str
    asked: str = "n_words >= 20"

    def vote(self) -> Column:
        case = f"CASE WHEN {self.asked} THEN CASE WHEN {self.fine} THEN 1 WHEN {self.poor} THEN -1 ELSE 0 END ELSE 0 END"
        return F.expr(f"coalesce({case.replace('{x}', f'({self.number})')}, 0)")


#: Each has a zone in the middle where it has no opinion, and none about texts that are too short for its number.
RULES = (
    Rule("symbols", "n_symbols / n_words", "{x} < 0.02", "{x} > 0.1"),
    Rule("capitals", "n_capitals / n_letters", "{x} < 0.1", "{x} > 0.3", "n_words >= 20 AND n_letters >= 40"),
    Rule("exclamations", "n_marks / n_words", "{x} < 0.05", "{x} > 0.3"),
    Rule("repeated words", "n_repeat_words / n_words", "{x} < 0.15", "{x} > 0.3"),
    Rule("repeated lines", "n_dup_lines / n_lines", "{x} < 0.25", "{x} > 0.4", "n_lines >= 4"),
    Rule("word length", "word_chars / n_words", "{x} BETWEEN 3.5 AND 9", "{x} NOT BETWEEN 3 AND 10"),
    Rule("short words", "n_short_words / n_words", "{x} > 0.1", "{x} < 0.05", "n_words >= 20 AND 2 * n_letters > word_chars"),
    Rule("one word", "n_top_word / n_words", "{x} < 0.12", "{x} > 0.2"),
)


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])


def _triples(words: Words, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of three words of one text begin, and a number for each, equal for equal windows of one text."""
    at = np.flatnonzero(text[:-2] == text[2:]) if len(text) > 2 else np.zeros(0, np.int64)
    key, kinds = text[at], max(len(words.kinds), 1)
    for i in range(3):
        if len(key) and int(key.max()) >= 2**62 // kinds:
            key = np.unique(key, return_inverse=True)[1]
        key = key * kinds + words.codes[at + i]
    return at, key


def _counts(words: Words) -> np.ndarray:
    """A row of COUNTS for each text."""
    counts = words.counts
    text = np.repeat(np.arange(len(counts)), counts)
    names = words.kinds.cast(pa.string())
    chars = pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(np.int64)
    short = (chars <= 3) & np.asarray(pc.match_substring_regex(names, r"\pL").to_numpy(zero_copy_only=False), bool)
    at, key = _triples(words, text)
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    repeated = np.zeros(len(text), bool)
    if len(twice):
        begins = at[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
        for i in range(3):
            repeated[begins + i] = True
    pairs, n = np.unique(text * max(len(words.kinds), 1) + words.codes, return_counts=True)
    top = np.zeros(len(counts), np.int64)
    np.maximum.at(top, pairs // max(len(words.kinds), 1), n)
    lines = np.zeros((len(counts), 2), np.int64)
    for i, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)):
        filled = [x for x in words.raw[a:b].tobytes().split(b"\n") if x.strip()]
        lines[i] = len(filled) - len(set(filled)), len(filled)
    of_bytes = [_per_text(kind[words.raw], words.bounds) for kind in (_SYMBOLS, _MARKS, _CAPITALS, _LETTERS)]
    of_words = [_per_text(x, words.starts) for x in (chars[words.codes], repeated, short[words.codes])]
    return np.stack([counts, of_words[0], of_bytes[0], lines[:, 0], of_words[1], lines[:, 1], *of_bytes[1:], of_words[2], top], axis=1)


def count(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS...) for every row of docs (doc_id, text), over whole texts; a null text counts as an empty one.

    Words are `[^\\x20\\x09-\\x0D]+`. word_chars: code points in words; n_symbols: characters of `[#*$%&|<>]`; n_dup_lines: lines
    with a word that equal an earlier line; n_repeat_words: words in windows of three that the text has twice or more; n_lines:
    lines with a word; n_short_words: words with a letter and at most three characters; n_top_word: how often the most
    frequent word occurs; marks are `!`, capitals and letters those of ASCII.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column(1)):
                table = _counts(words)
                ids = batch.column(0).slice(words.first, len(table))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in table.T)], ["doc_id", *COUNTS])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(each, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Accuracies:
    """The share of poor texts, and how often each rule that votes is right about fine and about poor ones."""

    poor: float
    on_fine: np.ndarray
    on_poor: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability that a text with these votes (rows of -1, 0, 1) is fine."""
        fine, poor = votes > 0, votes < 0
        odds = fine @ (np.log(self.on_fine) - np.log1p(-self.on_poor)) + poor @ (np.log1p(-self.on_fine) - np.log(self.on_poor))
        return 1 / (1 + np.exp(np.clip(np.log(self.poor) - np.log1p(-self.poor) - odds, -700, 700)))


def fit(votes: np.ndarray, weights: np.ndarray, rounds: int = 500) -> Accuracies:
    """Expectation-maximisation over distinct votes and how many texts have them, without any label.

    Votes are taken as independent given whether a text is fine. It begins with one text of ten poor, rules that are right
    about 19 of 20 fine and half of the poor ones, and adds these as the votes of 4 texts, so that rules that never vote
    stay there. A rule is never worse than chance: it is right about poor texts at least as often as wrong about fine ones.
    """
    now = Accuracies(0.1, np.full(votes.shape[1], 0.95), np.full(votes.shape[1], 0.5))
    added, fine, poor = 4.0, votes > 0, votes < 0
    for _ in range(rounds):
        w = weights * now.posterior(votes)
        v = weights - w
        share = (v.sum() + added * 0.1) / (weights.sum() + added)
        on_fine = (w @ fine + added * 0.95) / (w @ (votes != 0) + added)
        on_poor = np.maximum((v @ poor + added * 0.5) / (v @ (votes != 0) + added), 1 - on_fine)
        new = Accuracies(float(share), on_fine, on_poor)
        moved = max(abs(new.poor - now.poor), *np.abs(new.on_fine - now.on_fine), *np.abs(new.on_poor - now.on_poor))
        now = new
        if moved < 1e-10:
            break
    return now


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_fine) for every row of docs.

    base_failed: under 50 words, or over half of them in repeated windows; such texts aren't kept. Others are kept where the
    posterior probability p_fine, from the rules' votes, is `least` or more. The accuracies are learned from the votes of all
    rows: texts are read once, their counts written, and the driver gets the number of texts for each distinct combination
    of votes, at most 3 ** len(rules). Null and empty texts have no words, so they fail; null ids stay; repeated rows count
    and are judged each; other columns are ignored; no rows give none.
    """
    shared_dir(docs.sparkSession)
    code = sum(((r.vote() + 1) * 3**i for i, r in enumerate(rules)), F.lit(0)).cast("int")
    counted = cut(count(docs).withColumn("votes", code), "quality-counts")
    seen = counted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()
    votes = np.array([[r.votes // 3**i % 3 - 1 for i in range(len(rules))] for r in seen], np.int64).reshape(-1, len(rules))
    fine = fit(votes, np.array([r.n for r in seen], float)).posterior(votes)
    known = docs.sparkSession.createDataFrame([(r.votes, float(p)) for r, p in zip(seen, fine, strict=True)], "votes int, p_fine double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = counted.join(F.broadcast(known), "votes")  # at most 3 ** len(rules) rows
    return rows.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & (F.col("p_fine") >= least)).alias("kept"), "p_fine")
