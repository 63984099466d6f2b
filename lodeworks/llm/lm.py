"""N-gram scoring by a weighted backoff automaton: n-grams are states, failure arcs lead to shorter ones.

Texts are coded once, in chunks of many texts with words of their own. Whatever a chunk must know of the whole corpus it
asks for: it sends the distinct keys that it holds (words, pairs, triples, histories) with what it adds to them, hashed over
buckets; a bucket adds up all chunks' parts and answers each with the totals, in the order asked. So every n-gram is counted
over the whole corpus, goes out once from each chunk however often it occurs, and no table of the model is ever sent to all.
With the answers a chunk has all arcs, failure weights and states that its texts meet: they make its automaton, through which
its texts go from left to right, each with a state of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, held_out

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The end of a text as a word of the counts, and its start as a history; no word has a blank.
END = b" "
START = b"  "
DISCOUNT = 0.75
#: N-grams of two words and more are in the model from so many occurrences on, at any size of the corpus.
LEAST = 2
#: Words of a chunk, and keys that a bucket adds up, about. Neither changes a score.
CHUNK = 1 << 20
BUCKET = 1 << 22
#: Buckets are 2 ** 14 at most, one for a partition: a chunk's row for a bucket then still holds dozens of keys.
_BITS = 14
_TINY = 1e-9


def words_of(text: bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a UTF-8 text, A-Z in lower case."""
    return (text or b"").translate(_LOWER).split()


def mixed(codes: list[np.ndarray]) -> np.ndarray:
    """64 bits of each n-gram, given by the codes of its words, or of its history and its last word."""
    x = np.zeros(len(codes[0]), np.uint64)
    for c in codes:
        x = (x ^ c) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the place of each key among them. Keys and places are sorted in one number if both fit."""
    bits = max(1, len(keys)).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + bits > 63:
        return np.unique(keys, return_inverse=True)
    both = np.sort(keys << bits | np.arange(len(keys)))
    order, keys = both & (1 << bits) - 1, both >> bits
    new = np.append(True, keys[1:] != keys[:-1])
    found = np.empty(len(keys), np.int64)
    found[order] = np.cumsum(new) - 1
    return keys[new], found


def _planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers by the place of their bytes, so that the zeros of small ones lie together and pack well."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(planes: bytes, columns: int = 1) -> np.ndarray:
    """The numbers of one or more columns of equal length, each by its planes."""
    own = np.frombuffer(planes, np.uint8).reshape(columns, 8, -1)
    return np.ascontiguousarray(own.transpose(0, 2, 1)).view("<u8")[:, :, 0]


class _Local(dict):
    """Numbers of a chunk's words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


@dataclass
class _Builder:
    local: _Local = field(default_factory=_Local)
    at: list[np.ndarray] = field(default_factory=list)
    texts: list[tuple] = field(default_factory=list)
    size: int = 0

    def add(self, words: list[bytes], skip: int, row: int, doc: int | None, learned: bool) -> None:
        self.at.append(np.fromiter(map(self.local.__getitem__, words), np.uint32, len(words)))
        self.texts.append((row, doc, len(words), skip, learned))
        self.size += len(words)

    def out(self, number: int, seed: int) -> pa.RecordBatch:
        codes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w, seed) for w in self.local]), "<u8").reshape(-1, 2)
        rows, docs, lengths, skips, learned = zip(*self.texts, strict=True)
        parts = [[number], [self.size], [sum(x and s == 1 for x, s in zip(learned, skips, strict=True))], [codes[:, 0].tobytes()], [codes[:, 1].astype("<u4").tobytes()], [np.concatenate(self.at).tobytes()]]
        parts += [[list(rows)], [list(docs)], [list(lengths)], [list(skips)], [list(learned)]]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
        return pa.RecordBatch.from_arrays([pa.array(p, k) for p, k in zip(parts, kinds, strict=True)], _CHUNK_NAMES)


_CHUNK_NAMES = ["chunk", "size", "firsts", "codes", "checks", "at", "rows", "docs", "lengths", "skips", "learned"]
_CHUNK_KINDS = "chunk long, size long, firsts long, codes binary, checks binary, at binary, rows array<long>, docs array<long>, lengths array<int>, skips array<int>, learned array<boolean>"


def encode(rows: DataFrame, chunk: int = CHUNK, seed: int = 0) -> DataFrame:
    """The chunks of rows (doc_id, text, learned): texts of about `chunk` words as numbers of the chunk's own words.

    A longer text is cut in pieces; each begins with the two words before it (one, START, at the beginning), `skips` says
    how many, which are histories there and are counted and scored elsewhere.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        row, number, built = part << 40, part << 32, _Builder()
        for batch in batches:
            for doc, text, learned in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = [START, *words_of(text.as_py()), END]
                begin = 1
                while begin < len(words):
                    first, end = max(0, begin - 2), min(len(words), begin + chunk)
                    built.add(words[first:end], begin - first, row, doc, learned)
                    begin = end
                    if built.size >= chunk:
                        yield built.out(number, seed)
                        number, built = number + 1, _Builder()
                row += 1
        if built.size:
            yield built.out(number, seed)

    return rows.mapInArrow(each, _CHUNK_KINDS)


class Chunk:
    """A chunk's arrays: its tokens as places in its words, and its distinct pairs and triples as places in theirs."""

    def __init__(self, row: dict):
        self.number = row["chunk"]
        self.codes = np.frombuffer(row["codes"], "<u8")
        self.at = np.frombuffer(row["at"], "<u4").astype(np.int64)
        lengths = np.array(row["lengths"], np.int64)
        self.rows, self.docs, self.n = row["rows"], row["docs"], len(lengths)
        self.text = np.repeat(np.arange(self.n), lengths)
        place = np.arange(len(self.at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.place, self.own = place, place >= np.repeat(np.array(row["skips"]), lengths)
        self.trained = self.own & np.repeat(np.array(row["learned"], bool), lengths)

    def word_counts(self, start: int) -> np.ndarray:
        """Training occurrences of each word; START's are the texts that begin here."""
        n = np.bincount(self.at[self.trained], minlength=len(self.codes))
        first = (self.place[:-1] == 0) & self.trained[1:]  # only START stands before the first word of a text
        return n + np.bincount(self.at[:-1][first & (self.codes[self.at[:-1]] == np.uint64(start))], minlength=len(self.codes))

    def set_pairs(self, counts: np.ndarray) -> None:
        """Distinct pairs of words that may be in the model, by their last token's place: `pair` is -1 for the others."""
        often = counts >= LEAST
        last = np.flatnonzero((self.place >= 1) & often[self.at])
        last = last[often[self.at[last - 1]]]
        width = max(1, len(self.codes))
        keys, found = _distinct(self.at[last - 1] * width + self.at[last])
        self.pair = np.full(len(self.at), -1)
        self.pair[last] = found
        self.a, self.b = np.divmod(keys, width)
        self.pair_n = np.bincount(found[self.trained[last]], minlength=len(keys))
        self.pair_keys = mixed([self.codes[self.a], self.codes[self.b]])

    def set_triples(self, pair_counts: np.ndarray) -> None:
        """Distinct triples both of whose pairs are in the model, by their last token's place."""
        kept = np.append(pair_counts >= LEAST, False)  # a place of -1 means none
        last = np.flatnonzero((self.place >= 2) & self.own & kept[self.pair])
        last = last[kept[self.pair[last - 1]]]
        width = max(1, len(self.codes))
        keys, found = _distinct(self.pair[last - 1] * width + self.at[last])
        self.triple = np.full(len(self.at), -1)
        self.triple[last] = found
        self.history, word = np.divmod(keys, width)
        self.lower = np.zeros(len(keys), np.int64)  # the pair of a triple's last two words
        self.lower[found] = self.pair[last]
        self.triple_n = np.bincount(found[self.trained[last]], minlength=len(keys))
        self.triple_keys = mixed([self.pair_keys[self.history], self.codes[word]])


_ASKED = "phase int, bucket long, chunk long, n int, keys binary, adds binary"
_ANSWERED = "phase int, bucket long, chunk long, totals binary, owned binary, kinds long, once long, twice long, total long, clash boolean"


def _asked(phase: int, chunk: int, keys: np.ndarray, adds: list[np.ndarray], bits: int) -> list[tuple]:
    """Rows of _ASKED: keys in ascending order by their first `bits`, as steps, with what the chunk adds to each."""
    if not len(keys):
        return []
    order = np.argsort(keys)
    keys, adds = keys[order], [a[order] for a in adds]
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return [
        (phase, int(bucket[lo]), chunk, hi - lo, _planes(np.diff(keys[lo:hi], prepend=np.uint64(0))), b"".join(_planes(a[lo:hi]) for a in adds))
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True)
    ]


def _table(rows: list[tuple], kinds: str) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    names = [x.split() for x in kinds.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table([pa.array(c, types[k]) for c, (_, k) in zip(columns, names, strict=True)], [n for n, _ in names])


def _answers(asked: DataFrame, columns: dict[int, int], bits: int, check: bool = False) -> DataFrame:
    """What all chunks add to each key, for each chunk that asked: _ANSWERED. Of a key's chunks one owns it. columns: by phase.

    Over a bucket's keys, kinds counts those with a first total above 0, once and twice those with 1 and 2, total sums it.
    check: the last column isn't added up but must be the same for a key everywhere; clash says that it wasn't.
    """
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:2] != row[:2]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole(batches):
            sizes = [r[3] for r in rows]
            borders = np.cumsum(sizes)[:-1]
            key, of = np.unique(np.concatenate([np.cumsum(_numbers(r[4])[0], dtype=np.uint64) for r in rows]), return_inverse=True)
            adds = np.concatenate([_numbers(r[5], columns[r[0]]).astype(np.int64) for r in rows], axis=1)
            first = np.zeros(len(key), np.int64)
            first[of[::-1]] = np.arange(len(of))[::-1]
            clash = check and bool((adds[-1] != adds[-1][first[of]]).any())
            totals = [np.bincount(of, a).astype(np.int64) for a in (adds[:-1] if check else adds)]
            owned = np.split(first[of] == np.arange(len(of)), borders)
            answered = [np.split(t[of], borders) for t in totals]
            n = totals[0]
            sums = (int((n > 0).sum()), int((n == 1).sum()), int((n == 2).sum()), int(n.sum()), clash)
            out = [(r[0], r[1], r[2], b"".join(_planes(a[i]) for a in answered), np.packbits(owned[i]).tobytes(), *(sums if i == 0 else (0, 0, 0, 0, False))) for i, r in enumerate(rows)]
            yield from _table(out, _ANSWERED).to_batches()

    dealt = asked.repartitionById(1 << bits, F.col("bucket").cast("int")).sortWithinPartitions("phase", "bucket")
    return dealt.mapInArrow(each, _ANSWERED)


def _told(answers: list[dict], phase: int, keys: np.ndarray, columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The totals of keys asked for in a phase, and which of them the chunk owns."""
    order = np.argsort(keys)
    rows = sorted((r for r in answers if r["phase"] == phase), key=lambda r: r["bucket"])
    got = [_numbers(r["totals"], columns).astype(np.int64) for r in rows]
    totals, owned = np.zeros((columns, len(keys)), np.int64), np.zeros(len(keys), bool)
    if rows:
        totals[:, order] = np.concatenate(got, axis=1)
        owned[order] = np.concatenate([np.unpackbits(np.frombuffer(r["owned"], np.uint8), count=g.shape[1]) for r, g in zip(rows, got, strict=True)]).astype(bool)
    return list(totals), owned


@dataclass(frozen=True)
class Counts:
    """Sums over the training tokens, ends counted as tokens."""

    tokens: int
    kinds: int
    discount: float
    bits: int


_WORDS, _PAIRS, _OF_WORD, _TRIPLES, _OF_PAIR = range(5)


#: Tokens that a lane walks: longer texts are walked by several lanes at once, each from the two tokens before its own.
LANE = 256


@dataclass(frozen=True)
class Automaton:
    """States are histories: the empty one (0), words, pairs of words from `pairs` on. An arc over a word has a weight (log10 of
    a probability) and leads to the longest history of the model that then ends there. A state that has no arc for a word
    fails: its failure arc, which takes no word, leads to the history without its first word, at a weight. The empty
    history has arcs for all words.

    sources, weights, targets: the arcs of pairs and words. roots, first: weights and targets of the empty history's arcs, by
    word. fails, costs: the failure arc of each state.
    """

    pairs: int
    sources: np.ndarray
    weights: np.ndarray
    targets: np.ndarray
    roots: np.ndarray
    first: np.ndarray
    fails: np.ndarray
    costs: np.ndarray

    def step(self, state: np.ndarray, word: np.ndarray, of_pair: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word from each state: the weights of all arcs taken, failures included, and the states that it leads to.

        of_pair, of_word: the arcs (-1: none) over the word that the two words before it, or the last one, may have; one is
        taken only by the state that it begins in.
        """
        total, at, to, left = np.zeros(len(state)), state, np.zeros(len(state), np.int64), np.ones(len(state), bool)
        for arc in (of_pair, of_word):
            taken = left & (arc >= 0) & (self.sources[arc] == at) if len(self.sources) else np.zeros(len(state), bool)
            total = np.where(taken, total + self.weights[arc], total) if taken.any() else total
            to = np.where(taken, self.targets[arc], to) if taken.any() else to
            left = left & ~taken
            failing = left & (at >= self.pairs) if arc is of_pair else left
            total = total + np.where(failing, self.costs[at], 0.0)
            at = np.where(failing, self.fails[at], at)
        return total + np.where(left, self.roots[word], 0.0), np.where(left, self.first[word], to)

    def walk(self, words: np.ndarray, of_pair: np.ndarray, of_word: np.ndarray, begins: np.ndarray, own: np.ndarray, texts: int) -> np.ndarray:
        """The score of each text: its tokens are taken one by one from left to right, and its state goes with it; all texts of
        a chunk move together. own: tokens that count; those before them only lead to the state in which these begin."""
        ends = np.append(begins[1:], len(words))
        skips = np.array([int(np.argmax(own[b : b + 3])) for b in begins.tolist()], np.int64)
        lanes = -(-(ends - begins - skips) // LANE)
        of = np.repeat(np.arange(len(begins)), lanes)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = begins[of] + skips[of] + nth * LANE
        warm = np.minimum(2, start - begins[of])
        length = np.minimum(start + LANE, ends[of]) - start + warm
        order = np.argsort(-length, kind="stable")
        start, warm, length, of = (start - warm)[order], warm[order], length[order], of[order]
        state, score = np.zeros(len(of), np.int64), np.zeros(len(of))
        active = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left").tolist()  # lanes that have a token left
        for t, n in enumerate(active):
            at = start[:n] + t
            weight, state[:n] = self.step(state[:n], words[at], of_pair[at], of_word[at])
            score[:n] += weight if t >= 2 else np.where(warm[:n] <= t, weight, 0.0)
        return np.bincount(of, score, texts)


class Walk:
    """What a chunk knows of the model so far: each step takes its answers and asks for what comes next."""

    def __init__(self, row: dict, answers: list[dict], counts: Counts):
        self.chunk, self.answers, self.counts = Chunk(row), answers, counts
        (self.n1,), _ = _told(answers, _WORDS, self.chunk.codes, 1)
        self.chunk.set_pairs(self.n1)

    def pairs(self) -> list[tuple]:
        c = self.chunk
        return _asked(_PAIRS, c.number, c.pair_keys, [c.pair_n], self.counts.bits)

    def _know_pairs(self) -> None:
        c = self.chunk
        (self.n2,), self.own2 = _told(self.answers, _PAIRS, c.pair_keys, 1)
        self.kept2 = self.n2 >= LEAST
        self.histories = np.flatnonzero(self.n1 >= LEAST)  # of arcs that other chunks may have
        c.set_triples(self.n2)

    def of_words_and_triples(self) -> list[tuple]:
        """Asks for each history's arcs: sums of their counts, their number, and sums of their last words' counts; and for triples."""
        self._know_pairs()
        c, mine = self.chunk, self.kept2 & self.own2
        adds = [np.bincount(c.a[mine], w, len(c.codes)).astype(np.int64)[self.histories] for w in (self.n2[mine], np.ones(int(mine.sum())), self.n1[c.b[mine]])]
        return _asked(_OF_WORD, c.number, c.codes[self.histories], adds, self.counts.bits) + _asked(_TRIPLES, c.number, c.triple_keys, [c.triple_n], self.counts.bits)

    def of_pairs(self) -> list[tuple]:
        self._know_pairs()
        c = self.chunk
        (n3,), own3 = _told(self.answers, _TRIPLES, c.triple_keys, 1)
        mine, asked = (n3 >= LEAST) & own3, np.flatnonzero(self.kept2)
        adds = [np.bincount(c.history[mine], w, len(self.n2)).astype(np.int64)[asked] for w in (n3[mine], np.ones(int(mine.sum())), self.n2[c.lower[mine]])]
        return _asked(_OF_PAIR, c.number, c.pair_keys[asked], adds, self.counts.bits)

    def scores(self) -> list[tuple]:
        """(row, doc_id, n_tokens, n_known, base_score, score) of each text, or of its piece."""
        self._know_pairs()
        c, all_ = self.chunk, self.counts
        own = np.flatnonzero(c.own)
        text, word = c.text[own], c.at[own]
        tokens = np.bincount(text, minlength=c.n)
        n = self.n1[word]
        if not all_.tokens:
            zeros = np.zeros(c.n)
            return list(zip(c.rows, c.docs, tokens.tolist(), zeros.astype(int).tolist(), zeros.tolist(), zeros.tolist(), strict=True))
        base = np.log10((n + 0.1) / (all_.tokens + 0.1 * (all_.kinds + 1)))
        kinds = self.n1  # of each word
        single = np.log10(np.where(kinds > 0, np.maximum(kinds - all_.discount, _TINY), max(all_.discount * all_.kinds, _TINY)) / all_.tokens)

        def failure(sums: list[np.ndarray], of: np.ndarray, off: float, below: np.ndarray | float) -> np.ndarray:
            """log10 of what a state's arcs leave over what their lower probabilities leave."""
            seen, arcs, lower = sums
            left, rest = 1 - (seen - DISCOUNT * arcs) / of, 1 - (lower - off * arcs) / below
            return np.log10(np.maximum(left, _TINY) / np.maximum(rest, _TINY))

        fail1, fail2 = np.zeros(len(c.codes)), np.zeros(len(self.n2))
        sums, _ = _told(self.answers, _OF_WORD, c.codes[self.histories], 3)
        fail1[self.histories] = failure(sums, self.n1[self.histories], all_.discount, float(all_.tokens))
        asked = np.flatnonzero(self.kept2)
        sums, _ = _told(self.answers, _OF_PAIR, c.pair_keys[asked], 3)
        fail2[asked] = failure(sums, self.n2[asked], DISCOUNT, self.n1[c.b[asked]])
        (n3,), _ = _told(self.answers, _TRIPLES, c.triple_keys, 1)

        model, of_pair, of_word = self._automaton(single, fail1, fail2, n3)
        begins = np.flatnonzero(np.append(True, c.text[1:] != c.text[:-1]))
        score = model.walk(c.at, of_pair, of_word, begins, c.own, c.n)
        sums = [np.bincount(text, w, c.n) for w in (n > 0, base)]
        return list(zip(c.rows, c.docs, tokens.tolist(), sums[0].astype(int).tolist(), sums[1].tolist(), score.tolist(), strict=True))

    def _automaton(self, single: np.ndarray, fail1: np.ndarray, fail2: np.ndarray, n3: np.ndarray) -> tuple[Automaton, np.ndarray, np.ndarray]:
        """The part of the model that this chunk's texts can meet, and the arcs that each token may be taken by."""
        c = self.chunk
        width, pairs = len(c.codes), len(self.n2)
        word_state = np.where(self.n1 >= LEAST, 1 + np.arange(width), 0)
        pair_state = 1 + width + np.arange(pairs)
        p, t = np.flatnonzero(self.kept2), np.flatnonzero(n3 >= LEAST)
        sources = np.concatenate([word_state[c.a[p]], pair_state[c.history[t]]])
        weights = np.concatenate([np.log10((self.n2[p] - DISCOUNT) / self.n1[c.a[p]]), np.log10((n3[t] - DISCOUNT) / self.n2[c.history[t]])])
        targets = np.concatenate([pair_state[p], pair_state[c.lower[t]]])
        arc_of_pair, arc_of_triple = np.full(pairs + 1, -1), np.full(len(n3) + 1, -1)  # a place of -1 means none
        arc_of_pair[p], arc_of_triple[t] = np.arange(len(p)), len(p) + np.arange(len(t))
        fails = np.concatenate([np.zeros(1 + width, np.int64), word_state[c.b]])
        model = Automaton(1 + width, sources, weights, targets, single, word_state, fails, np.concatenate([[0.0], fail1, fail2]))
        return model, arc_of_triple[c.triple], arc_of_pair[c.pair]


_SCORED = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, parts: int = 10, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text).

    A null text counts as empty: it has one token, its end. The model learns from the rows that aren't held out; rows
    without an id are scored, never learned from, and count as held out. Each repeated row is learned from and scored.
    With nothing learned both scores are 0. Other columns are ignored. Words are told apart by 64 bits, and checked by 32
    more: should two share a code, all is coded anew with another seed; pairs and triples are told apart by 64 bits.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    try:
        return _scored(docs, parts, chunk, bucket, scratch)
    except BaseException:
        scratch.drop_all_but()  # a bucketed table is known to the session's catalog
        raise


def _scored(docs: DataFrame, parts: int, chunk: int, bucket: int, scratch: Scratch) -> DataFrame:
    learned = ~held_out(F.col("doc_id"), parts)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), learned.alias("learned"))
    for seed in range(8):
        chunks = scratch.bucketed(encode(rows, chunk, seed), f"chunks-{seed}", "chunk")
        start = int.from_bytes(xxhash.xxh3_128_digest(START, seed)[:8], "little")
        size, firsts = chunks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("firsts"), F.lit(0))).first()
        bits = min(_BITS, max(1, (size // bucket).bit_length()))

        def words(batches: Iterator[pa.RecordBatch], start: int = start, bits: int = bits) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    here = Chunk(row)
                    checks = np.frombuffer(row["checks"], "<u4").astype(np.int64)
                    yield from _table(_asked(_WORDS, here.number, here.codes, [here.word_counts(start), checks], bits), _ASKED).to_batches()

        answers = scratch.table(_answers(chunks.mapInArrow(words, _ASKED), {_WORDS: 2}, bits, check=True), f"words-{seed}")
        kinds, once, twice, tokens, clash = (answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("kinds", "once", "twice", "total")], F.coalesce(F.max("clash"), F.lit(False))).first())
        if not clash:
            break
    else:
        raise RuntimeError("words share codes with every seed")
    tokens, kinds, once, twice = tokens - firsts, kinds - (firsts > 0), once - (firsts == 1), twice - (firsts == 2)  # less START
    counts = Counts(tokens, kinds, once / (once + 2 * twice) if once and twice else 0.5, bits)

    def step(what: Callable[[Walk], list[tuple]], kinds: str) -> DataFrame:
        def each(left: pa.Table, right: pa.Table) -> pa.Table:
            told = right.to_pylist()
            return _table([x for row in left.to_pylist() for x in what(Walk(row, told, counts))], kinds)

        return chunks.groupBy("chunk").cogroup(answers.select("phase", "bucket", "chunk", "totals", "owned").groupBy("chunk")).applyInArrow(each, kinds)

    answers = answers.unionByName(scratch.table(_answers(step(Walk.pairs, _ASKED), {_PAIRS: 1}, bits), "pairs"))
    answers = answers.unionByName(scratch.table(_answers(step(Walk.of_words_and_triples, _ASKED), {_OF_WORD: 3, _TRIPLES: 1}, bits), "triples"))
    answers = answers.unionByName(scratch.table(_answers(step(Walk.of_pairs, _ASKED), {_OF_PAIR: 3}, bits), "of-pairs"))
    pieces = step(Walk.scores, _SCORED)
    sums = pieces.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    scored = scratch.table(sums, "scores")
    scratch.drop_all_but("scores")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), parts).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
