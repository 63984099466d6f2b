"""Periodic runs of words: blocks at dyadic scales, found again by exact integer convolutions; distances seed extensions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, slices

#: Numbers of one convolution that are held at once (longer transforms are held alone).
_HELD = 1 << 16
#: The longest transform that is one product of matrices; longer ones are cut by about their roots, or by this.
_DIRECT = 64


def _factor(n: int) -> int:
    return min(_DIRECT, 1 << (n.bit_length() // 2))


class Ring:
    """Number-theoretic transforms modulo a prime p = c * 2**k + 1 of which 3 generates the units, for lengths to 2**k.

    Numbers are kept between -p/2 and p/2 in doubles. A sum of 64 products stays below 2**53 and is exact; where p is
    larger, one factor is split in two halves so that it holds as well.
    """

    def __init__(self, p: int, halves: bool):
        self.p, self.halves = p, halves

    def mod(self, x: np.ndarray) -> np.ndarray:
        parts = x * (1.0 / self.p)
        np.rint(parts, out=parts)
        parts *= self.p
        x -= parts
        return x

    @cache
    def powers(self, n: int, rows: int, columns: int, inverse: bool) -> np.ndarray:
        """w ** (j * k) for j < rows and k < columns, w a root of unity of order n, or its inverse."""
        w = pow(3, (self.p - 1) // n * (n - 1 if inverse else 1), self.p)
        all_, known = np.ones(n, np.int64), 1
        while known < n:  # w ** i for i < n by doubling
            more = min(known, n - known)
            all_[known : known + more] = all_[:more] * pow(w, known, self.p) % self.p
            known += more
        table = all_[np.outer(np.arange(rows), np.arange(columns)) % n]
        return np.where(table > self.p // 2, table - self.p, table).astype(float)

    def _product(self, left: np.ndarray, right: np.ndarray, table_left: bool) -> np.ndarray:
        if not self.halves:
            return self.mod(np.matmul(left, right))
        table = left if table_left else right
        high = np.rint(table / 16384)
        low = table - 16384 * high
        parts = [np.matmul(t, right) if table_left else np.matmul(left, t) for t in (high, low)]
        return self.mod(16384 * self.mod(parts[0]) + parts[1])

    def forward(self, x: np.ndarray, n: int) -> np.ndarray:
        """Transforms of the rows of x, filled up with zeros to n; in an order of their own, which `inverse` takes."""
        if n <= _DIRECT:
            return self._product(x, self.powers(n, n, n, False)[: x.shape[1]], False)
        m = _factor(n)
        rest = n // m
        if x.shape[1] % rest:
            x = np.pad(x, ((0, 0), (0, -x.shape[1] % rest)))
        cut = x.reshape(len(x), -1, rest)
        own = self._product(self.powers(m, m, m, False)[:, : cut.shape[1]], cut, True)
        own *= self.powers(n, m, rest, False)
        return self.forward(self.mod(own).reshape(-1, rest), rest).reshape(len(x), n)

    def inverse(self, x: np.ndarray, behind: bool = False) -> np.ndarray:
        """What the rows of x are transforms of, times their length; only its second half if `behind`."""
        n = x.shape[1]
        first = n // 2 if behind else 0
        if n <= _DIRECT:
            return self._product(x, self.powers(n, n, n, True)[:, first:], False)
        m = _factor(n)
        rest = n // m
        own = self.inverse(x.reshape(-1, rest)).reshape(len(x), m, rest)
        own *= self.powers(n, m, rest, True)
        return self._product(self.powers(m, m, m, True)[first // rest :], self.mod(own), True).reshape(len(x), n - first)


_RING = Ring(7 * 2**20 + 1, False)
_LARGE = Ring(5 * 2**25 + 1, True)


def _repeats(values: np.ndarray, blocks: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) wherever a block of `size` words stands again at a distance of size to 2 * size - 1 words.

    The sum of squared differences of a block and what stands at a distance is a convolution of the block, reversed, with
    what stands behind it, and two sums of squares. It is zero, modulo the prime, for equal words; other words that
    give zero as well (about one in p) are told apart by the caller.
    """
    ring = _RING if 2 * size <= 2**20 else _LARGE
    p, n = ring.p, 2 * size
    squares = np.concatenate([[0], np.cumsum((values.astype(np.int64) ** 2) % p)])
    sums = ((squares[size:] - squares[:-size]) % p * size % p).astype(float)  # of `size` words from each on, times n / 2
    step = max(1, _HELD // n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, blocks, step):
        hi = min(lo + step, blocks)
        block = np.ascontiguousarray(values[lo * size : hi * size].reshape(-1, size)[:, ::-1])
        behind = np.lib.stride_tricks.sliding_window_view(values[(lo + 1) * size - 1 : (hi + 2) * size - 1], n)[::size]
        both = ring.forward(block, n)
        both *= ring.forward(np.ascontiguousarray(behind), n)
        product = ring.inverse(ring.mod(both), behind=True)
        rest = sums[(lo + 1) * size : (hi + 1) * size].reshape(-1, size) - product
        rest += sums[lo * size : hi * size : size, None]
        block_at, distance = np.nonzero(ring.mod(rest) == 0)
        found.append((block_at + lo, distance + size))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _stretches(at: np.ndarray, distance: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds sorted by distance and place, with the number of the stretch of adjoining blocks that each is in, and the number
    of blocks that a run of 4 periods and 6 words has at least."""
    order = np.lexsort((at, distance))
    at, distance = at[order], distance[order]
    new = np.ones(len(at), bool)
    new[1:] = (distance[1:] != distance[:-1]) | (at[1:] != at[:-1] + size)
    least = np.maximum(1, (np.maximum(6 - distance, 3 * distance) - size + 1) // size)
    return at, distance, np.cumsum(new) - 1, least


def _equal_words(codes: np.ndarray, at: np.ndarray, distance: np.ndarray, size: int, back: bool = False) -> np.ndarray:
    """How many words, up to `size`, from `at` on (or before it, going back) equal those at the distance behind them."""
    out = np.zeros(len(at), np.int64)
    step = max(1, _HELD // size)
    reach = -1 - np.arange(size) if back else np.arange(size)
    for lo in range(0, len(at), step):
        places = at[lo : lo + step, None] + reach
        differ = codes[places] != codes[places + distance[lo : lo + step, None]]
        out[lo : lo + step] = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
    return out


def runs_of(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all periodic runs of at least 6 words and 4 periods, by text, start and period.

    codes: the words of texts one after another, as numbers; counts: how many each text has. A run with a period of `size`
    to 2 * size - 1 words holds a block of `size` words, at a multiple of it, that stands again at the period's distance, and
    so do its next blocks; so each scale finds the runs of its periods. Blocks within a run of a smaller period are left
    out: what repeats at a multiple of that period has the smaller one. Longer texts come first, so that each scale
    takes only texts that have 4 * size words.
    """
    order = np.argsort(-counts, kind="stable")
    ends = np.cumsum(counts[order] + 1)  # each text, and a word of its own behind it
    begins = ends - counts[order] - 1
    total = int(ends[-1]) if len(ends) else 0
    largest = int(counts.max(initial=0))
    pad = 4 * max(largest, 1)
    place = np.empty(len(counts), np.int64)
    place[order] = begins
    starts = np.cumsum(counts) - counts
    kinds = int(codes.max(initial=-1)) + 1
    row = np.full(total + 2 * pad, -1, np.int64)
    row[pad + np.arange(len(codes)) + np.repeat(place - starts, counts)] = codes
    row[pad + ends - 1] = kinds + np.arange(len(ends))
    numbers = np.random.default_rng(11).integers(1, _RING.p // 2, kinds + len(ends) + 1).astype(float)
    values = numbers[row[pad:]]
    covered = np.zeros(total + 1, np.int64)  # how far the known runs that begin here or before reach
    found: list[np.ndarray] = []
    size = 1
    while (fit := int(np.searchsorted(-counts[order], -max(6, 4 * size), "right"))) > 0:
        blocks = int(ends[fit - 1]) // size
        block, distance = _repeats(values, blocks, size)
        at = block * size
        new = covered[at] < at + distance + size
        at, distance = at[new], distance[new]
        for checked in (False, True):  # stretches that are long enough, then those whose words are equal
            at, distance, stretch, least = _stretches(at, distance, size)
            enough = np.bincount(stretch)[stretch] >= least if len(at) else np.zeros(0, bool)
            at, distance, stretch = at[enough], distance[enough], stretch[enough]
            if not checked:
                same = _equal_words(row, at + pad, distance, size) == size
                at, distance = at[same], distance[same]
        if len(at):
            first = np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1]))
            last = np.append(first[1:], len(at)) - 1
            period = distance[first]
            start = at[first] - _equal_words(row, at[first] + pad, period, size, back=True)
            end = at[last] + size + _equal_words(row, at[last] + size + pad, period, size) + period
            long = end - start >= np.maximum(6, 4 * period)
            found.append(np.stack([start, end - start, period])[:, long])
            np.maximum.at(covered, start[long], end[long])
            covered = np.maximum.accumulate(covered)
        size *= 2
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    text = order[np.searchsorted(begins, start, "right") - 1]
    start = start - place[text]
    by = np.lexsort((period, start, text))
    return text[by], start[by], length[by], period[by]


def _found(words: Words) -> tuple[pa.Array, pa.Array]:
    """For each text its runs, and its words without the repetitions, joined by a blank."""
    text, start, length, period = runs_of(words.codes, words.counts)
    bounds = np.searchsorted(text, np.arange(len(words.counts) + 1)).astype(np.int32)
    fields = [pa.array(x) for x in (start, length, period)]
    runs = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    depth = np.zeros(len(words.codes) + 1, np.int64)
    at = words.starts[text] + start
    np.add.at(depth, at + period, 1)
    np.add.at(depth, at + length, -1)
    kept = np.cumsum(depth)[:-1] == 0
    ends = np.concatenate([[0], np.cumsum(kept)])[words.starts].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), words.kinds.take(pa.array(words.codes[kept])))
    return runs, pc.binary_join(lists, b" ")


_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of docs (doc_id, text); other columns are ignored.

    Words are `[^\\x20\\x09-\\x0D]+`. runs: all stretches of at least 6 words and 4 periods that no neighbouring word extends,
    with their smallest period, by start, then period; starts count words from 0. collapsed: the words that no run contains
    behind its first period, joined by one blank. A null or empty text has no words, no runs and an empty collapsed text;
    a null id stays one; repeated rows are searched each; no rows give none. The time of a text of n words
    grows as n * log(n) ** 2, whatever its words are, and a task holds a text and a few arrays of its length.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column(1)):
                runs, collapsed = _found(words)
                ids = batch.column(0).slice(words.first, len(runs))
                yield pa.RecordBatch.from_arrays([ids, pa.array(words.counts), runs, collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(each, _SCHEMA).withColumn("collapsed", F.col("collapsed").cast("string"))


def with_repetitions(docs: DataFrame) -> DataFrame:
    """(doc_id, text): docs with repetitions planted in one text of ten, by a hash of the id, so that searches have some to find.

    With h = crc32 of the id in decimal and g = h div 10: where h mod 10 is 0, the n words from a = g mod n on become the
    p = 1 + (n - a) div (3 + g mod 8) words there, repeated. A null id has no hash, so its text stays.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    sized = chosen.withColumns({"n": F.size("words"), "g": F.floor(F.col("h") / 10)}).withColumn("a", F.expr("int(if(n > 0, g % n, 0))"))
    repeated = F.expr(
        "array_join(slice(concat(slice(words, 1, a), flatten(array_repeat(slice(words, a + 1, int(1 + (n - a) div (3 + g % 8))), int(4 + g % 8)))), 1, n), ' ')"
    )
    return sized.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), repeated).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, the run of the greatest exponent, exponent_milli, runs_sha256, collapsed_sha256) of what `find` returns.

    Of equal exponents the first by start, then by period counts; where there is no run, start, length, period and
    exponent_milli are null.
    """
    best = F.expr("aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    exponent = F.expr("(1000 * best.length) div best.period")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
