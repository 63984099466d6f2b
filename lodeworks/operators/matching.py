"""Which texts contain which others, by shared pieces instead of all pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import text_parts
from ..sources.scratch import spread, written

#: Pieces in a row that a text must share with an item before the whole item is looked for in it.
PIECES = 4
#: Where texts are cut in pieces: at white space, or for texts without any at frequent letters and marks.
AT_BLANKS, AT_LETTERS = r"\s+", "[aeio,.的。，]"
#: Bytes of items that are sent to all tasks, and texts that a task cuts at once.
_SENT = 1 << 25
_ROWS = 2048
#: Pairs of an item and a text that are sent to all tasks.
_PAIRS = 1 << 20


def _runs(text: Column, cut: str, inner: bool) -> Column:
    """Hashes of PIECES pieces in a row; null if there are too few. inner: without the first and last piece, which may go on
    in the text around."""
    first = 1 if inner else 0

    def of(p: Column) -> Column:
        last = F.size(p) - PIECES - first
        run = lambda i: F.xxhash64(*[F.get(p, i + j) for j in range(PIECES)])
        return F.when(last >= first, F.transform(F.sequence(F.lit(first), F.greatest(last, F.lit(first))), run))

    return F.get(F.transform(F.array(F.split(text, cut)), of), F.lit(0))  # split once for each row


def _inner(text: Column, cut: str) -> Column:
    """The longest of a text's pieces but the first and the last, which may go on in the text around; null without any."""
    pieces = F.split(text, cut)
    inner = F.filter(F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))), lambda p: p != "")
    return F.array_max(F.transform(inner, lambda p: F.struct(F.length(p).alias("n"), p.alias("piece"))))["piece"]


def _cut(texts: pa.Array, cut: str) -> pa.Array:
    return pc.ascii_split_whitespace(texts) if cut == AT_BLANKS else pc.split_pattern_regex(texts, cut)


class _Sought:
    """Items as tasks need them: each is looked up by inner pieces in a row, of its runs of PIECES the longest, or all if it has fewer."""

    def __init__(self, items: pa.Table, cut: str) -> None:
        texts = items.column("wanted").combine_chunks().cast(pa.string())
        self.items, self.texts, self.cut = items.column("item").combine_chunks(), texts.cast(pa.binary()).to_pylist(), cut
        keys, number = [], {(): 0}
        for pieces in _cut(texts, cut).to_pylist():
            inner = pieces[1:-1]
            n = min(PIECES, len(inner))
            at = max(range(len(inner) - n + 1), key=lambda i: sum(map(len, inner[i : i + n])))
            keys.append(tuple(inner[at : at + n]))
        for key in keys:
            for n in range(len(key)):
                number.setdefault(key[: n + 1], len(number))
        code = {p: i for i, p in enumerate(dict.fromkeys(p for key in keys for p in key))}
        self.pieces, self.width = pa.array(code, pa.string()), max(len(code), 1)
        self.steps = []  # for each length, what a shorter run and one more piece make
        for n in range(1, PIECES + 1):
            step = sorted((number[key[:-1]] * self.width + code[key[-1]], to) for key, to in number.items() if len(key) == n)
            self.steps.append(np.array(step, np.int64).reshape(-1, 2).T)
        self.ends: list[list[int]] = [[] for _ in number]
        for i, key in enumerate(keys):
            self.ends[number[key]].append(i)
        self.last = np.array([bool(e) for e in self.ends])

    def rows(self, texts: pa.Array) -> tuple[list[int], list[int]]:
        """Places of items, and of the texts that contain them."""
        pieces = _cut(texts, self.cut)
        coded = pieces.flatten().dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.pieces), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        code = known[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(texts)), pieces.value_lengths().to_numpy())
        at, state = np.arange(len(code)), np.zeros(len(code), np.int64)
        maybe = [np.arange(len(texts)) * len(self.ends)] if self.last[0] else []  # items without a piece to look for
        for n, (step, to) in enumerate(self.steps):
            keep = at + n < len(code)
            at, state = at[keep], state[keep]
            keep = (code[at + n] >= 0) & (row[at + n] == row[at])
            at, state = at[keep], state[keep]
            if not len(step) or not len(at):
                break
            run = state * self.width + code[at + n]
            place = np.minimum(np.searchsorted(step, run), len(step) - 1)
            keep = step[place] == run
            at, state = at[keep], to[place[keep]]
            ended = self.last[state]
            maybe.append(row[at[ended]] * len(self.ends) + state[ended])
        found, text, before = [], b"", -1
        raw = texts.cast(pa.binary())
        for r, s in np.stack(np.divmod(np.unique(np.concatenate(maybe)), len(self.ends)), 1).tolist() if maybe else []:
            if r != before:
                text, before = raw[r].as_py(), r
            found.extend((i, r) for i in self.ends[s] if self.texts[i] in text)
        return [i for i, _ in found], [r for _, r in found]


def _found_in_tasks(texts: DataFrame, items: DataFrame, cut: str) -> DataFrame:
    """(item, id) for each of texts (id, text) that contains one of items (item, wanted), which all tasks get."""
    schema = T.StructType([T.StructField("item", items.schema["item"].dataType), T.StructField("id", texts.schema["id"].dataType)])
    sent = texts.sparkSession.sparkContext.broadcast(_Sought(items.select("item", "wanted").toArrow(), cut))  # of a counted size

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, 1, _ROWS):
                item, row = sent.value.rows(pc.fill_null(part.column(1).cast(pa.string()), ""))
                yield pa.RecordBatch.from_arrays([sent.value.items.take(pa.array(item, pa.int64())), part.column(0).take(pa.array(row, pa.int64()))], ["item", "id"])

    return texts.mapInArrow(search, schema)


def containing(texts: DataFrame, items: DataFrame, cut: str = AT_BLANKS, most_short: int = 10_000) -> DataFrame:
    """(item, id) for each of texts (id, text) that contains an item's text, of items (item, text), as it is.

    If a text contains an item, it has all of the item's inner pieces, whole and in a row; so each item is looked up by
    some of these in a row, and only texts that share them are searched. Up to _SENT bytes of items go to all tasks, which
    cut each text once and search it where it lies. More are looked up by an equi-join: on the hash of one run of their
    inner pieces (the least), or if they have too few for a run on their longest inner piece. Items that have none, of one
    or two pieces, are searched for in every text: they are counted first, and taken in blocks of about `most_short`, one
    after another. Null and empty texts give nothing; repeated rows give rows each.
    """
    items = items.filter("text <> ''").select("item", F.col("text").alias("wanted"), F.array_min(_runs(F.col("text"), cut, True)).alias("run"), _inner(F.col("text"), cut).alias("piece"))
    some, few = spread(texts.select("id", "text")), items.filter("run is null")
    size = F.coalesce(F.sum(F.octet_length("wanted").cast("long") * 4 + 256), F.lit(0))  # with its pieces and their places
    short = F.col("run").isNull() & F.col("piece").isNull()
    counts = items.agg(F.count_if(F.col("run").isNull() & F.col("piece").isNotNull()).alias("pieces"), F.count_if(short).alias("short"), size.alias("size")).first()

    def sought(keys: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
        maybe = written(keys.join(wanted.select("item", key), key).select("item", F.col("id").alias("_id")).distinct(), "maybe")
        maybe = F.broadcast(maybe) if maybe.count() <= _PAIRS else maybe  # texts then are searched where they lie
        pairs = texts.select("id", "text").join(maybe, F.col("id").eqNullSafe(F.col("_id")))
        return pairs.join(wanted.select(F.col("item").alias("_item"), "wanted"), F.col("item").eqNullSafe(F.col("_item"))).filter(F.contains("text", "wanted")).select("item", "id")

    if counts.size <= _SENT:
        found = [_found_in_tasks(some, items.filter(~short), cut)]
    else:
        found = [sought(some.select("id", F.explode(F.array_distinct(_runs(F.col("text"), cut, False))).alias("run")), items.filter("run is not null"), "run")]
        if counts.pieces:
            found.append(sought(some.select("id", F.explode(F.array_distinct(F.split("text", cut))).alias("piece")), few.filter("piece is not null"), "piece"))
    if counts.short:
        blocks = -(-counts.short // most_short)
        for i in range(blocks):
            block = F.broadcast(items.filter(short & (F.pmod(F.xxhash64("item", "wanted"), F.lit(blocks)) == i)))  # of a counted size
            found.append(texts.join(block, F.contains(texts["text"], F.col("wanted"))).select("item", "id"))
    return reduce(DataFrame.unionByName, found)
