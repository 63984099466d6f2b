"""Benchmark decontamination: exact hits of error-budget-plus-one pieces, verified by Myers' bit-parallel distance."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Errors (characters put in, left out or changed) allowed, as a share of an item's length.
ERROR_RATE = 0.1


def normal(text: str) -> str:
    """Lower case, and white space as one blank."""
    return " ".join(text.lower().split())


@dataclass
class Node:
    """A part [lo, hi) of an item with its own error budget; leaves have none and are looked up exactly."""

    lo: int
    hi: int
    budget: int
    up: Node | None
    masks: dict[str, int]


def pieces(text: str, budget: int) -> list[Node]:
    """The budget + 1 leaves of a tree of halves.

    If a part matches with its budget b, one half matches with half of what b - 1 leaves; so from any match of the
    whole a path of matches leads to a leaf that occurs exactly.
    """
    leaves, todo = [], [Node(0, len(text), min(budget, len(text) - 1), None, {})]
    while todo:
        node = todo.pop()
        if node.budget == 0:
            leaves.append(node)
            continue
        left, right = (node.budget - 1 + 1) // 2, (node.budget - 1) // 2
        middle = node.lo + (node.hi - node.lo) * (left + 1) // (left + right + 2)
        todo += [Node(node.lo, middle, left, node, {}), Node(middle, node.hi, right, node, {})]
    for leaf in leaves:
        node = leaf.up
        while node is not None and not node.masks:
            for i, c in enumerate(text[node.lo : node.hi]):
                node.masks[c] = node.masks.get(c, 0) | 1 << i
            node = node.up
    return leaves


def distance(masks: dict[str, int], length: int, text: str, budget: int) -> tuple[int, int] | None:
    """The least edit distance of a pattern to any part of text, and the first end where it is reached; None if over budget."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score, best = full, 0, length, None
    get = masks.get
    for at, c in enumerate(text):
        eq = get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(horizontal | plus)
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1, down << 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        if score <= budget and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


class Matcher:
    """All items of one slice; finds which of them a text contains within their budgets."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = ERROR_RATE):
        self.texts: list[str] = []
        self.ids: list[list[int | None]] = []
        place: dict[str, int] = {}
        leaves: dict[str, list[tuple[int, Node]]] = defaultdict(list)
        for item, text in sorted(items, key=lambda x: (x[0] is None, x)):
            text = normal(text)
            if not text:
                continue
            if text in place:
                self.ids[place[text]].append(item)
                continue
            k = place[text] = len(self.texts)
            self.texts.append(text)
            self.ids.append([item])
            for leaf in pieces(text, int(rate * len(text))):
                leaves[text[leaf.lo : leaf.hi]].append((k, leaf))
        self.automaton = ahocorasick.Automaton()
        for piece, found in leaves.items():
            self.automaton.add_word(piece, (len(piece), found))
        if leaves:
            self.automaton.make_automaton()
        self.any = bool(leaves)

    def climb(self, text: str, start: int, end: int, leaf: Node) -> tuple[int, int] | None:
        """Follows a leaf's exact hit up its tree; the distance of the whole item there and its end in text."""
        node, best = leaf, (0, end)
        while node.up is not None:
            node = node.up
            lo = max(0, start - (leaf.lo - node.lo) - node.budget)
            window = text[lo : end + (node.hi - leaf.hi) + node.budget]
            found = distance(node.masks, node.hi - node.lo, window, node.budget)
            if found is None:
                return None
            best = (found[0], lo + found[1])
        return best

    def find(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item, distance, length, end in the normal text) of each item's nearest, then first occurrence, by item."""
        best: dict[int, tuple[int, int]] = {}
        if not self.any:
            return []
        text = normal(text)
        done: dict[int, set[int]] = {}
        for last, (size, found) in self.automaton.iter(text):
            end = last + 1
            for k, leaf in found:
                item, begin = self.texts[k], end - size - leaf.lo
                if k in best and best[k][0] == 0 or begin in done.get(k, ()):
                    continue
                if begin >= 0 and text.startswith(item, begin):
                    best[k] = (0, begin + len(item))
                    continue
                got = self.climb(text, end - size, end, leaf)
                if got is not None:
                    done.setdefault(k, set()).add(begin)
                    best[k] = min(best.get(k, got), got)
        found = [(item, d, len(self.texts[k]), end) for k, (d, end) in best.items() for item in self.ids[k]]
        return sorted(found, key=lambda x: (x[0] is None, x[0] or 0, x))


_built: dict[str, Matcher] = {}


def _matcher(name: str, items: list[tuple[int | None, str]], rate: float) -> Matcher:
    """The matcher of a slice, built once by each worker and kept until the next slice."""
    if name not in _built:
        _built.clear()
        _built[name] = Matcher(items, rate)
    return _built[name]


def slices(items: DataFrame, most_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in lists of about most_bytes of text at most, one after another, so that each may be sent to every task and
    no more than one is held."""
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-total // most_bytes))
    own = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        yield [(r.item_id, r.text) for r in (rows if n == 1 else rows.filter(own == i)).toLocalIterator()]


def overlaps(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, most_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, item_id, distance, length, end) for each document and benchmark item that it contains.

    docs: doc_id, text; items: item_id, text; other columns are ignored. A document contains an item if some part of
    its text is within rate times the item's length of it by edit distance, both in lower case with white space as one
    blank. distance is the least one, length the item's, end where the nearest occurrence ends (the first, of ties) in
    the document's normal text. Null and empty texts contain nothing, null and empty items are in nothing; repeated rows
    are matched each, and rows of either without an id have a null one. More than most_bytes of items are matched slice by
    slice, each against all documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    names, kinds = ["doc_id", "item_id", "distance", "length", "end"], "doc_id long, item_id long, distance int, length int, end long"

    def matched(some: list[tuple[int | None, str]]) -> DataFrame:
        sent, name = spark.sparkContext.broadcast(some), uuid.uuid4().hex

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, sent.value, rate)
            for batch in batches:
                out = [(doc, *found) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for found in matcher.find(text or "")]
                columns = list(zip(*out, strict=True)) or [()] * 5
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        return rows.mapInArrow(each, kinds)

    return reduce(DataFrame.unionByName, map(matched, slices(items, most_bytes)))


def clean(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, most_bytes: int = 4 << 20) -> DataFrame:
    """The rows of docs that contain no benchmark item, by the rules of overlaps(); all columns stay as they are.

    Documents of null and empty texts stay, items without an id count like any other.
    """
    spark, at, names, schema = docs.sparkSession, docs.columns.index("text"), docs.columns, docs.schema
    for some in slices(items, most_bytes):
        sent, name = spark.sparkContext.broadcast(some), uuid.uuid4().hex

        def each(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, sent.value, rate)
            for batch in batches:
                keep = [not matcher.find(t or "") for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep, pa.bool_())).columns, names)

        docs = docs.mapInArrow(each, schema)
    return docs
