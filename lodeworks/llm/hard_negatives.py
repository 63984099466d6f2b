"""Hard negatives by an STR-packed R-tree: boxes give intervals of inner products, a best-first queue prunes by them."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch

#: Vectors of a page, boxes of an inner node, and vectors of a tree, which is one row of a table.
_PAGE = 64
_FAN = 16
_TREE = 1 << 13
#: Bytes of anchors that are sent to all tasks at once, and anchors whose intervals a task holds at once.
_SENT = 1 << 25
_HELD = 256
_LONG = 2**63 - 1


def _integers(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, width, head, square, x) of the vectors that take part: floor(scale * component), a double, in as few
    bytes as hold all of a vector's components; head: the first one; square: the product with itself."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = np.floor(lists.values.to_numpy(zero_copy_only=False).astype(float) * scale)  # nulls inside become NaN
            out: list[tuple[float, int, bytes] | None] = []
            for a, b, there in zip(*(lists.offsets.to_numpy()[i : len(lists) + i].tolist() for i in (0, 1)), lists.is_valid().to_pylist(), strict=True):
                own = values[a:b]
                if not there or not np.isfinite(own).all():
                    out.append(None)
                    continue
                most = np.abs(own).max(initial=0)
                kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
                out.append((float(own[0]) if b > a else 0.0, int(_products(own[None], own)[0]), own.astype(kind).tobytes()))
            good = pa.array([x is not None for x in out])
            ids, labels = (batch.column(i).filter(good) for i in (0, 1))
            widths = pa.array(np.diff(lists.offsets.to_numpy()).astype(np.int64)).filter(good)
            made = [pa.array([x[i] for x in out if x is not None], t) for i, t in enumerate((pa.float64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([ids, labels, widths, *made], ["vec_id", "label", "width", "head", "square", "x"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>"))
    return rows.filter("vec_id IS NOT NULL AND label IS NOT NULL").mapInArrow(pack, "vec_id long, label long, width long, head double, square long, x binary")


def _products(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """The inner products of whole numbers, exact; beyond a long they count as its ends."""
    if len(anchor) * np.abs(rows).max(initial=0) * np.abs(anchor).max(initial=0) < 2**53:
        return (rows @ anchor).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(anchor.tolist(), row, strict=True)) for row in rows.tolist()]
    return np.array([max(-_LONG - 1, min(_LONG, s)) for s in exact], np.int64)


def _matrix(raws: list[bytes], width: int) -> np.ndarray:
    kinds = {0: "<i2", 2: "<i2", 4: "<i4", 8: "<f8"}
    if len({len(r) for r in raws}) <= 1:
        return np.frombuffer(b"".join(raws), kinds[len(raws[0]) // max(width, 1) if raws else 0]).reshape(len(raws), width)
    return np.stack([np.frombuffer(r, kinds[len(r) // width]).astype(float) for r in raws])


def str_order(x: np.ndarray, page: int = _PAGE) -> np.ndarray:
    """The order of Sort-Tile-Recursive: sorted by a coordinate, cut into slabs of whole pages, and so on in each slab by the
    next one, with as many slabs each time as make the pages with the coordinates that are left. Wide ones come first."""
    axes = np.argsort(-np.ptp(x, axis=0), kind="stable") if len(x) else np.zeros(0, int)

    def tile(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        pages = -(-len(rows) // page)
        if pages <= 1 or depth == len(axes):
            return [rows]
        slabs = math.ceil(pages ** (1 / (len(axes) - depth)) - 1e-9)
        rows = rows[np.argsort(x[rows, axes[depth]], kind="stable")]
        size = -(-pages // slabs) * page
        return [part for lo in range(0, len(rows), size) for part in tile(rows[lo : lo + size], depth + 1)]

    return np.concatenate(tile(np.arange(len(x)), 0))


def _forest(rows: DataFrame) -> DataFrame:
    """(label, width, ids, x): trees of up to 8,192 vectors of one label and width, in STR order.

    The first cut is a range shuffle by label, width and first component, which splits a label of many vectors over tasks.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["label", "width", "head", "vec_id"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(group: tuple[int, int], ids: list[int], raws: list[bytes]) -> pa.RecordBatch:
            x = _matrix(raws, group[1])
            order = str_order(x)
            packed = [[group[0]], [group[1]], [np.array(ids, np.int64)[order].tobytes()], [np.ascontiguousarray(x[order]).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(packed, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["label", "width", "ids", "x"])

        now: tuple[int, int] | None = None
        ids: list[int] = []
        raws: list[bytes] = []
        for batch in batches:
            for vec_id, label, width, _, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and ((label, width) != now or len(ids) == _TREE):
                    yield row(now, ids, raws)
                    ids, raws = [], []
                now = (label, width)
                ids.append(vec_id)
                raws.append(raw)
        if now is not None:
            yield row(now, ids, raws)

    return rows.drop("square").repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(build, "label long, width long, ids binary, x binary")


class Tree:
    """Vectors in pages, and boxes over pages and over boxes, up to one."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x.astype(float)
        self.most = float(np.abs(self.x).max(initial=0))
        step, low, high = _PAGE, self.x, self.x
        self.levels: list[int] = []  # the number of the first box of each level, pages first
        lows, highs, total = [], [], 0
        while not lows or len(low) > 1:
            low, high = (f.reduceat(v, np.arange(0, len(v), step), axis=0) for f, v in ((np.minimum, low), (np.maximum, high)))
            self.levels.append(total)
            lows.append(low)
            highs.append(high)
            total, step = total + len(low), _FAN
        self.low, self.high = np.concatenate(lows), np.concatenate(highs)

    def children(self, box: int) -> range:
        level = int(np.searchsorted(self.levels, box, "right")) - 1
        first = self.levels[level - 1] + (box - self.levels[level]) * _FAN
        return range(first, min(first + _FAN, self.levels[level]))

    def intervals(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest inner product of each anchor with what a box may hold: a coordinate gives its share at one
        end of its side or the other. Where doubles may round, the interval is widened by more than that."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        least, greatest = up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T
        bound = anchors.shape[1] * self.most * float(np.abs(anchors).max(initial=0))
        slack = 0.0 if bound < 2**52 else bound * 2.0**-40
        return least - slack, greatest + slack

    def products(self, page: int, anchor: np.ndarray) -> np.ndarray:
        return _products(self.x[page * _PAGE : (page + 1) * _PAGE], anchor)


@dataclass
class Search:
    """The first k of each query's scores so far: an anchor's vector and a window that the score must be in."""

    k: int
    best: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    opened: int = 0

    def through(self, tree: Tree, anchor: np.ndarray, least: list[float], greatest: list[float], queries: list[tuple[int, int, int]]) -> None:
        """Searches a tree for the queries (number, low, high) of one anchor. Boxes wait in a queue by the best score that
        they may hold within the window; the search ends where that is less than the kth score found. Boxes outside of the
        window are never queued. Equal scores are looked at, as ties go to the smaller id."""
        known: dict[int, np.ndarray] = {}  # products by page, for all queries of the anchor
        root = len(greatest) - 1
        for number, low, high in queries:
            heap = self.best.setdefault(number, [])
            if greatest[root] < low or least[root] > high:
                continue
            queue = [(-min(greatest[root], high), root)]
            while queue:
                bound, box = heapq.heappop(queue)
                if len(heap) == self.k and -bound < heap[0][0]:
                    break
                if box >= (tree.levels[1] if len(tree.levels) > 1 else len(greatest)):
                    for child in tree.children(box):
                        top = min(greatest[child], high)
                        if top >= low and least[child] <= high and (len(heap) < self.k or top >= heap[0][0]):
                            heapq.heappush(queue, (-top, child))
                    continue
                if box not in known:
                    known[box] = tree.products(box, anchor)
                    self.opened += 1
                scores = known[box]
                floor = max(low, heap[0][0]) if len(heap) == self.k else low
                for i in np.flatnonzero((scores >= floor) & (scores <= high)).tolist():
                    entry = (int(scores[i]), -int(tree.ids[box * _PAGE + i]))
                    if len(heap) < self.k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)


def _first(trees: DataFrame, anchors: DataFrame, k: int, same: bool, scratch: Scratch, name: str) -> DataFrame:
    """(anchor, target, score, vec_id): of each anchor (anchor, label, width, x, windows array<struct<target, low, high>>) and
    window, the first k rows of the same label, or of others, over all trees.

    Anchors go to all tasks in slices of a bounded size, one after another; a task keeps k rows for each query over all
    its trees, and the rows of all tasks are ranked.
    """
    spark = trees.sparkSession
    total = anchors.agg(F.sum(F.length("x") + 32 * F.size("windows") + 32)).first()[0] or 0
    count = max(1, -(-total // _SENT))
    kinds = "anchor long, target long, score long, vec_id long"
    path = f"{scratch.folder}/{name}"
    for i in range(count):
        own = anchors.filter(F.pmod(F.xxhash64("anchor"), F.lit(count)) == i).collect()  # about _SENT bytes
        by_width: dict[int, list] = {}
        for r in own:
            by_width.setdefault(r.width, []).append((r.anchor, r.label, r.x, [tuple(w) for w in r.windows]))
        sent = spark.sparkContext.broadcast(by_width)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for width, rows in sent.value.items():
                groups[width] = (_matrix([r[2] for r in rows], width), np.array([r[1] for r in rows]))
            found = {width: Search(k) for width in groups}
            names: dict[int, list[tuple[int, int]]] = {w: [(r[0], t[0]) for r in rows for t in r[3]] for w, rows in sent.value.items()}
            begins = {w: np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]).tolist() for w, rows in sent.value.items()}
            for batch in batches:
                for label, width, ids, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if width not in groups:
                        continue
                    x, labels = groups[width]
                    wanted = np.flatnonzero((labels == label) == same)
                    if not len(wanted):
                        continue
                    vec_ids = np.frombuffer(ids, np.int64)
                    size = len(raw) // max(len(vec_ids) * width, 1)
                    tree = Tree(vec_ids, np.frombuffer(raw, {0: "<i2", 2: "<i2", 4: "<i4", 8: "<f8"}[size]).reshape(len(vec_ids), width))
                    for lo in range(0, len(wanted), _HELD):
                        held = wanted[lo : lo + _HELD]
                        own_x = x[held].astype(float)
                        least, greatest = (v.tolist() for v in tree.intervals(own_x))
                        for j, at in enumerate(held.tolist()):
                            first = begins[width][at]
                            queries = [(first + n, low, high) for n, (_, low, high) in enumerate(sent.value[width][at][3])]
                            found[width].through(tree, own_x[j], least[j], greatest[j], queries)
            for width, done in found.items():
                rows = [(*names[width][q], score, -minus) for q, heap in done.best.items() for score, minus in heap]
                for lo in range(0, len(rows), 50_000):
                    columns = zip(*rows[lo : lo + 50_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "target", "score", "vec_id"])

        trees.mapInArrow(search, kinds).write.mode("append").option("compression", "zstd").parquet(path)
        sent.unpersist()
    scratch.written[name] = None
    by = Window.partitionBy("anchor", "target").orderBy(F.desc("score"), "vec_id")
    return spark.read.schema(kinds).parquet(path).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, label: Column, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding).

    label: a row's label; anchor: which rows are anchors. Scores are inner products of the integers floor(scale * component);
    higher ones come first, ties by the smaller vec_id. An anchor's positives are its first other rows of its label; for
    each, the first rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score are its
    negatives, in ranks from 1. A positive with none has no row.

    Rows without an id, label or vector, and vectors with null or non-finite components (as given, or times scale) take no
    part. Only vectors of equal width are compared; empty ones have a score of 0 with each other. Repeated rows count each,
    as anchors too. Scores beyond a long count as its ends. Other columns are ignored; no rows give none.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    trees = scratch.table(_forest(_integers(vectors, label, scale)), "trees")
    own = _integers(vectors.filter(anchor), label, scale).withColumn("anchor", F.monotonically_increasing_id())
    anchors = scratch.table(own.drop("head"), "anchors")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("target"), F.lit(-_LONG - 1).alias("low"), F.lit(_LONG).alias("high")))
    near = _first(trees, anchors.withColumn("windows", everything), positives + 1, True, scratch, "near")
    # An anchor is among the rows of its label: it leaves the first ones once, if it is there.
    kept = Window.partitionBy("anchor").orderBy("rank")
    seen = near.join(anchors.select("anchor", F.col("vec_id").alias("own_id"), "square"), "anchor")
    itself = F.when((F.col("vec_id") == F.col("own_id")) & (F.col("score") == F.col("square")), F.col("rank"))
    others = seen.withColumn("self", F.min(itself).over(Window.partitionBy("anchor"))).filter("self IS NULL OR rank <> self")
    others = others.withColumn("place", F.row_number().over(kept)).filter(F.col("place") <= positives)
    first = scratch.table(others.select("anchor", F.col("own_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "place"), "positives")
    # low * p <= 100 * n <= high * p in whole numbers: from the quotient rounded up to the one rounded down.
    p = F.col("positive_score").cast("decimal(38,0)")
    window = F.struct(F.col("positive_score").alias("target"), F.ceil(low * p / 100).cast("long").alias("low"), F.floor(high * p / 100).cast("long").alias("high"))
    wanted = first.withColumn("w", window).filter("w.low <= w.high").groupBy("anchor").agg(F.collect_set("w").alias("windows"))  # at most `positives`
    far = _first(trees, anchors.join(wanted, "anchor"), negatives, False, scratch, "far")
    found = first.join(far.select("anchor", F.col("target").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "positive_score"])
    result = scratch.table(found.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score"), "result")
    scratch.drop_all_but("result")
    return result


def oracle_sql() -> str:
    """All pairs of anchors and rows, each row told apart by a number of its own."""
    return """
WITH v AS (
  SELECT row_number() OVER () AS row, CAST(vec_id AS BIGINT) AS vec_id, [floor(256 * CAST(e AS DOUBLE)) FOR e IN embedding] AS x,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0
), pairs AS (
  SELECT a.row, a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.x, v.x) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.row <> v.row AND len(a.x) = len(v.x)
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT row, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS place
  FROM pairs WHERE same QUALIFY place <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.row, p.place ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives AS p JOIN pairs AS n ON n.row = p.row AND NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
