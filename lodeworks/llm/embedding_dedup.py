"""Near-duplicate vectors by sorted projection passes: random bit strings, neighbour windows, union of verified pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, components, whole_groups

COSINE = 0.98
_BITS = 48
_BLOCK = 4096
#: The most passes of one turn; turns are repeated while they join components.
_PASSES = 96


def passes_for(largest: int, window: int, cosine: float, miss: float = 1e-3, spread: float = 1.0) -> int:
    """How many sorted passes find a pair at the threshold but for `miss`, when `largest` vectors share a label.

    Two vectors at an angle a agree on a random bit with 1 - a / pi; agreeing on the bits that single out window / 2
    of the vectors, they are within the window. spread: the mean square of the vectors' distances to their mean, from
    which they are hashed; the less it is, the wider is the angle of a pair seen from there. It counts as no less than
    1 - cosine: below it the label's vectors link with their mean's surroundings, and so with one another.
    """
    bits = max(0.0, math.log2(max(2.0 * largest / window, 1.0)))
    seen = max(-1.0, 1 - (1 - cosine) / max(min(spread, 1.0), 1 - cosine))
    found = (1 - math.acos(seen) / math.pi) ** bits
    return 4 if found > 0.999 else max(4, math.ceil(math.log(miss) / math.log(1 - found)))


def _means(nodes: DataFrame, window: int, cosine: float, kind: str) -> DataFrame:
    """(label, width, mean, n, passes): the mean of each label's vectors, their number, and the passes that its spread asks for.

    Tasks sum what they hold; the partial sums of a label, one or few from each task, are added in one row's fold.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[int, int], list] = {}
            for label, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault((label, len(raw)), [0, 0.0])
                own[0], own[1] = own[0] + 1, own[1] + units_of([raw], kind)[0]
            columns = list(zip(*((lab, width, n, total.tolist()) for (lab, width), (n, total) in sums.items()), strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["label", "width", "n", "total"])

    sums = nodes.select("label", "raw").mapInArrow(partial, "label long, width long, n long, total array<double>")
    placed = sums.select("label", "width", "n", F.posexplode("total").alias("place", "x"))
    each = placed.groupBy("label", "width", "place").agg((F.sum("x") / F.sum("n")).alias("x"), F.sum("n").alias("n"))
    whole = each.groupBy("label", "width").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("mean"),
        F.max("n").alias("n"),
        (1 - F.sum(F.col("x") * F.col("x"))).alias("spread"),
    )

    @F.udf("int")
    def passes(n: int, spread: float) -> int:
        return min(_PASSES, passes_for(n, window, cosine, spread=spread))

    return whole.select("label", "width", "mean", "n", passes("n", "spread").alias("passes"))


def raw_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, raw binary, a, b): vectors as the numbers they are given in (single or double floats), and 128 bits of
    them; raw is null where a vector links with nothing."""
    kind = _kind(vectors)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype(kind)  # nulls inside become NaN
            good, some = np.isfinite(values), values != 0
            out: list[bytes | None] = []
            for lo, hi, there in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lists.is_valid().to_pylist(), strict=True):
                out.append(values[lo:hi].tobytes() if there and hi > lo and good[lo:hi].all() and some[lo:hi].any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "raw"])

    wide = "array<float>" if kind == "<f4" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast(wide))
    return rows.mapInArrow(each, "vec_id long, label long, raw binary").withColumns({"a": F.xxhash64("raw"), "b": F.xxhash64(F.lit(1), "raw")})


def _kind(vectors: DataFrame) -> str:
    return "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"


def units_of(raws: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one width over their lengths, in double precision; scaled first, so that very large or small ones neither
    overflow nor vanish."""
    x = np.frombuffer(b"".join(raws), kind).astype(np.float64).reshape(len(raws), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class _Joined:
    """Which nodes of a task are connected by the pairs so far: only a pair that connects more leaves it."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, n: int) -> int:
        while (m := self.up.get(n, n)) != n:
            self.up[n] = self.up.get(m, m)
            n = m
        return n

    def new(self, a: list[int], b: list[int]) -> list[tuple[int, int]]:
        out = []
        for x, y in zip(a, b, strict=True):
            i, j = self.top(x), self.top(y)
            if i != j:
                self.up[max(i, j)] = min(i, j)
                out.append((min(x, y), max(x, y)))
        return out


_SORTED = ["pass", "width", "label", "bits", "node"]


def _near(keys: np.ndarray, node: np.ndarray, unit: np.ndarray, first: int, window: int, cosine: float, joined: _Joined) -> list[tuple[int, int]]:
    """Pairs of rows at most `window` places apart, the later one at place `first` or behind it, of equal keys (pass and
    label) and a cosine that suffices, less those that connect nothing new."""
    out: list[tuple[int, int]] = []
    for shift in range(1, min(window, len(node) - 1) + 1):
        later = np.arange(max(first, shift), len(node))
        later = later[(keys[later] == keys[later - shift]).all(axis=1)]
        near = later[np.einsum("ij,ij->i", unit[later], unit[later - shift]) >= cosine]
        out += joined.new(node[near - shift].tolist(), node[near].tolist())
    return out


_FOUND = "a long, b long, border int, side int, place int, pass int, width int, label long, node long, raw binary"


def _links(nodes: DataFrame, means: DataFrame, window: int, seed: list[int], cosine: float, kind: str, scratch: Scratch, turn: int) -> DataFrame:
    """(a, b): links between nodes found by sorted passes, as many as connect them.

    Every node goes once for each of its label's passes to a place in the order of (pass, label, bits, node), in one range
    partitioning; vectors are hashed from their label's mean, so that a common direction spends no bits. A task compares its
    rows within the window as they come, and hands on its first and last `window` rows, which are compared with those of the
    partitions beside it. Neither ranks nor copies of the sorted rows are written.
    """
    top, rows = means.agg(F.coalesce(F.max("passes"), F.lit(4)), F.coalesce(F.sum(F.col("n") * F.col("passes")), F.lit(0))).first()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(_BITS, dtype=np.int64)[::-1]
        for batch in batches:
            raws = batch.column(2).to_pylist()
            for width in {len(r) for r in raws}:
                own = np.array([i for i, r in enumerate(raws) if len(r) == width])
                x = units_of([raws[i] for i in own], kind) - np.array(batch.column(3).take(pa.array(own)).to_pylist())
                if width not in planes:
                    planes[width] = np.random.default_rng([*seed, width]).normal(size=(top, x.shape[1], _BITS))
                asked, some = batch.column(4).to_numpy()[own], batch.select(["node", "label", "raw"]).take(pa.array(own))
                for p in range(int(asked.max())):
                    here = np.flatnonzero(asked > p)
                    bits = (x[here] @ planes[width][p] > 0).astype(np.int64) @ weights
                    columns = [pa.array(np.full(len(here), p, np.int32)), pa.array(np.full(len(here), width, np.int32)), pa.array(bits)]
                    yield pa.RecordBatch.from_arrays([*columns, *some.take(pa.array(here)).columns], ["pass", "width", "bits", "node", "label", "raw"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        joined = _Joined()
        carried: list[tuple] = []  # the last rows, up to the window: pass, width, label, node, raw
        head: list[tuple] = []
        for batch in batches:
            for at in range(0, len(batch), _BLOCK):
                some = list(zip(*(batch.column(c).slice(at, _BLOCK).to_pylist() for c in ("pass", "width", "label", "node", "raw")), strict=True))
                head += some[: window - len(head)]
                pairs = _of_rows(carried + some, len(carried), window, cosine, kind, joined)
                carried = (carried + some)[-window:]
                place += len(some)
                yield _found(pairs, [])
        borders = [(part - 1, 1, i, *r) for i, r in enumerate(head)] + [(part, 0, i, *r) for i, r in enumerate(carried)]
        yield _found([], borders)

    n_parts = max(1, min(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // (64 * window)))
    centred = nodes.withColumn("width", F.length("raw").cast("long")).join(means, ["label", "width"])
    keyed = centred.select("node", "label", "raw", "mean", "passes").mapInArrow(keys, "pass int, width int, bits long, node long, label long, raw binary")
    ordered = keyed.repartitionByRange(n_parts, *_SORTED).sortWithinPartitions(*_SORTED)
    found = scratch.table(ordered.mapInArrow(compare, _FOUND), f"found-{turn}")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, 1):
            rows = list(zip(*(table[c].to_pylist() for c in ("side", "pass", "width", "label", "node", "raw")), strict=True))
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
                before = [r[1:] for r in rows[lo:hi] if r[0] == 0]
                behind = [r[1:] for r in rows[lo:hi] if r[0] == 1]
                yield _found(_of_rows(before + behind, len(before), window, cosine, kind, _Joined()), [])

    borders = found.filter("border is not null").repartition("border").sortWithinPartitions("border", "side", "place")
    pairs = borders.select("border", "side", "pass", "width", "label", "node", "raw").mapInArrow(across, _FOUND)
    return found.filter("a is not null").select("a", "b").unionByName(pairs.select("a", "b"))


def _of_rows(rows: list[tuple], first: int, window: int, cosine: float, kind: str, joined: _Joined) -> list[tuple[int, int]]:
    """_near() of sorted rows (pass, width, label, node, raw), width by width."""
    out: list[tuple[int, int]] = []
    widths = np.array([r[1] for r in rows])
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        some = [rows[i] for i in own]
        out += _near(np.array([(r[0], r[2]) for r in some]), np.array([r[3] for r in some]), units_of([r[4] for r in some], kind), int((own < first).sum()), window, cosine, joined)
    return out


def _found(pairs: list[tuple[int, int]], borders: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _FOUND.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.int64(), pa.int64(), pa.binary()]
    rows = [(*p, *[None] * 8) for p in pairs] + [(None, None, *b) for b in borders]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _degrees(nodes: DataFrame, linked: DataFrame, cosine: float, kind: str, largest: int = 8192) -> DataFrame:
    """(node, links): for each node of a component its exact links to the component's other rows, copies counted.

    Components of more than `largest` nodes are dealt into parts; each pair of parts is compared in a task of its own
    with blocks of a matrix product, and only sums leave it.
    """
    members = nodes.join(linked, "node").select("node", "component", "label", "copies", "raw")
    size = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / largest).cast("int").alias("parts"))
    dealt = members.join(size, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.select("component", "node", "label", "copies", "raw", "own", other.alias("other"), F.col("parts"))
    dealt = dealt.withColumn("part", F.least("own", "other") * F.col("parts") + F.greatest("own", "other"))
    dealt = dealt.withColumn("single", F.col("own") == F.col("other"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, 2):
            raws = table["raw"].to_pylist()
            node, copies, own, label, single = (table[c].to_numpy(zero_copy_only=False) for c in ("node", "copies", "own", "label", "single"))
            links = np.zeros(len(node), np.int64)
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=True):
                x = units_of(raws[lo:hi], kind)
                for at in range(0, hi - lo, 1024):
                    close = x[at : at + 1024] @ x.T >= cosine
                    close &= label[lo + at : min(lo + at + 1024, hi), None] == label[lo:hi]
                    if single[lo]:
                        close[np.arange(len(close)), np.arange(at, at + len(close))] = False
                    else:  # two parts: what is within one is counted in its own group
                        close &= own[lo + at : min(lo + at + 1024, hi), None] != own[lo:hi]
                    links[lo + at : lo + at + len(close)] = close @ copies[lo:hi]
            yield pa.RecordBatch.from_arrays([table["node"].combine_chunks(), pa.array(links)], ["node", "links"])

    dealt = dealt.select("component", "part", "node", "label", "copies", "raw", "own", "single")
    counted = dealt.repartition("component", "part").sortWithinPartitions("component", "part").mapInArrow(each, "node long, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, window: int = 32, seed: int = 20240607) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label); other columns are ignored.

    Vectors link if their labels are equal and not null and their cosine, in double precision, is `cosine` or more.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do those of
    different lengths. Equal vectors of a label are one node with copies; passes of sorted random projections, as
    many as the label's size and spread ask for, find pairs of nodes within a window; they are repeated with other
    projections until none joins two components. The pairs found make components, and within each component all links are
    counted exactly. component_id is the smallest vec_id reachable, kept marks the row with it. Repeated rows count as
    vectors of their own; a row without vec_id takes part, and has the smallest id of its component, if any.
    """
    kind, scratch = _kind(vectors), Scratch(vectors.sparkSession, "vectors")
    raws = raw_vectors(vectors)
    usable = raws.filter("label is not null and raw is not null")
    grouped = usable.groupBy("label", "raw").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("a").alias("a"), F.first("b").alias("b"))
    nodes = scratch.table(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes", "lz4")
    means = scratch.table(_means(nodes, window, cosine, kind), "means")
    linked, turn = None, 0
    while True:  # each turn but the last joins components, so it ends
        found = scratch.table(_links(nodes, means, window, [seed, turn], cosine, kind, scratch, turn).distinct(), f"pairs-{turn}")
        scratch.drop(f"found-{turn}")
        if linked is not None:
            of_a, of_b = (linked.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("a", "b"))
            apart = found.join(of_a, "a", "left").join(of_b, "b", "left").filter("of_a is null or of_b is null or of_a <> of_b").select("a", "b")
            found = scratch.table(apart, f"apart-{turn}")
            if not found.take(1):
                break
            found = found.unionByName(linked.select(F.col("node").alias("a"), F.col("component").alias("b")))
        elif not found.take(1):
            linked = scratch.table(components(found), f"components-{turn}")
            break
        linked, turn = scratch.table(components(found), f"components-{turn}"), turn + 1
    links = _degrees(nodes, linked, cosine, kind)
    least = nodes.drop("raw").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = least.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = least.join(smallest, "component").join(links, "node", "left")
    placed = placed.select(F.col("label").alias("of"), F.col("a").alias("h1"), F.col("b").alias("h2"), "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    placed = scratch.table(placed, "placed")
    scratch.drop_all_but("placed")
    usable = F.col("raw").isNotNull()
    keys = raws.select("vec_id", "label", "a", "b", usable.alias("usable"))
    same = (keys["label"] == placed["of"]) & (keys["a"] == placed["h1"]) & (keys["b"] == placed["h2"]) & keys["usable"]
    joined = keys.join(placed, same, "left")
    component = F.when(F.col("of").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
