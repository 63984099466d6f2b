"""SimHash near-duplicates by anchor points: covering codes as anchors, replication within radius plus threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import components, cut

#: A-Z to a-z, all other bytes as they are.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SEED, _STEP = 42, 1 << 17
#: Two fingerprints at 4 or fewer bits differ by at most 1, 1 or 0 bits in one of these blocks (else by 2 + 2 + 1).
#: (first bit, width, bits of a Hamming code, threshold): the anchors of a block are the code times the free bits.
_BLOCKS = ((0, 24, 15, 1), (24, 24, 15, 1), (48, 16, 0, 0))
MAX_BITS = 4


def fingerprint(text: bytes, words: int = 4) -> int:
    """The 64-bit SimHash of a UTF-8 text: a bit is 1 if over half of the shingles' XXH64 have it."""
    joined = b" ".join(text.translate(_LOWER).split())
    if not joined:
        return 0
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.append(0, blanks + 1), np.append(blanks, len(joined))
    if len(starts) > words:
        starts, ends = starts[: 1 - words], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed, bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _STEP):
        spans = zip(starts[at : at + _STEP].tolist(), ends[at : at + _STEP].tolist(), strict=True)
        some = np.array([hashed(joined[a:b], _SEED) for a, b in spans], "<u8")
        bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, copy, fp) of every row, copy a hash of its text; a null text counts as empty and has fingerprint zero."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t or b"", words) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "copy", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("copy"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(each, "doc_id long, copy long, fp long")


def _syndromes() -> np.ndarray:
    values, s = np.arange(1 << 15), np.zeros(1 << 15, np.int64)
    for bit in range(15):
        s ^= np.where(values >> bit & 1, bit + 1, 0)
    return s


def anchors(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(anchor, rows, home) for fingerprints: each one's own anchor, and all within covering radius plus threshold.

    A block of 24 bits has the perfect Hamming code of 15 bits times all words of its 9 free bits as anchors:
    covering radius 1, threshold 1, so anchors at distance 2 or less. The block of 16 bits has all words: radius 0.
    """
    rows = np.arange(len(values))
    syndrome_of = _syndromes()
    for tag, (first, width, coded, threshold) in enumerate(_BLOCKS):
        part = (values >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)
        mark = tag << 40
        if not coded:
            yield part | mark, rows, True
            continue
        word, free = part & ((1 << coded) - 1), part >> coded
        syndrome = syndrome_of[word]
        code = np.where(syndrome > 0, word ^ (1 << np.maximum(syndrome - 1, 0)), word)
        pack = lambda c, v, mark=mark, coded=coded: c | v << coded | mark
        yield pack(code, free), rows, True
        reach = threshold + 1
        for i in range(width - coded):  # one free bit away, the code word at 1 or 0
            yield pack(code, free ^ (1 << i)), rows, False
        exact, near = np.flatnonzero(syndrome == 0), np.flatnonzero(syndrome > 0)
        for i in range(width - coded):  # two free bits away, on a code word
            for j in range(i + 1, width - coded):
                if reach >= 2:
                    yield pack(code[exact], free[exact] ^ (1 << i | 1 << j)), exact, False
        for i in range(1, coded + 1):  # code words two bits away: pairs of positions whose sum is the syndrome
            other = syndrome[near] ^ i
            some = near[other > i]
            pair = syndrome[some] ^ i
            yield pack(word[some] ^ (1 << (i - 1)) ^ (1 << (pair - 1)), free[some]), some, False


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(values), 4096):
            some = values[at : at + 4096]
            parts = list(anchors(some.view(np.uint64)))
            keys = np.concatenate([k for k, _, _ in parts])
            rows = np.concatenate([r for _, r, _ in parts])
            home = np.concatenate([np.full(len(r), h) for _, r, h in parts])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(some[rows]), pa.array(home)], ["anchor", "fp", "home"])


def _linked(values: np.ndarray, edges: list[np.ndarray]) -> None:
    """Breadth first over one group: each value is compared with those not yet reached, so near copies cost little."""
    left = values
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            one = stack.pop()
            near = np.bitwise_count(left ^ one) <= MAX_BITS
            if near.any():
                hits, left = left[near], left[~near]
                edges.append(np.stack([np.full(len(hits), one), hits]))
                stack.extend(hits)


def _compare(keys: np.ndarray, values: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Links (2 x n) of whole groups, sorted by key; small groups by shifted comparison, larger ones breadth first."""
    starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    sizes = np.diff(np.append(starts, len(keys)))
    homes = np.add.reduceat(home.astype(np.int64), starts) if len(starts) else sizes
    edges: list[np.ndarray] = []
    small = np.repeat((sizes <= 24) & (sizes > 1) & (homes > 0), sizes)
    group = np.repeat(np.arange(len(starts)), sizes)
    v, g, h = values[small], group[small], home[small]
    for shift in range(1, 24):
        if len(v) <= shift:
            break
        same = np.flatnonzero((g[shift:] == g[:-shift]) & (h[shift:] | h[:-shift]))
        if not len(same) and not (g[shift:] == g[:-shift]).any():
            break
        near = same[np.bitwise_count(v[same + shift] ^ v[same]) <= MAX_BITS]
        if len(near):
            edges.append(np.stack([v[near], v[near + shift]]))
    for k in np.flatnonzero((sizes > 24) & (homes > 0)):
        _linked(values[starts[k] : starts[k] + sizes[k]], edges)
    return np.concatenate(edges, axis=1) if edges else np.empty((2, 0), np.uint64)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (anchor, part); the last group of a batch waits for the next batch."""
    rest = None
    for batch in _then_none(batches):
        if batch is not None:
            k = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            v = batch.column(2).to_numpy().view(np.uint64)
            h = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            if rest is not None:
                k, v, h = np.concatenate([rest[0], k]), np.concatenate([rest[1], v]), np.concatenate([rest[2], h])
            if not len(k):
                continue
            whole = np.flatnonzero((k != k[-1]).any(axis=1))
            end = int(whole[-1]) + 1 if len(whole) else 0
            rest, k, v, h = (k[end:], v[end:], h[end:]), k[:end], v[:end], h[:end]
        elif rest is not None:
            k, v, h = rest
        else:
            return
        if len(k):
            pairs = _compare(k, v, h).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(distinct: DataFrame, largest: int = 20_000) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (column fp, distinct) at MAX_BITS or fewer bits.

    Within a group that shares an anchor only a spanning forest is returned, never all pairs. Groups of more than
    `largest` rows are dealt into parts, and each pair of parts is compared in a task of its own.
    """
    copies = distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long, home boolean")
    hot = copies.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > largest)
    hot = hot.select("anchor", F.ceil(F.col("n") / largest).cast("int").alias("parts"))
    dealt = copies.join(hot, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.select("anchor", "fp", "home", "parts", own.alias("own"), other.alias("other"))
    part = (F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).cast("long")
    grouped = dealt.select("anchor", part.alias("part"), "fp", "home").repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return grouped.mapInArrow(_groups, "a long, b long")


def _placed(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints (doc_id, copy, fp) of all rows, and the component of each distinct one (fp, component, component_id)."""
    prints = cut(fingerprints(docs, words), "simhash-prints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    linked = components(links(nodes)).withColumnRenamed("node", "fp")
    placed = nodes.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints, cut(placed.join(least, "component").select("fp", "component", "component_id"), "simhash-placed")


def near_duplicates(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) for every row of docs (doc_id, text); other columns are ignored.

    Fingerprints link at 4 or fewer differing bits; component_id is the smallest doc_id reachable, itself included;
    kept marks the document with that id. Null and empty texts have fingerprint zero and link like any other. Rows
    without doc_id take part and get the smallest id of their component, if any; exact repeats of a row all stay.
    """
    prints, placed = _placed(docs, words)
    return prints.join(placed, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def keep_representatives(docs: DataFrame, words: int = 4) -> DataFrame:
    """One row of each component of near-duplicates, of the smallest doc_id; all columns stay as they are.

    Rows without doc_id come after all others; of rows with one id, the text of the least hash stays, and of equal
    rows one.
    """
    prints, placed = _placed(docs, words)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")).alias("first")
    kept = prints.join(placed, "fp").groupBy("component").agg(first).select(F.col("first.doc_id").alias("kept_id"), F.col("first.copy").alias("kept_copy"))
    kept = cut(kept, "simhash-kept")
    id_, copy = docs["doc_id"].cast("long"), F.xxhash64(docs["text"])
    chosen = docs.join(kept, id_.eqNullSafe(F.col("kept_id")) & (copy == F.col("kept_copy")), "left_semi")
    if prints.groupBy("doc_id", "copy").count().filter("count > 1").isEmpty():
        return chosen
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*docs.columns))
    return chosen.select(F.struct(*docs.columns).alias("row"), F.row_number().over(order).alias("n")).filter("n = 1").select("row.*")
