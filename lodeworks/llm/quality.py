"""Document quality: random Fourier features of text statistics, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, shared_dir

_BYTES = np.arange(256)
_IS = lambda chars: np.isin(_BYTES, np.frombuffer(chars, np.uint8))
#: Classes of bytes whose shares are features.
_CLASSES = np.stack(
    [
        (_BYTES >= 65) & (_BYTES <= 90),
        (_BYTES >= 97) & (_BYTES <= 122),
        (_BYTES >= 48) & (_BYTES <= 57),
        _BYTES >= 128,
        _IS(b" \t\r\x0b\x0c"),
        _IS(b"\n"),
        _IS(b".,;:'\"-"),
        _IS(b"!?"),
        _IS(b"|"),
        _IS(b"#$%&*+=@^~_\\/<>[]{}()`"),
    ]
).astype(float)
N_FEATURES = len(_CLASSES) + 10
THRESHOLD = 0.3


def statistics(text: bytes) -> np.ndarray:
    """Shares of byte classes, lengths, and repetition of words and lines of a whole UTF-8 text."""
    n = len(text)
    if not n:
        return np.zeros(N_FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = _CLASSES @ counts / n
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    m, k = max(len(words), 1), max(len(lines), 1)
    kinds = set(words)
    p = counts[counts > 0] / n
    own = [
        np.log1p(n) / 10,
        np.log1p(len(words)) / 10,
        np.log1p(k) / 5,
        len(kinds) / m,
        np.log1p(len(kinds)) / np.log1p(m),
        np.log1p(sum(map(len, words)) / m),
        np.log1p(max(map(len, words), default=0)) / 5,
        len(set(lines)) / k,
        max(map(len, lines), default=0) / n,
        float(-(p * np.log2(p)).sum()) / 8,
    ]
    return np.concatenate([np.sqrt(shares), own])


@dataclass(frozen=True)
class Model:
    """Standardized statistics to Fourier features to a ridge score to a calibrated probability; of fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    ridge: np.ndarray
    raw: np.ndarray
    level: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = (stats - self.mean) / self.scale
        waves = np.sqrt(2 / len(self.shift)) * np.cos(np.clip(z, -6, 6) @ self.weights + self.shift)
        return np.hstack([waves, np.ones((len(waves), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(stats) @ self.ridge, self.raw, self.level), 0.0, 1.0)


def isotonic(weight: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Nondecreasing levels nearest to `level` in weighted squares, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for w, y in zip(weight.tolist(), level.tolist(), strict=True):
        pools.append([w, y, 1])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            w2, y2, n2 = pools.pop()
            w1, y1, n1 = pools.pop()
            pools.append([w1 + w2, (w1 * y1 + w2 * y2) / (w1 + w2), n1 + n2])
    return np.concatenate([np.full(int(n), y) for _, y, n in pools]) if pools else np.zeros(0)


def _stats_of(batch: pa.RecordBatch, at: int) -> np.ndarray:
    rows = [statistics(t or b"") for t in batch.column(at).to_pylist()]
    return np.array(rows).reshape(-1, N_FEATURES)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, waves: int = 256, gamma: float = 0.05, penalty: float = 1e-3, bins: int = 512, parts: int = 5) -> Model:
    """Fits on rows of labels (doc_id, quality) that aren't held out and have a quality of 0 or 1.

    At most about sample_rows labelled rows are used, those with the least hash of their id: a documented bound.
    Statistics, normal equations (summed by partition) and calibration counts are made on Spark; the driver gets
    one matrix of fixed size for each of 8 partitions and at most `bins` counts.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("y"))
    known = known.filter("y in (0, 1)").filter(~held_out(F.col("doc_id"), parts))
    total = known.count()
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1_000_003)) / 1_000_003.0
    known = known.filter(draw < min(1.0, sample_rows / max(total, 1)))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _stats_of(batch, 0)
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    joined = texts.join(F.broadcast(known), "doc_id").select("text", "y")  # at most about sample_rows pairs of numbers
    sample = joined.mapInArrow(measure, "x array<double>, y double").repartition(8).checkpoint()
    moments = [F.struct(F.avg(F.col("x")[i]), F.stddev_pop(F.col("x")[i])) for i in range(N_FEATURES)]
    row = sample.agg(F.count(F.lit(1)), F.avg("y"), *moments).first()
    draws = np.random.default_rng(20240607)
    size = {"weights": draws.normal(0, np.sqrt(2 * gamma), (N_FEATURES, waves)), "shift": draws.uniform(0, 2 * np.pi, waves)}
    if not row[0]:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), **size, ridge=np.zeros(waves + 1), raw=np.zeros(1), level=np.full(1, 0.5))
    mean = np.array([m[0] for m in row[2:]])
    scale = np.array([m[1] if m[1] and m[1] > 1e-9 else 1.0 for m in row[2:]])
    blank = Model(mean, scale, **size, ridge=np.zeros(waves + 1), raw=np.zeros(1), level=np.zeros(1))
    base = float(row[1])

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((waves + 1, waves + 2))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist()).reshape(-1, N_FEATURES)
            y = batch.column(1).to_numpy() - base
            z = blank.features(x)
            both += z.T @ np.hstack([z, y[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([both.tobytes()], pa.binary())], ["sums"])

    sums = np.zeros((waves + 1, waves + 2))
    for part in sample.mapInArrow(equations, "sums binary").toLocalIterator():
        sums += np.frombuffer(part.sums).reshape(sums.shape)
    ridge = np.linalg.solve(sums[:, :-1] + penalty * row[0] * np.eye(waves + 1), sums[:, -1])
    fitted = Model(mean, scale, **size, ridge=ridge, raw=np.zeros(1), level=np.zeros(1))

    def raws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = fitted.features(np.array(batch.column(0).to_pylist()).reshape(-1, N_FEATURES)) @ ridge
            yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column(1)], ["raw", "y"])

    width = 4.0 / bins
    bin_of = F.least(F.lit(bins // 2), F.greatest(F.lit(-bins // 2), F.floor(F.col("raw") / width))).alias("bin")
    counts = sample.mapInArrow(raws, "raw double, y double").groupBy(bin_of).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), F.avg("raw").alias("raw"))
    rows = sorted(counts.collect(), key=lambda r: r.bin)
    level = isotonic(np.array([r.n for r in rows], float), np.array([r.y for r in rows]))
    return Model(mean, scale, **size, ridge=ridge, raw=np.array([r.raw for r in rows]), level=level)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, from its text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(_stats_of(batch, 1)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(each, "doc_id long, score double")


def assess(docs: DataFrame, labels: DataFrame, parts: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text), fitted on labels (doc_id, quality).

    A null text scores like an empty one. Rows without an id are scored, never learned from, and count as held out.
    A document with several labels is learned from once for each. With no labels every score is 0.5. Other columns,
    of either table, are ignored; repeated rows are scored each.
    """
    shared_dir(docs.sparkSession)
    scored = score(docs, fit(docs, labels, parts=parts))
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", held_out(F.col("doc_id"), parts).alias("held_out"), "score", predicted.alias("predicted"))
