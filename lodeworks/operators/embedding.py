"""Vectors from text: signed hashes of tokens in a fixed width, and what such vectors are told apart by."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import text_parts, tokens_in
from ..sources.scratch import spread


@dataclass(frozen=True)
class EmbeddingSpec:
    """What decides a vector besides its text; vectors of different specs are never compared."""

    provider: str
    model_name: str
    model_revision: str
    dimension: int
    max_sequence_length: int = 512
    normalization: str = "l2"
    query_instruction: str = ""
    document_instruction: str = ""

    def __post_init__(self) -> None:
        blank = [n for n in ("provider", "model_name", "model_revision") if not getattr(self, n).strip()]
        if blank or self.dimension < 1 or self.max_sequence_length < 1 or self.normalization not in ("none", "l2"):
            raise ValueError(f"not a spec of an embedding: blank {blank}, or a dimension, length or normalization that can't be")

    @property
    def identity(self) -> str:
        text = json.dumps(asdict(self), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return f"emb_{hashlib.sha256(text.encode()).hexdigest()}"


#: The offline default: whole texts, whatever their length.
TOKEN_HASH = EmbeddingSpec("offline", "token-hash", "1", dimension=256, max_sequence_length=2**31 - 1)


#: Rows whose tokens and vectors a task holds at once.
_ROWS = 1024


def token_place(token: bytes, dimension: int) -> tuple[int, int]:
    """Where a token counts and with which sign: the first 8 hexadecimal digits of its MD5, and the parity of the ninth."""
    digest = hashlib.md5(token, usedforsecurity=False).hexdigest()
    return int(digest[:8], 16) % dimension, 1 - 2 * (int(digest[8], 16) % 2)


def embedded(rows: DataFrame, spec: EmbeddingSpec = TOKEN_HASH, instruction: str = "", text: str = "text") -> DataFrame:
    """rows (.., text) with `vector` instead of text, and null where the text has no tokens or they cancel out.

    Each token adds its sign at its place, as often as it occurs; with l2 the sum is scaled to length 1. A task hashes each
    distinct token of some rows once, and holds no more rows than these as tokens and vectors.
    """
    if spec.provider != TOKEN_HASH.provider or spec.model_name != TOKEN_HASH.model_name:
        raise ValueError("only token-hash vectors are made here; vectors of other models are tables of their own")
    rest = [f for f in rows.schema.fields if f.name != text]
    schema = T.StructType([*rest, T.StructField("vector", T.ArrayType(T.DoubleType()))])
    d, most, scaled = spec.dimension, spec.max_sequence_length, spec.normalization == "l2"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_parts(whole, len(rest), _ROWS):
                row, code, words = tokens_in(batch.column(len(rest)))
                if len(row) > most:
                    some = np.arange(len(row)) - np.searchsorted(row, row) < most  # a text's first tokens
                    row, code = row[some], code[some]
                used = np.bincount(code, minlength=len(words)) > 0
                places = [token_place(t.encode(), d) if u else (0, 0) for t, u in zip(words.to_pylist(), used.tolist(), strict=True)]
                place, sign = np.array(places, np.int64).reshape(-1, 2).T
                sums = np.bincount(row * d + place[code], sign[code].astype(float), len(batch) * d).reshape(-1, d)
                norm = np.sqrt((sums * sums).sum(axis=1))
                good = norm > 0
                values = (sums[good] / norm[good, None] if scaled else sums[good]).ravel()
                ends = np.concatenate([[0], np.cumsum(np.where(good, d, 0))]).astype(np.int32)
                vectors = pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array(~good))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], vectors], [*[f.name for f in rest], "vector"])

    whole = F.concat(F.lit(instruction), F.coalesce(text, F.lit(""))).alias("_text")
    return spread(rows).select(*[f.name for f in rest], whole).mapInArrow(each, schema)
