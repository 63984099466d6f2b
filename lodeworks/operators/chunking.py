"""Fragments to chunks with stable, content-addressed ids."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_sha, collapse

# Fixed value: the characters that end a sentence.
ENDINGS = "。！？!?；;"
_TO_ONE = str.maketrans(ENDINGS, ENDINGS[0] * len(ENDINGS))


def _pieces(flat: str, most: int, overlap: int) -> list[str]:
    """One text's pieces, from its white space collapsed; each step looks at one window, so time follows the text."""
    half, start, n, found = max(1, most // 2), 0, len(flat), []
    marks = flat.translate(_TO_ONE)
    while True:
        end = min(start + most, n)
        if end < n:
            sentence = marks.rfind(ENDINGS[0], start + half, end)
            blank = flat.rfind(" ", start + half, end)
            end = sentence + 1 if sentence >= 0 else blank if blank >= 0 else end
        if piece := flat[start:end].strip(" "):
            found.append(piece)
        if end >= n:
            return found
        start = max(start + 1, end - overlap)
        if start < end and flat[start] == " ":
            start += 1


def chunk_texts(text: Column, most: int = 800, overlap: int = 100) -> Column:
    """Overlapping pieces of a text: cut behind a sentence, else at a blank, in the second half of a window, else hard.

    Null stays null, and a blank text is one empty piece. Cutting is a walk over each text, so it takes Arrow batches.
    """

    @F.pandas_udf("array<string>")
    def pieces(flat: pd.Series) -> pd.Series:
        return flat.map(lambda x: None if x is None else [x] if len(x) <= most else _pieces(x, most, overlap))

    return pieces(collapse(text))


def version(most: int = 800, overlap: int = 100) -> str:
    return f"structure-v1;max_chars={most};overlap_chars={overlap}"


def structure_chunk(fragments: DataFrame, most: int = 800, overlap: int = 100) -> DataFrame:
    """fragments (.., text) to rows with chunk_ordinal and the chunk's text; pieces never cross fragments."""
    rest = [c for c in fragments.columns if c != "text"]
    return fragments.select(*rest, F.posexplode(chunk_texts(F.col("text"), most, overlap)).alias("chunk_ordinal", "text"))


#: The fields of a place within a document, in canonical order.
LOCATION = "cell_reference string, heading_path array<string>, page_number int, sheet_name string, slide_number int, table_number int, table_row_number int"


def location(**known: Column) -> Column:
    """A place within a document, as a struct of LOCATION; what isn't given is null, and a heading path then empty."""
    fields = []
    for name, kind in (f.split() for f in LOCATION.split(", ")):
        value = known.pop(name, F.lit(None)).cast(kind)
        fields.append((F.coalesce(value, F.array().cast(kind)) if name == "heading_path" else value).alias(name))
    if known:
        raise ValueError(f"no fields of a place: {sorted(known)}")
    return F.struct(*fields)


def evidence_id(document_sha: Column, source: Column, fragment: Column, chunk: Column, text: Column, chunker: str, place: Column | None = None) -> Column:
    """Id of a chunk by content, coordinates and its place (a struct of LOCATION; null fields where none is given)."""
    fields = {"chunk_ordinal": chunk, "chunker_version": F.lit(chunker), "document_sha256": document_sha, "location": location() if place is None else place}
    return F.concat(F.lit("ev_"), canonical_sha(fields | {"source_fragment_ordinal": fragment, "source_reference": source, "text": text}))


def set_fingerprint(digests: DataFrame, column: str = "digest", digits: int = 4) -> DataFrame:
    """(fingerprint, members): one digest of a whole set of hexadecimal digests, whatever their order: hashed by their first
    `digits`, then these buckets' hashes together.

    No task holds more than a bucket's digests, and the last step as many as there are buckets.
    """
    bucket = F.substring(column, 1, digits).alias("bucket")
    parts = digests.groupBy(bucket).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(column)), ","), 256).alias("part"), F.count(F.lit(1)).alias("n"))
    whole = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "part"))), lambda x: x["part"]), ","), 256)
    return parts.agg(whole.alias("fingerprint"), F.sum("n").alias("members"))


#: Bytes of items that travel to the hash in one row; an Arrow batch holds ten thousand of these.
_BLOB = 1 << 14


def ordered_digest(rows: DataFrame, item: str, *order: str, before: str = "", between: str = ",", after: str = "") -> DataFrame:
    """(digest, members): SHA-256 of the items of all rows, joined in a global order: `before`, items with `between`, `after`;
    rows that are equal in `order` go by their item.

    One digest over one text is a walk in order by its nature. Rows are sorted in parallel, in ranges, and each range packs
    its items into binaries with the range's number and their own; one task then lays these, not the items, in a file as they
    come and hashes them one after another in their order: it holds their places, so its memory hardly follows the rows.
    Where a digest of another definition will do, set_fingerprint() hashes in parallel.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            blob = between.encode().join(held)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([len(held)]), pa.array([blob], pa.binary())], ["part", "number", "members", "blob"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(text.encode())
                size += len(held[-1])
                if size >= _BLOB:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, members, places, end = hashlib.sha256(before.encode()), 0, [], 0
        with tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as held:
            for batch in batches:
                for *place, blob in zip(*[c.to_pylist() for c in batch.columns[:3]], batch.column(3), strict=True):
                    data = blob.as_buffer()
                    places.append((*place, end, data.size))
                    held.write(data)
                    end += data.size
            for _, _, n, start, size in sorted(places):
                if not n:
                    continue
                held.seek(start)
                whole.update(between.encode() if members else b"")
                whole.update(held.read(size))
                members += n
        whole.update(after.encode())
        yield pa.RecordBatch.from_arrays([pa.array([whole.hexdigest()]), pa.array([members])], ["digest", "members"])

    ordered = rows.select(F.col(item).cast("string").alias("_item"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)])
    ordered = ordered.orderBy(*[f"_{i}" for i in range(len(order))], "_item").select("_item")
    packed = ordered.mapInArrow(pack, "part long, number long, members long, blob binary")
    packed = packed.unionByName(rows.sparkSession.sql("SELECT -1L AS part, 0L AS number, 0L AS members, X'' AS blob"))  # so that no rows give a digest too
    return packed.repartition(1).mapInArrow(digest, "digest string, members long")


def corpus_fingerprint(chunks: DataFrame) -> DataFrame:
    """(fingerprint, members) of chunks (evidence_id, document_sha256, chunker_version), by content and in the order of ids."""
    item = F.to_json(F.struct("chunker_version", "document_sha256", "evidence_id"))
    whole = ordered_digest(chunks.select("evidence_id", item.alias("item")), "item", "evidence_id", before="[", after="]")
    return whole.select(F.concat(F.lit("corpus_"), "digest").alias("fingerprint"), "members")
