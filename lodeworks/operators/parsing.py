"""Documents to fragments: each format goes to its parser, failures by their code to another way, the rest to a report."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import KeptTable
from ..sources.scratch import written
from .chunking import LOCATION, evidence_id, location, structure_chunk, version
from .decoding import reading_order, region_filter
from .evaluation import html_fragments

#: From documents (source, format, content_sha256, content) to fragments, or one row with a failure code, of each.
Parser = Callable[[DataFrame], DataFrame]
FRAGMENTS = f"source string, format string, content_sha256 string, ordinal int, text string, location struct<{', '.join(f.replace(' ', ': ') for f in LOCATION.split(', '))}>, failure string"
_DOCUMENT = ("source", "format", "content_sha256")


def _with_failures(documents: DataFrame, fragments: DataFrame, failure: str) -> DataFrame:
    """fragments (source, ordinal, text, location) with their documents' columns; documents without any fail."""
    rows = documents.select(*_DOCUMENT).join(fragments.select("source", "ordinal", "text", "location"), "source", "left")
    return rows.withColumn("failure", F.when(F.col("ordinal").isNull(), failure)).select(*_DOCUMENT, "ordinal", "text", "location", "failure")


def parse_html(documents: DataFrame) -> DataFrame:
    """Headings, paragraphs and list items of pages, each with the headings that it stands under."""
    blocks = html_fragments(documents.select(F.col("source").alias("page"), F.col("content").alias("html")))
    return _with_failures(documents, blocks.select(F.col("page").alias("source"), "ordinal", "text", location(heading_path=F.col("heading_path")).alias("location")), "no-extractable-content")


def _pages(documents: DataFrame, pages: DataFrame, failure: str) -> DataFrame:
    """A fragment for each page (source, page_number, text) that has text, in order; ordinals without gaps."""
    rows = documents.select("source").join(pages.filter(F.trim("text") != ""), "source")
    ordinal = (F.row_number().over(Window.partitionBy("source").orderBy("page_number")) - 1).alias("ordinal")  # a document's pages
    return _with_failures(documents, rows.select("source", ordinal, "text", location(page_number=F.col("page_number")).alias("location")), failure)


def text_layers(layers: DataFrame) -> Parser:
    """A parser of paged documents by their recorded text layers (source, page_number, text)."""
    return lambda documents: _pages(documents, layers, "pdf-text-layer-missing")


def recognized(regions: DataFrame, least: float = 0.5) -> Parser:
    """A parser by recorded regions (source, page_number, text, confidence, polygon): a page's regions in reading order."""

    def parse(documents: DataFrame) -> DataFrame:
        some = regions.join(documents.select("source"), "source", "left_semi")
        kept = region_filter(some, least).filter("problem IS NULL")
        return _pages(documents, reading_order(kept, "source", "page_number"), "no-extractable-content")

    return parse


def parse(documents: DataFrame, parsers: Mapping[str, Parser], fallbacks: Mapping[str, Parser] | None = None) -> DataFrame:
    """FRAGMENTS of documents (source, format, content_sha256, content): fragments, and a row with a failure for each document
    that has none.

    Every document goes to its format's parser, in one branch for each format; one without a parser fails as
    parser-not-registered. Documents that fail with a code of `fallbacks` go to that parser, whose outcome counts instead. What the
    parsers made is written once and then split by outcome. Sources name documents: they are taken as unique.
    """
    rows = documents.select(*_DOCUMENT, "content")
    parts = [parser(rows.filter(F.col("format") == name)) for name, parser in parsers.items()]
    other = rows.filter(~F.coalesce(F.col("format").isin(*parsers), F.lit(False))).select(*_DOCUMENT)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("ordinal", "int"), ("text", "string"))]
    parts.append(other.select(*_DOCUMENT, *none, location().alias("location"), F.lit("parser-not-registered").alias("failure")))
    first = written(reduce(DataFrame.unionByName, parts), "fragments")
    codes = dict(fallbacks or {})
    done = first.filter(~F.coalesce(F.col("failure").isin(*codes), F.lit(False))) if codes else first
    for code, parser in codes.items():
        again = rows.join(first.filter(F.col("failure") == code).select("source"), "source", "left_semi")
        done = done.unionByName(parser(again))
    return done


def identified_chunks(fragments: DataFrame, most: int = 800, overlap: int = 100) -> DataFrame:
    """(evidence_id, source, content_sha256, source_fragment_ordinal, chunk_ordinal, chunker_version, location, text) of
    fragments: their chunks, with ids by content, coordinates and place."""
    rows = fragments.filter("failure IS NULL").select("source", "content_sha256", F.col("ordinal").alias("source_fragment_ordinal"), "location", "text")
    chunker = version(most, overlap)
    id_ = evidence_id(F.col("content_sha256"), F.col("source"), F.col("source_fragment_ordinal"), F.col("chunk_ordinal"), F.col("text"), chunker, F.col("location"))
    made = structure_chunk(rows, most, overlap).withColumns({"evidence_id": id_, "chunker_version": F.lit(chunker)})
    return made.select("evidence_id", "source", "content_sha256", "source_fragment_ordinal", "chunk_ordinal", "chunker_version", "location", "text")


CHUNKS = f"evidence_id string, source string, content_sha256 string, source_fragment_ordinal int, chunk_ordinal int, chunker_version string, location struct<{', '.join(f.replace(' ', ': ') for f in LOCATION.split(', '))}>, text string"


def ingest(parsed: DataFrame, kept: KeptTable, name: str) -> DataFrame:
    """Appends the chunks of parsed documents to a kept table of CHUNKS, as the append `name`; (source, status, failure, fragments,
    chunks, inserted, skipped) of each document.

    A document's chunks that the table had before, or that come twice, are skipped.
    """
    chunks = written(identified_chunks(parsed), "chunks")
    kept.append(chunks, name)
    own = kept.of(name).groupBy("source").agg(F.count(F.lit(1)).alias("inserted"))
    made = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))
    documents = parsed.groupBy("source").agg(F.max("failure").alias("failure"), F.count("ordinal").alias("fragments"))
    rows = documents.join(made, "source", "left").join(own, "source", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    status = F.when(F.col("failure").isNull(), "succeeded").otherwise("parsing_failed")
    return rows.select("source", status.alias("status"), "failure", "fragments", count("chunks").alias("chunks"), count("inserted").alias("inserted"), (count("chunks") - count("inserted")).alias("skipped"))
