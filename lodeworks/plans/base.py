"""Registration of queries with their SQL, and pieces of SQL that several oracles share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CJK, TOKEN
from ..operators.matching import containing
from ..sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows."""

    def add(fn):
        QUERIES[name or fn.__name__] = fn
        if oracle is not None:
            ORACLES[name or fn.__name__] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """Spark SQL over the named tables, under names of their own that go again: no view of the session is touched."""
    views = {name: f"{name}_{uuid.uuid4().hex}" for name in tables}
    for name, view in views.items():
        table(spark, sf_dir, name).createTempView(view)
    try:
        return spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {views.get(m[2], m[2])}", text))
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def duck_tokens(text: str) -> str:
    """DuckDB expression for lexical_tokens()."""
    word = "[regexp_replace(lower(s), '^[._-]+|[._-]+$', '', 'g')]"
    pairs = "CASE WHEN length(s) > 1 THEN list_transform(range(1, length(s)), lambda i: substring(s, i, 2)) ELSE [s] END"
    cut = f"CASE WHEN regexp_matches(s, '^[{CJK}]') THEN {pairs} ELSE {word} END"
    return f"list_filter(flatten(list_transform(regexp_extract_all({text}, '{TOKEN}'), lambda s: {cut})), lambda t: t <> '')"


DUCK_BM25 = f"""
tok AS (SELECT doc_id AS id, source, {duck_tokens("text")} AS tokens FROM documents),
lens AS (SELECT id, source, len(tokens) AS length FROM tok),
post AS (SELECT id, source, term, count(*) AS tf FROM (SELECT id, source, unnest(tokens) AS term FROM tok) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
tot AS (SELECT count(*) AS n, avg(length) AS avgdl FROM lens),
qt AS (SELECT DISTINCT item_id AS query, unnest({duck_tokens("text")}) AS term FROM benchmark),
bm AS (SELECT query, post.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgdl))), 9) AS score,
    list_sort(list(DISTINCT post.term)) AS matched_terms
  FROM post JOIN qt USING (term) JOIN dfs USING (term) JOIN lens ON lens.id = post.id CROSS JOIN tot GROUP BY query, post.id),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM bm WHERE score > 0)"""

DUCK_QRELS = """
qrels AS (SELECT b.item_id AS query, d.doc_id AS id, CASE WHEN l.quality = 1 THEN 2 ELSE 1 END AS grade
  FROM benchmark b JOIN documents d ON contains(d.text, b.text) LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, text): the benchmark's passages."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")


def chunks_of(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(id, text, ..): the documents."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", *more)


def qrels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, id, grade): documents that contain a passage; grade 2 for those of quality 1. Sought once, then a written table."""
    labels, items = table(spark, sf_dir, "labels"), queries_of(spark, sf_dir).withColumnRenamed("query", "item")
    found = containing(chunks_of(spark, sf_dir), items)
    graded = found.select(F.col("item").alias("query"), F.col("id").alias("doc_id")).join(labels.select("doc_id", "quality"), "doc_id", "left")
    return written(graded.select("query", F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, 2).otherwise(1).alias("grade")), "qrels")
