"""Corpus bookkeeping: manifests, snapshots, appends, current views, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import there
from .chunking import ordered_digest


def first_of(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_n = 1").drop("_n")


def idempotent_append(existing: DataFrame, incoming: DataFrame, key: str, *order: Column) -> DataFrame:
    """The rows of incoming to add: of each key the first, and only keys that aren't there yet."""
    return first_of(incoming, [key], *order).join(existing.select(key).distinct(), key, "left_anti")


def snapshot_log(observations: DataFrame) -> DataFrame:
    """observations (source, sha, seq, at) with created, content_changed and version of each arrival.

    A content that its source never had makes the next version; a known one becomes current again. Arrival order (seq)
    decides, whatever the times say.
    """
    arrival = Window.partitionBy("source").orderBy("seq")
    again = Window.partitionBy("source", "sha").orderBy("seq")
    rows = observations.withColumn("created", F.row_number().over(again) == 1).withColumn("before", F.lag("sha").over(arrival))
    rows = rows.withColumn("content_changed", F.coalesce(F.col("before") != F.col("sha"), F.lit(False)))
    made = F.sum(F.col("created").cast("int")).over(arrival)
    return rows.withColumn("version", F.max(F.when(F.col("created"), made)).over(Window.partitionBy("source", "sha")).cast("int"))


def snapshot_versions(observations: DataFrame) -> DataFrame:
    """(source, sha, version, first_observed, last_observed, is_current) of each content that a source ever had."""
    seen = observations.groupBy("source", "sha").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min_by("at", "seq").alias("first_observed"), F.max("at").alias("last_observed"))
    own = Window.partitionBy("source")
    version = F.row_number().over(own.orderBy("first_seq")).alias("version")
    current = (F.col("last_seq") == F.max("last_seq").over(own)).alias("is_current")
    return seen.select("source", "sha", version, "first_observed", "last_observed", current)


def manifest_upsert(old: DataFrame, new: DataFrame, fixed: Sequence[str]) -> DataFrame:
    """The merged manifest with an outcome for each id: kept, created, updated, or rejected with its reason.

    A replacement must be captured later and keep the `fixed` columns; rejected ones leave the old entry as it is.
    """
    values = [c for c in old.columns if c != "source_id"]
    both = old.select("source_id", F.struct(*values).alias("o")).join(new.select("source_id", F.struct(*values).alias("n")), "source_id", "full")
    kept = F.forall(F.array(*[F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in fixed]), lambda x: x)
    outcome = (
        F.when(F.col("n").isNull(), "kept")
        .when(F.col("o").isNull(), "created")
        .when(~kept, "rejected-identity")
        .when(F.col("n.captured_at") <= F.col("o.captured_at"), "rejected-not-later")
        .otherwise("updated")
    )
    rows = both.withColumn("outcome", outcome)
    chosen = F.when(F.col("outcome").isin("created", "updated"), F.col("n")).otherwise(F.col("o"))
    changed = (F.col("outcome") == "updated") & (F.col("n.content_sha256") != F.col("o.content_sha256"))
    return rows.select("source_id", chosen.alias("e"), "outcome", changed.alias("content_changed")).select("source_id", "e.*", "outcome", "content_changed")


def ingest_report(items: DataFrame, order: str, policy: str = "continue") -> DataFrame:
    """items (.., order, failure code or null) with status; with policy stop, all behind the first failure isn't attempted."""
    status = F.when(F.col("failure").isNotNull(), "parsing_failed").otherwise("succeeded")
    if policy == "continue":
        return items.withColumn("status", status)
    first = items.filter("failure is not null").agg(F.min(order).alias("first_failed"))
    rows = items.crossJoin(F.broadcast(first))  # one row
    return rows.withColumn("status", F.when(F.col(order) > F.col("first_failed"), "not_attempted").otherwise(status)).drop("first_failed")


def violations(rows: DataFrame, id_: str, rules: dict[str, Column]) -> DataFrame:
    """(id, rule) for every rule that a row breaks, in one pass."""
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda r: r.isNotNull())
    return rows.select(F.col(id_).alias("id"), F.explode(broken).alias("rule"))


def verify_manifest(entries: DataFrame, files: DataFrame) -> DataFrame:
    """entries (.., path, content_sha256) with a verdict against files (path, actual): outside-root, missing, hash-mismatch, verified."""
    verdict = F.when(F.col("path").rlike(r"^/|(^|/)\.\.(/|$)"), "outside-root").when(F.col("actual").isNull(), "missing")
    verdict = verdict.when(F.col("actual") != F.col("content_sha256"), "hash-mismatch").otherwise("verified")
    return entries.join(files.select("path", "actual"), "path", "left").withColumn("verdict", verdict).drop("actual")


def link_conflicts(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, snapshot, linked_to) of incoming links (id, snapshot) whose id is already linked to another snapshot: the least such.

    The two least snapshots of an id say whether another one has it, so an id's links never meet in one row.
    """
    least = known.groupBy("id").agg(F.min("snapshot").alias("m1"))
    second = known.join(least, "id").filter("snapshot <> m1").groupBy("id").agg(F.min("snapshot").alias("m2"))
    linked = F.when(F.col("m1") != F.col("snapshot"), F.col("m1")).otherwise(F.col("m2"))
    rows = incoming.join(least, "id").join(second, "id", "left").select("id", "snapshot", linked.alias("linked_to"))
    return rows.filter("linked_to is not null")


def sets_equal(expected: DataFrame, actual: DataFrame, by: str, id_: str) -> DataFrame:
    """(by, expected, actual, equal): numbers of distinct ids on either side, and whether the sets are the same.

    Ids meet one by one in a full join, so no set is held. A group that only one side has isn't equal.
    """
    one = lambda rows, name: rows.select(by, id_).distinct().withColumn(name, F.lit(1))
    both = one(expected, "e").join(one(actual, "a"), [by, id_], "full")
    return both.groupBy(by).agg(F.count("e").alias("expected"), F.count("a").alias("actual"), F.bool_and(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("equal"))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def exact_duplicates(documents: DataFrame, id_: str) -> DataFrame:
    """(text_sha, documents, first_id) of contents that more than one document (id_, text) has."""
    hashed = documents.select(F.sha2("text", 256).alias("text_sha"), id_)
    return hashed.groupBy("text_sha").agg(F.count(F.lit(1)).alias("documents"), F.min(id_).alias("first_id")).filter("documents > 1")


def missing_ids(wanted: DataFrame, there: DataFrame, id_: str) -> DataFrame:
    """The distinct ids of wanted that aren't in there."""
    return wanted.select(id_).distinct().join(there.select(id_).distinct(), id_, "left_anti")


def match_documents(entries: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    """(key, verdict) of manifest entries (key, source, content_sha256) and artifacts of the same columns: matched, hash-differs,
    source-differs, or which side is missing."""
    other = artifacts.select(key, F.col("source").alias("_source"), F.col("content_sha256").alias("_sha"))
    verdict = F.when(F.col("content_sha256").isNull(), "entry-missing").when(F.col("_sha").isNull(), "artifact-missing")
    verdict = verdict.when(F.col("content_sha256") != F.col("_sha"), "hash-differs").when(~F.col("source").eqNullSafe(F.col("_source")), "source-differs")
    return entries.join(other, key, "full").select(key, verdict.otherwise("matched").alias("verdict"))


def judged_outside(judged: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, problem) of judged (id, document_sha256) that aren't in corpus (id, document_sha256), or there with another hash."""
    rows = judged.join(corpus.select("id", F.col("document_sha256").alias("_sha")), "id", "left")
    problem = F.when(F.col("_sha").isNull(), "outside-corpus").when(F.col("_sha") != F.col("document_sha256"), "wrong-hash")
    return rows.select("id", problem.alias("problem")).filter("problem is not null")


def profile(documents: DataFrame, by: Sequence[str], published: Column | None = None) -> DataFrame:
    """(dimension, value, documents, bytes, contents, duplicate_groups, duplicate_documents, missing_dates) of documents (.., text),
    for each value of each of the columns, and for all (dimension `all`, value null).

    duplicate_groups: contents that more than one document has, duplicate_documents: the documents that have them;
    missing_dates: documents without `published`. Rows are summed by value and content first, with map-side sums.
    """
    one = lambda name, value: F.struct(F.lit(name).alias("dimension"), value.cast("string").alias("value"))
    places = F.array(*[one(c, F.col(c)) for c in by], one("all", F.lit(None)))
    dated = F.lit(False) if published is None else published.isNull()
    rows = documents.select(F.explode(places).alias("p"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha"), dated.cast("long").alias("missing"))
    same = rows.groupBy("p.dimension", "p.value", "sha").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sum("missing").alias("missing"))
    again = F.col("n") > 1
    return same.groupBy("dimension", "value").agg(
        F.sum("n").alias("documents"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("contents"), F.count_if(again).alias("duplicate_groups"),
        F.sum(F.when(again, F.col("n")).otherwise(0)).alias("duplicate_documents"), F.sum("missing").alias("missing_dates"),
    )


def current_chunks(chunks: DataFrame, links: DataFrame, snapshots: DataFrame, chunker_version: str, source: str | None = None) -> DataFrame:
    """The chunks (evidence_id, source, chunker_version, ..) of one chunker version, of one source if it is named, that are linked
    (snapshot_id, evidence_id) to current snapshots (snapshot_id, is_current); in the order of a reader:
    source, fragment, chunk and id, as far as chunks have these columns."""
    some = chunks.filter(F.col("chunker_version") == chunker_version)
    some = some if source is None else some.filter(F.col("source") == source)
    now = links.join(snapshots.filter("is_current").select("snapshot_id"), "snapshot_id", "left_semi").select("evidence_id")
    order = [c for c in ("source", "source_fragment_ordinal", "chunk_ordinal", "evidence_id") if c in chunks.columns]
    return some.join(now, "evidence_id", "left_semi").orderBy(*order)


class FrozenConflict(ValueError):
    """A frozen manifest's place holds other entries than those that it is named by."""


def freeze_manifest(entries: DataFrame, folder: str) -> DataFrame:
    """Writes entries (source_id, entry: canonical JSON) below folder in a place named by their content; (identity, entries,
    path, created).

    The entries are written first, and then a marker with their identity and number: what has no marker isn't frozen, and is
    written anew. A place with a marker stays as it is: created is false if it holds these entries, and it is a conflict if
    it doesn't, for its entries are read and hashed again. No entries can't be frozen.
    """
    spark = entries.sparkSession
    identity, members = _manifest_identity(entries)
    if not members:
        raise ValueError("a manifest without entries can't be frozen")
    path = f"{folder}/identity={identity}"
    created = not there(spark, f"{path}/marker")
    if created:
        entries.select("source_id", "entry").write.mode("overwrite").parquet(f"{path}/entries")
        spark.createDataFrame([(identity, members)], "identity string, entries long").coalesce(1).write.mode("overwrite").parquet(f"{path}/marker")
    marked, held = spark.read.parquet(f"{path}/marker").first(), _manifest_identity(spark.read.parquet(f"{path}/entries"))
    if marked is None or (marked.identity, marked.entries) != (identity, members) or held != (identity, members):
        raise FrozenConflict(f"{path} is marked as {marked} and holds {held}, not {(identity, members)}")
    return spark.createDataFrame([(identity, members, path, created)], "identity string, entries long, path string, created boolean")


def _manifest_identity(entries: DataFrame) -> tuple[str, int]:
    digest = ordered_digest(entries, "entry", "source_id", before='{"entries":[', after="]}").first()
    return f"manifest_{digest.digest}", digest.members
