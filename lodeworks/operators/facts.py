"""Facts that cite evidence: grounding, support, activation, and search by filters."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, company_key, fold, location_key, quote_key, recruitment_type
from ..sources.scratch import in_parts


def citation_issues(citations: DataFrame, evidence: DataFrame, claim: Sequence[str] | None = None) -> DataFrame:
    """citations (.., evidence_id, quote) with issue: null, outside-evidence, quote-not-found or duplicate.

    evidence: evidence_id, text. With claim columns, of equal evidence ids of a claim the first (by ordinal) is checked
    and later ones are duplicates.
    """
    found = citations.join(evidence.select("evidence_id", F.col("text").alias("_text")), "evidence_id", "left")
    quoted = F.contains(quote_key(F.col("_text")), quote_key(F.col("quote")))
    issue = F.when(F.col("_text").isNull(), "outside-evidence").when(~quoted, "quote-not-found")
    if claim:
        nth = F.row_number().over(Window.partitionBy(*claim, "evidence_id").orderBy("ordinal"))
        issue = F.when(nth > 1, "duplicate").otherwise(issue)
    return found.withColumn("issue", issue).drop("_text")


def activation(events: DataFrame, current: DataFrame) -> DataFrame:
    """events (snapshot, record, seq) with outcome activated, unchanged or stale-snapshot and the record before.

    Only events of snapshots in `current` count; the last of a snapshot is its active record.
    """
    valid = events.join(current.select("snapshot").distinct().withColumn("_ok", F.lit(True)), "snapshot", "left")
    live = F.when(F.col("_ok"), F.col("record"))
    order = Window.partitionBy("snapshot").orderBy("seq")
    before = F.lag(live).over(order)
    outcome = F.when(F.col("_ok").isNull(), "stale-snapshot").when(before == F.col("record"), "unchanged").otherwise("activated")
    last = F.row_number().over(Window.partitionBy("snapshot").orderBy(F.desc("seq"))) == 1
    return valid.select("snapshot", "record", "seq", outcome.alias("outcome"), F.when(F.col("_ok"), before).alias("previous"), (last & F.col("_ok").isNotNull()).alias("is_active"))


def job_filter(records: DataFrame, *, company: str | None = None, title: str | None = None, code: str | None = None, kinds: Sequence[str] = (), after: str | None = None, before: str | None = None, location: str | None = None) -> DataFrame:
    """records that meet all given filters: company equality, title part, exact code, types, deadlines, any location."""
    keep = F.lit(True)
    if company is not None:
        keep = keep & (fold(F.trim("company")) == fold(F.trim(F.lit(company))))
    if title is not None:
        keep = keep & F.contains(F.lower("title"), F.lit(title.lower()))
    if code is not None:
        keep = keep & has_code(F.col("title"), code)
    if kinds:
        keep = keep & F.col("kind").isin(*kinds)
    if after is not None:
        keep = keep & (F.col("deadline") >= F.lit(after).cast("date"))
    if before is not None:
        keep = keep & (F.col("deadline") <= F.lit(before).cast("date"))
    if location is not None:
        keep = keep & F.exists("locations", lambda x: location_key(x) == location_key(F.lit(location)))
    return records.filter(keep)


def has_code(title: Column, code: str) -> Column:
    """A code, `J` and up to twenty digits, as a whole token of the title: the cheap search first, then the exact one."""
    if not re.fullmatch("[Jj][0-9]{1,20}", code):
        raise ValueError(f"{code!r} is no job code")
    return F.contains(F.lower(title), F.lit(code.lower())) & title.rlike(rf"(?i)(?<![A-Za-z0-9]){code}(?![A-Za-z0-9])")


def job_order() -> list[Column]:
    return [F.asc_nulls_last("deadline"), F.asc("company"), F.asc("title"), F.asc("id")]


def support_counts(judged: DataFrame, key: str) -> DataFrame:
    """(key, supported, unsupported, uncertain) of judged (key, label)."""
    return judged.groupBy(key).agg(*[F.count_if(F.col("label") == x).alias(x) for x in ("supported", "unsupported", "uncertain")])


def meets(case: dict[str, Column], record: dict[str, Column]) -> Column:
    """Whether a record (company, kind, deadline) meets a case's filters (company, kind, after), each null where it doesn't ask."""
    company = case["company"].isNull() | (company_key(case["company"]) == company_key(record["company"]))
    kind = case["kind"].isNull() | (case["kind"] == record["kind"])
    return company & kind & (case["after"].isNull() | F.coalesce(record["deadline"] >= case["after"].cast("date"), F.lit(False)))


def job_search_batch(records: DataFrame, cases: DataFrame, most_cases: int = 10_000) -> DataFrame:
    """(case_id, id) of the records (id, company, kind, deadline) that meet each case (case_id, company, kind, after).

    Cases that name a company or kind find their records by equi-joins on it; only what asks for neither meets every record,
    and its rows are that large by what is asked. Cases, counted first, go to all tasks in blocks of about `most_cases`, one
    after another, each against all records.
    """
    blocks = max(1, -(-cases.count() // most_cases))
    own = {c: F.col(f"_{c}") for c in ("company", "kind", "after")}
    asked = cases.select("case_id", *[F.col(c).alias(f"_{c}") for c in own])
    record = {c: F.col(c) for c in ("company", "kind", "deadline")}

    def block(i: int) -> DataFrame:
        wanted = F.broadcast(asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("case_id"), F.lit(blocks)) == i))  # of a counted size
        by_company = records.join(wanted.filter("_company is not null"), company_key(own["company"]) == company_key(record["company"]))
        by_kind = records.join(wanted.filter("_company is null and _kind is not null"), own["kind"] == record["kind"])
        by_none = records.join(wanted.filter("_company is null and _kind is null"))
        return by_company.unionByName(by_kind).unionByName(by_none)

    return reduce(DataFrame.unionByName, [block(i) for i in range(blocks)]).filter(meets(own, record)).select("case_id", "id")


def _place(text: Column) -> Column:
    """A place without white space and without one 市 at its end; its letters stay as they are."""
    return F.regexp_replace(F.regexp_replace(text, WS, ""), "市$", "")


def constraints_retained(expected: DataFrame, actual: DataFrame, default_limit: str = "10") -> DataFrame:
    """(id, retained): whether each of an id's expected filters (id, k, v) is among its actual ones (id, k, v).

    Values must be equal as they are, but: types are what their aliases stand for, and one that is no alias is
    never equal; places go without white space and a final 市; titles are folded, and one that is a code is enough
    as a part of the actual title. A missing limit counts as the default one.
    """
    k, v = F.col("k"), F.col("v")
    key = F.when(k == "recruitment_type", recruitment_type(v)).when(k == "location", _place(v)).when(k == "job_title", fold(v)).otherwise(v)
    asked = expected.select("id", F.lit(True).alias("asked"), "k", key.alias("key"))
    given = actual.filter("id is not null").withColumn("v", F.coalesce(v, F.when(k == "limit", default_limit))).select("id", F.lit(False).alias("asked"), "k", key.alias("key"))
    filters = F.collect_list(F.struct("asked", "k", "key"))  # an id's filters, of both sides
    rows = asked.unionByName(given)
    rows = in_parts(rows, "id").groupBy("id").agg(filters.alias("all"))
    rows = rows.select("id", F.filter("all", lambda f: f["asked"]).alias("wanted"), F.filter("all", lambda f: ~f["asked"]).alias("given"))

    def same(w: Column, key: Column) -> Column:
        code = (w["k"] == "job_title") & w["key"].rlike("^j[0-9]+$") & F.contains(key, w["key"])
        return F.coalesce((key == w["key"]) | code, F.lit(False))

    def held(w: Column) -> Column:
        none = ~F.exists("given", lambda g: F.coalesce(g["k"] == w["k"], F.lit(False)))
        default = none & F.coalesce(w["k"] == "limit", F.lit(False)) & same(w, F.lit(default_limit))
        return default | F.exists("given", lambda g: F.coalesce(g["k"] == w["k"], F.lit(False)) & same(w, g["key"]))

    return rows.filter(F.size("wanted") > 0).select("id", F.forall("wanted", held).alias("retained"))


def record_support(judged: DataFrame, grounding: DataFrame | None = None) -> DataFrame:
    """Counts of the labels of each record's facts (record, label) and its status: accepted, or what must be looked at.

    grounding (record, valid), if given, comes first: a record whose citations don't hold is grounding_failed, its facts aren't
    judged, and it has a row without any.
    """
    counts = support_counts(judged, "record")
    failed = F.lit(False)
    if grounding is not None:
        bad = grounding.groupBy("record").agg((~F.bool_and("valid")).alias("_failed")).filter("_failed")
        counts = support_counts(judged.join(bad, "record", "left_anti"), "record").withColumn("_failed", F.lit(False))
        counts = counts.unionByName(bad.select("record", *[F.lit(0).cast("long").alias(x) for x in ("supported", "unsupported", "uncertain")], "_failed"))
        failed = F.col("_failed")
    status = F.when(failed, "grounding_failed").when(F.col("unsupported") > 0, "semantic_validation_failed").when(F.col("uncertain") > 0, "manual_review_required")
    return counts.withColumn("status", status.otherwise("accepted")).drop("_failed")


def answer_support(claims: DataFrame, judged: DataFrame) -> DataFrame:
    """(answer, claims, unjudged, support_rate, needs_review) of the claims of answers (answer, claim, evidence: how many cited
    chunks are at hand), by the labels of those that were judged (answer, claim, label).

    A claim without evidence at hand has an insufficient context: it is never sent to a judge, and a label that it has all the same doesn't count.
    """
    labels = judged.select("answer", "claim", "label")
    rows = claims.join(labels, ["answer", "claim"], "left")
    bare = F.coalesce(F.col("evidence") == 0, F.lit(True))
    label = F.when(bare, "insufficient_context").otherwise(F.coalesce("label", F.lit("insufficient_context")))
    counts = rows.withColumn("label", label).groupBy("answer").agg(F.count(F.lit(1)).alias("claims"), F.count_if(bare).alias("unjudged"), F.count_if(F.col("label") == "supported").alias("supported"))
    return counts.select("answer", "claims", "unjudged", F.round(F.try_divide("supported", "claims"), 6).alias("support_rate"), (F.col("supported") < F.col("claims")).alias("needs_review"))


def filter_problem(kind: Column, after: Column, before: Column, limit: Column, most: int = 50, texts: Sequence[Column] = (), arguments: Column | None = None, known: Sequence[str] = ()) -> Column:
    """What is wrong with a search's filters, or valid: an argument that isn't known, a blank text, an unknown type, a reversed range
    of deadlines, a limit out of bounds. Nulls are filters that aren't asked for, but the type."""
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.trim(t) == "", F.lit(False)) for t in texts], F.lit(False))
    unknown = F.lit(False) if arguments is None else F.size(F.array_except(arguments, F.array(*[F.lit(k) for k in known]))) > 0
    verdict = F.when(unknown, "unknown-argument").when(blank, "blank-text").when(kind.isNull(), "unknown-type").when(after > before, "reversed-range").when(~limit.between(1, most), "limit-out-of-bounds")
    return verdict.otherwise("valid")


def both_current(records: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The last record (source, sha, seq, ..) of each snapshot, where the snapshot (source, sha, is_current) is current too."""
    last = records.groupBy("source", "sha").agg(F.max_by(F.struct(*records.columns), "seq").alias("r")).select("r.*")
    return last.join(snapshots.filter("is_current").select("source", "sha"), ["source", "sha"], "left_semi")


def unlinked_citations(citations: DataFrame, links: DataFrame) -> DataFrame:
    """The citations (record, snapshot, evidence_id) whose evidence isn't linked to their record's snapshot; links: snapshot, evidence_id."""
    return citations.join(links.select("snapshot", "evidence_id").distinct(), ["snapshot", "evidence_id"], "left_anti")


def report_rows(records: DataFrame, claims: DataFrame, scope: DataFrame) -> DataFrame:
    """Sections of a report: (kind, id, heading, body, cited, problem).

    records: id, company, title, kind, deadline, evidence_id; claims: id, text, evidence_id, grounded; scope: evidence_id that
    may be cited. Unknown facts get a wording; a section without a source, of an ungrounded claim, or that cites outside the
    scope says so in problem.
    """
    none = F.lit("not stated")
    body = F.concat_ws("; ", F.concat(F.lit("type: "), F.coalesce("kind", none)), F.concat(F.lit("deadline: "), F.coalesce(F.date_format("deadline", "yyyy-MM-dd"), none)))
    jobs = records.select(F.lit("job").alias("section"), "id", F.concat("title", F.lit(" at "), "company").alias("heading"), body.alias("body"), "evidence_id", F.lit(True).alias("grounded"))
    said = claims.select(F.lit("claim").alias("section"), "id", F.lit("claim").alias("heading"), F.col("text").alias("body"), "evidence_id", "grounded")
    rows = jobs.unionByName(said).join(scope.select("evidence_id").distinct().withColumn("_in", F.lit(True)), "evidence_id", "left")
    problem = F.when(F.col("evidence_id").isNull(), "missing-source").when(~F.col("grounded"), "invalid-grounding").when(F.col("_in").isNull(), "outside-scope")
    return rows.select("section", "id", "heading", "body", F.col("evidence_id").alias("cited"), problem.alias("problem"))
