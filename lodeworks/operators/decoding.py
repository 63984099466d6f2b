"""Model outputs and recognized regions to checked rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# The fields of a job record.
SCALAR_FACTS = ("company", "job_title", "job_code", "recruitment_type", "publication_date", "application_deadline")
LIST_FACTS = ("locations", "responsibilities", "requirements", "benefits")
_FACT = "struct<value:string,citations:array<struct<evidence_id:string,quoted_text:string>>>"


def plan_status(plan: Column, tools: Sequence[str]) -> Column:
    """answer or call_tool for a plan that keeps its contract, else what is wrong with it."""
    d = F.from_json(plan, "decision string, reason string, tool_name string, arguments map<string,string>")
    exact = F.array_sort(F.json_object_keys(plan)) == F.array(*[F.lit(k) for k in ("arguments", "decision", "reason", "tool_name")])
    payload = d["tool_name"].isNotNull() & d["arguments"].isNotNull()
    empty = d["tool_name"].isNull() & d["arguments"].isNull()
    shaped = F.coalesce(exact & (F.trim(d["reason"]) != ""), F.lit(False))
    status = F.when(F.json_object_keys(plan).isNull(), "invalid-plan-json").when(~shaped, "invalid-plan-contract")
    status = status.when((d["decision"] == "answer") & empty, "answer").when((d["decision"] == "call_tool") & payload & d["tool_name"].isin(*tools), "call_tool")
    return status.when((d["decision"] == "call_tool") & payload, "tool-not-allowed").otherwise("invalid-plan-contract")


def judgment_status(json: Column, exact: bool = False) -> Column:
    """valid, or what is wrong with a judgment: not JSON, a label that isn't one, a blank rationale; with `exact` also other keys."""
    d, keys = F.from_json(json, "label string, rationale string"), F.json_object_keys(json)
    more = F.array_sort(keys) != F.array(F.lit("label"), F.lit("rationale")) if exact else F.lit(False)
    status = F.when(keys.isNull(), "invalid-json").when(more, "invalid-keys")
    status = status.when(~F.coalesce(d["label"].isin("supported", "unsupported", "uncertain"), F.lit(False)), "invalid-label")
    return status.when(F.coalesce(F.trim(d["rationale"]) == "", F.lit(True)), "blank-rationale").otherwise("valid")


def answer_status(json: Column) -> Column:
    """answered, refused, or what is wrong with an answer: an answer has claims with citations each and no fallback, a refusal
    a fallback and no claims."""
    d = F.from_json(json, "status string, claims array<struct<text:string,citations:array<string>>>, fallback string")
    n = F.size(d["claims"])
    cited = F.forall(d["claims"], lambda c: F.coalesce(F.size(c["citations"]) > 0, F.lit(False)))
    answered = (d["status"] == "answered") & (n > 0) & cited & d["fallback"].isNull()
    refused = (d["status"] == "insufficient_evidence") & (n == 0) & d["fallback"].isNotNull()
    status = F.when(F.json_object_keys(json).isNull(), "invalid-answer-json").when(answered, "answered")
    return status.when(refused, "refused").otherwise("invalid-answer-contract")


def record_status(json: Column) -> Column:
    """valid, or the first rule that a record breaks: exact fields, a citation for what is stated only, unique citations and values."""
    schema = ", ".join([f"{n} {_FACT}" for n in SCALAR_FACTS] + [f"{n} array<{_FACT}>" for n in LIST_FACTS])
    d = F.from_json(json, schema)
    names = F.array(*[F.lit(n) for n in sorted(SCALAR_FACTS + LIST_FACTS)])
    scalars = F.array(*[d[n] for n in SCALAR_FACTS])
    lists = F.flatten(F.array(*[d[n] for n in LIST_FACTS]))
    facts = F.concat(scalars, lists)
    cited = lambda f: F.coalesce(F.size(f["citations"]), F.lit(0)) > 0
    unique = lambda f: F.size(F.array_distinct(f["citations"])) == F.size(f["citations"])
    distinct = F.forall(F.array(*[d[n] for n in LIST_FACTS]), lambda xs: F.size(F.array_distinct(F.transform(xs, lambda f: F.lower(f["value"])))) == F.size(xs))
    return (
        F.when(F.json_object_keys(json).isNull(), "invalid-record-json")
        .when(F.array_sort(F.json_object_keys(json)) != names, "invalid-record-contract")
        .when(F.exists(facts, lambda f: f["value"].isNotNull() & ~cited(f)), "stated-without-citation")
        .when(F.exists(facts, lambda f: f["value"].isNull() & cited(f)), "cited-without-value")
        .when(~F.forall(facts, unique), "repeated-citation")
        .when(~distinct, "repeated-value")
        .otherwise("valid")
    )


def region_filter(regions: DataFrame, least: float = 0.5) -> DataFrame:
    """regions (.., text, confidence, polygon) with their box left, top, right, bottom, and a problem if the box leaves the page.

    Blank regions and those of less confidence than `least` go.
    """
    side = lambda f, c: f(F.transform("polygon", lambda p: p[c]))
    rows = regions.filter((F.trim("text") != "") & (F.col("confidence") >= least))
    rows = rows.withColumns({"left": side(F.array_min, "x"), "top": side(F.array_min, "y"), "right": side(F.array_max, "x"), "bottom": side(F.array_max, "y")})
    outside = (F.col("left") < 0) | (F.col("top") < 0) | (F.col("right") > 1) | (F.col("bottom") > 1)
    return rows.withColumn("problem", F.when(outside, "outside-page")).drop("polygon")


def _lines(regions: list[tuple[float, float, float, str]]) -> str:
    """Text of one page's regions (top, left, bottom, text), as reading_order() says."""
    lines: list[list] = []  # top, bottom, [(left, text)]
    near: list[list] = []  # lines that reach below the region: others share nothing with it, or with what comes after
    for top, left, bottom, text in sorted(regions):
        near = [line for line in near if line[1] > top]
        shares = [(min(a_bottom, bottom) - max(a_top, top)) / (min(a_bottom - a_top, bottom - top) or 1.0) for a_top, a_bottom, _ in near]
        best = max(range(len(near)), key=shares.__getitem__, default=None)  # of equal shares the first
        if best is None or shares[best] < 0.5:
            lines.append([top, bottom, [(left, text)]])
            near.append(lines[-1])
        else:
            line = near[best]
            line[0], line[1] = min(line[0], top), max(line[1], bottom)
            line[2].append((left, text))
    return "\n".join(text for _, _, items in sorted(lines, key=lambda line: line[0]) for _, text in sorted(items, key=lambda item: item[0]))


def reading_order(regions: DataFrame, *page: str) -> DataFrame:
    """(page columns, text): a page's regions in reading order, one to a line of text.

    Regions come from the top; each joins the line with which it shares most of the smaller one's height, if that is half
    or more, of equal ones the first, and else begins a line. Lines go by their top, regions of a line by their left. Regions
    are sorted by page and walked as they come, batch after batch; a task holds one page, as many regions as that has.
    """
    at, schema = len(page), T.StructType([*[regions.schema[c] for c in page], T.StructField("text", T.StringType())])
    kinds = [f.type for f in to_arrow_schema(schema)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last: tuple | None = None
        for batch in batches:
            done: list[tuple] = []
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for own, some in groupby(rows, key=lambda row: row[:at]):
                if last is not None and own != last:
                    done.append((*last, _lines(held)))
                    held = []
                last = own
                held += [row[at:] for row in some]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], schema.names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*last, _lines(held)), kinds, strict=True)], schema.names)

    flat = regions.select(*page, *[F.col(c).cast("double").alias(c) for c in ("top", "left", "bottom")], "text")
    return flat.repartition(*page).sortWithinPartitions(*page).mapInArrow(walk, schema)


def verdict(task: Column, checks: dict[str, tuple[Sequence[str], Column]]) -> Column:
    """True if all checks that apply to the task (those that list it) hold."""
    return F.forall(F.array(*[F.when(task.isin(*tasks), ok).otherwise(True) for tasks, ok in checks.values()]), lambda x: x)


def task_checks(outcomes: DataFrame) -> DataFrame:
    """outcomes with the checks of a task as columns: ids_match, status_right, grounded, evidence_cited, terms_quoted, in_scope.

    outcomes: expected_ids and ids (the same, in whatever order, as often as they occur), expected_status and status,
    grounding_valid, target_evidence and cited (all targets are cited), required_terms and quoted (the text of all quotes holds
    each term), sources and scope (all cited sources are in scope). A missing list is an empty one, and missing flags don't hold.
    """
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    checks = {
        "ids_match": F.sort_array(empty("ids")) == F.sort_array(empty("expected_ids")),
        "status_right": F.col("status") == F.col("expected_status"),
        "grounded": F.col("grounding_valid"),
        "evidence_cited": F.size(F.array_except(empty("target_evidence"), empty("cited"))) == 0,
        "terms_quoted": F.forall(empty("required_terms"), lambda t: F.contains(F.coalesce("quoted", F.lit("")), t)),
        "in_scope": F.size(F.array_except(empty("sources"), empty("scope"))) == 0,
    }
    return outcomes.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in checks.items()})


#: Which checks a task must pass.
TASK_CHECKS = {"search": ("ids_match",), "answer": ("status_right", "grounded", "evidence_cited", "terms_quoted"), "mixed": ("ids_match", "status_right", "grounded", "evidence_cited", "terms_quoted", "in_scope"), "refuse": ("status_right",)}
