"""Queries that decode model outputs, plans and recognized pages, made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decoding as D
from ..sources.scratch import spread
from .base import query, sql, table
from .facts import DUCK_FACTS, records

_PLANS = "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'call it' WHEN event_id % 7 = 0 THEN concat('{\"decision\":\"call_tool\",\"reason\":\"r\",\"tool_name\":\"', event_type, '\",\"arguments\":null}') WHEN event_type = 'error' THEN '{\"decision\":\"answer\",\"reason\":\"done\",\"tool_name\":null,\"arguments\":null}' ELSE concat('{\"decision\":\"call_tool\",\"reason\":\"r\",\"tool_name\":\"', event_type, '\",\"arguments\":{\"k\":1}}') END AS plan FROM events"


@query(f"""WITH p AS ({_PLANS}) SELECT event_id, CASE WHEN NOT json_valid(plan) THEN 'invalid-plan-json' WHEN json_extract_string(plan, '$.decision') = 'answer' AND json_extract_string(plan, '$.tool_name') IS NULL THEN 'answer'
WHEN json_extract_string(plan, '$.decision') = 'call_tool' AND json_extract_string(plan, '$.arguments') IS NOT NULL AND json_extract_string(plan, '$.tool_name') IN ('click', 'view', 'purchase') THEN 'call_tool'
WHEN json_extract_string(plan, '$.decision') = 'call_tool' AND json_extract_string(plan, '$.arguments') IS NOT NULL THEN 'tool-not-allowed' ELSE 'invalid-plan-contract' END AS status FROM p""")
def plan_decode(spark, sf):
    plans = sql(spark, sf, _PLANS, "events")
    return plans.select("event_id", D.plan_status(F.col("plan"), ["click", "view", "purchase"]).alias("status"))


@query(f"WITH {DUCK_FACTS} SELECT id, CASE WHEN id % 13 = 0 THEN 'invalid-record-json' WHEN id % 11 = 0 THEN 'invalid-record-contract' WHEN id % 7 = 0 THEN 'stated-without-citation' ELSE 'valid' END AS status FROM recs")
def record_decode(spark, sf):
    cited = lambda v, n: F.struct(v.alias("value"), F.when(n, F.array(F.struct(F.lit("e1").alias("evidence_id"), F.lit("q").alias("quoted_text")))).otherwise(F.array()).alias("citations"))
    none = F.lit(None).cast("string")
    stated, unknown = lambda c: cited(c, F.lit(True)), cited(none, F.lit(False))
    scalars = {n: unknown for n in D.SCALAR_FACTS} | {"job_title": cited(F.col("title"), F.col("id") % 7 != 0), "company": stated(F.col("company"))}
    lists = {n: F.array(stated(F.lit("x"))) for n in D.LIST_FACTS}
    fields = scalars | lists
    whole = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})
    short = F.to_json(F.struct(*[c.alias(n) for n, c in list(fields.items())[:-1]]), {"ignoreNullFields": "false"})
    text = F.when(F.col("id") % 13 == 0, F.lit("{")).when(F.col("id") % 11 == 0, short).otherwise(whole)
    return records(spark, sf).select("id", text.alias("json")).select("id", D.record_status(F.col("json")).alias("status"))


#: Recognized regions made from all words of documents: pages of six lines of four words, some blank or of low confidence.
def _regions(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("n", "text"))
    words = words.select("doc_id", F.floor(F.col("n") / 24).cast("int").alias("page"), (F.col("n") % 24).alias("i"), "text")
    x0, y0 = (F.col("i") % 4) * 0.25, F.floor(F.col("i") / 4) * 0.15 + (F.col("i") % 2) * 0.01
    box = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x0 + 0.2, y0), (x0 + 0.2, y0 + 0.1), (x0, y0 + 0.1))])
    return words.select("doc_id", "page", "text", F.when(F.col("i") % 9 == 8, 0.3).otherwise(0.9).alias("confidence"), box.alias("polygon"))


_DUCK_REGIONS = r"""w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS text, unnest(range(len(regexp_split_to_array(text, '\s+')))) AS n FROM documents),
r AS (SELECT doc_id, (n // 24)::INT AS page, n % 24 AS i, text FROM w WHERE trim(text) <> '' AND (n % 24) % 9 <> 8)"""


@query(f"WITH {_DUCK_REGIONS} SELECT doc_id, page, count(*) AS regions FROM r GROUP BY doc_id, page")
def ocr_region_filter(spark, sf):
    kept = D.region_filter(_regions(spark, sf)).filter("problem is null")
    return kept.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("regions"))


#: Pages of four groups of three overlapping regions: the third overlaps the first enough, but more of it the second, and
#: stands left of both; where the second is lost, it belongs to the first.
def _overlapping(spark, sf):
    words = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("n", "text"))
    words = words.select("doc_id", F.floor(F.col("n") / 12).cast("int").alias("page"), (F.col("n") % 12).alias("i"), "n", "text")
    kind, base = F.col("i") % 3, F.floor(F.col("i") / 3) * 0.25
    x0, top, bottom = (F.when(kind == 0, a).when(kind == 1, b).otherwise(c) for a, b, c in ((0.5, 0.25, 0.0), (0.0, 0.06, 0.065), (0.1, 0.16, 0.11)))
    box = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, base + top), (x0 + 0.2, base + top), (x0 + 0.2, base + bottom), (x0, base + bottom))])
    return words.select("doc_id", "page", "text", F.when(F.col("n") % 7 == 6, 0.3).otherwise(0.9).alias("confidence"), box.alias("polygon"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS text, unnest(range(len(regexp_split_to_array(text, '\s+')))) AS n FROM documents),
r AS (SELECT doc_id, (n // 12)::INT AS page, (n % 12) // 3 AS g, n % 3 AS kind, text FROM w WHERE trim(text) <> '' AND n % 7 <> 6),
k AS (SELECT *, bool_or(kind = 1) OVER (PARTITION BY doc_id, page, g) AS second FROM r),
o AS (SELECT *, CASE WHEN second THEN [0, 2, 1][kind + 1] ELSE [1, 9, 0][kind + 1] END AS place FROM k)
SELECT doc_id, page, md5(string_agg(text, chr(10) ORDER BY g, place)) AS digest FROM o GROUP BY doc_id, page""")
def ocr_reading_order(spark, sf):
    kept = D.region_filter(_overlapping(spark, sf)).filter("problem is null")
    return D.reading_order(kept, "doc_id", "page").select("doc_id", "page", F.md5(F.col("text").cast("binary")).alias("digest"))


#: Outcomes of tasks as text for both engines: what was asked and what came, with things that go wrong.
_OUTCOMES = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'mixed' WHEN 2 THEN 'answer' ELSE 'refuse' END AS task, concat('a,b,', source) AS expected_ids, concat(source, ',', CASE WHEN doc_id % 9 = 0 THEN 'a' ELSE 'b,a' END) AS ids,
  CASE WHEN doc_id % 4 = 3 THEN 'refused' ELSE 'answered' END AS expected_status, CASE WHEN doc_id % 4 = 3 AND doc_id % 5 <> 0 THEN 'refused' ELSE 'answered' END AS status, doc_id % 7 <> 0 AS grounding_valid,
  concat('e', doc_id) AS target_evidence, concat(CASE WHEN doc_id % 11 = 0 THEN 'e' ELSE concat('e', doc_id) END, ',x') AS cited, concat(source, ',', lang) AS required_terms, concat('it says ', source, ' and ', CASE WHEN doc_id % 13 <> 0 THEN lang ELSE 'no more' END) AS quoted,
  source AS sources, CASE WHEN doc_id % 17 = 0 THEN 'elsewhere' ELSE concat('s,', source) END AS scope FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL"""


@query(f"""WITH t AS ({_OUTCOMES}), c AS (SELECT doc_id, task, doc_id % 9 <> 0 AS m, doc_id % 5 <> 0 AS r, doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND (doc_id % 13 <> 0 OR contains(quoted, split_part(required_terms, ',', 2))) AS e, doc_id % 17 <> 0 AS s FROM t)
SELECT doc_id, task, CASE task WHEN 'search' THEN m WHEN 'mixed' THEN m AND e AND s WHEN 'answer' THEN e ELSE r END AS passed FROM c""")
def task_verdict(spark, sf):
    lists = ("expected_ids", "ids", "target_evidence", "cited", "required_terms", "sources", "scope")
    checked = D.task_checks(sql(spark, sf, _OUTCOMES, "documents").withColumns({c: F.split(c, ",") for c in lists}))
    by_check = {c: [t for t, cs in D.TASK_CHECKS.items() if c in cs] for cs in D.TASK_CHECKS.values() for c in cs}
    return checked.select("doc_id", "task", D.verdict(F.col("task"), {c: (tasks, F.col(c)) for c, tasks in by_check.items()}).alias("passed"))
