"""Queries of the fact table, and of trust in sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import facts as O
from ..operators import trust as S
from ..operators.corpus import snapshot_versions
from .base import query, sql, table

W = T.WS
_KINDS = {"AUTOMOBILE": "实习", "BUILDING": "Campus", "FURNITURE": "社招", "HOUSEHOLD": " intern ", "MACHINERY": "apprentice"}
_CASE = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " END"
#: One text for both engines: the records, from orders, customers, nations and parts.
FACTS = f"""SELECT o_orderkey AS id, n.n_name AS company, concat('J', o_orderkey, ' ', p_name) AS title, {_CASE} AS kind_text,
  concat(n.n_name, ' 市') AS place1, m.n_name AS place2,
  CASE o_orderkey % 5 WHEN 0 THEN concat(year(o_orderdate), '年', month(o_orderdate), '月', day(o_orderdate), '日') WHEN 1 THEN concat(year(o_orderdate), '-', month(o_orderdate), '-', day(o_orderdate))
    WHEN 2 THEN concat(year(o_orderdate), '/', month(o_orderdate), '/31') WHEN 3 THEN 'as soon as possible' END AS deadline_text, o_orderdate
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation n ON n.n_nationkey = c_nationkey JOIN nation m ON m.n_nationkey = (c_nationkey + 7) % 25
JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)"""
_TABLES = ("orders", "customer", "nation", "part")
_Y = r"regexp_extract(t, '^(\d{4})(年|-|/)(\d{1,2})(月|-|/)(\d{1,2})(日?)$', ['y', 's1', 'm', 's2', 'd', 's3'])"
DUCK_FACTS = f"""facts AS ({FACTS}), dl AS (SELECT *, trim(regexp_replace(coalesce(deadline_text, ''), '{W}+', ' ', 'g')) AS t FROM facts),
dm AS (SELECT *, regexp_matches(t, '^\\d{{4}}(年\\d{{1,2}}月\\d{{1,2}}日|-\\d{{1,2}}-\\d{{1,2}}|/\\d{{1,2}}/\\d{{1,2}})$') AS shaped FROM dl),
dd AS (SELECT *, CASE WHEN shaped THEN try_cast(regexp_replace(regexp_replace(regexp_replace(t, '[年月/]', '-', 'g'), '日', ''), '-(\\d)\\b', '-0\\1', 'g') AS DATE) END AS deadline FROM dm),
recs AS (SELECT *, CASE WHEN t = '' THEN 'not_stated' WHEN shaped AND deadline IS NOT NULL THEN 'normalized' ELSE 'manual_review_required' END AS status,
  CASE WHEN t = '' OR (shaped AND deadline IS NOT NULL) THEN NULL WHEN shaped THEN 'invalid-calendar-date' ELSE 'unsupported-date-expression' END AS reason,
  CASE lower(trim(kind_text)) WHEN '实习' THEN 'internship' WHEN 'intern' THEN 'internship' WHEN 'campus' THEN 'campus' WHEN '社招' THEN 'experienced' END AS kind FROM dd)"""


def records(spark, sf):
    rows = sql(spark, sf, FACTS, *_TABLES)
    made = rows.withColumn("d", T.deadline(F.col("deadline_text"))).withColumn("kind", T.recruitment_type(F.col("kind_text")))
    return made.select("id", "company", "title", "kind", F.array("place1", "place2").alias("locations"), "d.deadline", "d.status", "d.reason", "kind_text")


@query(f"WITH {DUCK_FACTS} SELECT id, strftime(deadline, '%Y-%m-%d') AS deadline, status, reason FROM recs")
def deadline_normalize(spark, sf):
    return records(spark, sf).select("id", F.date_format("deadline", "yyyy-MM-dd").alias("deadline"), "status", "reason")


@query(f"WITH {DUCK_FACTS} SELECT id, coalesce(kind, 'unsupported') AS kind FROM recs")
def recruitment_type(spark, sf):
    return records(spark, sf).select("id", F.coalesce("kind", F.lit("unsupported")).alias("kind"))


@query(f"WITH {DUCK_FACTS} SELECT n_nationkey, lower(n_name) AS key, lower(n_name) AS suffixed FROM nation")
def location_key(spark, sf):
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", T.location_key(F.col("n_name")).alias("key"), T.location_key(F.concat("n_name", F.lit(" 市"))).alias("suffixed"))


_SEARCH = "kind IN ('internship', 'campus') AND deadline >= DATE '1995-06-01' AND deadline <= DATE '1997-12-31' AND (lower(place1) LIKE 'nation_1%' OR lower(place2) = 'nation_3')"


@query(f"WITH {DUCK_FACTS} SELECT id, company, title, strftime(deadline, '%Y-%m-%d') AS deadline FROM recs WHERE kind IN ('internship', 'campus') AND deadline >= DATE '1995-06-01' AND deadline <= DATE '1997-12-31' AND (replace(lower(place1), ' 市', '') = 'nation_3' OR lower(place2) = 'nation_3') ORDER BY recs.deadline, company, title, id LIMIT 20")
def job_search(spark, sf):
    found = O.job_filter(records(spark, sf), kinds=("internship", "campus"), after="1995-06-01", before="1997-12-31", location="Nation_3市")
    return found.orderBy(*O.job_order()).limit(20).select("id", "company", "title", F.date_format("deadline", "yyyy-MM-dd").alias("deadline"))


@query(f"WITH {DUCK_FACTS} SELECT id, title FROM recs WHERE contains(lower(title), 'j12') AND regexp_matches(title, '(?i)(^|[^A-Za-z0-9])J12([^A-Za-z0-9]|$)')")
def job_code_token(spark, sf):
    return O.job_filter(records(spark, sf), code="J12").select("id", "title")


@query(f"WITH {DUCK_FACTS} SELECT id, strftime(deadline, '%Y-%m-%d') AS deadline, row_number() OVER (ORDER BY recs.deadline NULLS LAST, company, title, id)::INT AS place FROM recs ORDER BY recs.deadline NULLS LAST, company, title, id LIMIT 50")
def nulls_last_order(spark, sf):
    from pyspark.sql import Window

    first = records(spark, sf).orderBy(*O.job_order()).limit(50)
    place = F.row_number().over(Window.orderBy(*O.job_order()))  # over the 50 rows of the report
    return first.withColumn("place", place).select("id", F.date_format("deadline", "yyyy-MM-dd").alias("deadline"), "place")


_FILTERS = [(i, f"NATION_{i * 3 % 25}" if i % 2 else None, ["internship", "campus", "experienced", None][i % 4], f"199{5 + i % 3}-03-01" if i % 3 == 0 else None) for i in range(32)]


def _filter_rows(quote: str = "'") -> str:
    cell = lambda x: "NULL" if x is None else f"'{x}'"
    return ", ".join(f"({i}, {cell(c)}, {cell(k)}, {cell(d)})" for i, c, k, d in _FILTERS)


@query(f"""WITH {DUCK_FACTS}, f(case_id, company, kind, after) AS (VALUES {_filter_rows()}),
slim AS MATERIALIZED (SELECT id, lower(company) AS c, kind, deadline FROM recs),
hit AS (SELECT case_id, slim.id FROM f CROSS JOIN slim WHERE (f.company IS NULL OR lower(f.company) = c) AND (f.kind IS NULL OR f.kind = slim.kind) AND (f.after IS NULL OR slim.deadline >= f.after::DATE)),
agg AS (SELECT case_id, count(*) AS found, sum(id)::BIGINT AS ids FROM hit GROUP BY case_id)
SELECT case_id, coalesce(found, 0) AS found, coalesce(ids, 0) AS ids FROM f LEFT JOIN agg USING (case_id)""")
def job_search_batch(spark, sf):
    cases = spark.createDataFrame(_FILTERS, "case_id int, company string, kind string, after string")
    got = O.job_search_batch(records(spark, sf), cases).groupBy("case_id").agg(F.count(F.lit(1)).alias("found"), F.sum("id").alias("ids"))
    rows = cases.select("case_id").join(got, "case_id", "left")
    return rows.select("case_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("found", "ids")])


@query(f"""WITH {DUCK_FACTS} SELECT id, CASE WHEN id % 13 = 0 THEN 'unknown-argument' WHEN id % 17 = 0 THEN 'blank-text' WHEN kind IS NULL THEN 'unknown-type' WHEN id % 7 = 0 THEN 'reversed-range' WHEN id % 11 = 0 THEN 'limit-out-of-bounds' ELSE 'valid' END AS verdict FROM recs""")
def filter_contract(spark, sf):
    rows = records(spark, sf).withColumn("limit", F.when(F.col("id") % 11 == 0, 500).otherwise(10))
    rows = rows.withColumn("after", F.lit("1996-01-01")).withColumn("before", F.when(F.col("id") % 7 == 0, "1995-01-01").otherwise("1997-01-01"))
    given = F.when(F.col("id") % 13 == 0, F.array(F.lit("company"), F.lit("salary"))).otherwise(F.array(F.lit("company")))
    blank = F.when(F.col("id") % 17 == 0, "  ").when(F.col("id") % 3 == 0, F.col("title"))
    problem = O.filter_problem(F.col("kind"), F.col("after"), F.col("before"), F.col("limit"), texts=[F.col("company"), blank], arguments=given, known=["company", "title", "kind", "after", "before", "limit"])
    return rows.select("id", problem.alias("verdict"))


#: Expected and actual filters by order: one of six ways in which they agree or not.
_WANTED = """SELECT o_orderkey AS id, 'recruitment_type' AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'unheard of' ELSE '校招' END AS v FROM orders
UNION ALL SELECT o_orderkey, 'location', concat('Bei jing', CASE WHEN o_orderkey % 2 = 0 THEN '市' ELSE '' END) FROM orders
UNION ALL SELECT o_orderkey, 'job_title', CASE WHEN o_orderkey % 3 = 0 THEN concat('J', o_orderkey) ELSE 'Data Engineer' END FROM orders
UNION ALL SELECT o_orderkey, 'company', o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 'limit', CASE WHEN o_orderkey % 5 = 0 THEN '20' ELSE '10' END FROM orders"""
_GIVEN = """SELECT o_orderkey AS id, 'recruitment_type' AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'unheard of' WHEN o_orderkey % 11 = 0 THEN 'intern' ELSE ' Campus ' END AS v FROM orders
UNION ALL SELECT o_orderkey, 'location', CASE WHEN o_orderkey % 13 = 0 THEN 'beijing' ELSE 'Beijing 市' END FROM orders
UNION ALL SELECT o_orderkey, 'job_title', CASE WHEN o_orderkey % 3 = 0 THEN concat('the j', o_orderkey, ' job') WHEN o_orderkey % 17 = 0 THEN 'Senior data engineer' ELSE 'DATA ENGINEER' END FROM orders
UNION ALL SELECT o_orderkey, 'company', CASE WHEN o_orderkey % 6 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END FROM orders"""


@query("""SELECT o_orderkey AS id, o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 17 <> 0) AND (o_orderkey % 6 <> 0 OR lower(o_orderpriority) = o_orderpriority) AND o_orderkey % 5 <> 0 AS retained FROM orders""")
def constraints_retained(spark, sf):
    return O.constraints_retained(sql(spark, sf, _WANTED, "orders"), sql(spark, sf, _GIVEN, "orders"))


@query("""WITH cur AS (SELECT user_id, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1), r AS (SELECT user_id, event_type, arg_max(event_id, event_id) FILTER (WHERE event_id % 4 <> 0) AS event_id FROM events GROUP BY 1, 2)
SELECT r.user_id, r.event_id, sha256(r.event_type) AS sha FROM r JOIN cur ON cur.user_id = r.user_id AND cur.kind = r.event_type WHERE r.event_id IS NOT NULL""")
def current_records(spark, sf):
    """Every event is a snapshot's observation; all but each fourth also make a record of it."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("source"), F.sha2("event_type", 256).alias("sha"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    found = O.both_current(e.filter("seq % 4 <> 0").select("source", "sha", "seq"), snapshot_versions(e))
    return found.select(F.col("source").alias("user_id"), F.col("seq").alias("event_id"), "sha")


_CITED = """SELECT doc_id AS answer, doc_id % 3 AS claim, 0 AS ordinal, CASE WHEN doc_id % 7 = 0 THEN doc_id + 1000000 ELSE doc_id END AS evidence_id,
  CASE WHEN doc_id % 13 = 0 THEN concat(substring(text, 20, 20), '~', substring(text, 40, 20)) ELSE concat(' ', substring(text, 20, 20), '  ', substring(text, 40, 20)) END AS quote FROM documents
UNION ALL SELECT doc_id, doc_id % 3, 1, doc_id, substring(text, 20, 40) FROM documents WHERE doc_id % 11 = 0"""
_QK = lambda c: f"replace(lower(regexp_replace({c}, '{W}', '', 'g')), 'ß', 'ss')"


@query(f"""WITH c AS ({_CITED}), n AS (SELECT c.*, d.text, row_number() OVER (PARTITION BY answer, claim, evidence_id ORDER BY ordinal) AS n FROM c LEFT JOIN documents d ON d.doc_id = c.evidence_id)
SELECT answer, claim, ordinal, CASE WHEN n > 1 THEN 'duplicate' WHEN text IS NULL THEN 'outside-evidence' WHEN NOT contains({_QK('text')}, {_QK('quote')}) THEN 'quote-not-found' END AS issue FROM n""")
def citation_check(spark, sf):
    docs = table(spark, sf, "documents")
    cited = sql(spark, sf, _CITED, "documents")
    return O.citation_issues(cited, docs.select(F.col("doc_id").alias("evidence_id"), "text"), ["answer", "claim"]).select("answer", "claim", "ordinal", "issue")


@query(f"""WITH c AS ({_CITED}) SELECT answer AS record, concat('fact_', claim) AS field, ordinal, CASE WHEN text IS NULL THEN 'outside-evidence' WHEN NOT contains({_QK('text')}, {_QK('quote')}) THEN 'quote-not-found' END AS issue FROM c LEFT JOIN documents d ON d.doc_id = c.evidence_id""")
def fact_grounding(spark, sf):
    docs = table(spark, sf, "documents")
    cited = sql(spark, sf, _CITED, "documents")
    checked = O.citation_issues(cited, docs.select(F.col("doc_id").alias("evidence_id"), "text"))
    return checked.select(F.col("answer").alias("record"), F.concat(F.lit("fact_"), "claim").alias("field"), "ordinal", "issue")


@query("""WITH c AS (SELECT l.doc_id AS record, sha256(d.text) AS snapshot, CASE WHEN l.doc_id % 7 = 0 THEN l.doc_id + 1 ELSE l.doc_id END AS evidence_id FROM labels l JOIN documents d USING (doc_id))
SELECT record, evidence_id FROM c WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = c.evidence_id AND sha256(d.text) = c.snapshot)""")
def citation_lineage(spark, sf):
    """A record's snapshot is its document's content; each seventh cites the next document's evidence."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("snapshot"))
    cited = F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    citations = table(spark, sf, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("record"), "snapshot", cited.alias("evidence_id"))
    return O.unlinked_citations(citations, docs.select("snapshot", F.col("doc_id").alias("evidence_id"))).select("record", "evidence_id")


_LABEL = "CASE WHEN toxic = 1 THEN 'uncertain' WHEN quality = 1 THEN 'supported' ELSE 'unsupported' END"


@query(f"""WITH j AS (SELECT doc_id // 5 AS record, {_LABEL} AS label FROM labels), s AS (SELECT record, count(*) FILTER (WHERE label = 'supported') AS supported, count(*) FILTER (WHERE label = 'unsupported') AS unsupported, count(*) FILTER (WHERE label = 'uncertain') AS uncertain FROM j GROUP BY 1)
SELECT record, CASE WHEN record % 9 = 4 THEN 0 ELSE supported END AS supported, CASE WHEN record % 9 = 4 THEN 0 ELSE unsupported END AS unsupported, CASE WHEN record % 9 = 4 THEN 0 ELSE uncertain END AS uncertain,
  CASE WHEN record % 9 = 4 THEN 'grounding_failed' WHEN unsupported > 0 THEN 'semantic_validation_failed' WHEN uncertain > 0 THEN 'manual_review_required' ELSE 'accepted' END AS status FROM s""")
def fact_support(spark, sf):
    """Five labels make a record; of each ninth record, one citation isn't grounded."""
    label = F.when(F.col("toxic") == 1, "uncertain").when(F.col("quality") == 1, "supported").otherwise("unsupported")
    judged = table(spark, sf, "labels").select("doc_id", F.floor(F.col("doc_id") / 5).cast("long").alias("record"), label.alias("label"))
    last = judged.groupBy("record").agg(F.max("doc_id").alias("doc_id"))
    grounding = judged.select("record", "doc_id").join(last.withColumn("last", F.lit(True)), ["record", "doc_id"], "left")
    return O.record_support(judged, grounding.select("record", (F.col("last").isNull() | (F.col("record") % 9 != 4)).alias("valid")))


@query(f"""WITH j AS (SELECT doc_id % 40 AS answer, CASE WHEN doc_id % 13 = 5 THEN 'insufficient_context' ELSE {_LABEL} END AS label FROM labels)
SELECT answer, count(*) AS claims, count(*) FILTER (WHERE label = 'insufficient_context') AS unjudged, round(count(*) FILTER (WHERE label = 'supported') / count(*), 6) AS support_rate, count(*) FILTER (WHERE label <> 'supported') > 0 AS needs_review FROM j GROUP BY 1""")
def claim_support(spark, sf):
    """Claims cite two chunks; of each thirteenth, neither is at hand, so it isn't judged."""
    label = F.when(F.col("toxic") == 1, "uncertain").when(F.col("quality") == 1, "supported").otherwise("unsupported")
    rows = table(spark, sf, "labels").select((F.col("doc_id") % 40).alias("answer"), F.col("doc_id").alias("claim"), label.alias("label"), F.when(F.col("doc_id") % 13 == 5, 0).otherwise(2).alias("evidence"))
    return O.answer_support(rows.drop("label"), rows.filter("evidence > 0").drop("evidence"))


@query("""WITH v AS (SELECT user_id AS snapshot, event_type AS record, event_id AS seq, user_id % 10 <> 0 AS ok FROM events),
l AS (SELECT *, lag(CASE WHEN ok THEN record END) OVER (PARTITION BY snapshot ORDER BY seq) AS b, row_number() OVER (PARTITION BY snapshot ORDER BY seq DESC) = 1 AS last FROM v)
SELECT snapshot, record, seq, CASE WHEN NOT ok THEN 'stale-snapshot' WHEN coalesce(b = record, false) THEN 'unchanged' ELSE 'activated' END AS outcome, CASE WHEN ok THEN b END AS previous, last AND ok AS is_active FROM l""")
def record_activation(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("snapshot"), F.col("event_type").alias("record"), F.col("event_id").alias("seq"))
    return O.activation(e, e.select("snapshot").filter("snapshot % 10 <> 0"))


@query(f"""WITH {DUCK_FACTS}, s AS (SELECT 'job' AS section, id, concat(title, ' at ', company) AS heading, concat('type: ', coalesce(kind, 'not stated'), '; deadline: ', coalesce(strftime(deadline, '%Y-%m-%d'), 'not stated')) AS body, CASE WHEN id % 23 <> 0 THEN concat('order-', id) END AS cited, true AS grounded FROM recs
UNION ALL SELECT 'claim', item_id, 'claim', text, concat('item-', item_id), item_id % 6 <> 0 FROM benchmark)
SELECT section, id, heading, body, cited, CASE WHEN cited IS NULL THEN 'missing-source' WHEN NOT grounded THEN 'invalid-grounding' WHEN id % 31 = 0 THEN 'outside-scope' END AS problem FROM s""")
def report_rows(spark, sf):
    jobs = records(spark, sf).withColumn("evidence_id", F.when(F.col("id") % 23 != 0, F.concat(F.lit("order-"), "id")))
    claims = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text", F.concat(F.lit("item-"), "item_id").alias("evidence_id"), (F.col("item_id") % 6 != 0).alias("grounded"))
    scope = jobs.select("id", "evidence_id").unionByName(claims.select("id", "evidence_id")).filter("id % 31 <> 0").select("evidence_id")
    return O.report_rows(jobs, claims, scope)


_HOST = "rtrim(regexp_extract(lower(trim(url)), '^https?://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.')"
#: The registry: registrable names (last two labels) of the hosts, one company for each first label; every 5th revoked later.
DUCK_REGISTRY = f"""hosts AS (SELECT page_id, url, {_HOST} AS host FROM pages), own AS (SELECT page_id, url, host, string_split(host, '.') AS l FROM hosts),
named AS (SELECT page_id, url, host, concat(l[-2], '.', l[-1]) AS domain, l[-3] AS company FROM own),
reg0 AS (SELECT concat(company, '.', domain) AS domain, company, min(page_id) AS id FROM named GROUP BY 1, 2),
reg AS (SELECT domain, company, id, 1 AS version, 'active' AS status FROM reg0 UNION ALL SELECT domain, company, id, 2, 'revoked' FROM reg0 WHERE id % 5 = 0),
cur AS (SELECT domain, company, id FROM (SELECT *, row_number() OVER (PARTITION BY company, domain ORDER BY version DESC, id) AS n FROM reg) WHERE n = 1 AND status = 'active')"""


def _pages(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", "url", T.host(F.col("url")).alias("host")).withColumn("labels", F.split("host", r"\."))
    at = lambda i: F.try_element_at("labels", F.lit(i))
    return rows.select("page_id", "url", "host", "labels", F.concat(at(-2), F.lit("."), at(-1)).alias("domain"), at(-3).alias("company"))


def _registry(spark, sf):
    base = _pages(spark, sf).select(F.concat("company", F.lit("."), "domain").alias("domain"), "company", "page_id").groupBy("domain", "company").agg(F.min("page_id").alias("id"))
    log = base.withColumns({"version": F.lit(1), "status": F.lit("active")}).unionByName(base.filter("id % 5 = 0").withColumns({"version": F.lit(2), "status": F.lit("revoked")}))
    return S.registry_current(log)


@query(f"WITH {DUCK_REGISTRY} SELECT domain, company, id FROM cur")
def registry_current(spark, sf):
    return _registry(spark, sf)


def _matches(spark, sf):
    return S.domain_matches(_pages(spark, sf), _registry(spark, sf))


def _official(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", (F.col("page_id") % 3 != 0).alias("official"))


_DUCK_MATCHES = f"{DUCK_REGISTRY}, m AS (SELECT n.page_id, arg_min(c.domain, c.id) AS matched FROM named n JOIN cur c ON c.company = n.company AND (n.host = c.domain OR ends_with(n.host, '.' || c.domain)) GROUP BY 1)"


@query(f"WITH {_DUCK_MATCHES} SELECT * FROM m")
def domain_match(spark, sf):
    return _matches(spark, sf)


@query(f"""WITH {_DUCK_MATCHES} SELECT CASE WHEN p.page_id % 3 = 0 THEN 'not_applicable' WHEN m.matched IS NULL THEN 'unverified' ELSE 'verified' END AS verdict, count(*) AS pages, count(DISTINCT m.matched) AS domains FROM pages p LEFT JOIN m USING (page_id) GROUP BY 1""")
def source_audit(spark, sf):
    audited = S.source_audit(_official(spark, sf), _matches(spark, sf))
    return audited.groupBy("verdict").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("matched").alias("domains"))


@query(f"""WITH {_DUCK_MATCHES} SELECT p.page_id, array_to_string(list_filter([CASE WHEN m.matched IS NULL THEN 'ownership-unverified' END, CASE WHEN p.page_id % 3 = 0 THEN 'cross-check-required' END, CASE WHEN NOT starts_with(lower(p.url), 'https://') THEN 'not-https' END, 'freshness-unverified'], lambda x: x IS NOT NULL), ',') AS reasons, true AS manual_review FROM pages p LEFT JOIN m USING (page_id)""")
def source_assessment(spark, sf):
    return S.source_assessment(_official(spark, sf), _matches(spark, sf)).withColumn("reasons", F.array_join("reasons", ","))


@query(f"WITH {DUCK_REGISTRY} SELECT page_id, host, domain, coalesce(company, '') AS company FROM named")
def company_domain_keys(spark, sf):
    return _pages(spark, sf).select("page_id", F.col("host"), T.domain_key(F.concat("domain", F.lit(".."))).alias("domain"), F.coalesce(T.company_key(F.concat(F.lit(" "), "company")), F.lit("")).alias("company"))


@query("SELECT s_suppkey, sha256(concat_ws(chr(31), lower(s_name), concat('s', s_suppkey, '.example.com'), concat('ref-', s_nationkey), '2024-01-01', 'reviewer', CASE WHEN s_suppkey % 5 = 0 THEN 'revoked' ELSE 'active' END)) AS fingerprint FROM supplier")
def domain_fingerprint(spark, sf):
    domain = T.domain_key(F.concat(F.lit("S"), "s_suppkey", F.lit(".Example.com.")))
    parts = [T.company_key(F.col("s_name")), domain, F.concat(F.lit("ref-"), "s_nationkey"), F.lit("2024-01-01"), F.lit("reviewer"), F.when(F.col("s_suppkey") % 5 == 0, "revoked").otherwise("active")]
    return table(spark, sf, "supplier").select("s_suppkey", S.domain_fingerprint(*parts).alias("fingerprint"))


@query("SELECT page_id, code, retryable, action FROM (SELECT page_id, CASE WHEN length(html) < 1500 THEN 'no-extractable-content' WHEN page_id % 17 = 0 THEN 'document-read-failed' END AS code FROM pages) JOIN (VALUES ('no-extractable-content', false, 'use-fallback-extractor-or-manual-review'), ('document-read-failed', true, 'retry-source-read')) f(code, retryable, action) USING (code)")
def parse_failures(spark, sf):
    from ..sources.failures import FAILURES, failure_table

    code = F.when(F.length("html") < 1500, "no-extractable-content").when(F.col("page_id") % 17 == 0, "document-read-failed")
    assert {"no-extractable-content", "document-read-failed"} <= {f[0] for f in FAILURES}
    return table(spark, sf, "pages").select("page_id", code.alias("code")).join(F.broadcast(failure_table(spark)), "code").select("page_id", "code", "retryable", "action")
