"""Queries of evaluation: comparisons, intervals, answers, tool calls, recognition, page fragments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decoding as D
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..operators.chunking import ordered_digest
from ..sources.scratch import written
from .base import qrels_of, query, sql, table
from .retrieval import DUCK_HYBRID, _duck_metrics, _hybrid_branches

_RUNS = f"{DUCK_HYBRID}, {_duck_metrics('(SELECT * FROM hbmr)', 5, 'b')}, {_duck_metrics('fusr', 5, 'h')}"


def _two_runs(spark, sf):
    """RR at 5 of BM25 alone and of the fusion, for the queries that have gold documents."""
    lexical, dense = _hybrid_branches(spark, sf)
    lexical = written(lexical, "lexical")  # a top-k, read twice
    judged, fused = qrels_of(spark, sf), R.rrf_fuse({"bm25": lexical, "dense": dense})
    return R.retrieval_metrics(lexical, judged, 5), R.retrieval_metrics(fused, judged, 5), judged


@query(f"WITH {_RUNS} SELECT query, round(b.rr, 6) AS baseline, round(h.rr, 6) AS candidate, round(h.rr - b.rr, 6) AS delta, CASE WHEN h.rr > b.rr THEN 'improved' WHEN h.rr < b.rr THEN 'regressed' ELSE 'unchanged' END AS change FROM b JOIN h USING (query)")
def report_compare(spark, sf):
    lexical, fused, _ = _two_runs(spark, sf)
    rows = E.report_compare(lexical, fused, "query", "rr")
    return rows.select("query", *[F.round(c, 6).alias(c) for c in ("baseline", "candidate", "delta")], "change")


_DRAW = "('0x' || substr(md5(concat_ws('|', '{seed}', sample, i)), 1, 8))::BIGINT"


def _duck_resample(groups: str, seed: str, b: int) -> str:
    return f"""g AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS k, count(*) OVER () AS size FROM ({groups})),
draws AS (SELECT sample, {_DRAW.format(seed=seed)} % (SELECT max(size) FROM g) AS k FROM range({b}) s(sample), range((SELECT max(size) FROM g)) t(i)),
rs AS (SELECT sample, sum(diff) AS diff, sum(n) AS n FROM draws JOIN g USING (k) GROUP BY sample)"""


PAIRED, CLUSTERED = 20_000, 10_000


@query(f"WITH {_RUNS}, {_duck_resample('SELECT query AS key, h.rr - b.rr AS diff, 1.0 AS n FROM b JOIN h USING (query)', 'paired', PAIRED)} SELECT count(*) AS resamples, round(quantile_cont(diff / n, 0.025), 5) AS low, round(quantile_cont(diff / n, 0.975), 5) AS high FROM rs")
def paired_bootstrap(spark, sf):
    lexical, fused, _ = _two_runs(spark, sf)
    groups = E.report_compare(lexical, fused, "query", "rr").select(F.col("query").alias("key"), F.col("delta").alias("diff"), F.lit(1.0).alias("n"))
    rows = E.resampled(groups, PAIRED, "paired").withColumn("mean", F.col("diff") / F.col("n"))
    p = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))  # of as many numbers as there are resamples
    return rows.agg(F.count(F.lit(1)).alias("resamples"), F.round(p[0], 5).alias("low"), F.round(p[1], 5).alias("high"))


@query(f"WITH {_RUNS}, src AS (SELECT query, min(source) AS source FROM qrels JOIN documents ON doc_id = id GROUP BY query), {_duck_resample('SELECT source AS key, sum(h.rr - b.rr) AS diff, count(*)::DOUBLE AS n FROM b JOIN h USING (query) JOIN src USING (query) GROUP BY source', 'cluster', CLUSTERED)}, o AS (SELECT diff / n AS mean, row_number() OVER (ORDER BY diff / n) - 1 AS place FROM rs) SELECT round(max(mean) FILTER (WHERE place = 249), 5) AS low, round(max(mean) FILTER (WHERE place = 9749), 5) AS high FROM o")
def cluster_bootstrap(spark, sf):
    lexical, fused, judged = _two_runs(spark, sf)
    sources = judged.join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source"), "id").groupBy("query").agg(F.min("source").alias("key"))
    groups = E.report_compare(lexical, fused, "query", "rr").join(sources, "query").groupBy("key").agg(F.sum("delta").alias("diff"), F.count(F.lit(1)).cast("double").alias("n"))
    means = E.resampled(groups, CLUSTERED, "cluster").agg(F.sort_array(F.collect_list(F.col("diff") / F.col("n"))).alias("m"))  # as many numbers as resamples
    return means.select(F.round(F.get("m", F.lit(249)), 5).alias("low"), F.round(F.get("m", F.lit(9749)), 5).alias("high"))


@query("""SELECT event_type, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, min(value) AS least, max(value) AS most, count(*) FILTER (WHERE user_id % 7 <> 0) AS succeeded, count(*) FILTER (WHERE user_id % 7 = 0) AS failed,
round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS throughput FROM events GROUP BY event_type""")
def latency_summary(spark, sf):
    return E.latency_summary(table(spark, sf, "events").withColumns({"failed": F.col("user_id") % 7 == 0, "started": F.col("ts")}), ["event_type"])


#: One text for both engines: planned calls and what was expected, with the argument k as text.
_CALLS = """SELECT event_id AS case_id, user_id % 2 AS run, CASE WHEN event_type = 'error' THEN 'refuse' ELSE 'call_tool' END AS expected_decision, CASE WHEN event_id % 17 = 0 THEN 'refuse' ELSE 'call_tool' END AS actual_decision,
CASE WHEN event_type <> 'error' THEN event_type END AS expected_tool, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 9 = 0 THEN 'click' ELSE event_type END AS actual_tool, {k} AS k, CASE WHEN event_id % 5 = 0 THEN concat(' ', {k}, ' ') WHEN event_id % 11 = 0 THEN 'x' ELSE {k} END AS given,
value AS latency, CASE WHEN event_id % 13 <> 0 THEN CAST({k} AS BIGINT) END AS tokens, event_id % 19 = 0 AS failed FROM events"""
_DUCK_CALLS = "calls AS (" + _CALLS.format(k="json_extract_string(props, '$.k')") + """), marks AS (SELECT *, NOT failed AND expected_decision = actual_decision AS decision, NOT failed AND expected_decision = 'call_tool' AND coalesce(expected_tool = actual_tool, false) AS tool,
  CASE WHEN expected_tool = 'click' THEN trim(k) = trim(given) ELSE k = given END AS same FROM calls),
tm AS (SELECT run, count(*) AS cases, round(count(*) FILTER (WHERE decision) / count(*), 6) AS decision_accuracy, round(count(*) FILTER (WHERE tool) / nullif(count(*) FILTER (WHERE expected_decision = 'call_tool'), 0), 6) AS tool_accuracy,
round(count(*) FILTER (WHERE tool AND same) / nullif(count(*) FILTER (WHERE expected_decision = 'call_tool'), 0), 6) AS arguments_accuracy,
round(count(*) FILTER (WHERE CASE WHEN expected_decision = 'call_tool' THEN decision AND tool AND same ELSE decision AND actual_tool IS NULL END) / count(*), 6) AS case_accuracy,
count(*) FILTER (WHERE failed) AS failed_calls, round(avg(latency), 6) AS mean_latency, coalesce(sum(tokens), 0)::BIGINT AS tokens, count(*) FILTER (WHERE tokens IS NULL) AS usage_unavailable FROM marks GROUP BY run)"""
#: A click's argument counts without blanks around it, and must be a number.
_NORMALIZERS = {"click": lambda m: F.when(F.trim(m["k"]).rlike("^[0-9]+$"), F.transform_values(m, lambda k, v: F.trim(v)))}


def _calls(spark, sf):
    calls = sql(spark, sf, _CALLS.format(k="get_json_object(props, '$.k')"), "events")
    return calls.withColumns({"expected_arguments": F.create_map(F.lit("k"), "k"), "actual_arguments": F.create_map(F.lit("k"), "given")}).drop("k", "given")


def _tool_metrics(spark, sf):
    return E.tool_call_metrics(_calls(spark, sf), ["run"], _NORMALIZERS)


@query(f"WITH {_DUCK_CALLS} SELECT * FROM tm")
def tool_call_metrics(spark, sf):
    return _tool_metrics(spark, sf)


@query(f"""WITH {_DUCK_CALLS} SELECT run, 'case-accuracy-below-minimum' AS code, case_accuracy AS actual, 0.8::DOUBLE AS threshold FROM tm WHERE case_accuracy < 0.8
UNION ALL SELECT run, 'failed-model-calls-above-maximum', failed_calls, 0 FROM tm WHERE failed_calls > 0 UNION ALL SELECT run, 'latency-above-maximum', mean_latency, 5 FROM tm WHERE mean_latency > 5
UNION ALL SELECT run, 'usage-unavailable-above-maximum', usage_unavailable, 0 FROM tm WHERE usage_unavailable > 0 UNION ALL SELECT run, 'tokens-per-call-above-maximum', tokens_per_call, 40 FROM (SELECT *, round(tokens / nullif(cases - usage_unavailable, 0), 6) AS tokens_per_call FROM tm) WHERE tokens_per_call > 40""")
def quality_gate(spark, sf):
    m = _tool_metrics(spark, sf).withColumn("tokens_per_call", F.round(F.try_divide(F.col("tokens"), F.col("cases") - F.col("usage_unavailable")), 6))
    rules = {"case-accuracy-below-minimum": ("case_accuracy", "<", 0.8), "failed-model-calls-above-maximum": ("failed_calls", ">", 0), "latency-above-maximum": ("mean_latency", ">", 5), "usage-unavailable-above-maximum": ("usage_unavailable", ">", 0), "tokens-per-call-above-maximum": ("tokens_per_call", ">", 40)}
    return E.quality_gate(m, rules).select("run", "code", "actual", "threshold")


@query(f"""WITH {_DUCK_CALLS}, c AS (SELECT case_id % 5000 AS case_id, expected_decision = 'call_tool' AS call, expected_tool, given FROM calls)
SELECT count(*) AS cases, count(*) FILTER (WHERE call) AS call_tool_cases, count(*) FILTER (WHERE NOT call) AS refusal_cases, count(*) - count(DISTINCT case_id) AS repeated_ids, count(*) FILTER (WHERE call AND expected_tool NOT IN ('click', 'view', 'purchase')) AS unregistered_tools,
count(*) FILTER (WHERE call AND expected_tool = 'click' AND NOT regexp_matches(trim(given), '^[0-9]+$')) AS invalid_arguments FROM c""")
def tool_case_preflight(spark, sf):
    tools = spark.createDataFrame([("click",), ("view",), ("purchase",)], "tool string")
    cases = _calls(spark, sf).withColumn("case_id", F.col("case_id") % 5000).withColumn("expected_arguments", F.col("actual_arguments"))
    return E.tool_case_preflight(cases, tools, _NORMALIZERS)


@query("""WITH a AS (SELECT user_id AS run, CASE WHEN event_type = 'error' THEN 'insufficient_evidence' ELSE 'answered' END AS expected, CASE WHEN event_id % 6 = 0 THEN 'insufficient_evidence' ELSE 'answered' END AS actual, event_id % 10 <> 1 AS grounded, event_id % 4 <> 0 AS model_called FROM events)
SELECT run, round(avg(CASE WHEN expected = actual THEN 1.0 ELSE 0 END), 6) AS status_accuracy, round(coalesce(avg(CASE WHEN expected = actual THEN 1.0 ELSE 0 END) FILTER (WHERE expected = 'answered'), 0), 6) AS answered_accuracy,
round(coalesce(avg(CASE WHEN expected = actual THEN 1.0 ELSE 0 END) FILTER (WHERE expected <> 'answered'), 0), 6) AS refusal_accuracy, round(coalesce(avg(CASE WHEN grounded THEN 1.0 ELSE 0 END) FILTER (WHERE actual = 'answered'), 0), 6) AS grounding_pass_rate,
round(avg(CASE WHEN model_called THEN 1.0 ELSE 0 END), 6) AS model_call_rate FROM a GROUP BY run""")
def answer_metrics(spark, sf):
    e = table(spark, sf, "events")
    kind = lambda c: F.when(c, "insufficient_evidence").otherwise("answered")
    answers = e.select(F.col("user_id").alias("run"), kind(F.col("event_type") == "error").alias("expected"), kind(F.col("event_id") % 6 == 0).alias("actual"), (F.col("event_id") % 10 != 1).alias("grounded"), (F.col("event_id") % 4 != 0).alias("model_called"))
    return E.answer_metrics(answers, ["run"])


#: Gold sets of a hundred labels: some provisional, some of another tokenizer or chunker, some judged on another text.
_GOLD = """SELECT concat('set-', CAST(floor(doc_id / 100) AS BIGINT)) AS dataset_id, CASE WHEN floor(doc_id / 100) % 4 = 1 THEN 'provisional' ELSE 'final' END AS status, CASE WHEN floor(doc_id / 100) % 5 = 2 THEN 'tok-0' ELSE 'tok-1' END AS tokenizer_version,
CASE WHEN floor(doc_id / 100) % 3 = 1 THEN 'chunk-0' ELSE 'chunk-1' END AS chunker_version, {sha} AS document_sha256, doc_id AS id FROM labels JOIN documents USING (doc_id)"""


@query("WITH g AS (" + _GOLD.format(sha="sha256(CASE WHEN doc_id % 41 = 7 THEN text || 'x' ELSE text END)") + """), c AS (SELECT doc_id AS id, sha256(text) AS sha FROM documents WHERE doc_id % 50 <> 3),
r AS (SELECT dataset_id, unnest(list_filter([CASE WHEN status = 'provisional' THEN 'provisional' END, CASE WHEN tokenizer_version <> 'tok-1' THEN 'tokenizer-version' END, CASE WHEN chunker_version <> 'chunk-1' THEN 'chunker-version' END, CASE WHEN sha IS NULL THEN 'outside-corpus' END,
  CASE WHEN sha <> document_sha256 THEN 'wrong-document-hash' END], lambda x: x IS NOT NULL)) AS problem FROM g LEFT JOIN c USING (id)) SELECT dataset_id, problem, count(*) AS cases FROM r GROUP BY 1, 2""")
def evaluation_guard(spark, sf):
    gold = sql(spark, sf, _GOLD.format(sha="sha2(CASE WHEN doc_id % 41 = 7 THEN concat(text, 'x') ELSE text END, 256)"), "labels", "documents")
    corpus = table(spark, sf, "documents").filter("doc_id % 50 <> 3").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("document_sha256"))
    return E.evaluation_problems(gold, corpus, tokenizer="tok-1", chunker="chunk-1")


@query("""WITH r AS (SELECT user_id AS run, user_id % 3 AS model, user_id % 2 AS prompt, user_id // 30 AS dataset FROM (SELECT DISTINCT user_id FROM events))
SELECT a.run AS baseline, b.run AS candidate, CASE WHEN a.model <> b.model AND a.prompt <> b.prompt THEN 'rejected' WHEN a.model <> b.model THEN 'model' WHEN a.prompt <> b.prompt THEN 'prompt' ELSE 'repeatability' END AS axis FROM r a JOIN r b ON a.dataset = b.dataset AND b.run > a.run""")
def experiment_axis(spark, sf):
    r = table(spark, sf, "events").select(F.col("user_id").alias("run")).distinct()
    return E.experiment_axes(r.select("run", (F.col("run") % 3).alias("model"), (F.col("run") % 2).alias("prompt"), F.floor(F.col("run") / 30).alias("dataset")))


# What is recognized: whole texts in ASCII, every third with each e and o misread. As no c or 0 can stand for an e or o
# elsewhere, such a pair is as many edits apart as it has e and o, and as many words as hold one.
_OCR = "SELECT doc_id, lang, trim(regexp_replace(regexp_replace(text, '[^ -~]', ''{g}), ' +', ' '{g})) AS expected FROM documents"
_WORDS = lambda c: f"list_filter(string_split({c}, ' '), lambda w: w <> '')"
_DUCK_OCR = "e AS (" + _OCR.format(g=", 'g'") + f"""), o AS (SELECT doc_id, lang, doc_id % 3 = 0 AS misread, CASE WHEN doc_id % 3 = 0 THEN length(expected) - length(regexp_replace(expected, '[eo]', '', 'g')) ELSE 0 END AS char_edits, length(expected) AS chars, len({_WORDS('expected')}) AS words,
  CASE WHEN doc_id % 3 = 0 THEN len(list_filter({_WORDS('expected')}, lambda w: regexp_matches(w, '[eo]'))) ELSE 0 END AS word_edits, doc_id % 3 <> 0 OR NOT regexp_matches(expected, '[eo]') AS exact FROM e WHERE expected <> '')"""


def _ocr(spark, sf):
    e = sql(spark, sf, _OCR.format(g=""), "documents")
    return E.ocr_error_rates(e.withColumn("actual", F.when(F.col("doc_id") % 3 == 0, F.translate("expected", "eo", "c0")).otherwise(F.col("expected"))))


@query(f"WITH {_DUCK_OCR} SELECT doc_id, exact, char_edits::INT AS char_edits, word_edits::INT AS word_edits, round(char_edits / chars, 6) AS cer, round(word_edits / words, 6) AS wer FROM o")
def ocr_error_rates(spark, sf):
    return _ocr(spark, sf).select("doc_id", "exact", "char_edits", "word_edits", F.round("cer", 6).alias("cer"), F.round("wer", 6).alias("wer"))


@query(f"""WITH {_DUCK_OCR}, h AS (SELECT 'ocr_dataset_' || sha256(string_agg(doc_id || ':' || sha256(expected), ',' ORDER BY doc_id)) AS dataset FROM e WHERE expected <> '')
SELECT dataset, 'translate-eo' AS recognizer, count(*) AS cases, round(avg(CASE WHEN exact THEN 1.0 ELSE 0 END), 6) AS exact_rate, round(avg(char_edits / chars), 6) AS macro_cer, round(sum(char_edits) / sum(chars), 6) AS micro_cer, round(avg(word_edits / words), 6) AS macro_wer, round(sum(word_edits) / sum(words), 6) AS micro_wer FROM o, h GROUP BY dataset""")
def ocr_batch(spark, sf):
    rates = written(_ocr(spark, sf), "rates")
    cases = rates.select("doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("expected", 256)).alias("item"))
    digest = ordered_digest(cases, "item", "doc_id").select(F.concat(F.lit("ocr_dataset_"), "digest").alias("dataset"), F.lit("translate-eo").alias("recognizer"))
    return E.ocr_batch(rates).crossJoin(F.broadcast(digest))  # one row each


@query(f"WITH {_DUCK_OCR}, f AS (SELECT coalesce(lang, 'none') AS field, exact, doc_id % 4 = 0 AS critical FROM o) SELECT coalesce(field, 'all') AS field, count(*) AS fields, round(avg(CASE WHEN exact THEN 1.0 ELSE 0 END), 6) AS exact_rate, round(avg(CASE WHEN exact THEN 1.0 ELSE 0 END) FILTER (WHERE critical), 6) AS critical_rate FROM f GROUP BY GROUPING SETS ((field), ())")
def ocr_fields(spark, sf):
    fields = _ocr(spark, sf).select(F.col("doc_id").alias("case_id"), F.coalesce("lang", F.lit("none")).alias("field"), "exact", (F.col("doc_id") % 4 == 0).alias("critical"))
    return E.ocr_fields(fields).withColumn("field", F.coalesce("field", F.lit("all")))


_JUDGED = "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'not json' WHEN doc_id % 7 = 0 THEN '{\"label\":\"maybe\",\"rationale\":\"x\"}' WHEN doc_id % 5 = 0 THEN '{\"label\":\"supported\",\"rationale\":\" \"}' WHEN quality = 1 THEN '{\"label\":\"supported\",\"rationale\":\"seen\"}' ELSE '{\"label\":\"unsupported\",\"rationale\":\"not seen\"}' END AS answer FROM labels"


@query(f"""WITH j AS ({_JUDGED}) SELECT doc_id, CASE WHEN NOT json_valid(answer) THEN 'invalid-json' WHEN json_extract_string(answer, '$.label') NOT IN ('supported', 'unsupported', 'uncertain') THEN 'invalid-label' WHEN trim(json_extract_string(answer, '$.rationale')) = '' THEN 'blank-rationale' ELSE 'valid' END AS status FROM j""")
def judgment_decode(spark, sf):
    return sql(spark, sf, _JUDGED, "labels").select("doc_id", D.judgment_status(F.col("answer")).alias("status"))


_ANSWERS = "SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN '' WHEN conv_id % 7 = 0 THEN 'oops' WHEN turn % 3 = 0 THEN '{\"status\":\"answered\",\"claims\":[{\"text\":\"a\",\"citations\":[\"e1\"]}],\"fallback\":null}' WHEN turn % 3 = 1 THEN '{\"status\":\"answered\",\"claims\":[],\"fallback\":null}' ELSE '{\"status\":\"insufficient_evidence\",\"claims\":[],\"fallback\":\"none\"}' END AS answer FROM conversations"


@query(f"""WITH a AS ({_ANSWERS}) SELECT conv_id, turn, CASE WHEN NOT json_valid(answer) OR answer = '' THEN 'invalid-answer-json' WHEN json_extract_string(answer, '$.status') = 'answered' AND json_array_length(answer, '$.claims') > 0 AND json_extract_string(answer, '$.fallback') IS NULL THEN 'answered'
WHEN json_extract_string(answer, '$.status') = 'insufficient_evidence' AND json_array_length(answer, '$.claims') = 0 AND json_extract_string(answer, '$.fallback') IS NOT NULL THEN 'refused' ELSE 'invalid-answer-contract' END AS status FROM a""")
def answer_decode(spark, sf):
    return sql(spark, sf, _ANSWERS, "conversations").select("conv_id", "turn", D.answer_status(F.col("answer")).alias("status"))


def _fragments(spark, sf):
    return E.html_fragments(table(spark, sf, "pages").select(F.col("page_id").alias("page"), "html"))


_TAGS = "'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'p', 'li'"
_DECODE = "regexp_replace(array_to_string(list(tok ORDER BY pos), ' '), '', '')"
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
    _DECODE = f"regexp_replace({_DECODE}, '{_e}?', '{_c}', 'g')"  # the semicolon may be missing, as in HTML


_DUCK_FRAGMENTS = f"""c AS (SELECT page_id AS page, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g'), '<[^>]*>|[^<]+') AS toks FROM pages),
t AS (SELECT page, unnest(range(len(toks))) AS pos, unnest(toks) AS tok FROM c),
r AS (SELECT *, lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, starts_with(tok, '<') AS is_tag, starts_with(tok, '</') AS closing FROM t),
b AS (SELECT *, sum(CASE WHEN is_tag AND NOT closing AND tag IN ({_TAGS}) THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY pos) AS block FROM r),
w AS (SELECT *, first_value(tag) OVER (PARTITION BY page, block ORDER BY pos) AS own FROM b WHERE block > 0),
x AS (SELECT *, max(CASE WHEN closing AND tag = own THEN 1 ELSE 0 END) OVER (PARTITION BY page, block ORDER BY pos) AS closed FROM w),
f AS (SELECT page, block, own AS tag, trim(regexp_replace({_DECODE}, '\\s+', ' ', 'g')) AS text FROM x WHERE NOT is_tag AND closed = 0 GROUP BY page, block, own),
o AS (SELECT page, (row_number() OVER (PARTITION BY page ORDER BY block) - 1)::INT AS ordinal, tag, CASE WHEN starts_with(tag, 'h') THEN substring(tag, 2, 1)::INT ELSE 0 END AS level, text FROM f WHERE text <> '')"""


@query(f"WITH {_DUCK_FRAGMENTS} SELECT page, ordinal, tag, md5(text) AS digest FROM o")
def html_fragments(spark, sf):
    return _fragments(spark, sf).select("page", "ordinal", "tag", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"""WITH RECURSIVE {_DUCK_FRAGMENTS}, p(page, ordinal, path) AS (SELECT page, ordinal, CASE WHEN level > 0 THEN [text] ELSE []::VARCHAR[] END FROM o WHERE ordinal = 0
UNION ALL SELECT o.page, o.ordinal, CASE WHEN level > 0 THEN list_append(list_slice(path, 1, level - 1), text) ELSE path END FROM p JOIN o ON o.page = p.page AND o.ordinal = p.ordinal + 1)
SELECT page, ordinal, array_to_string(path, ' > ') AS heading_path FROM p""")
def heading_path(spark, sf):
    blocks = _fragments(spark, sf).select("page", "ordinal", "level", "text")
    return E.heading_paths(blocks).select("page", "ordinal", F.array_join("heading_path", " > ").alias("heading_path"))
