"""Scores of runs: comparisons, intervals by resampling, tool calls, gates, recognition errors."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from itertools import groupby
from operator import itemgetter, ne

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.scratch import numbered


def report_compare(baseline: DataFrame, candidate: DataFrame, key: str, metric: str) -> DataFrame:
    """(key, baseline, candidate, delta, change) for each case of either run; change says which side lacks it, or how it moved."""
    a = baseline.select(F.col(key), F.col(metric).alias("baseline"))
    b = candidate.select(F.col(key), F.col(metric).alias("candidate"))
    delta = F.col("candidate") - F.col("baseline")
    change = F.when(F.col("baseline").isNull(), "only-candidate").when(F.col("candidate").isNull(), "only-baseline")
    change = change.when(delta > 0, "improved").when(delta < 0, "regressed").otherwise("unchanged")
    return a.join(b, key, "full").select(key, "baseline", "candidate", delta.alias("delta"), change.alias("change"))


def draw(seed: str, *parts: Column) -> Column:
    """A number of 32 bits from the MD5 of a seed and parts: the same on any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def resampled(groups: DataFrame, resamples: int, seed: str) -> DataFrame:
    """groups (key, diff, n) resampled with replacement: (sample, diff, n) sums of as many draws as there are groups.

    Groups are numbered in the order of their keys, and draws join them by number; sums are taken by sample with map-side
    combination, so neither the groups nor a sample's draws meet in one row.
    """
    spark = groups.sparkSession
    placed = numbered(groups.repartitionByRange("key").sortWithinPartitions("key"), "place")
    size = placed.count()
    draws = spark.range(resamples).select(F.col("id").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("i")) if size else spark.range(0).select(F.col("id").alias("sample"), F.lit(0).alias("i"))
    drawn = draws.select("sample", (draw(seed, F.col("sample").cast("string"), F.col("i").cast("string")) % F.lit(max(size, 1))).alias("place"))
    return drawn.join(placed, "place").groupBy("sample").agg(F.sum("diff").alias("diff"), F.sum("n").alias("n"))


def same_arguments(tool: Column, expected: Column, actual: Column, normalizers: dict[str, Callable[[Column], Column]]) -> Column:
    """Whether a call's arguments (maps) are the expected ones. A tool's normalizer, an expression over a map, comes first; it
    gives null for arguments that don't fit, which equal nothing."""
    pick = lambda arguments: _by_tool(tool, arguments, normalizers)
    entries = lambda arguments: F.array_sort(F.map_entries(arguments))
    return F.coalesce(entries(pick(expected)) == entries(pick(actual)), F.lit(False))


def _by_tool(tool: Column, arguments: Column, normalizers: dict[str, Callable[[Column], Column]]) -> Column:
    chosen = arguments
    for name, normalizer in normalizers.items():
        chosen = F.when(tool == name, normalizer(arguments)).otherwise(chosen)
    return chosen


def tool_call_metrics(calls: DataFrame, by: Sequence[str] = (), normalizers: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Accuracy, failures, latency and token use of calls.

    calls: expected_decision, actual_decision (call_tool or refuse), expected_tool, actual_tool, expected_arguments,
    actual_arguments (maps), latency, tokens (null: not reported), failed. A refusal is right if nothing was called, a call if
    decision, tool and arguments are. Tool and argument rates are over the cases that expect a call, null without any; a
    failed call is right in nothing.
    """
    wanted, done = F.col("expected_decision") == "call_tool", ~F.col("failed")
    decision = done & F.coalesce(F.col("expected_decision") == F.col("actual_decision"), F.lit(False))
    tool = done & wanted & F.coalesce(F.col("expected_tool") == F.col("actual_tool"), F.lit(False))
    arguments = tool & same_arguments(F.col("expected_tool"), F.col("expected_arguments"), F.col("actual_arguments"), normalizers or {})
    passed = F.when(wanted, decision & tool & arguments).otherwise(decision & F.col("actual_tool").isNull())
    rate = lambda ok, of: F.round(F.try_divide(F.count_if(ok), F.count_if(of)), 6)
    every = F.lit(True)
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"),
        rate(decision, every).alias("decision_accuracy"),
        rate(tool, wanted).alias("tool_accuracy"),
        rate(arguments, wanted).alias("arguments_accuracy"),
        rate(passed, every).alias("case_accuracy"),
        F.count_if("failed").alias("failed_calls"),
        F.round(F.avg("latency"), 6).alias("mean_latency"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.count_if(F.col("tokens").isNull()).alias("usage_unavailable"),
    )


def tool_case_preflight(cases: DataFrame, tools: DataFrame, normalizers: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """One row of counts over cases (case_id, expected_decision, expected_tool, expected_arguments) before a run.

    tools: (tool) that are registered. repeated_ids counts rows beyond the first of an id, unregistered_tools and
    invalid_arguments calls that expect an unknown tool, or arguments that its normalizer refuses.
    """
    known = cases.join(tools.select(F.col("tool").alias("expected_tool")).distinct().withColumn("known", F.lit(True)), "expected_tool", "left")
    call = F.col("expected_decision") == "call_tool"
    refused = _by_tool(F.col("expected_tool"), F.col("expected_arguments"), normalizers or {}).isNull()
    ids = known.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(call).alias("calls"), F.count_if(call & F.col("known").isNull()).alias("unknown"), F.count_if(call & F.col("known").isNotNull() & refused).alias("refused"))
    add = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return ids.agg(
        add("n").alias("cases"), add("calls").alias("call_tool_cases"), (add("n") - add("calls")).alias("refusal_cases"),
        add(F.col("n") - 1).alias("repeated_ids"), add("unknown").alias("unregistered_tools"), add("refused").alias("invalid_arguments"),
    )


def answer_metrics(answers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rates over answers (expected, actual status, grounded, model_called): of right status, over all, over those that
    should be answered and refused; of grounded ones among the answered; of model calls. An empty subset has rate 0."""
    right = (F.col("expected") == F.col("actual")).cast("double")
    answered = F.col("expected") == "answered"
    rate = lambda v, c: F.round(F.coalesce(F.avg(F.when(c, v)), F.lit(0.0)), 6)
    return answers.groupBy(*by).agg(
        rate(right, F.lit(True)).alias("status_accuracy"),
        rate(right, answered).alias("answered_accuracy"),
        rate(right, ~answered).alias("refusal_accuracy"),
        rate(F.col("grounded").cast("double"), F.col("actual") == "answered").alias("grounding_pass_rate"),
        rate(F.col("model_called").cast("double"), F.lit(True)).alias("model_call_rate"),
    )


def evaluation_problems(gold: DataFrame, corpus: DataFrame, *, tokenizer: str, chunker: str, allow_provisional: bool = False) -> DataFrame:
    """(dataset_id, problem, cases): why a gold set may not be scored against a corpus; no rows if it may.

    gold: dataset_id, status, tokenizer_version, chunker_version, document_sha256, id (judged); corpus: id, document_sha256.
    """
    known = corpus.select("id", F.col("document_sha256").alias("sha")).distinct()
    rows = gold.join(known, "id", "left")
    rules = {
        "provisional": (F.col("status") == "provisional") & F.lit(not allow_provisional),
        "tokenizer-version": F.col("tokenizer_version") != tokenizer,
        "chunker-version": F.col("chunker_version") != chunker,
        "outside-corpus": F.col("sha").isNull(),
        "wrong-document-hash": F.col("sha") != F.col("document_sha256"),
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda r: r.isNotNull())
    found = rows.select("dataset_id", F.explode(broken).alias("problem")).groupBy("dataset_id", "problem").agg(F.count(F.lit(1)).alias("cases"))
    if not corpus.isEmpty():
        return found
    return found.unionByName(gold.groupBy("dataset_id").agg(F.lit("empty-corpus").alias("problem"), F.count(F.lit(1)).alias("cases")))


def experiment_axes(runs: DataFrame) -> DataFrame:
    """(baseline, candidate, axis) for each two runs (run, dataset, model, prompt) of one dataset, the earlier one first.

    Of a pair's model and prompt one may differ and names the axis; with none it is repeatability, with both the pair is
    rejected. Runs of a dataset are few; each pair of them is a row of the result.
    """
    other = runs.select("dataset", F.col("run").alias("candidate"), F.col("model").alias("_model"), F.col("prompt").alias("_prompt"))
    moved, reworded = ~F.col("model").eqNullSafe(F.col("_model")), ~F.col("prompt").eqNullSafe(F.col("_prompt"))
    axis = F.when(moved & reworded, "rejected").when(moved, "model").when(reworded, "prompt").otherwise("repeatability")
    return runs.join(other, "dataset").filter(F.col("run") < F.col("candidate")).select(F.col("run").alias("baseline"), "candidate", axis.alias("axis"))


def quality_gate(metrics: DataFrame, rules: dict[str, tuple[str, str, float]]) -> DataFrame:
    """(code, actual, threshold) for each broken rule {code: (metric, '<' or '>', threshold)} of a metrics row."""
    broken = [
        F.when((F.col(m) < t) if op == "<" else (F.col(m) > t), F.struct(F.lit(code).alias("code"), F.col(m).cast("double").alias("actual"), F.lit(float(t)).alias("threshold")))
        for code, (m, op, t) in sorted(rules.items())
    ]
    keys = [c for c in metrics.columns if c not in {m for m, _, _ in rules.values()}]
    return metrics.select(*keys, F.inline(F.filter(F.array(*broken), lambda x: x.isNotNull())))


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Least number of items put in, left out or changed from a to b.

    Of equal lengths it is at most the number of places that differ, and never less than the number of items that one side has
    more of: where both are the same, as with changed items only, that is it. Else the bits of one number hold a whole column
    of the table, so that a step takes a few operations on it, and only one column is held."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return max(len(a), len(b))
    if len(a) == len(b):
        changed = sum(map(ne, a, b))
        if (Counter(a) - Counter(b)).total() == changed:
            return changed
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, len(a) - 1
    plus, minus, score = full, 0, len(a)
    for x in b:
        eq = masks.get(x, 0)
        across = (((eq & plus) + plus) ^ plus) | eq
        down = minus | full & ~(across | plus)
        up = plus & across
        score += (down >> top & 1) - (up >> top & 1)
        down, up = (down << 1 | 1) & full, up << 1 & full
        across = eq | minus
        plus, minus = up | full & ~(across | down), down & across
    return score


_EDITS = [("expected", T.StringType(), pa.string()), ("actual", T.StringType(), pa.string())] + [(c, T.IntegerType(), pa.int32()) for c in ("chars", "words", "char_edits", "word_edits")]


def ocr_error_rates(pairs: DataFrame) -> DataFrame:
    """pairs (.., expected, actual) with exact, edits and rates by characters and words.

    Both texts are put in Unicode's compatibility form with white space collapsed; null counts as empty. Whole texts are
    compared, of any length. Pairs whose expected text is blank have no rates and go. The work follows a text's length, or
    its square where more than single items were changed, so pairs are dealt anew over the tasks, however few partitions they come in.
    """
    spark, rest = pairs.sparkSession, [c for c in pairs.columns if c not in ("expected", "actual")]
    names = [*rest, *[c for c, _, _ in _EDITS]]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pair in zip(batch.column(len(rest)).to_pylist(), batch.column(len(rest) + 1).to_pylist(), strict=True):
                e, a = (" ".join(unicodedata.normalize("NFKC", x or "").split()) for x in pair)
                rows.append((e, a, len(e), len(e.split()), edit_distance(e, a), edit_distance(e.split(), a.split())))
            columns = [pa.array(c, k) for c, (_, _, k) in zip(list(zip(*rows, strict=True)) or [()] * len(_EDITS), _EDITS, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(rest))], *columns], names)

    schema = T.StructType([*[pairs.schema[c] for c in rest], *[T.StructField(c, k) for c, k, _ in _EDITS]])
    spread = pairs.select(*rest, "expected", "actual").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("expected", "actual"))
    rows = spread.mapInArrow(each, schema).filter("chars > 0").withColumn("exact", F.col("expected") == F.col("actual"))
    return rows.withColumn("cer", F.try_divide("char_edits", "chars")).withColumn("wer", F.try_divide("word_edits", "words"))


def ocr_batch(rates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row for a run of ocr_error_rates(): cases, exact rate, rates averaged over cases (macro) and over all text (micro)."""
    micro = lambda a, b: F.round(F.try_divide(F.sum(a), F.sum(b)), 6)
    return rates.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.avg(F.col("exact").cast("double")), 6).alias("exact_rate"), F.round(F.avg("cer"), 6).alias("macro_cer"), micro("char_edits", "chars").alias("micro_cer"),
        F.round(F.avg("wer"), 6).alias("macro_wer"), micro("word_edits", "words").alias("micro_wer"),
    )


def ocr_fields(fields: DataFrame) -> DataFrame:
    """(field, fields, exact_rate, critical_rate) of fields (case_id, field, exact, critical), by field and over all (field
    null); critical_rate is over the critical ones alone, null without any. A field of a case that comes twice counts once."""
    exact = F.col("exact").cast("double")
    one = fields.groupBy("case_id", "field").agg(F.bool_and("exact").alias("exact"), F.bool_or("critical").alias("critical"))
    return one.groupingSets([["field"], []], "field").agg(F.count(F.lit(1)).alias("fields"), F.round(F.avg(exact), 6).alias("exact_rate"), F.round(F.avg(F.when(F.col("critical"), exact)), 6).alias("critical_rate"))


def latency_summary(calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, nearest-rank percentiles, extremes and outcomes of calls (value in seconds, failed, started), and calls a second.

    Percentiles are those of the nearest rank. All values are sorted in ranges and numbered, so a value's rank is its number
    less its group's first one, and no task holds a group. throughput is over the time from the first start to the last; null
    if that is none.
    """
    by = list(by)
    sums = calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("valued"), F.count_if("failed").alias("failed"), F.min("started").alias("began"), F.max("started").alias("ended"),
        F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"),
    )
    ordered = numbered(calls.filter("value is not null").select(*by, "value").orderBy(*by, "value"), "_no")
    firsts = ordered.groupBy(*by).agg(F.min("_no").alias("_first"), F.count(F.lit(1)).alias("_valued"))
    placed = ordered.join(firsts, by) if by else ordered.crossJoin(F.broadcast(firsts))  # one row
    rank = F.col("_no") - F.col("_first") + 1
    at = lambda q: F.min(F.when(rank == F.ceil(F.lit(q) * F.col("_valued")), F.col("value")))
    ranks = placed.groupBy(*by).agg(*[at(q).alias(name) for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])
    whole = sums.join(ranks, by, "left") if by else sums.crossJoin(F.broadcast(ranks))
    seconds = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("began").cast("timestamp"))) / 1e6
    return whole.select(*by, F.round("mean", 6).alias("mean"), "p50", "p95", "p99", "least", "most", (F.col("n") - F.col("failed")).alias("succeeded"), "failed", F.round(F.try_divide(F.col("n"), seconds), 6).alias("throughput"))


def _pushed(path: list[str], level: int, text: str) -> list[str]:
    """The stack of headings behind a block: a heading cuts it to its level less one, by places, and is put on it."""
    return [*path[: level - 1], text] if level else path


def heading_paths(blocks: DataFrame) -> DataFrame:
    """blocks (page long, ordinal int, level 0-6, text) with heading_path. The stack is one of places: h3 and then h2 keeps the
    h3's text in front. A page's blocks are walked in order, batch after batch, so a page may be of any length."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, path = None, []
        for batch in batches:
            out = []
            for p, level, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                path = _pushed(path if p == page else [], level, text)
                page = p
                out.append(path)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.string()))], ["page", "ordinal", "level", "text", "heading_path"])

    rows = blocks.select(F.col("page").cast("long"), F.col("ordinal").cast("int"), F.col("level").cast("int"), "text")
    ordered = rows.repartition("page").sortWithinPartitions("page", "ordinal")
    return ordered.mapInArrow(each, "page long, ordinal int, level int, text string, heading_path array<string>")


# The elements whose text makes a block, and those whose text is none.
_CONTENT = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "p", "li"))
_SILENT = frozenset(("script", "style"))


class _Spans(HTMLParser):
    """Text with the number and the tag of the block that it stands in. A block begins where its tag opens, whatever is open
    then, and is over at the first end tag of its kind."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.spans: list[tuple[int, str, str]] = []
        self.block, self.muted = (0, ""), 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.muted += tag in _SILENT
        if not self.muted and tag in _CONTENT:
            self.block = (self.block[0] + 1, tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.muted and tag == self.block[1]:
            self.block = (self.block[0], "")
        self.muted -= tag in _SILENT and self.muted > 0

    def handle_data(self, data: str) -> None:
        if self.block[1] and not self.muted:
            self.spans.append((*self.block, data))


def _blocks(html: str) -> Iterator[tuple[str, int, str, list[str]]]:
    """(tag, level, text, heading path) of the blocks of a page that have text."""
    parser, path = _Spans(), []
    parser.feed(html)
    parser.close()
    for (_, tag), spans in groupby(parser.spans, key=itemgetter(0, 1)):
        if words := " ".join(data for _, _, data in spans).split():
            level = int(tag[1]) if tag.startswith("h") else 0
            path = _pushed(path, level, " ".join(words))
            yield tag, level, " ".join(words), path


def html_fragments(pages: DataFrame) -> DataFrame:
    """pages (page, html) to (page, ordinal, tag, level, text, heading_path): headings, paragraphs and list items in order.

    Tags, references and quoting are read as HTML parsers do; text outside of blocks and in scripts and styles goes. A null
    or empty page, or one without such blocks, has no rows.
    """
    names = ["page", "ordinal", "tag", "level", "text", "heading_path"]
    schema = T.StructType([pages.schema["page"], *T.StructType.fromDDL("ordinal int, tag string, level int, text string, heading_path array<string>").fields])
    kinds = [f.type for f in to_arrow_schema(schema)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for page, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(page, i, *block) for i, block in enumerate(_blocks(html or ""))]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return pages.select("page", F.col("html").cast("string")).mapInArrow(each, schema)
