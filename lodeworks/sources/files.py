"""File sources: artifacts by format, manifests, registries and gold sets with row-numbered problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Formats by file ending, and the columns of a source manifest in their order.
FORMATS = {"htm": "html", "html": "html", "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx"}
MANIFEST_COLUMNS = "source_id company job_title job_id recruitment_type published_date location source_kind source_url final_url captured_at artifact_path content_sha256 status notes".split()
REGISTRY_COLUMNS = "company domain evidence_reference verified_at verified_by status".split()


def document_format(path: Column) -> Column:
    """Format by the file's ending, whatever its case; null for any other."""
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    found = F.lit(None).cast("string")
    for ending, name in FORMATS.items():
        found = F.when(end == ending, name).otherwise(found)
    return found


def artifact_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, format, content_sha256, byte_size) of the files below a folder; Spark lists none of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", document_format(F.col("path")).alias("format"), F.sha2("content", 256).alias("content_sha256"), F.col("length").alias("byte_size"))


def _csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The rows of a CSV file, or of a folder of them, with file and row: 2 for the first behind a file's header.

    Quoted values may hold line breaks, so a file is one split; a byte order mark is no part of a header, and every file must
    have the given one.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    read = spark.read.schema(schema).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    placed = read.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_at"))
    rows = placed.withColumn("row", F.row_number().over(Window.partitionBy("file").orderBy("_at")))
    header = F.array(F.regexp_replace(columns[0], "^\ufeff", ""), *columns[1:])
    wrong = rows.filter("row = 1").filter(~F.coalesce(header == F.array(*[F.lit(c) for c in columns]), F.lit(False))).select("file", header.alias("header")).take(1)
    if wrong:
        raise ValueError(f"{wrong[0].file}: header {wrong[0].header} instead of {columns}")
    return rows.filter("row > 1").drop("_at")


def manifest_scan(spark: SparkSession, path: str) -> DataFrame:
    """A manifest CSV's rows with parsed dates, and `problems`: what is wrong with a row, empty if nothing."""
    rows = _csv(spark, path, MANIFEST_COLUMNS)
    published, captured = F.try_to_date("published_date", "yyyy-MM-dd"), F.try_to_timestamp("captured_at")
    rules = {
        "source-id-blank": F.coalesce(F.trim("source_id") == "", F.lit(True)),
        "published-date-invalid": F.col("published_date").isNotNull() & published.isNull(),
        "captured-at-invalid": captured.isNull(),
        "captured-at-without-zone": ~F.coalesce(F.col("captured_at").rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.lit(False)),
        "path-outside-root": F.coalesce(F.col("artifact_path").rlike(r"^/|(^|/)\.\.(/|$)"), F.lit(True)),
        "sha256-invalid": ~F.coalesce(F.col("content_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
    }
    problems = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("problems", problems).withColumn("published_date", published).withColumn("captured_at", captured)


def domain_registry_scan(spark: SparkSession, path: str) -> DataFrame:
    """A domain registry CSV's rows with parsed dates and their problems."""
    rows = _csv(spark, path, REGISTRY_COLUMNS)
    verified = F.try_to_date("verified_at", "yyyy-MM-dd")
    rules = {
        "company-blank": F.coalesce(F.trim("company") == "", F.lit(True)),
        "domain-blank": F.coalesce(F.trim("domain") == "", F.lit(True)),
        "verified-at-invalid": verified.isNull(),
        "status-unknown": ~F.coalesce(F.col("status").isin("active", "revoked"), F.lit(False)),
    }
    problems = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("problems", problems).withColumn("verified_at", verified)


_HEADER = ("dataset_id", "annotated_by", "source_reference", "chunker_version", "tokenizer_version")


def qrels_scan(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(dataset_id, case_id, query, id, grade, problem) of nested JSON gold sets: one to a file, or one to a line.

    problem says what is wrong, first with the set, then with the case or judgment: set-unreadable, <field>-blank,
    status-unknown, document-digest-invalid, no-cases; case-blank, no-judgments, evidence-blank, grade-invalid; null if nothing.
    A set or case that has nothing below it keeps a row.
    """
    judgment = "struct<evidence_id:string,relevance_grade:string,evidence_text:string>"
    schema = f"annotation_status string, document_sha256 string, {', '.join(f'{c} string' for c in _HEADER)}, cases array<struct<case_id:string,query:string,judgments:array<{judgment}>>>, _corrupt string"
    rows = spark.read.schema(schema).option("multiLine", not lines).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    of_set = F.when(F.col("_corrupt").isNotNull(), "set-unreadable")
    for c in _HEADER:
        of_set = of_set.when(blank(c), f"{c.replace('_', '-')}-blank")
    of_set = of_set.when(~F.coalesce(F.col("annotation_status").isin("provisional", "reviewed"), F.lit(False)), "status-unknown")
    of_set = of_set.when(~F.coalesce(F.col("document_sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), "document-digest-invalid").when(F.coalesce(F.size("cases"), F.lit(0)) < 1, "no-cases")
    cases = rows.select("dataset_id", of_set.alias("of_set"), F.explode_outer("cases").alias("c"))
    of_case = F.when(blank("c.case_id") | blank("c.query"), "case-blank").when(F.coalesce(F.size("c.judgments"), F.lit(0)) < 1, "no-judgments")
    judged = cases.select("dataset_id", "of_set", "c.case_id", "c.query", of_case.alias("of_case"), F.explode_outer("c.judgments").alias("j"))
    grade = F.when(F.col("j.relevance_grade").rlike("^[0-9]{1,9}$"), F.col("j.relevance_grade")).cast("int")
    of_judgment = F.when(blank("j.evidence_id"), "evidence-blank").when(~F.coalesce(grade >= 1, F.lit(False)), "grade-invalid")
    return judged.select("dataset_id", "case_id", "query", F.col("j.evidence_id").alias("id"), grade.alias("grade"), F.coalesce("of_set", "of_case", of_judgment).alias("problem"))


def gold_dataset_scan(texts: DataFrame, case_keys: list[str], case_schema: str) -> DataFrame:
    """texts (json) of gold sets `{dataset_id, cases}` to (dataset_id, case, problem): a set or case must have exactly its keys."""
    cases = F.from_json("json", "dataset_id string, cases array<string>")
    exact = F.array_sort(F.json_object_keys("json")) == F.array(F.lit("cases"), F.lit("dataset_id"))
    rows = texts.select("json", cases.alias("d"), F.coalesce(exact, F.lit(False)).alias("exact"))
    bad = rows.filter(~F.col("exact")).select(F.col("d.dataset_id").alias("dataset_id"), F.lit(None).cast(f"struct<{case_schema}>").alias("case"), F.lit("dataset-keys").alias("problem"))
    each = rows.filter("exact").select("d.dataset_id", F.explode("d.cases").alias("c"))
    wanted = F.array(*[F.lit(k) for k in sorted(case_keys)])
    same = F.coalesce(F.array_sort(F.json_object_keys("c")) == wanted, F.lit(False))
    good = each.select("dataset_id", F.from_json("c", f"struct<{case_schema}>").alias("case"), F.when(~same, "case-keys").alias("problem"))
    return good.unionByName(bad)


def beir_scan(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus (id, text, problem), queries (query, text) and qrels (query, id, grade > 0) of a BEIR folder."""
    docs = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    text = F.trim(F.concat_ws("\n", F.nullif("title", F.lit("")), F.nullif("text", F.lit(""))))
    corpus = docs.select(F.col("_id").alias("id"), text.alias("text"), F.when(text == "", "empty-text").alias("problem"))
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("query"), "text")
    judged = spark.read.option("sep", "\t").option("header", True).schema("query string, id string, grade int").csv(f"{folder}/qrels/test.tsv")
    return corpus, queries, judged.filter("grade > 0")


def evaluation_catalog(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """(path, family, dataset_id, version, status, cases, metrics) of the JSON reports below a folder, one to a file, or one to a
    line; unreadable ones are left out."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    if lines:
        doc = read.format("text").load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modificationTime"), F.col("value").alias("json"))
    else:
        doc = read.format("binaryFile").load(folder).select("path", "modificationTime", F.col("content").cast("string").alias("json"))
    get = lambda p: F.get_json_object("json", p)
    metrics = F.map_filter(F.from_json(get("$.metrics"), "map<string,string>"), lambda k, v: v.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"))
    n_cases = F.coalesce(F.when(get("$.cases").rlike(r"^\d+$"), get("$.cases").cast("int")), F.json_array_length(get("$.cases")))
    good = doc.filter(F.json_object_keys("json").isNotNull())
    family = F.when(F.contains("path", F.lit("/experiments/")), "experiment").otherwise("dataset")
    rows = good.select("path", family.alias("family"), get("$.dataset_id").alias("dataset_id"), get("$.dataset_version").alias("version"), get("$.annotation_status").alias("status"), n_cases.alias("cases"), F.transform_values(metrics, lambda k, v: v.cast("double")).alias("metrics"), "modificationTime")
    return rows.orderBy(F.desc("family"), F.desc("modificationTime"), "path", "dataset_id", "version")
