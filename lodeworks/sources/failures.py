"""Why a document could not be parsed, whether to try again, and what an operator does."""

from pyspark.sql import DataFrame, SparkSession

# Code, retryable, action.
FAILURES = [
    ("parser-not-registered", False, "register-parser"),
    ("format-mismatch", False, "investigate-format-routing"),
    ("document-read-failed", True, "retry-source-read"),
    ("unsupported-text-encoding", False, "detect-or-transcode-encoding"),
    ("no-extractable-content", False, "use-fallback-extractor-or-manual-review"),
    ("invalid-document-package", False, "redownload-or-manual-review"),
    ("invalid-pdf", False, "redownload-or-manual-review"),
    ("invalid-spreadsheet", False, "redownload-or-manual-review"),
    ("invalid-presentation", False, "redownload-or-manual-review"),
    ("password-protected-document", False, "request-unlocked-document-or-manual-review"),
    ("pdf-text-layer-missing", False, "run-ocr-or-manual-review"),
    ("invalid-parser-output", False, "investigate-parser"),
]


def failure_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FAILURES, "code string, retryable boolean, action string")
