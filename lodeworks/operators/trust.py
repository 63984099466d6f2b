"""Trust in sources: a registry of verified domains, which of them a page's host belongs to, and what is left to review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import company_key, domain_key, host
from .corpus import first_of


def registry_current(log: DataFrame) -> DataFrame:
    """The newest row of each company and domain of a registry's log (company, domain, id, version, status), less revoked ones."""
    return first_of(log, ["company", "domain"], F.desc("version"), F.col("id")).filter("status = 'active'").select("company", "domain", "id")


def domain_fingerprint(*fields: Column) -> Column:
    """SHA-256 of a registry row's fields, joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", *fields), 256)


def domain_matches(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """(page_id, matched) of pages (page_id, url, company) whose host is, or ends in, a domain of their company.

    registry: company, domain, id; of several domains the one of the least id counts. A host's label suffixes are rows, so
    the match is an equi-join. Pages without a host or a match have no row; companies and domains are compared by their keys.
    """
    labels = F.split(host(F.col("url")), r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    wide = pages.filter(host(F.col("url")).isNotNull()).select("page_id", company_key(F.col("company")).alias("company"), F.explode(suffixes).alias("key"))
    known = registry.select(company_key(F.col("company")).alias("company"), domain_key(F.col("domain")).alias("key"), "domain", "id")
    return wide.join(known, ["company", "key"]).groupBy("page_id").agg(F.min_by("domain", "id").alias("matched"))


def source_audit(pages: DataFrame, matches: DataFrame) -> DataFrame:
    """(page_id, verdict, matched) of pages (page_id, official): whether an official page's domain is verified."""
    rows = pages.join(matches, "page_id", "left")
    verdict = F.when(~F.col("official"), "not_applicable").when(F.col("matched").isNull(), "unverified").otherwise("verified")
    return rows.select("page_id", verdict.alias("verdict"), "matched")


def source_assessment(pages: DataFrame, matches: DataFrame) -> DataFrame:
    """(page_id, reasons, manual_review) of pages (page_id, url, official): what a reviewer must look at, in a fixed order.

    Freshness can't be told from a page, so every page is reviewed.
    """
    rows = pages.join(matches, "page_id", "left")
    reasons = F.array(
        F.when(F.col("matched").isNull(), "ownership-unverified"),
        F.when(~F.col("official"), "cross-check-required"),
        F.when(~F.coalesce(F.lower("url").startswith("https://"), F.lit(False)), "not-https"),
        F.lit("freshness-unverified"),
    )
    kept = F.filter(reasons, lambda x: x.isNotNull())
    return rows.select("page_id", kept.alias("reasons"), (F.size(kept) > 0).alias("manual_review"))
