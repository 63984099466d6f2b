"""Declared constraints of a corpus' entities, checked over whole tables: rules of rows, unique keys, references."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Unique:
    """No two rows, of those that meet `where`, have the same values; a row with a null among them is like no other."""

    columns: Sequence[str]
    where: str = "true"


@dataclass(frozen=True)
class Reference:
    """A row's values, if none is null, are those of a row of the parent entity."""

    columns: Sequence[str]
    parent: str
    parent_columns: Sequence[str]


@dataclass(frozen=True)
class Entity:
    """key: the columns that name a row, unique and never null. required: columns that are never null. checks: conditions in
    SQL that hold or are null, as in a table's CHECK. unique, references: what concerns rows beside each other."""

    key: Sequence[str]
    required: Sequence[str] = ()
    checks: Mapping[str, str] = field(default_factory=dict)
    unique: Mapping[str, Unique] = field(default_factory=dict)
    references: Mapping[str, Reference] = field(default_factory=dict)


_PLACES = ("page_number", "slide_number", "table_number", "table_row_number")
#: The entities of a corpus and of the facts drawn from it.
ENTITIES = {
    "domain": Entity(["id"], ["record_fingerprint"], {"status-known": "status IN ('active', 'revoked')"}, {"one-fingerprint": Unique(["record_fingerprint"])}),
    "chunk": Entity(
        ["evidence_id"],
        ["source_fragment_ordinal", "chunk_ordinal"],
        {f"{c}-from-{n}": f"{c} >= {n}" for n, cs in ((0, ("source_fragment_ordinal", "chunk_ordinal")), (1, _PLACES)) for c in cs} | {"row-within-table": "table_row_number IS NULL OR table_number IS NOT NULL"},
    ),
    "snapshot": Entity(
        ["snapshot_id"],
        ["source_reference", "content_sha256", "version_number"],
        {"format-known": "document_format IN ('html', 'pdf', 'docx', 'xlsx', 'pptx')", "size-from-0": "byte_size >= 0", "version-from-1": "version_number >= 1", "observed-in-order": "last_observed_at >= first_observed_at"},
        {"one-version-of-content": Unique(["source_reference", "content_sha256"]), "one-content-of-version": Unique(["source_reference", "version_number"]), "one-current-of-source": Unique(["source_reference"], "is_current")},
    ),
    "link": Entity(["snapshot_id", "evidence_id"], unique={"one-snapshot-of-evidence": Unique(["evidence_id"])}, references={"snapshot-there": Reference(["snapshot_id"], "snapshot", ["snapshot_id"]), "evidence-there": Reference(["evidence_id"], "chunk", ["evidence_id"])}),
    "record": Entity(
        ["record_id"],
        ["record_fingerprint", "source_snapshot_id"],
        {
            "deadline-status-known": "deadline_status IN ('normalized', 'not_stated', 'manual_review_required')",
            "deadline-consistent": "CASE deadline_status WHEN 'normalized' THEN deadline IS NOT NULL AND deadline_reason IS NULL WHEN 'not_stated' THEN coalesce(deadline_raw, cast(deadline AS string), deadline_reason) IS NULL"
            " WHEN 'manual_review_required' THEN deadline_raw IS NOT NULL AND deadline IS NULL AND deadline_reason IS NOT NULL END",
            "current-was-activated": "NOT is_current OR (activated_at IS NOT NULL AND activation_reference IS NOT NULL)",
        },
        {"one-fingerprint": Unique(["record_fingerprint"]), "one-current-of-snapshot": Unique(["source_snapshot_id"], "is_current")},
        {"snapshot-there": Reference(["source_snapshot_id"], "snapshot", ["snapshot_id"])},
    ),
    "citation": Entity(
        ["record_id", "field_path", "citation_ordinal"],
        ["evidence_id"],
        {"ordinal-from-1": "citation_ordinal >= 1"},
        references={"record-there": Reference(["record_id"], "record", ["record_id"]), "evidence-there": Reference(["evidence_id"], "chunk", ["evidence_id"])},
    ),
}


def _broken(name: str, entity: Entity, rows: DataFrame, tables: Mapping[str, DataFrame]) -> Iterator[DataFrame]:
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in entity.key]).alias("key")
    whole = {f"{c}-missing": F.col(c).isNull() for c in [*entity.key, *entity.required]}
    rules = whole | {n: ~F.expr(c) for n, c in entity.checks.items()}
    found = F.filter(F.array(*[F.when(broken, F.lit(n)) for n, broken in rules.items()]), lambda r: r.isNotNull())
    yield rows.select(F.lit(name).alias("entity"), key, F.explode(found).alias("rule"))  # all rules of rows in one pass
    for rule, one in {"one-key": Unique(entity.key), **entity.unique}.items():
        asked = rows.filter(one.where).dropna(subset=list(one.columns))
        twice = asked.groupBy(*one.columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*one.columns)
        yield asked.join(twice, list(one.columns), "left_semi").select(F.lit(name).alias("entity"), key, F.lit(rule).alias("rule"))
    for rule, to in entity.references.items():
        if to.parent in tables:
            known = tables[to.parent].select(*[F.col(p).alias(c) for p, c in zip(to.parent_columns, to.columns, strict=True)]).distinct()
            lost = rows.dropna(subset=list(to.columns)).join(known, list(to.columns), "left_anti")
            yield lost.select(F.lit(name).alias("entity"), key, F.lit(rule).alias("rule"))


def violations(tables: Mapping[str, DataFrame], entities: Mapping[str, Entity] = ENTITIES) -> DataFrame:
    """(entity, key, rule) for each rule that a row of the given tables breaks; tables by the names of their entities.

    A table's own rules are one pass over it; a unique rule counts its groups with map-side sums and names all their rows;
    a reference is an anti-join with the parent's table, and isn't looked at where that isn't given. The parts of
    a key are joined by |, nulls left out.
    """
    if unknown := set(tables) - set(entities):
        raise ValueError(f"no entities: {sorted(unknown)}")
    return reduce(DataFrame.unionByName, [part for name, rows in tables.items() for part in _broken(name, entities[name], rows, tables)])
