"""Mixing sources to target weights: budgets down a tree of domains, languages and sources, token prefixes of seeded epochs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WHITE, cut

_BLANK = " \t\n\x0b\x0c\r"
_DIGITS = 3  # hexadecimal digits of the order key that make a leaf's 4096 buckets


@dataclass(frozen=True)
class Recipe:
    """Target weights by level (1 where a name isn't listed), the budget as a share of all tokens, and how often a text may come."""

    domains: dict[str, float] = field(default_factory=lambda: {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0})
    langs: dict[str, float] = field(default_factory=lambda: {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0})
    sources: dict[str, float] = field(default_factory=dict)
    share: float = 0.8
    epochs: int = 2
    seed: str = "mix-1"


#: Where the table has no domain: one of four, by the source's name.
def default_domain() -> Column:
    name = F.md5(F.coalesce(F.col("source").cast("string"), F.lit("")).cast("binary"))
    return F.concat(F.lit("d"), F.ascii(name) % 4)


SQL_DOMAIN = "concat('d', ascii(md5(coalesce(source, ''))) % 4)"


def n_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; 0 if null."""
    inner = F.trim(F.translate(text, _BLANK[1:], " " * 5))
    return F.when(F.length(inner) > 0, F.size(F.split(inner, WHITE))).otherwise(0).cast("long")


def _weight(weights: dict[str, float], name: str) -> Column:
    chain = F.lit(1.0)
    for key, value in sorted(weights.items()):
        chain = F.when(F.col(name) == key, F.lit(float(value))).otherwise(chain)
    return chain


def shares(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Adds `given` to siblings (same parent) with columns weight, cap and budget (the parent's).

    Weights are propagated: each sibling gets its part by weight, but no more than its cap; what one can't take is
    dealt among the siblings that can, by their weights again. In the order of cap to weight the capped ones come first,
    so running sums find them without a loop.
    """
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf")))
    over = Window.partitionBy(*parent).orderBy("ratio", name)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    after = over.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    rows = nodes.withColumn("ratio", ratio).withColumn("level", F.when(F.col("weight") > 0, level))
    open_level = F.when(F.col("ratio") > F.col("level"), F.struct(F.col("ratio"), F.col(name).alias("k"), F.col("level")))
    first = F.min(open_level).over(Window.partitionBy(*parent))
    capped = F.col("weight") > 0
    given = F.when(~capped, F.lit(0.0)).when(F.col("ratio") <= F.col("level"), F.col("cap").cast("double"))
    return rows.withColumn("given", given.otherwise(F.coalesce(first["level"] * F.col("weight"), F.col("cap").cast("double")))).drop("ratio", "level", "budget")


def budgets(leaves: DataFrame, recipe: Recipe) -> DataFrame:
    """(domain, lang, source, leaf_tokens, target, epochs_full, rest) for leaves (domain, lang, source, leaf_tokens).

    A node's cap is what its leaves can give in all epochs, so a shortage stays among siblings while they can take it
    and only what a whole subtree lacks goes to its ancestors' other children.
    """
    leaves = leaves.withColumn("cap", F.col("leaf_tokens") * F.lit(recipe.epochs)).withColumn("weight", _weight(recipe.sources, "source"))
    leaves = leaves.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.sum("leaf_tokens").alias("tokens")).withColumn("weight", _weight(recipe.langs, "lang"))
    langs = langs.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", _weight(recipe.domains, "domain"))
    domains = domains.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0))
    total = domains.agg(F.floor(F.sum("tokens") * F.lit(recipe.share)).alias("want"), F.sum("cap").alias("most"))
    total = total.select(F.least("want", "most").cast("double").alias("budget"))
    top = shares(domains.join(F.broadcast(total)).withColumn("root", F.lit(0)), ["root"], "domain")  # total is one row
    of_domain = top.select("domain", F.col("given").alias("budget"))
    middle = shares(langs.join(of_domain, "domain"), ["domain"], "lang")
    of_lang = middle.select("domain", "lang", F.col("given").alias("budget"))
    bottom = shares(leaves.join(of_lang, ["domain", "lang"]), ["domain", "lang"], "source")
    target = F.floor(F.col("given") + F.lit(1e-6)).cast("long")
    full = F.when(F.col("leaf_tokens") > 0, F.floor(F.col("target") / F.col("leaf_tokens"))).otherwise(0).cast("long")
    rows = bottom.withColumn("target", target).withColumn("epochs_full", full)
    return rows.select("domain", "lang", "source", "leaf_tokens", "target", "epochs_full", (F.col("target") - F.col("epochs_full") * F.col("leaf_tokens")).alias("rest"))


def _order_key(recipe: Recipe) -> Column:
    return F.md5(F.concat_ws("|", F.lit(recipe.seed), F.col("epochs_full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


LEAF = ["domain", "lang", "source"]


def plan(narrow: DataFrame, recipe: Recipe) -> DataFrame:
    """budgets() of narrow (leaf columns, doc_id, tokens), and where each leaf's token prefix ends: a small, frozen table.

    A leaf's last, partial epoch is a seeded order of its texts, in 4096 buckets. Sums by bucket find the one in which
    the prefix ends, so a hot leaf never meets in one task.
    """
    target = cut(budgets(narrow.groupBy(*LEAF).agg(F.sum("tokens").alias("leaf_tokens")), recipe), "mix-budgets")
    keyed = _keyed(narrow, target, recipe)
    sums = keyed.groupBy(*LEAF, "bucket").agg(F.sum("tokens").alias("bucket_tokens"), F.first("rest").alias("rest"))
    running = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bucket_tokens").over(running), F.lit(0)))
    border = sums.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("bucket_tokens") >= F.col("rest")))
    border = border.select(*LEAF, F.col("bucket").alias("border"), F.col("before").alias("border_before"))
    return cut(target.join(border, LEAF, "left"), "mix-plan")


def _keyed(docs: DataFrame, target: DataFrame, recipe: Recipe, most: int = 100_000) -> DataFrame:
    """docs with their leaf's row of target: sent to every task while there are `most` leaves or fewer, else joined by key."""
    rows = docs.join(F.broadcast(target) if target.count() <= most else target, LEAF).withColumn("key", _order_key(recipe))
    return rows.withColumn("bucket", F.substring("key", 1, _DIGITS))


def _placed(docs: DataFrame, planned: DataFrame, recipe: Recipe, keep: Sequence[str]) -> DataFrame:
    """docs (leaf columns, doc_id, tokens and `keep`) with epochs_full and partial_tokens; only border buckets are sorted."""
    marked = _keyed(docs, planned, recipe)
    inside = marked.filter(F.col("bucket") == F.col("border"))
    ahead = Window.partitionBy(*LEAF).orderBy("key", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("border_before") + F.coalesce(F.sum("tokens").over(ahead), F.lit(0))
    inside = inside.withColumn("partial_tokens", F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("rest") - before)))
    outside = marked.filter(F.coalesce(F.col("bucket") != F.col("border"), F.lit(True)))
    outside = outside.withColumn("partial_tokens", F.when(F.col("bucket") < F.col("border"), F.col("tokens")).otherwise(0))
    columns = ["doc_id", *LEAF, "tokens", "epochs_full", "partial_tokens", *keep]
    return outside.select(*columns).unionByName(inside.select(*columns))


def _leaves(domain: Column | None) -> list[Column]:
    named = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")}
    return [(default_domain() if domain is None else F.coalesce(domain, F.lit(""))).alias("domain"), named["lang"], named["source"]]


def mix(docs: DataFrame, recipe: Recipe | None = None, domain: Column | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, epochs_full, partial_tokens, taken_tokens) for every row of docs.

    docs: doc_id, text, lang, source; other columns are ignored. taken_tokens = epochs_full * tokens + partial_tokens,
    and the taken tokens of a leaf sum to its target exactly. The last text of a prefix may be taken in part. Null and
    empty texts have no tokens; null lang or source make a leaf of the empty name; rows without doc_id take part;
    repeated rows are texts of their own. An empty table gives no rows.
    """
    recipe = recipe or Recipe()
    rows = docs.select(F.col("doc_id").cast("long"), *_leaves(domain), n_words(F.col("text")).alias("tokens"))
    rows = cut(rows, "mix-tokens")
    placed = _placed(rows, plan(rows, recipe), recipe, [])
    return placed.withColumn("taken_tokens", F.col("epochs_full") * F.col("tokens") + F.col("partial_tokens"))


def first_words(text: Column, n: Column) -> Column:
    """The first n words of a text, with one blank between them."""
    return F.array_join(F.slice(F.split(F.trim(F.translate(text, _BLANK[1:], " " * 5)), WHITE), F.lit(1), n.cast("int")), " ")


def select_documents(docs: DataFrame, recipe: Recipe | None = None, domain: Column | None = None) -> DataFrame:
    """The rows of docs as often as the recipe takes them, with all columns as they are.

    The text at the end of a leaf's prefix comes once more cut to the words that are taken of it, with n_chars, if there is
    such a column, of what is left; so the leaves meet their targets to the word. Texts without words, null ones too, aren't
    taken. Null lang or source make a leaf of the empty name, rows without doc_id take part, repeated rows are texts of
    their own; of texts with one key the one of fewer words comes first. An empty table gives no rows.
    """
    recipe = recipe or Recipe()
    row = F.struct(*docs.columns).alias("row")
    rows = docs.select(F.col("doc_id").cast("long"), *_leaves(domain), n_words(F.col("text")).alias("tokens"), row)
    narrow = cut(rows.drop("row"), "mix-tokens")
    placed = _placed(rows, plan(narrow, recipe), recipe, ["row"])
    whole = F.col("epochs_full") + F.when((F.col("partial_tokens") == F.col("tokens")) & (F.col("tokens") > 0), 1).otherwise(0)
    some = (F.col("partial_tokens") > 0) & (F.col("partial_tokens") < F.col("tokens"))
    taken = placed.select("row", F.when(F.col("tokens") > 0, whole).otherwise(0).cast("int").alias("n"), F.when(some, F.col("partial_tokens")).alias("words"))
    times = F.concat(F.array_repeat(F.lit(None).cast("long"), F.col("n")), F.when(F.col("words").isNotNull(), F.array("words")).otherwise(F.array().cast("array<long>")))
    each = taken.select("row", F.explode(times).alias("words"))
    shorter = first_words(F.col("row.text"), F.col("words"))
    changed = {"text": shorter} | ({"n_chars": F.length(shorter).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    values = [F.when(F.col("words").isNull(), F.col(f"row.`{c}`")).otherwise(changed[c]).alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return each.select(*values)


def _sql_weight(weights: dict[str, float], name: str) -> str:
    return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {float(v)}::DOUBLE" for k, v in sorted(weights.items())) + " ELSE 1.0::DOUBLE END" if weights else "1.0::DOUBLE"


def _sql_level(name: str, rows: str, parent: str, key: str) -> str:
    return f"""
{name}_r AS (SELECT *, CASE WHEN weight > 0 THEN cap / weight ELSE 'inf'::DOUBLE END AS ratio FROM ({rows})),
{name}_l AS (SELECT *, CASE WHEN weight > 0 THEN (budget - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY ratio, {key}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (PARTITION BY {parent} ORDER BY ratio, {key}
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS level FROM {name}_r),
{name}_f AS (SELECT *, first_value(CASE WHEN ratio > level THEN level END IGNORE NULLS) OVER (PARTITION BY {parent} ORDER BY ratio, {key}
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS opened FROM {name}_l),
{name} AS (SELECT *, CASE WHEN weight <= 0 THEN 0.0 WHEN ratio <= level THEN cap::DOUBLE ELSE coalesce(opened * weight, cap::DOUBLE) END AS given FROM {name}_f)"""


def oracle_sql(domain: str = SQL_DOMAIN, recipe: Recipe | None = None) -> str:
    """DuckDB SQL for mix() over documents, with one window over each leaf's whole order instead of buckets."""
    r = recipe or Recipe()
    return f"""
WITH docs AS (
  SELECT doc_id, {domain} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
leaf0 AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS leaf_tokens FROM docs GROUP BY ALL),
leaf1 AS (SELECT *, {_sql_weight(r.sources, "source")} AS weight, leaf_tokens * {r.epochs} AS cap FROM leaf0),
lang1 AS (SELECT domain, lang, sum(cap)::DOUBLE AS cap, sum(leaf_tokens) AS tokens, {_sql_weight(r.langs, "lang")} AS weight FROM leaf1 GROUP BY domain, lang),
domain1 AS (SELECT domain, sum(cap)::DOUBLE AS cap, sum(tokens) AS tokens, {_sql_weight(r.domains, "domain")} AS weight FROM lang1 GROUP BY domain),
total AS (SELECT least(floor(sum(tokens) * {r.share}), sum(cap))::DOUBLE AS budget FROM domain1),
{_sql_level("top", "SELECT domain1.*, budget, 0 AS root FROM domain1, total", "root", "domain").strip()},
{_sql_level("middle", "SELECT lang1.*, top.given AS budget FROM lang1 JOIN top USING (domain)", "domain", "lang").strip()},
{_sql_level("bottom", "SELECT leaf1.domain, leaf1.lang, leaf1.source, leaf_tokens, leaf1.weight, leaf1.cap::DOUBLE AS cap, middle.given AS budget FROM leaf1 JOIN middle USING (domain, lang)", "domain, lang", "source").strip()},
plan0 AS (SELECT domain, lang, source, leaf_tokens, floor(given + 1e-6)::BIGINT AS target FROM bottom),
plan AS (SELECT *, CASE WHEN leaf_tokens > 0 THEN target // leaf_tokens ELSE 0 END AS epochs_full FROM plan0),
keyed AS (SELECT docs.*, epochs_full, target - epochs_full * leaf_tokens AS rest,
    md5(concat_ws('|', '{r.seed}', epochs_full::VARCHAR, coalesce(doc_id::VARCHAR, ''))) AS key FROM docs JOIN plan USING (domain, lang, source)),
placed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed)
SELECT doc_id, domain, lang, source, tokens, epochs_full::BIGINT AS epochs_full,
  greatest(0, least(tokens, rest - before))::BIGINT AS partial_tokens,
  (epochs_full * tokens + greatest(0, least(tokens, rest - before)))::BIGINT AS taken_tokens
FROM placed"""
