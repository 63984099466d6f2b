"""Column expressions over text: white space, folding, tokens, normalized values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space, one class that Java and RE2 read alike.
WS = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Recruitment types and the words that name them.
RECRUITMENT_ALIASES = {
    "internship": ("internship", "intern", "实习", "实习生", "实习招聘", "日常实习", "日常实习项目"),
    "campus": ("campus", "campus recruitment", "graduate", "校招", "校园招聘", "应届生招聘"),
    "experienced": ("experienced", "experienced hire", "social recruitment", "社招", "社会招聘"),
}
CJK = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
FIRST_CJK = "\u3400"
TOKEN = rf"[{CJK}]+|[A-Za-z0-9][A-Za-z0-9+#._-]*"
BEARER = r"(?i)bearer\s+[a-z0-9._-]+"
TURN_CHARS = 600


def collapse(text: Column) -> Column:
    """White space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def fold(text: Column) -> Column:
    """Lower case, and ss for the sharp s."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def quote_key(text: Column) -> Column:
    """Text without white space, folded: what quotes are compared by."""
    return fold(F.regexp_replace(text, WS, ""))


def location_key(place: Column) -> Column:
    """A place's name without white space, folded, less a final 市 behind other characters."""
    key = quote_key(place)
    return F.when((F.length(key) > 1) & key.endswith("市"), F.substring(key, F.lit(1), F.length(key) - 1)).otherwise(key)


def lexical_tokens(text: Column) -> Column:
    """CJK runs as overlapping pairs (a single character stays), ASCII words folded and stripped of `._-` at the end."""
    pieces = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1)
    pairs = lambda s: F.when(F.length(s) > 1, F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))).otherwise(F.array(s))
    word = lambda s: F.rtrim(F.lower(s), F.lit("._-"))  # noqa: E731  words begin with a letter or digit
    mixed = F.flatten(F.transform(pieces, lambda s: F.when(s >= FIRST_CJK, pairs(s)).otherwise(F.array(word(s)))))
    return F.when(text.rlike(f"[{CJK}]"), mixed).otherwise(F.transform(pieces, word))


def recruitment_type(value: Column) -> Column:
    """internship, campus or experienced; null for what isn't an alias."""
    key = F.lower(collapse(value))
    found = F.lit(None).cast("string")
    for name, aliases in RECRUITMENT_ALIASES.items():
        found = F.when(key.isin(*aliases), name).otherwise(found)
    return found


def deadline(value: Column) -> Column:
    """struct(deadline date, status, reason) of a free-text deadline in one of three full shapes."""
    text = collapse(value)
    shapes = (r"^(\d{4})年(\d{1,2})月(\d{1,2})日$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{4})/(\d{1,2})/(\d{1,2})$")
    part = lambda i: F.coalesce(*[F.nullif(F.regexp_extract(text, s, i), F.lit("")) for s in shapes])
    date = F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-M-d")
    stated = F.coalesce(text != "", F.lit(False))
    shaped = F.coalesce(part(1).isNotNull(), F.lit(False))
    status = F.when(~stated, "not_stated").when(shaped & date.isNotNull(), "normalized").otherwise("manual_review_required")
    reason = F.when(~stated | (shaped & date.isNotNull()), F.lit(None).cast("string")).when(shaped, "invalid-calendar-date").otherwise("unsupported-date-expression")
    return F.struct(F.when(shaped, date).alias("deadline"), status.alias("status"), reason.alias("reason"))


def company_key(name: Column) -> Column:
    return fold(F.trim(name))


def domain_key(domain: Column) -> Column:
    return F.rtrim(F.lower(F.trim(domain)), F.lit("."))


def host(url: Column) -> Column:
    """Host of an http(s) URL in lower case, without user, port and final dots; null if there is none."""
    found = F.regexp_extract(F.lower(F.trim(url)), r"^https?://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.rtrim(found, F.lit(".")), F.lit(""))


def safe_turn(text: Column) -> Column:
    """A turn with bearer tokens redacted, trimmed, of 600 characters at most (599 and an ellipsis where cut)."""
    clean = F.trim(F.regexp_replace(text, BEARER, "[redacted bearer token]"))
    cut = F.concat(F.rtrim(F.substring(clean, 1, TURN_CHARS - 1)), F.lit("…"))
    return F.when(F.length(clean) > TURN_CHARS, cut).otherwise(clean)


def credential_rules(text: Column) -> Column:
    """The rules by which a text is rejected, in order; empty if none."""
    rules = {
        "blank": F.coalesce(collapse(text) == "", F.lit(True)),
        "control-character": text.rlike(r"[\x00-\x08\x0b-\x1f]"),
        "bearer": text.rlike(r"Bearer\s+\S+"),
        "jwt": text.rlike(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
        "secret-key": text.rlike(r"sk-[A-Za-z0-9_-]{16,}"),
    }
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda r: r.isNotNull())


def canonical_sha(fields: dict[str, Column]) -> Column:
    """SHA-256 of a JSON object with sorted keys and no blanks, nulls kept."""
    row = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)
