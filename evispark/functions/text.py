"""Column functions on text: tokens, normal forms, hashes, numbers and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry nothing in a query (fixed values).
STOPWORDS = (
    "a an and any are as at be been being by can could did do does for how i if in into is it me might must my next no not of on or s "
    "shall should some that the these this those to what whether will with would yes you your"
).split()


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))


def query_terms(query: str) -> list[str]:
    """Distinct tokens of two characters or more that are no stopwords, in order."""
    import re

    found = (t.lower() for t in re.findall(r"[A-Za-z0-9_]+", query))
    return list(dict.fromkeys(t for t in found if len(t) >= 2 and t not in STOPWORDS))


def required_hits(terms: int) -> int:
    """How many specific terms a result must have."""
    return 2 if terms >= 4 else min(terms, 1)


def token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0)))


def normal_statement(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+", " "))


def slug(text: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", F.lit("untitled")).otherwise(made)


def contains_term(text: Column, term: str) -> Column:
    """Terms of up to three characters match whole words, longer ones anywhere."""
    low = F.lower(text)
    return low.rlike(rf"(^|[^a-z0-9_]){term}([^a-z0-9_]|$)") if len(term) <= 3 else low.contains(term)


def mask_mail(text: Column) -> Column:
    return F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[redacted]")


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def hash_share(key: Column) -> Column:
    """The first 52 bits of the key's sha256 as a number in [0, 1): samples by it are stable."""
    return F.conv(F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


_WORD, _SPACE = r"[^ \t\n\f\r]+", " \t\n\f\r"


def words(text: Column) -> Column:
    """Runs of characters that are no ASCII white space; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))


def trim_budget(text: Column, most: int) -> Column:
    """At most `most` words: a longer text keeps three fewer and a mark; up to three words have no room for it."""
    w = words(text)
    cut = F.array_join(F.slice(w, 1, most), " ") if most <= 3 else F.concat(F.array_join(F.slice(w, 1, most - 3), " "), F.lit(" ... [truncated]"))
    return F.when(F.size(w) <= most, F.btrim(text, F.lit(_SPACE))).otherwise(cut)


def without_front_matter(text: Column) -> Column:
    """The trimmed text after a leading block between `---` marks; an unclosed block is ordinary text."""
    bare = F.btrim(text, F.lit(_SPACE))
    return F.btrim(F.regexp_replace(bare, r"\A---(?s:.*?)\n---", ""), F.lit(_SPACE))


def looks_like_base64(text: Column) -> Column:
    """800 characters or more of the alphabet, over 20 of them different."""
    kinds = F.size(F.array_distinct(F.split(F.regexp_replace(text, "[\r\n]", ""), "")))
    return (F.length(text) >= 800) & text.rlike(r"\A[A-Za-z0-9+/=\r\n]*\z") & (kinds > 20)


def looks_like_json(text: Column) -> Column:
    """Over 3000 characters that open as JSON and nest four times or name a key."""
    bare = F.regexp_replace(text, r"\A[- \t]+", "")
    return (F.length(bare) > 3000) & bare.rlike(r"\A[{\[]") & ((F.regexp_count(bare, F.lit(r"[{\[]")) >= 4) | bare.contains('":'))


def passage(text: Column, heading: Column, most: int = 6000) -> Column:
    """What is embedded: the heading, an empty line and the text's first `most` characters."""
    body, head = F.substring(F.btrim(text, F.lit(_SPACE)), 1, most), F.btrim(F.coalesce(heading, F.lit("")), F.lit(_SPACE))
    return F.when(head == "", body).otherwise(F.concat(head, F.lit("\n\n"), body))


def entity_name(name: Column) -> Column:
    """Lower-cased letters, digits, apostrophes and ampersands with single spaces between; null is empty."""
    straight = F.regexp_replace(F.coalesce(name.cast("string"), F.lit("")), "[‘’]", "'")
    return F.lower(F.trim(F.regexp_replace(straight, "[^0-9A-Za-z'&]+", " ")))
