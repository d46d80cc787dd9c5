"""Column functions on short statements: stems, overlaps, contrasts and references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of one group that exclude each other.
CONTRASTS = [
    ["old", "older", "oldest", "new", "newer", "newest", "latest"],
    ["before", "after"],
    ["increase", "increases", "increased", "decrease", "decreases", "decreased"],
    ["higher", "high", "lower", "low"],
    ["accept", "accepted", "approve", "approved", "reject", "rejected"],
    ["active", "inactive", "archived", "stale", "superseded"],
    ["yes", "true", "no", "false"],
]
# Kinds of ids that texts cite, and their patterns.
REFERENCES = {
    "memory": r"\bmem_[A-Za-z0-9_]+\b",
    "chunk": r"\bchunk_[A-Za-z0-9_]+\b",
    "document": r"\bdoc_[A-Za-z0-9_]+\b",
    "wiki_page": r"\b(?:concepts|decisions|projects|people|open_loops|timelines|references)/(?:[A-Za-z0-9._-]+/)*[A-Za-z0-9._-]+\.md\b",
}


# Endings that go, the least length of a word for it, how many letters go and what takes their place; the first that fits.
ENDINGS = [("ss", 0, 0, ""), ("ies", 6, 3, "y"), ("ing", 7, 3, ""), ("ed", 6, 2, ""), ("s", 5, 1, "")]
# Words that stand for others, before and after their ending goes.
ALIASES = {
    "admin": "administrator", "admins": "administrator", "administrator": "administrator", "administrators": "administrator", "analyses": "analysis", "childrens": "children", "children": "child", "collaboration": "collaborate",
    "collaborating": "collaborate", "collaborative": "collaborate", "collaborator": "collaborate", "consume": "consume", "consumption": "consume", "cross": "cross-functional", "dashboard": "dashboard", "dashboards": "dashboard",
    "distribute": "share", "distributed": "share", "distributing": "share", "distribution": "share", "finance": "financial", "finops": "finops", "group": "group", "groups": "group", "identity": "identity", "leader": "leader",
    "leaders": "leader", "leads": "leader", "organization": "org", "organizations": "org", "permission": "access", "permissions": "access", "publish": "share", "published": "share", "publishing": "share", "kids": "child", "kid": "child",
    "recreating": "recreate", "recreated": "recreate", "recreate": "recreate", "re": "recreate", "reporting": "report", "reports": "report", "shared": "share", "sharing": "share", "teammate": "team", "teammates": "team", "teams": "team",
    "visibility": "access", "visible": "access", "view": "access", "viewer": "access",
}
# Words kept as they are, words that carry nothing, words that carry little, words that deny.
WHOLE = ["ai", "llm", "api", "ui"]
EMPTY = ["a", "about", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "into", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "use", "using", "with"]
WEAK = [
    "ability", "administrative", "based", "broad", "broadly", "capability", "capabilities", "center", "centered", "concrete", "context", "core", "directly", "focus", "focused", "framing", "immediate", "important", "inside", "merely",
    "model", "organization", "organizational", "part", "primary", "problem", "prompt", "related", "simply", "solution", "strong", "stronger", "useful", "underlying",
]
DENIALS = ["no", "not", "never", "without", "cannot", "cant", "won't", "wont", "isnt", "isn't"]
# Words of progress, plain denials, words of a claim that carry little.
PROGRESS = ["became", "becomes", "current", "currently", "earlier", "final", "formerly", "later", "moved", "new", "now", "previous", "previously", "then", "updated"]
PLAIN_DENIALS = ["not", "no", "never", "without"]
CLAIM_WEAK = ["also", "believ", "expect", "he", "mention", "say", "said", "she", "think", "they", "while"]
# Numbers as words, the units that make them values, and the forms of dates, weekdays, numbers and amounts.
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]
UNITS = ["day", "week", "month", "quarter", "year", "hour", "minute", "dollar", "percent", "seat", "user"]
MONTHS = "jan|january|feb|february|mar|march|apr|april|may|jun|june|jul|july|aug|august|sep|sept|september|oct|october|nov|november|dec|december"
VALUES = [rf"\b(?:{MONTHS})\s+\d{{1,2}}(?:,\s*\d{{4}})?\b", r"\b\d{4}-\d{2}-\d{2}\b", r"\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b", r"\b\d+(?:\.\d+)?%?\b", r"\$[\d,]+(?:\.\d+)?"]
FIGURES = r"(?<![A-Za-z0-9])(?:\$?\d+(?:[.,]\d+)?%?|\d+(?:st|nd|rd|th))(?![A-Za-z0-9])"


def _listed(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _other(word: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), word), word)


def stem(word: Column) -> Column:
    """Plural and verb endings off, where enough of the word stays."""
    size, out = F.length(word), None
    for ending, least, gone, put in ENDINGS:
        fits = word.endswith(ending) & (size >= least)
        kept = F.concat(F.substring(word, F.lit(1), size - gone), F.lit(put))
        out = F.when(fits, kept) if out is None else out.when(fits, kept)
    return out.otherwise(word)


def canonical(words: Column) -> Column:
    """Words by their alias, without their ending, by their alias again; a step for each, so that none is computed twice."""
    named = F.transform(words, _other)
    return F.transform(F.transform(named, lambda w: F.when(w.isin(WHOLE), w).otherwise(stem(w))), _other)


def fact_words(statement: Column) -> Column:
    """The distinct canonical words of a statement that carry something."""
    text = F.lower(F.coalesce(statement, F.lit("")))
    text = F.regexp_replace(F.regexp_replace(text, "children's|childrens", "children"), r"\bre[- ]?creat(?:e|ed|es|ing)\b", "recreate")
    found = canonical(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)))
    return F.array_distinct(F.filter(found, lambda w: (w != "") & ~w.isin(EMPTY)))


def material_values(statement: Column) -> Column:
    """Dates, weekdays, numbers and amounts of a lower-cased statement, and number words with a unit as `3 day`."""
    text = F.lower(F.coalesce(statement, F.lit("")))
    plain = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in VALUES])
    counted = F.regexp_extract_all(text, F.lit(rf"\b((?:{'|'.join(NUMBER_WORDS)})\s+[a-z]+)\b"), F.lit(1))
    pairs = F.transform(counted, lambda x: F.split(x, r"\s+"))
    unit = lambda p: F.regexp_replace(p[1], "s$", "")
    kept = F.filter(pairs, lambda p: p[1].isin([*UNITS, *[f"{u}s" for u in UNITS if u != "percent"]]))
    return F.array_sort(F.array_distinct(F.concat(plain, F.transform(kept, lambda p: F.concat_ws(" ", (F.array_position(_listed(NUMBER_WORDS), p[0]) - 1).cast("string"), unit(p))))))


def denied_words(statement: Column) -> Column:
    """For each denial the canonical words among the six that follow it."""
    text = F.regexp_replace(F.lower(F.coalesce(statement, F.lit(""))), r"\bnot\s+(?:merely|simply|just|only)\b", "")
    words = F.regexp_extract_all(text, F.lit("[a-z']+"), F.lit(0))
    windows = F.filter(F.transform(words, lambda w, i: F.when(w.isin(DENIALS), F.slice(words, i + 2, F.lit(6)))), lambda x: x.isNotNull())
    sets = F.transform(windows, lambda x: F.array_distinct(F.filter(canonical(x), lambda c: (c != "") & ~c.isin([*EMPTY, *WEAK, *DENIALS]))))
    return F.filter(sets, lambda s: F.size(s) > 0)


def denial_conflict(denied_a: Column, said_a: Column, denied_b: Column, said_b: Column) -> Column:
    """Whether one of two statements denies what the other, which denies nothing, says (its words but the weak ones)."""

    def met(denied, said):
        def hits(s):
            both = F.array_intersect(s, said)
            return (F.size(both) >= 2) | F.exists(both, lambda w: (F.length(w) >= 5) & ~w.isin("broad", "complete", "full", "partial"))

        return F.exists(denied, hits)

    only_a, only_b = (F.size(denied_a) > 0) & (F.size(denied_b) == 0), (F.size(denied_b) > 0) & (F.size(denied_a) == 0)
    return F.when(only_a, met(denied_a, said_b)).when(only_b, met(denied_b, said_a)).otherwise(F.lit(False))


def strong(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(WEAK))


def letter_words(statement: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(statement, F.lit(""))), F.lit("[a-z]+"), F.lit(0)))


def figures(statement: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(statement, F.lit("")), F.lit(FIGURES), F.lit(0))))


def anchors_of(words: Column) -> Column:
    return F.filter(words, lambda w: (F.length(w) >= 5) & ~w.isin([*WEAK, *EMPTY]))


def plain_words(statement: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(statement, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def progression(a: Column, b: Column) -> Column:
    return F.arrays_overlap(F.concat(plain_words(a), plain_words(b)), _listed(PROGRESS))


def stems(statement: Column) -> Column:
    """The distinct stems of a statement's words; null has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(statement, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.transform(found, stem))


def overlap(a: Column, b: Column) -> Column:
    """What the smaller of two sets shares; 0 with an empty one."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def contrast(a: Column, b: Column) -> Column:
    """Whether two lower-cased word sets name different words of one group of CONTRASTS."""

    def differ(group):
        own = F.array(*map(F.lit, group))
        x, y = F.array_intersect(a, own), F.array_intersect(b, own)
        return (F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) > 0) | (F.size(F.array_except(y, x)) > 0))

    return reduce(lambda p, q: p | q, map(differ, CONTRASTS))


def references(text: Column) -> Column:
    """The ids a text cites, as distinct (kind, id) in the order of REFERENCES."""
    found = lambda kind, p: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("id")))
    return F.array_distinct(F.concat(*[found(k, p) for k, p in REFERENCES.items()]))
