"""Column functions on mail and logs: quoted history, white space, secrets and their masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines that begin what a reply quotes.
REPLIES = [r"(?i)^\s*On .{1,500} wrote:\s*$", r"(?i)^\s*-{2,}\s*Original Message\s*-{2,}\s*$", r"(?i)^\s*Begin forwarded message:\s*$", r"(?i)^\s*>+\s*(?:\*\*|__)?\s*Archived\s+note\s*:\s*(?:\*\*|__)?\s*$", r"^\s*_{5,}\s*$"]
HEADER, HEADER_NAMES = r"(?i)^\s*(?:From|Sent):\s+.+$", ["from", "sent", "to", "subject", "date"]
# Shapes of secrets in logs.
AUTHORIZATION = r"(?i)(\bauthorization\s*[:=]\s*(?:bearer|basic)\s+)([A-Za-z0-9._~+/\-=]+)"
NAMED_SECRET = r"(?i)([\"']?\b[A-Z0-9_.-]*(?:SECRET|PASSWORD|API[_-]?KEY|CREDENTIAL|ACCESS[_-]?TOKEN|REFRESH[_-]?TOKEN)[A-Z0-9_.-]*\b[\"']?\s*[:=]\s*[\"']?)([^\s\"',;]+)"
SECRET_SHAPE = r"(?i)\b(?:GOCSPX-[A-Za-z0-9._/-]+|ya29\.[A-Za-z0-9._/-]+|1//[A-Za-z0-9._/-]+|AIza[A-Za-z0-9._/-]+|sk-[A-Za-z0-9._/-]+)"
# Kinds of what is masked in texts; a pattern's group 1 is masked.
SECRETS = {
    "access_key": r"\b((?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{20,}|sk-[A-Za-z0-9_-]{20,})",
    "labelled_secret": r"(?i)\b(?:passcode|password|pin|otp|secret|token|api[_-]?key)\b(?:\s*(?::|=)\s*|\s+(?:is|was)\s+)[\"']?([^\s<>{}\[\](),;|\"']{4,256})",
    "numeric_code": r"(?i)\b(?:one[\s-]?time|verification|security|access|sign[\s-]?in|login|authentication)\s+(?:password|passcode|code)\b(?:\s*(?::|=)\s*|\s+(?:is|was)\s+|\s+)(\d(?:[ \t-]*\d){3,11})\b",
    "authorization": r"(?i)\bauthorization\s*[:=]\s*(?:bearer|basic)\s+([A-Za-z0-9._~+/\-=]+)",
    "private_key": r"(?s)(-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----)",
    "mail_address": r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b",
    "card_number": r"\b((?:\d{4}[ -]?){3}\d{4})\b",
    "address": r"\b((?:\d{1,3}\.){3}\d{1,3})\b",
}


def normal_space(text: Column) -> Column:
    """Single spaces and at most one empty line between lines; none at the ends."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.btrim(F.regexp_replace(x, r"[ \t]+", " ")))
    kept = F.filter(lines, lambda x, i: (x != "") | (i == 0) | (F.element_at(lines, F.greatest(i, F.lit(1))) != ""))
    return F.btrim(F.array_join(kept, "\n"), F.lit("\n "))


def without_quotes(text: Column) -> Column:
    """What a mail says itself: up to the first line that begins a quotation, without lines that start with `>`."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")
    named = lambda i: F.size(F.array_intersect(F.transform(F.filter(F.slice(lines, i + 1, F.lit(5)), lambda x: x.contains(":")), lambda x: F.lower(F.trim(F.substring_index(x, ":", 1)))), F.array(*map(F.lit, HEADER_NAMES))))
    marks = F.transform(lines, lambda x, i: x.rlike("|".join(f"(?:{p})" for p in REPLIES)) | (x.rlike(HEADER) & (named(i) >= 3)))
    end = F.array_position(marks, True)
    said = F.when(end > 0, F.slice(lines, F.lit(1), (end - 1).cast("int"))).otherwise(lines)
    return normal_space(F.array_join(F.filter(said, lambda x: ~F.ltrim(x).startswith(">")), "\n"))


def redacted_log(text: Column) -> Column:
    """A log text without credentials: values of headers and of names that say so, and tokens by their shape."""
    bare = F.btrim(text, F.lit(" \t\n\r\f"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, AUTHORIZATION, "$1[redacted]"), NAMED_SECRET, "$1[redacted]"), SECRET_SHAPE, "[redacted]")


def secret_kinds(text: Column) -> Column:
    """Which kinds of secret a text holds, in the order of SECRETS."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in SECRETS.items()]), lambda k: k.isNotNull())


def masked(text: Column, mask: str = "*") -> Column:
    """The text with every secret's characters but white space masked, so that offsets stay: spans found by any pattern, merged by being
    masked once."""
    hits = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in SECRETS.values()])
    longest_first = F.array_sort(F.array_distinct(F.filter(hits, lambda x: x != "")), lambda x, y: F.length(y) - F.length(x))
    found = F.aggregate(longest_first, text, lambda t, x: F.replace(t, x, F.regexp_replace(x, r"\S", mask)))
    return F.when(F.size(longest_first) > 0, found).otherwise(text)
