"""Canonical forms, bounded labels and shape tests of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shapes of identifiers that say nothing in a search.
PURE_IDENTIFIERS = (
    r"^[0-9]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?i:run|build|pipeline|job|ci)[-_][0-9]+$",
)
#: Handles of pull requests and pipeline runs in a question.
PULL_REQUEST = r"(?i)\b(?:PR|pull\s+request)\s*#?\s*(\d+)\b"
PIPELINE_RUN = r"(?i)\b(?:CI\s+pipeline|CI\s+run|pipeline\s+run|pipeline|run)\b\s*#?\s*(\d{4,})\b"


def bounded_label(c: Column, fallback: Column, most: int = 1000) -> Column:
    """The text if it has 1 to ``most`` characters, else the fallback."""
    return F.when(F.char_length(F.coalesce(c, F.lit(""))).between(1, most), c).otherwise(fallback)


def safe_uri(c: Column) -> Column:
    """The URI if it has a scheme and at most 2048 characters, else empty."""
    good = c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & (F.char_length(c) <= 2048)
    return F.when(good, c).otherwise("")


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def canonical_question(c: Column) -> Column:
    """One space between words, trimmed, lower case, no punctuation at the end."""
    once = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.regexp_replace(F.lower(once), r"[.?!,;:\s]+$", "")


def question_hash(c: Column) -> Column:
    return F.sha2(canonical_question(c), 256)


def relation_name(c: Column) -> Column:
    """Upper case, anything but letters, digits and _ as _, at most 64 characters."""
    return F.upper(F.substring(F.regexp_replace(F.lower(c), r"[^a-z0-9_]", "_"), 1, 64))


def canonical_list(c: Column, most_chars: int, most_items: int) -> Column:
    """Trimmed, bounded, distinct, sorted and joined by commas."""
    items = F.filter(F.transform(c, lambda x: F.substring(F.trim(x), 1, most_chars)), lambda x: x != "")
    return F.array_join(F.slice(F.array_sort(F.array_distinct(items)), 1, most_items), ",")


def search_text(*columns: Column, most: int = 2000) -> Column:
    """The non-empty parts, one a line, bounded."""
    return F.substring(F.concat_ws("\n", *[null_if_empty(F.trim(c)) for c in columns]), 1, most)


def is_pure_identifier(c: Column) -> Column:
    """Every word is digits, a UUID, a numbered run, or 12 or more hex digits with two decimals."""

    def one(word: Column) -> Column:
        hexes = word.rlike(r"^[0-9a-fA-F]{12,}$") & (F.char_length(F.regexp_replace(word, r"[^0-9]", "")) >= 2)
        for shape in PURE_IDENTIFIERS:
            hexes = hexes | word.rlike(shape)
        return hexes

    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    return (F.size(words) > 0) & F.forall(words, one)


def handles(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), 1)


def json_array_or_empty(c: Column) -> Column:
    """A JSON array of texts; anything else is empty."""
    return F.coalesce(F.from_json(F.when(c.rlike(r"^\s*\["), c), "array<string>"), F.array().cast("array<string>"))


def bounded_text(c: Column, most: int) -> Column:
    """Without white space around it and at most so many characters; never ends in white space."""
    return F.rtrim(F.substring(F.trim(c), 1, most))
