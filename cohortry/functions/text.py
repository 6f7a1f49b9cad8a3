"""Column expressions over text and lists of text.

``(?U)`` makes Java's ``\\s`` and ``\\b`` Unicode-aware.  The four control
characters U+001C..U+001F count as white space too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, f"(?U)^{_BLANK}+|{_BLANK}+$", "")


def clean_text(text: Column) -> Column:
    """Collapse white space runs to one space, trim, and turn empty text into null."""
    collapsed = F.regexp_replace(text.cast("string"), f"(?U){_BLANK}+", " ")
    return F.nullif(F.trim(collapsed), F.lit(""))


def clean_list(items: Column) -> Column:
    """Strip items, drop empty and null ones, keep the first of equals; a null list is empty."""
    kept = F.filter(F.transform(items, lambda item: strip(item)), lambda item: F.coalesce(item != "", F.lit(False)))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def split_list(text: Column, separator: str = ";") -> Column:
    """Split collapsed text at a separator into non-empty, trimmed parts; null gives an empty list."""
    parts = F.transform(F.split(clean_text(text), separator), lambda part: F.trim(part))
    return F.coalesce(F.filter(parts, lambda part: part != ""), F.array().cast("array<string>"))


def title_case(text: Column) -> Column:
    return F.initcap(text)


def after_last(text: Column, marker: str = "->") -> Column:
    """Trimmed text behind the last marker; null where the marker is absent."""
    return F.when(text.contains(marker), F.trim(F.element_at(F.split(text, marker), -1)))


def contains_literal(needle: str, *columns: Column) -> Column:
    """Case-insensitive literal search in the columns joined by one space, nulls as empty text."""
    parts = []
    for column in columns:
        parts += [F.lit(" "), F.coalesce(F.lower(column), F.lit(""))]
    return F.contains(F.concat(*parts[1:]), F.lit(needle.lower()))


def text_length(text: Column) -> Column:
    """Length in code points, 0 for null."""
    return F.length(F.coalesce(text, F.lit("")))
