"""Text expressions. All are built-ins: they run inside the scan stage, with no Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonemill import fixed_values as fixed


def title_and_text(title: Column, text: Column) -> Column:
    """``title: text``; null if either side is null."""
    return F.concat(title, F.lit(": "), text)


def strip_urls(text: Column) -> Column:
    """Delete ``http`` and everything up to the next blank; a lone ``http`` stays."""
    return F.regexp_replace(text, fixed.URL_PATTERN, "")


def strip_junk(text: Column) -> Column:
    """Delete every character that is not a-z, 0-9 or a blank (``a-b`` becomes ``ab``)."""
    return F.regexp_replace(text, fixed.JUNK_PATTERN, "")


def squeeze_blanks(text: Column) -> Column:
    """Each run of blanks becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, fixed.BLANK_RUN_PATTERN, " "))


def clean_text(text: Column) -> Column:
    """Lower-case, drop URLs, drop other characters, squeeze blanks."""
    return squeeze_blanks(strip_junk(strip_urls(F.lower(text))))


def word_count(text: Column) -> Column:
    """Number of word-character runs."""
    return F.regexp_count(text, F.lit(fixed.WORD_PATTERN))


def preview(text: Column, chars: int = fixed.PREVIEW_CHARS) -> Column:
    """First ``chars`` characters, with ``...`` only where something was cut."""
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def tokens(text: Column) -> Column:
    """Space-separated tokens of cleaned text; empty text has none."""
    return F.array_remove(F.split(text, " "), "")
