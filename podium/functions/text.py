"""Name norms and text predicates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from podium.functions.rating import col

#: Difficulty labels in order, the five-level and the four-level set.
FIVE_LEVELS = ("very_easy", "easy", "medium", "hard", "very_hard")
FOUR_LEVELS = ("easy", "medium", "hard", "very_hard")


def norm_alnum(name) -> Column:
    """Lower case, letters a-z and digits only; a title of other letters becomes empty."""
    return F.regexp_replace(F.lower(F.coalesce(col(name), F.lit(""))), "[^a-z0-9]", "")


def norm_space(name) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(name), F.lit(""))), r"\s+", " "))


def season_of(year, name) -> Column:
    """The year, or the one before for finals; null for a null year."""
    final = F.coalesce(col(name), F.lit("")).rlike("(?i)championship|world final")
    return F.when(final, col(year) - 1).otherwise(col(year))


def or_default(value, default) -> Column:
    """The default for null and empty strings."""
    return F.coalesce(F.nullif(col(value), F.lit("")), F.lit(default))


def text_filter(query: str, *cols) -> Column:
    """Case-insensitive substring of the joined columns."""
    return F.lower(F.concat_ws(" ", *map(col, cols))).contains(query.lower())


def level(label, levels=FIVE_LEVELS) -> Column:
    """Position of a difficulty label from 0; null for any other."""
    at = F.array_position(F.array(*map(F.lit, levels)), col(label))
    return F.when(at > 0, at - 1)


def contest_of_url(line) -> Column:
    """The number in ``contest/<number>``, null without."""
    return F.nullif(F.regexp_extract(col(line), r"contest/(\d+)", 1), F.lit("")).cast("long")


def html_escape(value) -> Column:
    out = col(value)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
