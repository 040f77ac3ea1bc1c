"""Expressions on text lines: tokens, names, features, weights."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from meander.params import SEPARATOR


def trimmed(line: Column) -> Column:
    """The line without leading and trailing whitespace of any kind (``trim`` drops spaces only)."""
    line = F.col(line) if isinstance(line, str) else line
    # Most lines have none and are let through by their first and last characters.
    some = (F.substring(line, 1, 1).rlike(r"\s")) | _may_end(line, r"\s")
    return F.when(some, F.regexp_replace(line, r"^\s+|\s+$", "")).otherwise(line)


def _may_end(value: Column, pattern: str) -> Column:
    """Whether the pattern of one character may match before ``$``, which also stands before a line's last terminator."""
    return F.substring(value, -1, 1).rlike(f"{pattern}|[\n\r\u0085\u2028\u2029]")


def tokens(line: Column) -> Column:
    """The whitespace-separated tokens; a blank line gives one empty token."""
    return words(trimmed(line))


def words(line: Column) -> Column:
    """The tokens of a trimmed line."""
    # A pattern is compiled anew for every line that it splits; lines with single blanks don't need it.
    return F.when(line.rlike(r"[^\S ]|  "), F.split(line, r"\s+")).otherwise(F.split(line, " "))


def first_token(line: Column) -> Column:
    return F.regexp_extract(trimmed(line), r"^(\S*)", 1)


def last_token(line: Column) -> Column:
    return F.regexp_extract(trimmed(line), r"(\S*)$", 1)


def nth_token(line: Column, n: int) -> Column:
    """Token number ``n`` from 1; an empty string where there are fewer."""
    return F.regexp_extract(trimmed(line), r"^(?:\S+\s+){%d}(\S+)" % (n - 1), 1)


def has_two_tokens(line: Column) -> Column:
    return F.coalesce(line.rlike(r"\S\s+\S"), F.lit(False))


def is_blank(value: Column) -> Column:
    """True for null, empty and whitespace-only values."""
    return F.coalesce(F.length(F.regexp_replace(value, r"\s", "")), F.lit(0)) == 0


def _without_trailing(token: Column, sep: str) -> Column:
    end = f"(?:{re.escape(sep)})+$"
    return F.when(_may_end(token, re.escape(sep[-1])), F.regexp_replace(token, end, "")).otherwise(token)


def name_of(token: Column, sep: str = SEPARATOR) -> Column:
    """The part of a padded token before the first separator."""
    return F.substring_index(token, sep, 1)


def feature_of(token: Column, sep: str = SEPARATOR) -> Column:
    """The last non-empty part of a padded token; without a separator, the name."""
    return after_last(_without_trailing(token, sep), sep)


def after_last(value: Column, sep: str) -> Column:
    """What follows the last separator, or the whole value without one."""
    if len(sep) == 1:
        return F.substring_index(value, sep, -1)
    return F.split_part(value, F.lit(sep), F.lit(-1))  # a longer one may overlap itself


def number_or(value: Column, default: float) -> Column:
    """The text as a double, or the default where it isn't a number."""
    return F.coalesce(value.try_cast("double"), F.lit(float(default)))


def padded_token(name: Column, feat: Column, sep: str = SEPARATOR) -> Column:
    return F.concat_ws(sep, name, feat)


def joined(array: Column, delimiter: str) -> Column:
    """The elements of an array of any simple type as one delimited string."""
    return F.array_join(array.cast("array<string>"), delimiter)
