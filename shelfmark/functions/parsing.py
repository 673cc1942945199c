"""Column expressions that turn messy text into typed values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.schema import FALSE_WORDS, MISSING_TOKENS, TRUE_WORDS

_NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

_BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: White space at the ends of a text, in a form that Spark and DuckDB both read.
BLANK_ENDS = f"^{_BLANK}|{_BLANK}$"


def missing_to_null(c: Column, tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    return F.when(~c.isin(list(tokens)), c)


def parse_number(c: Column) -> Column:
    """Text to double. The pattern guard is needed because casts also take ``19.99d``."""
    return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))


def parse_boolean(c: Column) -> Column:
    word = F.lower(c)
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def number_to_boolean(c: Column) -> Column:
    return c != 0


def strip(c: Column) -> Column:
    """Without white space at both ends: tabs, line breaks and no-break spaces, too."""
    return F.regexp_replace(c, BLANK_ENDS, "")


def parse_text(c: Column) -> Column:
    return strip(F.nullif(c, F.lit("")))


def is_blank(c: Column) -> Column:
    """True for NULL, empty and all-blank text."""
    return F.coalesce(strip(c) == "", F.lit(True))


def brand_key(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def text_key(*cols: Column) -> Column:
    """The lower-cased search text of a row; ``concat_ws`` leaves NULLs out."""
    return F.lower(F.concat_ws(" ", *cols))
