"""Text normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from poicraft.functions._col import col

# Parity default: the original application turns a missing value into the text
# 'None' before any string test or cleaning. Pass null_text=None for SQL nulls.
NULL_TEXT = "None"

# Characters the context broker rejects; each becomes one space.
FORBIDDEN_CHARS = "();='><"


def as_text(c, null_text: str | None = NULL_TEXT) -> Column:
    """Column as string; a null becomes ``null_text`` (unless that is None)."""
    s = col(c).cast("string")
    return s if null_text is None else F.coalesce(s, F.lit(null_text))


def clean_chars(c, null_text: str | None = NULL_TEXT) -> Column:
    """Each forbidden character replaced by one space; null → ``null_text``."""
    return F.translate(as_text(c, null_text), FORBIDDEN_CHARS, " " * len(FORBIDDEN_CHARS))


def clean_chars_array(c, null_text: str | None = NULL_TEXT) -> Column:
    """X1 applied to each element; a null array stays null."""
    return F.transform(col(c), lambda x: clean_chars(x, null_text))


def icontains(c, keyword: str, null_text: str | None = NULL_TEXT) -> Column:
    """Case-folded substring test, ``keyword.lower() in str(c).lower()``.

    Both sides are lower-cased by Spark, so the literal folds at plan time.
    """
    return F.lower(as_text(c, null_text)).contains(F.lower(F.lit(keyword)))
