"""Deterministic category colours.

The original picked each hex digit at random from a per-position alphabet. Here
each position takes the alphabet character indexed by one hex digit of
``md5(category)``, so a category always gets the same colour on every run,
executor and engine.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from poicraft.functions._col import col

# Alphabets for the six hex digits of a category colour, in position
# order; the plain 16-digit alphabet; the remainder key and its colour.
COLOR_ALPHABETS = ("05E2F19", "04589ACF", "17AF3D0", "04589ACF", "40F0A3C", "04589ACF")
PLAIN_ALPHABET = "0123456789ABCDEF"
OTHER = "Other"
OTHER_COLOR = "#A4A4A4"


def _pick(digest: Column, position: int, alphabet: str) -> Column:
    digit = F.conv(F.substr(digest, F.lit(position), F.lit(1)), 16, 10).cast("int")
    index = F.pmod(digit, F.lit(len(alphabet))) + F.lit(1)
    return F.substr(F.lit(alphabet), index, F.lit(1))


def _color(c, alphabets: Sequence[str]) -> Column:
    digest = F.md5(col(c).cast("string").cast("binary"))
    return F.concat(F.lit("#"), *[_pick(digest, i + 1, a) for i, a in enumerate(alphabets)])


def category_color(c) -> Column:
    """Colour of a category from the fixed per-position alphabets."""
    return _color(c, COLOR_ALPHABETS)


def plain_color(c) -> Column:
    """Colour from the plain 16-digit alphabet (the unrestricted palette)."""
    return _color(c, [PLAIN_ALPHABET] * 6)


def color_for_keys(c, keys: Sequence[str] | None = None, in_keys: Column | None = None) -> Column:
    """The category's colour when it is a palette key, else the ``Other`` colour.

    Give either a literal key list (``keys``) or a boolean column ``in_keys``
    computed by a join against a key table. A null category and a category
    literally named ``Other`` get the ``Other`` colour.
    """
    c = col(c)
    member = c.isin(list(keys)) if in_keys is None else F.coalesce(in_keys, F.lit(False))
    return F.when(member & c.isNotNull() & (c != F.lit(OTHER)), category_color(c)) \
        .otherwise(F.lit(OTHER_COLOR))
