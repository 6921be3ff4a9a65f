"""Row predicates F1–F3 as native boolean expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from poicraft.functions._col import col
from poicraft.functions.text import NULL_TEXT, as_text, icontains


# Up to so many tests are joined one by one; a longer list becomes one array literal, which
# keeps the plan flat. Lists of thousands belong in a table (``operators.keywords``).
FLAT_FROM = 64


def first_line(text) -> Column:
    """First line of a text without splitting the rest of it."""
    return F.substring_index(col(text), "\n", 1)


def address_keyword_pred(address, postal, keywords: Iterable[str],
                         null_text: str | None = NULL_TEXT, line=None) -> Column:
    """F1 on the first address line.

    A row is rejected when the postal code text occurs in its first address line
    (the line holds no street), otherwise every keyword must be a case-folded
    substring of that line. An empty keyword is always true; an empty postal
    code is contained in every line, so it rejects. A null or empty address list
    drops the row; a null first line reads as ``null_text``. Pass ``line`` (e.g. :func:`first_line` of a text) instead of an
    address array to avoid building the array.
    """
    if line is None:
        arr = col(address)
        present = F.coalesce(F.size(arr) > 0, F.lit(False))
        first = F.get(arr, F.lit(0))
    else:
        first = col(line)
        present = first.isNotNull()
    line = as_text(first, null_text)
    cond = present & ~line.contains(as_text(postal, null_text))
    keywords = list(keywords)
    if len(keywords) > FLAT_FROM:
        return cond & _folded(line, null_text, lambda said: F.forall(_words(keywords), lambda k: said.contains(k)))
    return reduce(and_, [icontains(line, k, null_text) for k in keywords], cond)


def _words(keywords: Sequence[str]) -> Column:
    return F.array(*[F.lower(F.lit(k)) for k in keywords])


def _folded(text, null_text: str | None, test) -> Column:
    """``test`` of the case-folded text, which is evaluated once for all keywords."""
    return F.transform(F.array(F.lower(as_text(text, null_text))), test)[0]


def street_entity_pred(street, entity, keywords: Sequence[str], entity_mode: str = "always",
                       null_text: str | None = NULL_TEXT) -> Column:
    """the list's last item is the federal entity, the others street keywords.

    All non-blank street keywords must occur in ``street`` (case-folded). The
    entity must occur in ``entity`` unless it is blank. With
    ``entity_mode='reference'`` the entity is tested only when at least one
    non-blank street keyword exists, as the original loop did.
    """
    if entity_mode not in ("always", "reference"):
        raise ValueError(f"entity_mode must be 'always' or 'reference', got {entity_mode!r}")
    keywords = list(keywords)
    if not keywords:
        return F.lit(True)
    *street_kws, ent = keywords
    terms = [icontains(street, k, null_text) for k in street_kws if k != ""]
    cond = reduce(and_, terms, F.lit(True))
    if ent != "" and (entity_mode == "always" or terms):
        cond = cond & icontains(entity, ent, null_text)
    return cond


def any_keyword_pred(columns: Sequence, keywords: Iterable[str],
                     null_text: str | None = NULL_TEXT) -> Column:
    """true when any keyword occurs (case-folded) in any of the columns.

    Non-string columns are compared through their string form; an empty keyword
    list selects nothing.
    """
    columns, keywords = list(columns), list(keywords)
    if len(columns) * len(keywords) > FLAT_FROM:
        tests = [_folded(c, null_text, lambda said: F.exists(_words(keywords), lambda k: said.contains(k))) for c in columns]
        return reduce(or_, tests)
    terms = [icontains(c, k, null_text) for k in keywords for c in columns]
    return reduce(or_, terms, F.lit(False))
