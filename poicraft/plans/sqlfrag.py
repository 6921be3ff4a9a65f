"""DuckDB SQL fragments mirroring the column functions, for the oracle queries."""

from __future__ import annotations

from poicraft.functions.palette import COLOR_ALPHABETS, OTHER, OTHER_COLOR
from poicraft.functions.text import FORBIDDEN_CHARS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def text(x: str) -> str:
    return f"coalesce(cast({x} as varchar), 'None')"


def clean(x: str) -> str:
    return f"translate({text(x)}, {lit(FORBIDDEN_CHARS)}, {lit(' ' * len(FORBIDDEN_CHARS))})"


def icontains(x: str, kw: str) -> str:
    return f"contains(lower({text(x)}), lower({lit(kw)}))"


def color(x: str) -> str:
    parts = []
    for i, alpha in enumerate(COLOR_ALPHABETS):
        digit = f"(strpos('0123456789abcdef', substr(md5(cast({x} as varchar)), {i + 1}, 1)) - 1)"
        parts.append(f"substr({lit(alpha)}, ({digit} % {len(alpha)}) + 1, 1)")
    return "'#' || " + " || ".join(parts)


def color_for_keys(x: str, keys) -> str:
    klist = ", ".join(lit(k) for k in keys)
    return (f"case when {x} in ({klist}) and {x} <> {lit(OTHER)} then {color(x)} "
            f"else {lit(OTHER_COLOR)} end")


NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def num(x: str) -> str:
    return f"case when regexp_matches({x}, {lit(NUMBER)}) then try_cast({x} as double) end"


def coords(lng: str, lat: str) -> str:
    return (f"case when {num(lng)} is not null and {num(lat)} is not null "
            f"then [{num(lng)}, {num(lat)}] else []::double[] end")


def haversine(lat0: float, lng0: float, lat: str, lng: str, r: float = 6371000.0) -> str:
    dphi = f"radians({lat} - {lat0!r}::double)"
    dl = f"radians({lng} - {lng0!r}::double)"
    a = (f"(sin({dphi} / 2) * sin({dphi} / 2) + cos(radians({lat0!r}::double)) * cos(radians({lat}))"
         f" * sin({dl} / 2) * sin({dl} / 2))")
    return f"({2.0 * r!r}::double * asin(sqrt({a})))"
