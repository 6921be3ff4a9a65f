"""Cells of a space-filling curve: the order in which a clustered venue store is kept.

Latitude and longitude are cut into ``2 ** BITS`` steps each, and the bits of the two step
numbers are interleaved (Morton order), so venues that are near each other mostly have
near cell numbers. A store sorted by it (``sinks.write_clustered``) has row groups that
each cover a small area, and a search names the few cell ranges it can touch.
"""

from __future__ import annotations

import heapq
from functools import reduce
from operator import or_
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL = "_cell"
BITS = 20
# Cell ranges of one search: more of them fit the box closer, and make a longer filter.
RANGES = 32
# Shifts and masks that spread the bits of a number to every other place.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(step):
    """Works on a column and on a number alike."""
    for shift, mask in SPREAD:
        if isinstance(step, Column):
            step = step.bitwiseOR(F.shiftleft(step, shift)).bitwiseAND(F.lit(mask))
        else:
            step = (step | step << shift) & mask
    return step


def _step(value: float, low: float, width: float) -> int:
    """Number of the step a coordinate falls into; beyond the ends it is the first or last."""
    value = min(max(value, low), low + width)
    return min(int((value - low) / width * (1 << BITS)), (1 << BITS) - 1)


def _step_column(value: Column, low: float, width: float) -> Column:
    inside = F.least(F.greatest(value.cast("double"), F.lit(low)), F.lit(low + width))
    step = F.floor((inside - F.lit(low)) / F.lit(width) * F.lit(float(1 << BITS))).cast("bigint")
    # greatest and least skip nulls, so a missing coordinate is told apart here
    return F.when(value.isNotNull(), F.least(step, F.lit((1 << BITS) - 1).cast("bigint")))


def cell(lat: str = "lat", lng: str = "lng") -> Column:
    """Cell number of a point (null without both coordinates)."""
    y, x = _step_column(F.col(lat), -90.0, 180.0), _step_column(F.col(lng), -180.0, 360.0)
    return F.shiftleft(_spread(y), 1).bitwiseOR(_spread(x))


def cell_ranges(boxes: Sequence, most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` closed ranges of cells that cover the boxes.

    Squares that a box cuts are quartered, the largest first, as long as the ranges fit.
    """
    spans = [(_step(sw[0], -90.0, 180.0), _step(ne[0], -90.0, 180.0), _step(sw[1], -180.0, 360.0), _step(ne[1], -180.0, 360.0))
             for sw, ne in boxes if sw[0] <= ne[0] and sw[1] <= ne[1]]

    def touch(side, y, x):
        """0: outside all boxes, 1: cut by one, 2: inside one."""
        y0, x0, y1, x1 = y * side, x * side, (y + 1) * side - 1, (x + 1) * side - 1
        hits = [(a, b, c, d) for a, b, c, d in spans if a <= y1 and y0 <= b and c <= x1 and x0 <= d]
        return 0 if not hits else 1 + any(a <= y0 and y1 <= b and c <= x0 and x1 <= d for a, b, c, d in hits)

    whole, cut = [], [(-(1 << BITS), 0, 0)] if spans else []
    while cut:
        side, y, x = cut[0]
        half = -side // 2
        parts = [(half, 2 * y + i, 2 * x + j) for i in (0, 1) for j in (0, 1) if half]
        kinds = [(p, touch(*p)) for p in parts]
        if not half or len(whole) + len(cut) - 1 + sum(k > 0 for _, k in kinds) > most:
            break
        heapq.heappop(cut)
        for (s, v, u), kind in kinds:
            if kind == 2:
                whole.append((-s, v, u))
            elif kind == 1:
                heapq.heappush(cut, (-s, v, u))
    out: list[tuple[int, int]] = []
    for low, high in sorted(((first := _spread(y) << 1 | _spread(x)) * side * side, (first + 1) * side * side - 1) for side, y, x in
                            ((-s, y, x) for s, y, x in whole + cut)):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def in_cells(boxes: Sequence, column: str = CELL, most: int = RANGES) -> Column:
    """Range predicates on the cell column, which a parquet scan takes over: true for every
    point of the boxes, and for some points near them."""
    ranges = [(F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high)) for low, high in cell_ranges(boxes, most)]
    return reduce(or_, ranges, F.lit(False)) if not ranges else reduce(or_, ranges)
