"""Mixing sources to target weights by subset-sum budget fitting.

Targets: the sources, ordered by name (code points, null last), get the weights in
turn and share a budget; a target stops at ``MAX_REPEAT`` times its source's size and
the excess is shared again by weight among the others, until none is above.

Fitting, per source: documents are counted by exact length. Whole repeats of the
source come first; of what remains, every length gives its proportional number of
documents, the fraction carried on from longer to shorter lengths, so the rest is
below one document's length at every size; a bounded-knapsack dynamic program over
the lengths fills that rest as exactly as the lengths allow. Only the histogram (a row per
source and length) goes through this step.

Selection: of each source and length, as many documents as fitted are taken, in
the order of a seeded hash. Their ranks come from counts per hash range, so a
length that very many documents have is spread over many tasks.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poicraft.llm.common import stored, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2
SEED = 11
#: Hash ranges of one source and length.
RANGES = 256

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _fill(weights: list[int], room: int, low: int = 0) -> list[int]:
    """Which of the weights to take so that they add up to ``room`` or as little below it as
    they can; partial sums, in this order, stay within ``-low`` and ``room``."""
    maker = np.full(room + low + 1, -1, np.int32)  # the step that first made each sum, from -low on
    maker[low] = 0
    for step, w in enumerate(weights, 1):
        if maker[-1] >= 0:
            break
        if abs(w) >= len(maker):
            continue
        old, to = (maker[:-w], maker[w:]) if w > 0 else (maker[-w:], maker[:w])
        to[(old >= 0) & (to < 0)] = step
    out, at = [], int(np.flatnonzero(maker >= 0)[-1])
    while maker[at] > 0:
        out.append(int(maker[at]) - 1)
        at -= weights[out[-1]]
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, share: float, capacity: int | None = None) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to ``budget``
    or as little below it as the dynamic program can reach.

    ``share`` is the budget's part of all documents; lengths are positive, distinct, ascending.
    Every length gets its part; the fraction is carried on to the next shorter length, so
    what is left is less than one document of the longest length, however large the source.
    Where added documents can't make it, documents up to ``capacity`` words (by default the
    longest length, so any one document can be exchanged) may be given back for others.
    """
    all_ = int((lengths * counts).sum())
    if not all_:
        return np.zeros(len(lengths), np.int64)
    budget = min(max(int(budget), 0), all_)
    upto = [int(c) * budget // all_ for c in np.cumsum(counts[::-1])]
    take = np.diff([0, *upto])[::-1].astype(np.int64)
    rest = budget - int((take * lengths).sum())
    # Lengths near half the rest come first, one document each: two of them mostly make the sum.
    near = sorted(range(len(lengths)), key=lambda j: (abs(2 * int(lengths[j]) - rest), j))

    def chosen(back, low=0):
        free = {j: min(int(counts[j] - take[j]), (rest + low) // int(lengths[j])) for j in near}
        items = back + [(j, 1) for j in near if free[j] > 0]
        for j in near:
            left, k = free[j] - 1, 1
            while left > 0:  # the bounded item as items of 1, 2, 4, ... documents
                k = min(k, left)
                items.append((j, k))
                left, k = left - k, 2 * k
        return [items[i] for i in _fill([k * int(lengths[j]) for j, k in items], rest, low)]

    more = chosen([])
    if sum(k * int(lengths[j]) for j, k in more) < rest:
        # Not reached: lengths that the carried fraction rounded up may give a document back.
        least = np.floor(counts * min(max(share, 0.0), 1.0)).astype(np.int64)
        back = [(j, -1) for j in near if take[j] > least[j]]
        more = chosen(back, min(sum(int(lengths[j]) for j, _ in back), int(lengths[-1]) if capacity is None else capacity))
    for j, k in more:
        take[j] += k
    return take


def _sized(docs: DataFrame, doc_id: str, text: str, source: str, columns: list[str], seed: int) -> DataFrame:
    """``skey, source, size, id, h, range`` and, with columns to keep, these as the struct ``row``."""
    own = F.col(f"`{text}`").cast("string")
    h = F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), text_of(text))
    name = F.col(f"`{source}`").cast("string")
    row = [F.struct(*[F.col(f"`{c}`").alias(c) for c in columns]).alias("row")] if columns else []
    return docs.select(
        *row, name.alias("source"), F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("skey"),
        size_of(own).alias("size"), F.col(f"`{doc_id}`").alias("id"), h.alias("h")).select(
        "*", F.pmod("h", F.lit(RANGES)).alias("range"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """``skey, source_size, target`` from ``skey, source, source_size`` (a row per source).

    A source is at its limit if the limit is below what the budget, less the
    limits of those before it, gives it by weight; sources stand in order of
    limit per weight, so one pass finds all of them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.select("skey", "source", "source_size", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).alias("w"))
    s = s.select("*", (F.col("source_size") * float(max_repeat)).alias("limit"))
    order = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.select("*", (F.sum("source_size").over(every) * share).alias("budget"),
                 F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("spent"), F.sum("w").over(after).alias("open"))
    s = s.select("*", (F.col("limit") <= (F.col("budget") - F.col("spent")) / F.col("open") * F.col("w")).alias("full"))
    free = F.col("budget") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(every)
    open_ = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(every)
    return s.select("skey", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(
        free * F.col("w") / open_).alias("target"))


def plan_mix(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """``skey, size, range, source_size, target, whole, quota`` for rows of ``_sized``.

    Every document of the range is taken ``whole`` times, and the first ``quota`` by hash once more.
    """
    counts = stored(rows.groupBy("skey", "source", "size", "range").agg(F.count("*").alias("n")), "mix-counts")
    sizes = counts.groupBy("skey", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = stored(targets(sizes, weights, share, max_repeat), "mix-targets")
    histogram = counts.filter("size > 0").groupBy("skey", "size").agg(F.sum("n").alias("n")).join(goal, "skey")

    def extra(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        whole, size = pdf["target"].iloc[0] // pdf["source_size"].iloc[0], int(pdf["source_size"].iloc[0])
        budget = int(round(pdf["target"].iloc[0] - whole * size))
        take = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), budget, budget / size)
        return pd.DataFrame({"skey": pdf["skey"], "size": pdf["size"], "whole": np.int64(whole), "extra": take})

    fitted = stored(histogram.groupBy("skey").applyInPandas(extra, "skey string, size bigint, whole bigint, extra bigint"), "mix-fit")
    before = Window.partitionBy("skey", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranged = counts.select("skey", "size", "range", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    quota = F.greatest(F.lit(0), F.least(F.col("n"), F.coalesce("extra", F.lit(0)) - F.col("before")))
    return stored(ranged.join(fitted, ["skey", "size"], "left").join(goal, "skey").select(
        "skey", "size", "range", "source_size", "target", F.coalesce("whole", F.lit(0)).alias("whole"), quota.alias("quota")), "mix-plan")


def mix(docs: DataFrame, columns: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights=WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """One row per input row: ``row`` (a struct of the given columns, all by default),
    ``size, source_size, target, copies``.

    ``copies`` (0 to ``max_repeat``) is how often the mix takes the document; a
    document without words adds none, and is taken as often as all of its source
    are. A null source is a source of its own, after the others. Repeated rows
    are taken one by one. The same table gives the same mix.
    """
    columns = docs.columns if columns is None else columns
    plan = plan_mix(stored(_sized(docs, doc_id, text, source, [], seed), "mix-rows"), weights, share, max_repeat)
    rows = _sized(docs, doc_id, text, source, columns, seed).drop("source")
    place = F.row_number().over(Window.partitionBy("skey", "size", "range").orderBy("h", "id"))
    return rows.join(plan, ["skey", "size", "range"]).select("*", place.alias("place")).select(
        "row", "size", "source_size", "target",
        (F.col("whole") + F.when(F.col("place") <= F.col("quota"), 1).otherwise(0)).alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    found = mix(docs, **options).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
