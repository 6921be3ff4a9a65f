"""Distinct by key with a deterministic survivor."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def dedupe_by_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """Keep one row per key: the smallest by ``order_by``, then by the other columns.

    A minimum of structs per key, so Spark aggregates partially on the map side:
    a hot key is reduced to one row per input partition before the shuffle and
    never gathered whole into one task. All null keys form one group. Select the
    columns an output needs before this: the whole row goes through the shuffle.
    With ``order_by``, the survivor's values in those columns do not depend on
    which other columns are kept. Map columns have no order and don't decide.
    """
    keys, order_by = list(keys), list(order_by)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    first = [F.col(f"`{c}`").alias(f"_ord{i}") for i, c in enumerate(order_by)]
    values = [F.col(f"`{c}`") for c in rest]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if all(orderable(kinds[c]) for c in rest):
        keep = F.min(F.struct(*first, *values))
    else:
        ranked = [F.col(f"`{c}`") for c in rest if orderable(kinds[c])]
        keep = F.min_by(F.struct(*values), F.struct(*first, *ranked, F.lit(0).alias("_end")))
    winners = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(keep.alias("_keep"))
    return winners.select(*[F.col(f"`{k}`") if k in keys else F.col(f"_keep.`{k}`").alias(k) for k in df.columns])
