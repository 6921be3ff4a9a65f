"""Named queries over the benchmark tables, each with its DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE_SQL[name] -> str``.
Nested outputs are flattened or rendered as JSON text so both engines can be
compared value by value.
"""

from __future__ import annotations

from typing import Callable, Dict, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: Dict[str, QueryFn] = {}
ORACLE_SQL: Dict[str, str] = {}


def query(name: str, sql: Optional[str] = None):
    """Register a query (and its oracle SQL when SQL can express it)."""
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


def comparable(df: DataFrame) -> DataFrame:
    """Arrays/structs/maps → JSON text (only used where no double is nested)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
