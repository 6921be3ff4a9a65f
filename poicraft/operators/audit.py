"""A9 stage counts in one pass, A10/A11 column profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class StageAudit:
    """Row counts at named stages of one plan, collected by a single action.

    ``df = audit.mark(df, "after dedup")`` attaches an observation; after the
    pipeline's one action (its sink), :meth:`table` returns ``(seq, stage, n)``.
    Replaces a ``count()`` per stage, each of which re-ran the whole lineage.
    """

    def __init__(self) -> None:
        self._marks: list[tuple[str, Observation]] = []

    def mark(self, df: DataFrame, stage: str) -> DataFrame:
        obs = Observation(f"stage_{len(self._marks)}")
        self._marks.append((stage, obs))
        return df.observe(obs, F.count(F.lit(1)).alias("n"))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, stage, int(obs.get["n"])) for i, (stage, obs) in enumerate(self._marks)]
        return spark.createDataFrame(rows, "seq bigint, stage string, n bigint")


def column_profile(df: DataFrame) -> DataFrame:
    """A10 + A11: total rows, column count and non-null count per column, one row."""
    aggs = [F.count(F.lit(1)).alias("n_rows")] + [F.count(F.col(c)).alias(f"nn_{c}") for c in df.columns]
    return df.agg(*aggs).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))
