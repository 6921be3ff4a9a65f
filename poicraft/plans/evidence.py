"""Plans of a query as they run: its result's and those of every frame it writes on the way."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from unittest.mock import patch

from pyspark.sql import DataFrame
from pyspark.sql.readwriter import DataFrameWriter


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@contextmanager
def written_plans() -> Iterator[list[str]]:
    """Collects the physical plan of each frame that is written while the block runs."""
    plans: list[str] = []

    def recording(method):
        def write(self, *args, **kwargs):
            plans.append(physical_plan(self._df))
            return method(self, *args, **kwargs)
        return write

    names = ("parquet", "json", "csv", "text", "save", "saveAsTable")
    with patch.multiple(DataFrameWriter, **{n: recording(getattr(DataFrameWriter, n)) for n in names}):
        yield plans
